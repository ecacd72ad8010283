"""Trailing windows: what is known of a trajectory over the past ``width`` of time at each of its own times."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Length of a chunk of a series in window widths, and points of the windows that a kernel gets at once.
CHUNK_WIDTHS, POINTS_AT_ONCE = 4, 1 << 18


def frame(keys: list[str], width: float, time: str = "time") -> str:
    """The window's SQL: all rows of the key within ``width`` before, rows of the same time included."""
    return f"(PARTITION BY {', '.join(keys)} ORDER BY {time} RANGE BETWEEN {float(width)}D PRECEDING AND CURRENT ROW)"


def anchors(rows: DataFrame, keys: list[str], time: str = "time") -> DataFrame:
    """The distinct times of each key."""
    return rows.select(*keys, time).distinct()


def trailing_statistics(rows: DataFrame, keys: list[str], width: float, min_points: int = 1, time: str = "time", value: str = "value") -> DataFrame:
    """keys, time and n, mean, sd (population, 1 if 0), tmin, tmax, slope: one row for each distinct time with enough rows."""
    w = frame(keys, width, time)
    known = rows.where(F.col(value).isNotNull())
    made = known.selectExpr(
        *keys, time, f"count(*) OVER {w} AS n", f"avg({value}) OVER {w} AS mean", f"coalesce(nullif(stddev_pop({value}) OVER {w}, 0.0D), 1.0D) AS sd",
        f"min({time}) OVER {w} AS tmin", f"max({time}) OVER {w} AS tmax", f"regr_slope({value}, {time}) OVER {w} AS slope",
    )
    return made.where(F.col("n") >= min_points).dropDuplicates([*keys, time])


def trailing_rows(rows: DataFrame, keys: list[str], width: float, min_points: int = 1, time: str = "time", value: str = "value") -> DataFrame:
    """keys, time, n, window: the window's (time, value) rows as a sorted array, one row for each distinct time."""
    w = frame(keys, width, time)
    made = rows.where(F.col(value).isNotNull()).selectExpr(*keys, time, f"count(*) OVER {w} AS n", f"collect_list(struct({time} AS t, {value} AS v)) OVER {w} AS window")
    return made.where(F.col("n") >= min_points).dropDuplicates([*keys, time]).withColumn("window", F.array_sort("window"))


def series_chunks(rows: DataFrame, keys: list[str], width: float, time: str = "time", value: str = "value") -> DataFrame:
    """keys, chunk_, t, v: each key's series in chunks of ``CHUNK_WIDTHS`` widths, with what lies up to ``width`` before a chunk, sorted.

    A point is in two chunks at most, so what goes to Python grows with the points, not with points times window.
    """
    length = CHUNK_WIDTHS * width
    place = lambda t: F.floor(t / F.lit(length))
    known = rows.where(F.col(value).isNotNull() & F.col(time).isNotNull()).select(*keys, F.col(time).cast("double").alias("t_"), F.col(value).cast("double").alias("v_"))
    # a little further than the width, so that rounding leaves no point out; the kernel compares times itself
    listed = known.select("*", F.explode(F.sequence(place(F.col("t_")), place(F.col("t_") + F.lit(width * (1 + 1e-9) + 1e-9)))).alias("chunk_"))
    # as many partitions as a shuffle has: few bytes of points are much work, which adaptive coalescing would put into one task
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = listed.repartition(max(parts, 2 * rows.sparkSession.sparkContext.defaultParallelism), *keys, "chunk_").groupBy(*keys, "chunk_").agg(F.array_sort(F.collect_list(F.struct("t_", "v_"))).alias("p_"))
    return made.select(*keys, "chunk_", F.col("p_.t_").alias("t"), F.col("p_.v_").alias("v"))


def sliding_windows(batches: Iterator[pa.RecordBatch], keys: list[str], width: float, min_points: int) -> Iterator[pa.RecordBatch]:
    """keys, time, t, v: in a task, the trailing windows of ``series_chunks`` as arrays, one for each distinct time with enough points."""
    length = CHUNK_WIDTHS * width
    for batch in batches:
        chunk = batch.column("chunk_").to_numpy()
        size = batch.column("t").value_lengths().to_numpy(zero_copy_only=False)
        first = np.concatenate([[0], np.cumsum(size)])
        t, v = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("t", "v"))
        rows, times, low, high = [], [], [], []
        for i in range(batch.num_rows):
            own = t[first[i] : first[i + 1]]
            at = np.unique(own)
            at = at[np.floor(at / length) == chunk[i]]
            lo, hi = np.searchsorted(own, at - width), np.searchsorted(own, at, "right")
            on = hi - lo >= min_points
            rows.append(np.full(on.sum(), i))
            times.append(at[on])
            low.append(first[i] + lo[on])
            high.append(first[i] + hi[on])
        rows, times, low, high = (np.concatenate(a) if a else np.zeros(0, int) for a in (rows, times, low, high))
        lengths = high - low
        part = np.cumsum(lengths) // POINTS_AT_ONCE
        for k in np.unique(part):
            on = part == k
            n = lengths[on]
            ends = np.concatenate([[0], np.cumsum(n)])
            at = np.arange(ends[-1]) + np.repeat(low[on] - ends[:-1], n)
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(a[at])) for a in (t, v)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(rows[on])) for c in keys), pa.array(times[on]), *lists], [*keys, "time", "t", "v"])


def latest(rows: DataFrame, keys: list[str], time: str = "time") -> DataFrame:
    """The last row of each key; of equal times the greatest row."""
    rest = [c for c in rows.columns if c not in keys and c != time]
    best = rows.groupBy(*keys).agg(F.max(F.struct(time, *rest)).alias("best_"))
    return best.select(*keys, *[F.col(f"best_.{c}").alias(c) for c in (time, *rest)])
