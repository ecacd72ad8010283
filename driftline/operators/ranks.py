"""Exact orders over whole tables without a sort in one task: ranges of values, running sums over them, medians."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, staged

#: Rows that one window may hold, and ranges that more rows are cut into.
FEW, RANGES = 100_000, 512
#: Buckets of a median's histogram.
BUCKETS = 1024


def in_ranges(df: DataFrame, column: str, name: str = "range_", few: int = FEW, ranges: int = RANGES) -> DataFrame:
    """``df``, a stored table, with the number of the range of values that ``column`` lies in; one range for few rows.

    The ranges' bounds are approximate quantiles, at most ``ranges`` numbers; rows of a value are in one range.
    """
    if df.count() <= few:
        return df.withColumn(name, F.lit(0))
    cuts = sorted(set(df.approxQuantile(column, [i / ranges for i in range(1, ranges)], 0.1 / ranges)))
    made = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol=column, outputCol=name, handleInvalid="keep")
    return made.transform(df).withColumn(name, F.col(name).cast("int"))


def running_sum(df: DataFrame, column: str, value: str, name: str, keys: tuple[str, ...] = (), descending: bool = False, few: int = FEW, ranges: int = RANGES) -> DataFrame:
    """``df``, a stored table, with the sum of ``value`` over the key's rows whose ``column`` is less (greater if ``descending``).

    A window holds the rows of one range; the sums of whole ranges before it are added, from a row for each key and range.
    """
    ranged = in_ranges(df, column, few=few, ranges=ranges)
    way = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    whole = ranged.groupBy(*keys, "range_").agg(F.sum(value).alias("sum_"))
    ahead = Window.partitionBy(*keys).orderBy(way("range_")).rowsBetween(Window.unboundedPreceding, -1)
    before = whole.select(*[F.col(k).alias(f"{k}_of_") for k in keys], F.col("range_").alias("range_of_"), F.coalesce(F.sum("sum_").over(ahead), F.lit(0)).alias("before_"))
    on = F.col("range_") == F.col("range_of_")
    for k in keys:
        on = on & (F.col(k) == F.col(f"{k}_of_"))
    by = Window.partitionBy(*keys, "range_").orderBy(way(column)).rangeBetween(Window.unboundedPreceding, 0)
    same = Window.partitionBy(*keys, "range_", column)
    inside = F.sum(value).over(by) - F.sum(value).over(same)
    made = ranged.withColumn("inside_", inside).join(before, on)
    return made.withColumn(name, F.col("inside_") + F.col("before_")).select(*df.columns, name)


def medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Exact medians of number columns, null and NaN left out; None where nothing is left. Infinite values count; between both infinities
    the middle is NaN.

    Values are counted once by value. Then histograms of the two middle values' ranges are refined until a bucket holds one value;
    the driver sees ``BUCKETS`` counts for each.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns])).alias("cell")
    counts = staged(df.select(cells).select("cell.*").where("v is not null and not isnan(v)").groupBy("name", "v").agg(F.count("*").alias("n")), "value-counts")
    found: dict[tuple[str, int], float] = {}
    open_: dict[tuple[str, int], tuple[float, float, int]] = {}
    infinite = F.col("v") == float("inf")
    finite = F.when(F.abs("v") < float("inf"), F.col("v"))
    sums = [F.sum("n").alias("n"), F.sum(F.when(F.col("v") == float("-inf"), F.col("n")).otherwise(0)).alias("under"), F.sum(F.when(infinite, F.col("n")).otherwise(0)).alias("over")]
    totals = {r["name"]: r for r in counts.groupBy("name").agg(*sums, F.min(finite).alias("lo"), F.max(finite).alias("hi")).collect()}
    for c, r in totals.items():
        for rank in {(r["n"] - 1) // 2, r["n"] // 2}:
            if rank < r["under"] or rank >= r["n"] - r["over"]:  # infinities are end cells, no range to part
                found[c, rank] = float("-inf") if rank < r["under"] else float("inf")
            else:
                open_[c, rank] = (r["lo"], r["hi"], r["under"])
    while open_:
        asked = counts.sparkSession.createDataFrame([(c, k, lo, hi) for (c, k), (lo, hi, _) in open_.items()], "of_ string, rank_ long, lo_ double, hi_ double")
        inside = counts.join(F.broadcast(asked), (F.col("name") == F.col("of_")) & F.col("v").between(F.col("lo_"), F.col("hi_")))
        place = F.least(F.floor((F.col("v") / 2 - F.col("lo_") / 2) / (F.col("hi_") / 2 - F.col("lo_") / 2) * BUCKETS), F.lit(BUCKETS - 1))  # halves: no overflow
        rows = inside.groupBy("name", "rank_", F.when(F.col("hi_") > F.col("lo_"), place).otherwise(0).alias("bucket_")).agg(F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        for key, (_, _, below) in list(open_.items()):
            for r in sorted((r for r in rows if (r["name"], r["rank_"]) == key), key=lambda r: r["lo"]):
                if below + r["n"] > key[1]:
                    break
                below += r["n"]
            if r["lo"] == r["hi"]:
                found[key] = r["lo"]
                del open_[key]
            else:
                open_[key] = (r["lo"], r["hi"], below)
    discard(counts)
    return {c: 0.5 * found[c, (totals[c]["n"] - 1) // 2] + 0.5 * found[c, totals[c]["n"] // 2] if c in totals else None for c in columns}
