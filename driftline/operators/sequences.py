"""Per-patient sequence samples, padding into batches, and a recurrent encoder run over them.

Everything about one patient sits in one row as arrays; no join is made by position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, types as T
from pyspark.sql import functions as F

from ..functions.trajectory import dealt, gather, padded
from ..session import by_key
from .binning import bin_grid, event_targets, treated_at, treatment_start


def union_timeline(dynamic: DataFrame, features: list[str]) -> DataFrame:
    """pid, time: the distinct times at which any of the features was measured."""
    return dynamic.where(F.col("feature_name").isin(features)).select("pid", "time").distinct()


def feature_values(asked: DataFrame, dynamic: DataFrame, features: list[str], order: str, before_first: str = "zero") -> DataFrame:
    """pid, ``order``, time and for feature j: x_j, m_j (seen by then), dt_j (time since, 1e-6 at least, null if unseen).

    One union and one shuffle by patient for all features: the window carries each feature's latest row. Of rows of a feature at one time
    the greatest value counts.
    """
    event = F.struct(F.col("time").alias("t"), F.col("value").alias("v"))
    left = asked.select("pid", F.col("time").alias("at_"), F.lit(1).alias("side_"), F.col(order).alias("order_"), *[F.lit(None).cast("struct<t:double,v:double>").alias(f"e_{j}") for j in range(len(features))])
    right = dynamic.where(F.col("feature_name").isin(features)).select(
        "pid", F.col("time").alias("at_"), F.lit(0).alias("side_"), F.lit(None).cast(asked.schema[order].dataType).alias("order_"), *[F.when(F.col("feature_name") == f, event).alias(f"e_{j}") for j, f in enumerate(features)]
    )
    value = F.coalesce(*[F.col(f"e_{j}.v") for j in range(len(features))])
    rows = left.unionByName(right).withColumn("v_", value)
    sorted_ = Window.partitionBy("pid").orderBy("at_", "side_", "v_")
    upto, whole = sorted_.rowsBetween(Window.unboundedPreceding, 0), sorted_.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    hits = {f"h_{j}": F.last(f"e_{j}", ignorenulls=True).over(upto) for j in range(len(features))}
    if before_first == "first":
        hits = {h: F.coalesce(c, F.first(f"e_{h[2:]}", ignorenulls=True).over(whole)) for h, c in hits.items()}
    out = []
    for j in range(len(features)):
        t = F.col(f"h_{j}.t")
        seen = t.isNotNull() & (t <= F.col("at_"))
        out += [F.coalesce(F.col(f"h_{j}.v"), F.lit(0.0)).alias(f"x_{j}"), seen.cast("double").alias(f"m_{j}"), F.when(seen, F.greatest(F.lit(1e-6), F.col("at_") - t)).alias(f"dt_{j}")]
    return rows.withColumns(hits).where("side_ = 1").select("pid", F.col("order_").alias(order), F.col("at_").alias("time"), *out)


def time_gap(n: int, mode: str = "last_feature") -> Column:
    """The step's gap: that of the last listed feature that was seen, or the least; 1 if none was."""
    gaps = [F.col(f"dt_{j}") for j in range(n)]
    found = F.coalesce(*reversed(gaps)) if mode == "last_feature" else F.array_min(F.array(*gaps))
    return F.coalesce(found, F.lit(1.0))


def nested(rows: DataFrame, order: str, columns: dict[str, Column]) -> DataFrame:
    """One row per patient: each column as an array in the rows' order."""
    made = rows.groupBy("pid").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o_"), *[c.alias(n) for n, c in columns.items()]))).alias("rows_"))
    return made.select("pid", *[F.col(f"rows_.{n}").alias(n) for n in columns])


def sequence_samples(dynamic: DataFrame, static: DataFrame, embed: list[str], aggregate: list[str], width: float = 1.0, dt_mode: str = "last_feature") -> DataFrame:
    """The per-patient sample: raw_time, X_raw, M_raw, DT_raw; agg_time, STD_agg, y_event, at_risk, idx_map; Z.

    Raw steps are the times of the embedded features. STD carries the last value at each bin start, before that the
    first. idx_map is the place of the last raw time at or before the bin's start, -1 before the first.
    """
    steps = union_timeline(dynamic, embed).withColumn("step", F.col("time"))
    values = feature_values(steps, dynamic, embed, "step")
    p, q = range(len(embed)), range(len(aggregate))
    raw = nested(values, "step", {"raw_time": F.col("time"), "X_raw": F.array(*[f"x_{j}" for j in p]), "M_raw": F.array(*[f"m_{j}" for j in p]), "DT_raw": F.array(time_gap(len(embed), dt_mode))})
    grid = bin_grid(static, dynamic, width)
    targets = event_targets(grid.join(by_key(treatment_start(dynamic)), "pid", "left").withColumn("treatment", treated_at(F.col("start"), F.col("t_start"))))
    std = feature_values(grid.select("pid", "bin_idx", F.col("start").alias("time")), dynamic, aggregate, "bin_idx", "first").drop("time")
    bins = nested(targets.join(by_key(std), ["pid", "bin_idx"]), "bin_idx", {"agg_time": F.col("start"), "STD_agg": F.array(*[f"x_{j}" for j in q]), "y_event": F.col("y_event"), "at_risk": F.col("at_risk")})
    made = bins.join(by_key(raw), "pid", "left").join(by_key(static), "pid")
    for c, kind in (("raw_time", "array<double>"), ("X_raw", "array<array<double>>"), ("M_raw", "array<array<double>>"), ("DT_raw", "array<array<double>>")):
        made = made.withColumn(c, F.coalesce(c, F.array().cast(kind)))
    index = F.transform("agg_time", lambda t: F.size(F.filter("raw_time", lambda x: x <= t)) - 1)
    z = F.array(*[F.col(c).cast("double") for c in ("age", "sex", "cci")])
    return made.select("pid", "raw_time", "agg_time", "X_raw", "M_raw", "DT_raw", "STD_agg", z.alias("Z"), "y_event", "at_risk", index.alias("idx_map"))


def sequences_on_bins(dynamic: DataFrame, grid: DataFrame, features: list[str], dt_mode: str = "last_feature") -> DataFrame:
    """pid, bin_idx and X, M, DT evaluated at the bin starts."""
    values = feature_values(grid.select("pid", "bin_idx", F.col("start").alias("time")), dynamic, features, "bin_idx")
    p = range(len(features))
    return values.select("pid", "bin_idx", F.array(*[f"x_{j}" for j in p]).alias("X"), F.array(*[f"m_{j}" for j in p]).alias("M"), time_gap(len(features), dt_mode).alias("DT"))


def pad_batches(samples: DataFrame, batch_size: int, arrays: dict[str, str]) -> DataFrame:
    """batch_id and the arrays filled up to the longest of their batch: 0, [0..] for nested ones, -1 for ``index``.

    ``arrays`` maps a column to ``flat``, ``nested`` or ``index``. Batches are dealt by a hash of the patient, about
    ``batch_size`` to a batch.
    """
    n = max(1, -(-samples.count() // batch_size))
    rows = samples.withColumn("batch_id", dealt("pid", n))
    for c, kind in arrays.items():
        longest = F.max(F.size(c)).over(Window.partitionBy("batch_id"))
        width = F.max(F.coalesce(F.size(F.get(c, F.lit(0))), F.lit(0))).over(Window.partitionBy("batch_id")) if kind == "nested" else None
        fill = F.array_repeat(F.lit(0.0), F.col("width_")) if kind == "nested" else F.lit(-1) if kind == "index" else F.lit(0.0)
        rows = rows.withColumn("longest_", longest)
        rows = rows.withColumn("width_", width) if width is not None else rows
        rows = rows.withColumn(c, padded(F.col(c), F.col("longest_"), fill)).drop("longest_", "width_")
    return rows


def embedding_rows(rows: DataFrame, vectors: str, width: int, key: str = "pid", prefix: str = "h", first: int = 1) -> DataFrame:
    """key, t_idx, <prefix>1..: one row for each step of an array of vectors."""
    steps = rows.select(key, F.posexplode(vectors).alias("t_idx", "h_"))
    return steps.select(key, "t_idx", *[F.get("h_", F.lit(i)).alias(f"{prefix}{i + first}") for i in range(width)])


def gather_steps(samples: DataFrame, vectors: str, index: str, width: int, name: str = "H_agg") -> DataFrame:
    """The vector of each bin's raw step; zeros before the first."""
    return samples.withColumn(name, F.transform(index, lambda i: gather(F.col(vectors), i, width)))


def encoder_weights(inputs: int, hidden: int, seed: int = 0, light: bool = False) -> dict[str, np.ndarray]:
    """Weights of the right shapes, for tests and as a template for trained ones. Those of the light recurrence have no ``W_h`` and ``b_h``."""
    rng = np.random.default_rng(seed)
    u = lambda *shape: rng.uniform(-1, 1, shape) / np.sqrt(hidden)
    decay = {} if light else {"W_h": u(hidden, inputs), "b_h": u(hidden)}
    return {**decay, "W_ih": u(3 * hidden, 2 * inputs + light), "W_hh": u(3 * hidden, hidden), "b_ih": u(3 * hidden), "b_hh": u(3 * hidden)}


def hidden_size(weights: dict[str, np.ndarray]) -> int:
    return weights["W_hh"].shape[1]


#: Numbers that padded patients take at once.
PADDED = 1 << 20


def encode_steps(x: np.ndarray, m: np.ndarray, dt: np.ndarray, lengths: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """States after each step of many sequences, which lie end to end in ``x``, ``m`` and ``dt``; a step of all sequences at once.

    With ``W_h`` a state decays by the gap towards an image of the seen values, and gates (r, z, n) run on [seen values, m]; without
    it, in the light recurrence, gates run on [x, m, gap]. Sequences go longest first, so that those that have ended are the last rows.
    """
    hidden = hidden_size(w)
    sig = lambda a: 0.5 * (1 + np.tanh(a / 2))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(int)
    out = np.zeros((len(x), hidden))
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    per = max(1, PADDED // (8 * hidden + 4 * x.shape[1]))
    for k in range(0, len(order), per):
        own = order[k : k + per]
        h = np.zeros((len(own), hidden))
        for step in range(lengths[own[0]]):
            live = int(np.searchsorted(-lengths[own], -step))
            at = starts[own[:live]] + step
            h = h[:live]
            if "W_h" in w:
                seen = m[at] * x[at]
                decay = np.exp(-np.logaddexp(0, dt[at].sum(1)))[:, None]
                h = decay * h + (1 - decay) * np.tanh(seen @ w["W_h"].T + w["b_h"])
                entry = np.concatenate([seen, m[at]], 1)
            else:
                entry = np.concatenate([x[at], m[at], dt[at]], 1)
            a, b = entry @ w["W_ih"].T + w["b_ih"], h @ w["W_hh"].T + w["b_hh"]
            r, z = sig(a[:, :hidden] + b[:, :hidden]), sig(a[:, hidden : 2 * hidden] + b[:, hidden : 2 * hidden])
            h = (1 - z) * np.tanh(a[:, 2 * hidden :] + r * b[:, 2 * hidden :]) + z * h
            out[at] = h
    return out


def encode_sequence(x: np.ndarray, m: np.ndarray, dt: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """``encode_steps`` of one sequence."""
    return encode_steps(x, m, dt, np.array([len(x)]), w)


def encode(samples: DataFrame, weights: dict[str, np.ndarray]) -> DataFrame:
    """``samples`` with H_raw, a state for each raw step. All columns pass through the map: samples are made once and joined to nothing."""
    held = samples.sparkSession.sparkContext.broadcast(weights)
    kept = [c for c in samples.columns if c != "H_raw"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        hidden = hidden_size(w)
        for batch in batches:
            lists = [batch.column(c) for c in ("X_raw", "M_raw", "DT_raw")]
            lengths = lists[0].value_lengths().to_numpy(zero_copy_only=False)
            total = int(lengths.sum())
            x, m, dt = (v.flatten().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(total, -1 if total else 1) for v in lists)
            states = encode_steps(x, m, dt, lengths, w) if total else np.zeros((0, hidden))
            steps = pa.ListArray.from_arrays(pa.array(np.arange(total + 1) * hidden, pa.int32()), pa.array(states.ravel()))
            made = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), steps)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), made], [*kept, "H_raw"])

    plain = samples.select(*kept)
    return plain.mapInArrow(rows, T.StructType([*plain.schema.fields, T.StructField("H_raw", T.ArrayType(T.ArrayType(T.DoubleType())))]))


def sample_violations(samples: DataFrame, arrays: dict[str, list[str]]) -> DataFrame:
    """n_rows, n_bad: rows whose arrays, by group, differ in length from the group's first."""
    bad = F.lit(False)
    for first, others in arrays.items():
        for c in others:
            bad = bad | ~F.size(first).eqNullSafe(F.size(c))
    return samples.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(bad.cast("long")), F.lit(0)).alias("n_bad"))


def require_columns(df: DataFrame, kinds: dict[str, str]) -> None:
    """Raise if a column is missing or of another type."""
    have = dict(df.dtypes)
    wrong = {c: have.get(c) for c, k in kinds.items() if have.get(c) != k}
    if wrong:
        raise ValueError(f"columns that are missing or of another type: {wrong}")
