"""Fixed-width bins: grids, treatment starts, covariates per bin.

A bin is known by the integer ``bin_idx``; its start is ``bin_idx * width``. Nothing joins or groups on a time that was
added up. Every window runs within one patient's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import by_key, staged
from .asof import asof
from .ranks import medians


def bin_count(tmax: Column, width: float) -> Column:
    return F.ceil(tmax / F.lit(width)).cast("int")


def bin_starts(tmax: Column, width: float) -> Column:
    """Array of a follow-up's bin starts; empty where there is none."""
    n = bin_count(tmax, width)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * F.lit(width))).otherwise(F.array().cast("array<double>"))


def bin_edges(tmax: Column, width: float) -> Column:
    """Bin starts and the end of the last bin."""
    n = bin_count(tmax, width)
    return F.transform(F.sequence(F.lit(0), n), lambda i: i * F.lit(width))


def bin_grid(static: DataFrame, dynamic: DataFrame, width: float = 1.0) -> DataFrame:
    """pid, bin_idx, start, stop: every bin of the patients that have measurements."""
    known = static.join(by_key(dynamic.select("pid")), "pid", "left_semi").where(F.col("Tmax") > 0)
    grid = known.select("pid", F.explode(F.sequence(F.lit(0), bin_count(F.col("Tmax"), width) - 1)).alias("bin_idx"))
    return grid.withColumn("start", F.col("bin_idx") * F.lit(width)).withColumn("stop", (F.col("bin_idx") + 1) * F.lit(width))


def in_bins(dynamic: DataFrame, grid: DataFrame, width: float = 1.0) -> DataFrame:
    """Measurements with their bin, by an equi join on its index."""
    return dynamic.withColumn("bin_idx", F.floor(F.col("time") / F.lit(width)).cast("int")).join(by_key(grid.select("pid", "bin_idx", "start", "stop")), ["pid", "bin_idx"])


def treatment_start(dynamic: DataFrame) -> DataFrame:
    """pid, t_start: first time with treated = 1, else null."""
    return dynamic.groupBy("pid").agg(F.min(F.when(F.col("treated") == 1, F.col("time"))).alias("t_start"))


def treated_at(start: Column, t_start: Column) -> Column:
    return F.coalesce(start >= t_start, F.lit(False)).cast("int")


def mark_treated(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """``rows`` with treated = 1 from the patient's start on."""
    return rows.drop("treated").join(by_key(starts), "pid", "left").withColumn("treated", treated_at(F.col("time"), F.col("t_start"))).drop("t_start")


def binary_features(dynamic: DataFrame, prefixes: tuple[str, ...] = ("Med",)) -> DataFrame:
    """pid, feature_name, is_binary: by the name's prefix, or all of the patient's values are 0 or 1."""
    named = F.lit(False)
    for p in prefixes:
        named = named | F.col("feature_name").startswith(p)
    seen = dynamic.groupBy("pid", "feature_name").agg(F.bool_and(F.coalesce(F.col("value").isin(0.0, 1.0), F.lit(False))).alias("all01"))
    return seen.select("pid", "feature_name", (named | F.col("all01")).alias("is_binary"))


def binned_mean(dynamic: DataFrame, grid: DataFrame, width: float = 1.0) -> DataFrame:
    """pid, bin_idx, feature_name, value: mean of a bin's values that are not null."""
    return in_bins(dynamic, grid, width).groupBy("pid", "bin_idx", "feature_name").agg(F.avg("value").alias("value"))


def last_in_bin(dynamic: DataFrame, grid: DataFrame, width: float = 1.0) -> DataFrame:
    """pid, bin_idx, feature_name, value: the bin's latest value; of equal times the larger."""
    latest = F.max(F.struct("time", "value"))["value"]
    return in_bins(dynamic, grid, width).groupBy("pid", "bin_idx", "feature_name").agg(latest.alias("value"))


def forward_fill(df: DataFrame, columns: list[str], order: str = "bin_idx") -> DataFrame:
    """Each patient's last known value."""
    w = Window.partitionBy("pid").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def median_fill(df: DataFrame, columns: list[str], exact: bool = True, fills: dict[str, float | None] | None = None) -> DataFrame:
    """Nulls become the column's median; the exact one needs no task that holds a column. ``exact=False`` takes a sketch instead.

    For exact medians ``df`` is stored, so that what makes it runs once. ``fills`` are the medians of an earlier table: an empty
    dictionary receives those found, a filled one is used instead of this table's.
    """
    if fills:
        found = fills
    elif exact:
        df = staged(df, "to-fill")
        found = medians(df, columns)
    else:
        found = df.agg(*[F.percentile_approx(c, 0.5, 10_000).alias(c) for c in columns]).first().asDict()
    if fills is not None:
        fills.update(found)
    return df.withColumns({c: F.coalesce(c, F.lit(found[c]).cast("double")) for c in columns})


def wide(rows: DataFrame, features: list[str]) -> DataFrame:
    """pid, bin_idx and a column for each feature."""
    return rows.groupBy("pid", "bin_idx").pivot("feature_name", features).agg(F.first("value"))


def aggregate_to_bins(dynamic: DataFrame, static: DataFrame, features: list[str], width: float = 1.0, prefixes: tuple[str, ...] = ("Med",), fills: dict[str, float | None] | None = None) -> DataFrame:
    """pid, bin_idx, start, stop, treatment, one column a feature: one row for each bin of each patient.

    Binary features carry the last value at or before the bin's start, and the first value before that (0 without rows).
    Others take the bin's mean, carry it forward, and fill what is left with the median over all bins (``fills`` as in ``median_fill``).
    ``dynamic`` is read twice: the patients' starts, the features' rows and the grid are stored, as several branches read each.
    """
    own = staged(dynamic.where(F.col("feature_name").isin(features)).select("pid", "time", "feature_name", "value"), "features")
    starts = staged(treatment_start(dynamic), "treatment-starts")
    grid = staged(bin_grid(static, starts, width), "grid")
    kinds = binary_features(own, prefixes)
    flagged = own.join(by_key(kinds), ["pid", "feature_name"])
    means = wide(binned_mean(flagged.where(~F.col("is_binary")), grid, width), features)
    binary = flagged.where("is_binary")
    asked = grid.join(by_key(kinds.where("is_binary").select("pid", "feature_name")), "pid").select("pid", "feature_name", "bin_idx", F.col("start").alias("time"))
    carried = wide(asof(asked, binary, ["pid", "feature_name"], ["value"], before_first="first").select("pid", "bin_idx", "feature_name", "value"), features)
    found = grid.join(by_key(means.withColumnsRenamed({c: f"mean_{c}" for c in features})), ["pid", "bin_idx"], "left").join(by_key(carried.withColumnsRenamed({c: f"held_{c}" for c in features})), ["pid", "bin_idx"], "left")
    absent = {c: F.lit(0.0) if c.startswith(prefixes) else F.lit(None).cast("double") for c in features}
    found = found.withColumns({c: F.coalesce(f"held_{c}", f"mean_{c}", absent[c]) for c in features})
    found = found.join(by_key(starts), "pid", "left").withColumn("treatment", treated_at(F.col("start"), F.col("t_start")))
    return median_fill(forward_fill(found, features), features, fills=fills).select("pid", "bin_idx", "start", "stop", "treatment", *features)


def aggregate_last(dynamic: DataFrame, static: DataFrame, features: list[str], width: float = 1.0, prefixes: tuple[str, ...] = ("Med",)) -> DataFrame:
    """The other rule: medications take the bin's last value, carried forward, then 0; others as above. Flag ``treated``."""
    own = dynamic.where(F.col("feature_name").isin(features))
    grid = bin_grid(static, dynamic, width)
    held = [c for c in features if c.startswith(prefixes)]
    rest = [c for c in features if c not in held]
    rows = last_in_bin(own.where(F.col("feature_name").isin(held)), grid, width).unionByName(binned_mean(own.where(F.col("feature_name").isin(rest)), grid, width))
    found = grid.join(by_key(wide(rows, features)), ["pid", "bin_idx"], "left").join(by_key(treatment_start(dynamic)), "pid", "left")
    found = forward_fill(found.withColumn("treated", treated_at(F.col("start"), F.col("t_start"))), features)
    found = found.fillna(0.0, subset=held) if held else found
    found = median_fill(found, rest) if rest else found
    return found.select("pid", "bin_idx", "start", "stop", "treated", *features)


def event_targets(bins: DataFrame, treated: str = "treatment", include_event_bin: bool = True, onset: str = "y_event", risk: str = "at_risk") -> DataFrame:
    """One-hot first treated bin, and at risk up to it (all bins of a patient that is never treated)."""
    first = F.min(F.when(F.col(treated) == 1, F.col("bin_idx"))).over(Window.partitionBy("pid"))
    return bins.withColumn("first_", first).withColumns({
        onset: F.coalesce(F.col("bin_idx") == F.col("first_"), F.lit(False)).cast("double"),
        risk: F.coalesce(F.col("bin_idx") <= (F.col("first_") if include_event_bin else F.col("first_") - 1), F.lit(True)).cast("double"),
    }).drop("first_")
