"""Joins that assemble a counting-process design."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F, types as T

from ..session import by_key, staged
from .asof import asof
from .ranks import FEW, running_sum


def attach_static(rows: DataFrame, static: DataFrame, columns: list[str] | None = None, on: str = "pid") -> DataFrame:
    """Static covariates on each row."""
    return rows.join(by_key(static.select(on, *(columns or [c for c in static.columns if c != on]))), on, "left")


def fill_zero(df: DataFrame) -> DataFrame:
    """Remaining nulls and NaN of number columns as 0."""
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    return df.fillna(0, subset=numbers)


def with_prefix(df: DataFrame, *prefixes: str) -> list[str]:
    """Columns by prefix, in the table's order."""
    return [c for c in df.columns if c.startswith(prefixes)]


def with_suffix(df: DataFrame, columns: list[str], lab: str) -> DataFrame:
    """``columns`` renamed to ``<column>__<lab>``, once."""
    return df.withColumnsRenamed({c: f"{c}__{lab}" for c in columns if not c.endswith(f"__{lab}")})


def align_by_lab(grid: DataFrame, tables: dict[str, DataFrame], prefix: str = "traj_prob_") -> DataFrame:
    """pid, bin_idx and every lab's probabilities as of the bin's start, 0.0 before its history: one as-of for all labs."""
    own = {lab: with_prefix(rows, prefix) for lab, rows in tables.items()}
    values = list(dict.fromkeys(v for names in own.values() for v in names))
    parts = [rows.withColumnRenamed("patient_id", "pid").select("pid", F.lit(lab).alias("lab_"), "time", *own[lab]) for lab, rows in tables.items()]
    events = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).select("pid", "lab_", "time", *values)
    asked = grid.select("pid", F.explode(F.array(*[F.lit(lab) for lab in tables])).alias("lab_"), F.col("start").alias("time"), "bin_idx")
    made = asof(asked, events, ["pid", "lab_"], values, before_first="zero")
    columns = [F.max(F.when(F.col("lab_") == lab, F.col(v))).alias(v if v.endswith(f"__{lab}") else f"{v}__{lab}") for lab in tables for v in own[lab]]
    return made.groupBy("pid", "bin_idx").agg(*columns)


def align_rows(grid: DataFrame, rows: DataFrame, values: list[str]) -> DataFrame:
    """pid, bin_idx and the whole latest row of ``values`` as of the bin's start; its nulls and all before it as 0.0."""
    asked = grid.select("pid", F.col("start").alias("time"), "bin_idx")
    made = asof(asked, rows.withColumnRenamed("patient_id", "pid"), ["pid"], values, before_first="zero")
    return made.select("pid", "bin_idx", *values).fillna(0.0, subset=values)


def merge_labs(tables: list[DataFrame], on: tuple[str, ...] = ("patient_id", "time")) -> DataFrame:
    """All labs' covariates at the union of their times, in one shuffle. A lab has one row at a time."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return rows.groupBy(*on).agg(*[F.first(c, ignorenulls=True).alias(c) for c in rows.columns if c not in on])


def counting_process(static: DataFrame, bins: DataFrame, aligned: DataFrame, static_cols: list[str] | None = None) -> DataFrame:
    """One row per bin: covariates, aligned trajectory covariates, static ones; nulls as 0."""
    return fill_zero(attach_static(bins.join(by_key(aligned), ["pid", "bin_idx"], "left"), static, static_cols))


def cohort(covariates: DataFrame, classes: DataFrame, treatments: DataFrame, on: str = "patient_id", time: str = "time") -> DataFrame:
    """Covariates with class and treatment, where all three know the patient and time."""
    return covariates.join(by_key(classes), on).join(by_key(treatments), [on, time])


def with_time(rows: DataFrame, times: DataFrame) -> DataFrame:
    """Rows by (pid, t_idx) with the true time."""
    return rows.join(by_key(times), ["pid", "t_idx"], "left")


def at_risk_intervals(intervals: DataFrame, events: DataFrame) -> DataFrame:
    """event_time and the rows (id, start, stop) at risk then: start < event_time <= stop.

    Event times are cut into days of the interval's own span, so that the join has an equi key: each interval is listed
    for the whole units that it touches.
    """
    unit = F.explode(F.sequence(F.floor("start").cast("long"), F.floor("stop").cast("long"))).alias("unit_")
    listed = intervals.select("*", unit)
    times = events.select(F.col("event_time"), F.floor("event_time").cast("long").alias("unit_")).distinct()
    return listed.join(times, "unit_").where((F.col("start") < F.col("event_time")) & (F.col("event_time") <= F.col("stop"))).drop("unit_")


def aligned_risk(design: DataFrame, treatment: str = "treatment") -> DataFrame:
    """bin_idx, n_risk, n_event: risk sets where all intervals are bins."""
    return design.groupBy("bin_idx").agg(F.count("*").alias("n_risk"), F.sum(treatment).alias("n_event"))


def risk_counts(intervals: DataFrame, events: DataFrame, few: int = FEW) -> DataFrame:
    """event_time, n_risk: how many intervals (start, stop) are at risk at each event time; times with none are left out.

    What has started before a time less what has stopped before it: a running sum over distinct times. No interval is listed more
    than once, and no window holds more than a range of times.
    """
    known = intervals.where(F.col("start") < F.col("stop"))
    points = known.select(F.explode(F.array(F.struct(F.col("start").cast("double").alias("at_"), F.lit(1).alias("d_")), F.struct(F.col("stop").cast("double").alias("at_"), F.lit(-1).alias("d_")))).alias("p_")).select("p_.*", F.lit(False).alias("event_"))
    asked = events.where(F.col("event_time").isNotNull()).select(F.col("event_time").cast("double").alias("at_"), F.lit(0).alias("d_"), F.lit(True).alias("event_"))
    times = staged(points.unionByName(asked).groupBy("at_").agg(F.sum("d_").alias("d_"), F.max("event_").alias("event_")), "risk-times")
    made = running_sum(times, "at_", "d_", "n_risk", few=few)
    return made.where(F.col("event_") & (F.col("n_risk") > 0)).select(F.col("at_").alias("event_time"), "n_risk")
