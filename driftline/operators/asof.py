"""Backward as-of joins: the last event at or before each asked time, in one shuffle by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(asked: DataFrame, events: DataFrame, keys: list[str], values: list[str], before_first: str = "null", time: str = "time", event_time: str | None = None) -> DataFrame:
    """``asked`` (keys, ``time``, any more columns) with the whole latest event row's ``values`` and its time ``<event_time>_at``.

    The row is carried as one struct, its nulls too. ``before_first``: what comes before the first event, ``null``,
    ``zero`` or ``first`` (the first event, though it lies ahead). Of events at one time the greatest row counts.
    """
    if before_first not in ("null", "zero", "first"):
        raise ValueError(f"before_first: {before_first}")
    more = [c for c in asked.columns if c not in keys and c != time]
    left = asked.select(*keys, F.col(time).alias("at_"), F.lit(1).alias("side_"), F.struct(*[F.col(c) for c in more] or [F.lit(None).alias("none_")]).alias("asked_"), F.lit(None).cast(event_type(events, values, event_time or time)).alias("event_"))
    right = events.select(*keys, F.col(event_time or time).alias("at_"), F.lit(0).alias("side_"), F.lit(None).cast(left.schema["asked_"].dataType).alias("asked_"), F.struct(F.col(event_time or time).alias("t_"), *values).alias("event_"))
    key = Window.partitionBy(*keys)
    upto = key.orderBy("at_", "side_", "event_").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.last("event_", ignorenulls=True).over(upto)
    if before_first == "first":
        hit = F.coalesce(hit, F.first("event_", ignorenulls=True).over(key.orderBy("at_", "side_", "event_").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    found = left.unionByName(right).withColumn("hit_", hit).where("side_ = 1")
    fill = (lambda c: F.when(F.col("hit_").isNull(), F.lit(0.0)).otherwise(c)) if before_first == "zero" else (lambda c: c)
    return found.select(*keys, F.col("at_").alias(time), *[F.col(f"asked_.{c}").alias(c) for c in more], *[fill(F.col(f"hit_.{c}")).alias(c) for c in values], F.col("hit_.t_").alias(f"{event_time or time}_at"))


def event_type(events: DataFrame, values: list[str], time: str):
    return events.select(F.struct(F.col(time).alias("t_"), *values).alias("e")).schema["e"].dataType
