"""Risk-set softmax and the losses of hazard models, each a few grouped sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.trajectory import dealt
from ..session import staged
from .ranks import FEW


#: Width of the blocks of eta in which exponentials are added up: no sum overflows, and one pass finds both maximum and sum.
BLOCK = 64.0


def exponential_sums(rows: DataFrame, by: list[str], eta: Column) -> DataFrame:
    """by, shift_, sum_: sum of exp(eta - shift_), where shift_ is the start of the key's highest block; one pass over ``rows``."""
    block = F.floor(eta / BLOCK)
    parts = rows.where(eta.isNotNull()).select(*by, block.alias("block_"), F.exp(eta - block * BLOCK).alias("e_")).groupBy(*by, "block_").agg(F.sum("e_").alias("s_"))
    tops = parts.groupBy(*by).agg(F.max("block_").alias("top_"), F.collect_list(F.struct("block_", "s_")).alias("parts_"))
    total = F.aggregate("parts_", F.lit(0.0), lambda a, x: a + x["s_"] * F.exp((x["block_"] - F.col("top_")) * BLOCK))
    return tops.select(*by, (F.col("top_") * BLOCK).alias("shift_"), total.alias("sum_"))


def riskset_softmax(rows: DataFrame, by: str = "bin_idx", eta: str = "eta", risk: str = "at_risk", name: str = "ps") -> DataFrame:
    """Softmax of eta over the rows at risk at each time; 0 for others.

    One pass adds up a row for each time, which are stored and counted; few are broadcast, more are joined by a shuffle. A
    time's whole risk set never sits in one task.
    """
    there = F.col(risk) > 0
    sums = staged(exponential_sums(rows.where(there), [by], F.col(eta)).withColumnRenamed(by, "k_"), "risk-sets")
    few = sums.count() <= FEW
    joined = rows.join(F.broadcast(sums) if few else sums, F.col(by) == F.col("k_"), "left")
    return joined.withColumn(name, F.when(there & F.col("sum_").isNotNull(), F.exp(F.col(eta) - F.col("shift_")) / F.col("sum_")).otherwise(0.0)).drop("k_", "shift_", "sum_")


def log_sum_exp(rows: DataFrame, by: list[str], eta: Column, alias: str = "lse") -> DataFrame:
    """Of all rows of a key, from sums by block."""
    return exponential_sums(rows, by, eta).select(*by, (F.col("shift_") + F.log("sum_")).alias(alias))


def binned_cox_loss(rows: DataFrame) -> DataFrame:
    """loss: mean over events of log-sum-exp of their bin's risk set less eta."""
    lse = log_sum_exp(rows.where("at_risk > 0"), ["bin_idx"], F.col("eta"))
    events = rows.groupBy("bin_idx").agg(F.sum("y_event").alias("d"), F.sum(F.col("y_event") * F.col("eta")).alias("e"))
    per_bin = events.join(lse, "bin_idx", "left")
    return per_bin.agg((F.sum(F.col("d") * F.coalesce("lse", F.lit(0.0)) - F.col("e")) / F.greatest(F.sum("d"), F.lit(1.0))).alias("loss"))


def pooled_cox_loss(rows: DataFrame, epsilon: float = 1e-8) -> DataFrame:
    """loss: the same with one log-sum-exp over all intervals, those not at risk at a weight of ``epsilon``."""
    weighed = F.col("eta") + F.log(F.col("at_risk") + F.lit(epsilon))
    lse = log_sum_exp(rows, [], weighed)
    sums = rows.agg(F.sum("y_event").alias("d"), F.sum(F.col("y_event") * F.col("eta")).alias("e"))
    return sums.crossJoin(F.broadcast(lse)).select(((F.col("d") * F.col("lse") - F.col("e")) / F.greatest("d", F.lit(1.0))).alias("loss"))


def hazard_loss(rows: DataFrame, positive_weight: float = 1.0) -> DataFrame:
    """loss: mean cross-entropy of the hazard over intervals at risk."""
    x, y = F.col("eta"), F.col("y_event")
    soft = lambda z: F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
    loss = F.lit(positive_weight) * y * soft(-x) + (1 - y) * soft(x)
    return rows.agg((F.sum(loss * F.col("at_risk")) / F.greatest(F.sum("at_risk"), F.lit(1.0))).alias("loss"))


def history_mask(rows: DataFrame, index: str = "idx_map") -> DataFrame:
    """Targets as 0 in bins before the first raw observation."""
    return rows.withColumns({c: F.when(F.col(index) >= 0, F.col(c)).otherwise(0.0) for c in ("y_event", "at_risk")})


def row_index(rows: DataFrame, key: str = "pid", order: str = "time") -> DataFrame:
    """t_idx: 0-based place of a row in its patient's order."""
    return rows.withColumn("t_idx", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)


def running_max(rows: DataFrame, column: str, key: str = "pid", order: str = "time") -> DataFrame:
    """``column`` made monotone in time; equal times see each other."""
    return rows.withColumn(column, F.max(column).over(Window.partitionBy(key).orderBy(order).rangeBetween(Window.unboundedPreceding, 0)))


def patient_split(rows: DataFrame, key: str = "pid", train_percent: int = 80, seed: int = 0) -> DataFrame:
    """is_train: a split of patients by hash, the same on any partitioning."""
    return rows.withColumn("is_train", dealt(key, 100, f"|{seed}") < train_percent)
