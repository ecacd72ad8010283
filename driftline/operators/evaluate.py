"""Scores of fitted models and of sampler traces."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, types as T
from pyspark.sql import functions as F

from ..session import discard, staged
from .ranks import FEW, running_sum


def brier(rows: DataFrame, p: str = "ps", y: str = "y") -> DataFrame:
    """brier: mean squared distance of probability and outcome."""
    return rows.agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"))


def concordance(rows: DataFrame, time: str = "stop", score: str = "ps", event: str = "treatment", orientation: str = "survival", few: int = FEW) -> DataFrame:
    """concordant, tied, comparable, c_index over all comparable pairs, without making them.

    A row with an event at time t is compared with all rows of later time, and with those of the same time without an
    event: with those of a later place, if distinct times are numbered with events first. Two places differ in the first bit, from
    the top, that one has and the other has not; so each row counts once for each bit, among the rows that share the bits above
    it. There, running counts over scores tell how many comparable rows score above and equal. That is rows times bits,
    for a few bins or for continuous times. Rows without a time or score are left out.

    ``survival``: larger scores should mean later events, ``risk``: earlier ones. No window holds more than a range of scores.
    """
    sign = F.lit(1.0 if orientation == "survival" else -1.0)
    cells = rows.groupBy(F.col(time).cast("double").alias("t"), F.coalesce(F.col(event) > 0, F.lit(False)).alias("e"), (F.col(score) * sign).alias("s")).agg(F.count("*").alias("n"))
    cells = staged(cells.where("t is not null and s is not null"), "score-cells")
    times = staged(cells.groupBy("t").agg(F.max(F.col("e").cast("long")).alias("with_"), F.max((~F.col("e")).cast("long")).alias("without_")).withColumn("kinds_", F.col("with_") + F.col("without_")), "event-times")
    places = running_sum(times, "t", "kinds_", "place_", few=few).select(F.col("t").alias("at_"), "with_", "place_")
    bits = max(1, int((times.agg(F.sum("kinds_")).first()[0] or 1) - 1).bit_length())
    place = F.col("place_") + F.when(F.col("e"), 0).otherwise(F.col("with_"))
    spread = cells.join(places, F.col("t") == F.col("at_")).select("e", "s", "n", place.alias("place"), F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("bit"))
    later = F.expr("shiftright(place, bit) % 2 = 1")
    both = spread.where(later | F.col("e")).groupBy("bit", F.expr("shiftright(place, bit + 1)").alias("above_bit"), "s").agg(
        F.sum(F.when(later, F.col("n")).otherwise(0)).alias("others"), F.sum(F.when(~later & F.col("e"), F.col("n")).otherwise(0)).alias("events")
    )
    both = staged(both, "score-counts")
    above = running_sum(both, "s", "others", "above", ("bit", "above_bit"), descending=True, few=few)
    totals = both.groupBy(F.col("bit").alias("bit_"), F.col("above_bit").alias("above_bit_")).agg(F.sum("others").alias("total"))
    made = above.where("events > 0").join(totals, (F.col("bit") == F.col("bit_")) & (F.col("above_bit") == F.col("above_bit_")))
    sums = made.agg(
        F.sum(F.col("events") * F.col("above")).alias("concordant"), F.sum(F.col("events") * F.col("others")).alias("tied"), F.sum(F.col("events") * F.col("total")).alias("comparable")
    )
    return sums.withColumn("c_index", F.try_divide(F.col("concordant") + F.col("tied") / 2, F.col("comparable")))


def split_chains(trace: DataFrame) -> DataFrame:
    """trace (param, chain, draw, value) with each chain halved: column ``half``."""
    n = F.count("*").over(Window.partitionBy("param", "chain"))
    place = F.row_number().over(Window.partitionBy("param", "chain").orderBy("draw"))
    cut = trace.withColumns({"n_": n, "i_": place}).withColumn("m_", F.floor(F.col("n_") / 2))
    # an odd chain loses its middle draw
    return cut.where((F.col("i_") <= F.col("m_")) | (F.col("i_") > F.col("n_") - F.col("m_"))).withColumn("half", F.col("chain") * 2 + (F.col("i_") > F.col("m_")).cast("int")).drop("n_", "i_", "m_")


@F.pandas_udf(T.DoubleType())
def normal_score(p: pd.Series) -> pd.Series:
    """Inverse of the normal distribution function."""
    from statistics import NormalDist

    return p.map(NormalDist().inv_cdf)


def value_ranks(rows: DataFrame, value: str, few: int = FEW) -> DataFrame:
    """param, value, n_, less_, total_, stored: a parameter's values with how many draws equal them, lie below, and there are. NaN is no value."""
    counts = staged(rows.where(~F.isnan(value)).groupBy("param", value).agg(F.count("*").alias("n_")), "draw-counts")
    ranked = running_sum(counts, value, "n_", "less_", ("param",), few=few)
    totals = counts.groupBy(F.col("param").alias("param_")).agg(F.sum("n_").alias("total_"))
    made = staged(ranked.join(totals, F.col("param") == F.col("param_")).drop("param_"), "value-ranks")
    discard(counts)
    return made


def normal_scores(ranks: DataFrame, value: str, name: str) -> DataFrame:
    """param, value and the normal score of its mean rank."""
    rank = F.col("less_") + (F.col("n_") + 1) / 2
    return ranks.select("param", value, normal_score((rank - 0.375) / (F.col("total_") + 0.25)).alias(name))


def middles(ranks: DataFrame, value: str, name: str) -> DataFrame:
    """param and its exact median: the mean of the values that hold the two middle places."""
    holds = lambda place: F.max(F.when((F.col("less_") <= place) & (place < F.col("less_") + F.col("n_")), F.col(value)))
    return ranks.groupBy("param").agg((holds(F.floor((F.col("total_") - 1) / 2)) * 0.5 + holds(F.floor(F.col("total_") / 2)) * 0.5).alias(name))


def autocovariance(x: np.ndarray) -> np.ndarray:
    """Of one chain at each lag, its squares' mean at lag 0."""
    x = x - x.mean()
    size = 1 << int(2 * len(x) - 1).bit_length()
    return np.fft.irfft(np.abs(np.fft.rfft(x, size)) ** 2, size)[: len(x)] / len(x)


def chain_statistics(n: np.ndarray, mean: np.ndarray, variance: np.ndarray, acov: list[np.ndarray] | None = None) -> tuple[float, float]:
    """R-hat and effective size from chains' lengths, means, variances (n - 1) and autocovariances.

    Chains need not be equally long: the within variance is the mean over chains, a lag's autocovariance the mean over the chains
    that reach it, up to the shortest one's length, and the size counts all draws.
    """
    m, length = len(n), float(n.mean())
    if n.min() < 2:
        return float("nan"), float("nan")
    within, between = variance.mean(), mean.var(ddof=1) if m > 1 else 0.0
    pooled = (length - 1) / length * within + between
    rhat = float(np.sqrt(pooled / within)) if within > 0 else float("nan")
    if acov is None:
        return rhat, float("nan")
    short = int(n.min())
    there = np.mean([a[:short] * k / (k - 1) for a, k in zip(acov, n)], axis=0)
    rho = 1 - (within - there) / pooled if pooled > 0 else np.zeros(short)
    rho[0] = 1.0
    pairs = rho[: short - short % 2].reshape(-1, 2).sum(1)
    stop = np.flatnonzero(pairs < 0)
    pairs = np.minimum.accumulate(pairs[: stop[0]] if len(stop) else pairs)
    total = float(n.sum())
    tau = max(-1 + 2 * pairs.sum(), 1 / np.log10(total))
    return rhat, float(total / tau)


def trace_diagnostics(trace: DataFrame, few: int = FEW) -> DataFrame:
    """param, rhat, ess_bulk of rank-normalised split chains; chains may differ in length, and all their draws count.

    Ranks, and the medians that values are folded around, come from counts by ranges of values, of all parameters together. A task
    holds one half of a chain, and then one row for each half.
    """
    halves = staged(split_chains(trace), "half-chains")
    ranks = value_ranks(halves, "value", few)
    scores = normal_scores(ranks, "value", "z").join(middles(ranks, "value", "middle_"), "param").withColumn("folded", F.abs(F.col("value") - F.col("middle_"))).drop("middle_")
    folded = staged(halves.join(scores, ["param", "value"]), "folded-draws")
    discard(halves, ranks)
    scored = folded.join(normal_scores(value_ranks(folded, "folded", few), "folded", "f"), ["param", "folded"])

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("draw")
        z, f = pdf["z"].to_numpy(), pdf["f"].to_numpy()
        spread = lambda x: float(x.var(ddof=1)) if len(x) > 1 else float("nan")
        return pd.DataFrame({"param": [key[0]], "n": [len(z)], "mean": [z.mean()], "var": [spread(z)], "fmean": [f.mean()], "fvar": [spread(f)], "acov": [autocovariance(z)]})

    def all_(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf["n"].to_numpy()
        rhat, ess = chain_statistics(n, pdf["mean"].to_numpy(), pdf["var"].to_numpy(), list(pdf["acov"]))
        return pd.DataFrame({"param": [key[0]], "rhat": [max(rhat, chain_statistics(n, pdf["fmean"].to_numpy(), pdf["fvar"].to_numpy())[0])], "ess_bulk": [ess]})

    made = scored.groupBy("param", "half").applyInPandas(one, "param string, n long, mean double, var double, fmean double, fvar double, acov array<double>")
    return made.groupBy("param").applyInPandas(all_, "param string, rhat double, ess_bulk double")


def check_rhat(diagnostics: DataFrame, threshold: float = 1.01) -> DataFrame:
    """max_rhat and how many parameters are over the threshold."""
    return diagnostics.agg(F.max("rhat").alias("max_rhat"), F.sum((F.col("rhat") > threshold).cast("long")).alias("n_over"))


def ess_summary(diagnostics: DataFrame) -> DataFrame:
    """min_ess and median_ess."""
    return diagnostics.agg(F.min("ess_bulk").alias("min_ess"), F.median("ess_bulk").alias("median_ess"))


def mean_pool(rows: DataFrame, key: str = "pid", vector: str = "h", mask: str | None = None) -> DataFrame:
    """key, dim, pooled: mean over time of a vector per step, weighed by the mean of its mask (1e-6 at least)."""
    weight = F.lit(1.0) if mask is None else F.aggregate(mask, F.lit(0.0), lambda a, x: a + x) / F.size(mask)
    cells = rows.withColumn("w_", F.greatest(weight, F.lit(1e-6))).select(key, "w_", F.posexplode(vector).alias("dim", "x_"))
    return cells.groupBy(key, "dim").agg((F.sum(F.col("x_") * F.col("w_")) / F.sum("w_")).alias("pooled"))


