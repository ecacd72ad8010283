"""Mixed-model trajectories, their classes, and a check of features by supervised learning."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import by_key, staged


def mixed_model(rows: DataFrame, fixed_intercept: bool = False, key: str = "patient_id") -> tuple[DataFrame, dict[str, float]]:
    """``rows`` with ``predicted`` and ``u`` (the patient's intercept) of value ~ time + time^2 with random intercepts.

    Patients' sums are all that is needed; for each ratio of variances they add up to one small system. The ratio is
    found on a grid that is refined twice.
    """
    names = (["1.0D"] if fixed_intercept else []) + ["time", "time * time"]
    p = len(names)
    x = [F.expr(n).alias(f"x{i}") for i, n in enumerate(names)]
    sums = rows.select(key, F.col("lab_value").alias("y"), *x).where("y is not null").groupBy(key).agg(
        F.count("*").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy"), *[F.sum(f"x{i}").alias(f"sx{i}") for i in range(p)],
        *[F.sum(F.col(f"x{i}") * F.col("y")).alias(f"sxy{i}") for i in range(p)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"sxx{i}_{j}") for i in range(p) for j in range(i, p)],
    ).persist()

    def systems(ratios: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, float, float, float]]:
        """X'V^-1 X, X'V^-1 y, y'V^-1 y, log |V|, n for each ratio, in one pass."""
        parts = []
        for k, r in enumerate(ratios):
            shrink = F.lit(float(r)) / (1 + F.lit(float(r)) * F.col("n"))
            parts += [F.sum(F.col(f"sxx{i}_{j}") - shrink * F.col(f"sx{i}") * F.col(f"sx{j}")).alias(f"a{k}_{i}_{j}") for i in range(p) for j in range(i, p)]
            parts += [F.sum(F.col(f"sxy{i}") - shrink * F.col(f"sx{i}") * F.col("sy")).alias(f"b{k}_{i}") for i in range(p)]
            parts += [F.sum(F.col("syy") - shrink * F.col("sy") * F.col("sy")).alias(f"c{k}"), F.sum(F.log1p(F.lit(float(r)) * F.col("n"))).alias(f"d{k}")]
        row = sums.agg(F.sum("n").alias("n"), *parts).first()
        out = []
        for k in range(len(ratios)):
            a = np.zeros((p, p))
            for i in range(p):
                for j in range(i, p):
                    a[i, j] = a[j, i] = row[f"a{k}_{i}_{j}"]
            out.append((a, np.array([row[f"b{k}_{i}"] for i in range(p)]), row[f"c{k}"], row[f"d{k}"], row["n"]))
        return out

    def profile(system) -> tuple[float, np.ndarray, float]:
        a, b, c, logdet, n = system
        beta = np.linalg.solve(a + 1e-12 * np.eye(p), b)
        s2 = max((c - b @ beta) / n, 1e-12)
        return -0.5 * (n * np.log(s2) + logdet), beta, s2

    ratios = np.geomspace(1e-3, 1e3, 13)
    for _ in range(3):
        made = [profile(s) for s in systems(ratios)]
        best = int(np.argmax([m[0] for m in made]))
        ratio, (_, beta, s2) = float(ratios[best]), made[best]
        ratios = np.geomspace(ratios[max(best - 1, 0)], ratios[min(best + 1, len(ratios) - 1)], 9)
    fixed = sum((F.expr(n) * F.lit(float(b)) for n, b in zip(names, beta)), F.lit(0.0))
    residual = F.col("sy") - sum((F.col(f"sx{i}") * F.lit(float(b)) for i, b in enumerate(beta)), F.lit(0.0))
    effects = sums.select(key, (F.lit(ratio) * residual / (1 + F.lit(ratio) * F.col("n"))).alias("u"))
    sums.unpersist()
    return rows.join(by_key(effects), key, "left").withColumn("predicted", fixed + F.coalesce("u", F.lit(0.0))), {"ratio": ratio, "sigma2": float(s2), **{f"beta{i}": float(b) for i, b in enumerate(beta)}}


def trajectory_classes(effects: DataFrame, columns: list[str], k: int = 5, seed: int = 0, key: str = "patient_id") -> DataFrame:
    """key, class: the likeliest component of a Gaussian mixture over the columns."""
    rows = VectorAssembler(inputCols=columns, outputCol="x_").transform(effects.dropna(subset=columns))
    fit = GaussianMixture(k=k, featuresCol="x_", predictionCol="class", probabilityCol="p_", seed=seed).fit(rows)
    return fit.transform(rows).select(key, "class")


def stratified_folds(rows: DataFrame, label: str, key: str, folds: int = 5, seed: int = 0) -> DataFrame:
    """fold: dealt in turn by hash within each label's hash bucket, so that no label's rows gather in one task."""
    shard = F.pmod(F.xxhash64(key, F.lit(seed + 1)), F.lit(64))
    w = Window.partitionBy(label, "shard_").orderBy(F.xxhash64(key, F.lit(seed)), key)
    return rows.withColumn("shard_", shard).withColumn("fold", F.pmod(F.row_number().over(w) + F.col("shard_"), F.lit(folds)).cast("int")).drop("shard_")


def supervised_check(rows: DataFrame, columns: list[str], label: str, key: str, folds: int = 5, model: str = "logistic") -> DataFrame:
    """fold, accuracy: standardised features, a linear model for the label, held-out accuracy of each fold."""
    held = stratified_folds(StringIndexer(inputCol=label, outputCol="y_").fit(rows).transform(rows), label, key, folds)
    held = staged(held, "folds")
    learner = LogisticRegression(featuresCol="z_", labelCol="y_", predictionCol="guess_", probabilityCol="p_", rawPredictionCol="r_", family="multinomial", regParam=0.01, maxIter=50)
    if model == "svm":
        learner = OneVsRest(classifier=LinearSVC(featuresCol="z_", labelCol="y_", maxIter=30), featuresCol="z_", labelCol="y_", predictionCol="guess_")
    steps = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="x_"), StandardScaler(inputCol="x_", outputCol="z_", withMean=True), learner])
    parts = None
    for k in range(folds):
        guessed = steps.fit(held.where(F.col("fold") != k)).transform(held.where(F.col("fold") == k)).select("fold", (F.col("guess_") == F.col("y_")).cast("double").alias("right"))
        parts = guessed if parts is None else parts.unionByName(guessed)
    return parts.groupBy("fold").agg(F.avg("right").alias("accuracy"))
