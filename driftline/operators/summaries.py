"""Trajectory summaries per patient, lab and anchor: spline posteriors and penalised-spline coefficients.

Spark cuts each series in chunks of time with what lies a window before them, so a patient with a long history is many
small rows, no task holds all of it, and no point is sent more than twice. A task slides the window over a chunk, and a kernel in numpy
turns batches of windows into rows. Random numbers are
seeded by patient, lab and anchor: results are the same on any partitioning.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import shapes, splines
from ..functions.trajectory import Classifier, coefficient_columns, decline_flags, four_class_flags, increase_flags
from .trailing import series_chunks, sliding_windows

KEYS = ["patient_id", "lab", "time"]


def seed(patient: str, lab: str, time: float, base: int) -> np.random.Generator:
    return np.random.default_rng(zlib.crc32(f"{patient}|{lab}|{time!r}|{base}".encode()))


def over_windows(long: DataFrame, width: float, min_points: int, kernel: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``kernel`` makes of batches of windows (patient_id, lab, time, t, v): those of every anchor with enough points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliding_windows(batches, KEYS[:2], width, min_points):
            yield from kernel(batch)

    return series_chunks(long, KEYS[:2], width, "time", "lab_value").mapInArrow(run, schema)


@dataclass
class PosteriorConfig:
    """Defaults of the posterior back end."""

    window: float = 2.0
    min_points: int = 5
    df: int = 6
    frequency: int = 12
    draws: int = 4_000
    standardize: bool = True
    least_grid: int | None = None
    seed: int = 920


#: Drawn values that a kernel holds at once.
CHUNK_VALUES = 1 << 18


def posteriors(batch: pa.RecordBatch, c: PosteriorConfig) -> Iterator[tuple[np.ndarray, np.ndarray, splines.Posteriors, np.ndarray]]:
    """Rows of a batch of windows, their grids, and their posteriors in the windows' own units but for the last array, which is to be added.

    Windows of as many points and as long a grid are fitted together.
    """
    patient, lab, time = (batch.column(k).to_pylist() for k in KEYS)
    t, v = ([np.asarray(x, float) for x in batch.column(k).to_pylist()] for k in ("t", "v"))
    low, high = np.array([x.min() for x in t]), np.array([x.max() for x in t])
    length = np.maximum(np.rint((high - low) * c.frequency).astype(int), max(c.least_grid if c.least_grid is not None else c.frequency, 2))
    alike: dict[tuple[int, int], list[int]] = {}
    for i, (x, g) in enumerate(zip(t, length)):
        alike.setdefault((len(x), int(g)), []).append(i)
    for (n, g), rows in alike.items():
        step = max(1, CHUNK_VALUES // (c.draws * g))
        for k in range(0, len(rows), step):
            own = np.array(rows[k : k + step])
            x, y = np.stack([t[i] for i in own]), np.stack([v[i] for i in own])
            lo, span = low[own, None], (high - low)[own, None]
            grid = lo + span * np.linspace(0, 1, g)
            if c.standardize:
                mu, sd, scale, df = y.mean(1, keepdims=True), y.std(1, keepdims=True), np.maximum(span, 1e-8), splines.effective_df(c.df, n)
                sd[sd == 0] = 1.0
            else:
                mu, sd, scale, df = np.zeros((len(own), 1)), np.ones((len(own), 1)), 1.0, c.df
            rngs = [seed(patient[i], lab[i], time[i], c.seed) for i in own]
            fit = splines.spline_posteriors((x - lo) / scale, (y - mu) / sd, (grid - lo) / scale, df, c.draws, rngs)
            fit.at *= sd[:, :, None]
            yield own, grid, fit, mu


def listed(values: np.ndarray) -> pa.ListArray:
    """Rows of a table of numbers as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(np.ascontiguousarray(values).ravel()))


def posterior_curves(long: DataFrame, config: PosteriorConfig) -> DataFrame:
    """patient_id, lab, time, draw, grid, traj: posterior curves of every window in its own units, one row for each draw."""

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for own, grid, fit, mu in posteriors(batch, config):
            curves = fit.curves + mu[:, :, None]
            at = pa.array(np.repeat(own, config.draws))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).take(at) for k in KEYS), pa.array(np.tile(np.arange(config.draws, dtype=np.int32), len(own))), listed(np.repeat(grid, config.draws, 0)), listed(curves.reshape(-1, curves.shape[-1]))],
                [*KEYS, "draw", "grid", "traj"],
            )

    return over_windows(long, config.window, config.min_points, rows, "patient_id string, lab string, time double, draw int, grid array<double>, traj array<double>")


def posterior_summaries(long: DataFrame, config: PosteriorConfig) -> DataFrame:
    """patient_id, lab, time, draws, grid, mean, sd: every window's posterior curve, one row for each window."""

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for own, grid, fit, mu in posteriors(batch, config):
            middle, sd = fit.moments()
            keys = [batch.column(k).take(pa.array(own)) for k in KEYS]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(np.full(len(own), config.draws, np.int64)), listed(grid), listed(middle + mu), listed(sd)], [*KEYS, "draws", "grid", "mean", "sd"])

    return over_windows(long, config.window, config.min_points, rows, "patient_id string, lab string, time double, draws long, grid array<double>, mean array<double>, sd array<double>")


def posterior_frequencies(curves: DataFrame, classifier: Classifier = decline_flags, **thresholds: float) -> DataFrame:
    """traj_prob_<class>: the share of an anchor's draws that has each flag. ``classifier`` makes columns of columns."""
    flags = classifier(F.col("traj"), F.col("grid"), **thresholds)
    return curves.groupBy(*KEYS).agg(*[F.avg(f.cast("double")).alias(f"traj_prob_{name}") for name, f in flags.items()])


#: Classifiers that kernels know too.
SHAPES = {decline_flags: shapes.decline, increase_flags: shapes.increase, four_class_flags: shapes.four_class}


@dataclass
class CurveClassifier:
    """Any numpy function of (curves: draw x place, grid, **thresholds) that gives a flag or a probability by draw for each of ``names``."""

    names: list[str]
    flags: Callable[..., dict[str, np.ndarray]]


def trajectory_probabilities(long: DataFrame, config: PosteriorConfig, classifier: Classifier | CurveClassifier = decline_flags, **thresholds: float) -> DataFrame:
    """traj_prob_<class> of every window of all labs, one row a window.

    The known classifiers and any ``CurveClassifier`` run where curves are drawn; a classifier of columns gets the curves as rows.
    """
    if isinstance(classifier, CurveClassifier):
        names = classifier.names

        def shares(grid: np.ndarray, fit: splines.Posteriors, mu: np.ndarray) -> list[np.ndarray]:
            made = [classifier.flags(curves + m, g, **thresholds) for curves, m, g in zip(fit.curves, mu, grid)]
            return [np.array([np.mean(np.asarray(flags[x], float)) for flags in made]) for x in names]

    elif classifier in SHAPES:
        shape = SHAPES[classifier]
        names = list(shape(np.zeros((1, 1, 1)), **thresholds))

        def shares(grid: np.ndarray, fit: splines.Posteriors, mu: np.ndarray) -> list[np.ndarray]:
            apart = np.diff(grid, axis=1)[:, :, None]
            known = apart[:, 0, 0] > 0  # slopes over no time count for nothing
            flags = shape((np.diff(fit.at, axis=1) / np.where(apart > 0, apart, 1.0)) @ fit.beta, **thresholds)
            return [np.where(known, flags[x].mean(1), 0.0) for x in names]

    else:
        return posterior_frequencies(posterior_curves(long, config), classifier, **thresholds)

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for own, grid, fit, mu in posteriors(batch, config):
            made = [pa.array(x) for x in shares(grid, fit, mu)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(own)) for k in KEYS), *made], [*KEYS, *(f"traj_prob_{x}" for x in names)])

    schema = ", ".join(["patient_id string, lab string, time double", *(f"traj_prob_{x} double" for x in names)])
    return over_windows(long, config.window, config.min_points, rows, schema)


@dataclass
class GamConfig:
    """Defaults of the penalised-spline back end. ``mode``: gcv, folds or robust."""

    window: float = 2.0
    min_points: int = 5
    low: int = 4
    high: int = 6
    lams: list[float] = field(default_factory=lambda: [0.3, 1.0, 3.0])
    degree: int = 3
    mode: str = "robust"
    folds: int = 3
    seed: int = 920


def gam_fits(long: DataFrame, config: GamConfig) -> DataFrame:
    """patient_id, lab, time, coefficients (intercept first), n_splines, lam, fit_success, zero_beta, attempts.

    Windows of as many points are fitted together, all penalties at once.
    """
    c = config

    def chosen(x: np.ndarray, y: np.ndarray, keys: list[tuple]) -> splines.ChosenFits:
        if c.mode == "robust":
            return splines.choose_all_first_good(x, y, c.low, c.high, c.lams, c.degree)
        if c.mode == "folds" and x.shape[1] >= max(c.folds, 5):
            return splines.choose_all_by_folds(x, y, c.low, c.high, c.lams, c.degree, c.folds, [seed(*k, c.seed) for k in keys])
        return splines.choose_all_by_gcv(x, y, c.low, c.high, c.lams, c.degree)

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        t, v = (batch.column(k) for k in ("t", "v"))
        lengths = t.value_lengths().to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(lengths)])
        t, v = (a.flatten().to_numpy(zero_copy_only=False).astype(float) for a in (t, v))
        for n in np.unique(lengths):
            alike = np.flatnonzero(lengths == n)
            step = max(1, CHUNK_VALUES // int(n * (c.high + 1) * len(c.lams)))
            for k in range(0, len(alike), step):
                own = alike[k : k + step]
                at = starts[own][:, None] + np.arange(n)
                low, sd = t[at].min(1, keepdims=True), v[at].std(1, keepdims=True)
                x = (t[at] - low) / np.maximum(t[at].max(1, keepdims=True) - low, 1e-12)
                y = (v[at] - v[at].mean(1, keepdims=True)) / np.where(sd == 0, 1.0, sd)
                keys = [batch.column(name).take(pa.array(own)) for name in KEYS]
                fit = chosen(x, y, list(zip(*(a.to_pylist() for a in keys))))
                good = fit.n_splines > 0
                size = np.where(good, fit.n_splines, c.high) + 1
                values = fit.coefficients[np.arange(c.high + 1) < size[:, None]]
                beta = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(values))
                flags = [pa.array(fit.n_splines.astype(float), mask=~good), pa.array(fit.lam, mask=~good), *(pa.array(a.astype(float)) for a in (good, ~fit.coefficients.any(1), fit.tried))]
                yield pa.RecordBatch.from_arrays([*keys, beta, *flags], [*KEYS, "coefficients", "n_splines", "lam", "fit_success", "zero_beta", "attempts"])

    schema = "patient_id string, lab string, time double, coefficients array<double>, n_splines double, lam double, fit_success double, zero_beta double, attempts double"
    return over_windows(long, c.window, c.min_points, rows, schema)


def fitted_anchors(wide: DataFrame, labs: list[str]) -> DataFrame:
    """Anchors at which at least one lab was fitted."""
    return wide.where(F.greatest(*[F.coalesce(f"{lab}_fit_success", F.lit(0.0)) for lab in labs], F.lit(0.0)) == 1.0)


def gam_covariates(long: DataFrame, labs: list[str], config: GamConfig) -> DataFrame:
    """patient_id, time and every lab's block of coefficients and flags at the union of the labs' anchors."""
    struct = F.first(F.struct("coefficients", "n_splines", "lam", "fit_success", "zero_beta", "attempts"))
    wide = gam_fits(long.where(F.col("lab").isin(labs)), config).groupBy("patient_id", "time").pivot("lab", labs).agg(struct)
    columns = [F.col("patient_id"), F.col("time")]
    for lab in labs:
        there = F.col(lab).isNotNull()
        block = coefficient_columns(lab, F.col(f"`{lab}`.coefficients"), config.high)
        columns += [F.when(there, b).alias(n) for b, n in zip(block, [f"{lab}_beta_intercept", *(f"{lab}_beta_s{i}" for i in range(1, config.high + 1))])]
        columns += [F.col(f"`{lab}`.{x}").alias(f"{lab}_{x}") for x in ("n_splines", "lam", "fit_success", "zero_beta", "attempts")]
    return fitted_anchors(wide.select(*columns), labs)


def block_pca(covariates: DataFrame, lab: str, k: int) -> DataFrame:
    """patient_id, time, <lab>_pc1..k, <lab>_n_splines, <lab>_lam: centred components of a lab's coefficient block.

    A component's sign is that of its largest loading.
    """
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    block = [c for c in covariates.columns if c.startswith(f"{lab}_beta_")]
    rows = VectorAssembler(inputCols=block, outputCol="x_").transform(covariates.fillna(0.0, subset=block))
    centred = StandardScaler(inputCol="x_", outputCol="z_", withMean=True, withStd=False).fit(rows).transform(rows)
    fit = PCA(k=min(k, len(block)), inputCol="z_", outputCol="p_").fit(centred)
    loadings = fit.pc.toArray()
    sign = np.sign(loadings[np.abs(loadings).argmax(0), np.arange(loadings.shape[1])])
    parts = [(F.get(vector_to_array("p_"), F.lit(i)) * F.lit(float(s))).alias(f"{lab}_pc{i + 1}") for i, s in enumerate(sign)]
    return fit.transform(centred).select("patient_id", "time", *parts, f"{lab}_n_splines", f"{lab}_lam")
