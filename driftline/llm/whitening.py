"""Embedding whitening: leading principal components of fixed-point embeddings, each row's whitened coordinates.

Spark makes the sums: distinct points, their count and sums, the centred products, and the whitened covariance that
checks the result. The driver holds one d x d covariance and slices its spectrum: the signs of D in LDLᵀ factors of the
shifted covariance count the eigenvalues above a shift (Sylvester), bisection on these counts isolates each leading
eigenvalue, Rayleigh quotient iteration converges to it cubically, and two more counts certify its number.

Edges: a null vector, or one with null or non-finite entries, is left out; so are empty vectors and those of another length than
the most common one (of lengths as common the shorter). Entries beyond 2 ** 53 steps of 1/64 count as that many. Repeated rows
are rows of their own but one point of the fit. Without variance there are no components and no rows; a direction whose variance is
rounding noise is no component. A null ``vec_id`` stays null. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, slices, staged, table

#: Fixed-point form of an entry c: floor(STEPS * c) + OFFSET.
STEPS, OFFSET, FURTHEST = 64, 1_000_000, float(1 << 53)
COMPONENTS = 16
#: The driver holds a covariance of this many rows at most.
MAX_DIMENSION = 4096
#: Growth bound of a pivot of one row in LDLᵀ factors.
ALPHA = (1 + 17**0.5) / 8


def usable(vector: Column) -> Column:
    """Not null, not empty, all entries finite numbers."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.coalesce(fine & (F.size(vector) > 0), F.lit(False))


def fixed_point(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(F.least(F.greatest(c * STEPS, F.lit(-FURTHEST)), F.lit(FURTHEST))) + F.lit(OFFSET))


def points(df: DataFrame, vector: str = "embedding", *keep: str) -> DataFrame:
    """``keep`` and ``x``, the fixed-point form, of rows whose vector is usable."""
    doubles = F.col(vector).cast("array<double>")
    return df.select(*keep, doubles.alias("v_")).where(usable(F.col("v_"))).select(*keep, fixed_point(F.col("v_")).alias("x"))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def positives(matrix: np.ndarray) -> int:
    """How many eigenvalues of a symmetric matrix are above zero: the signs of D in LDLᵀ, pivots of one or two rows (Bunch and Kaufman)."""
    a, k, count = matrix.copy(), 0, 0
    n = len(a)

    def swap(i: int, j: int) -> None:
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]

    while k < n:
        step = 1
        below = np.abs(a[k + 1 :, k])
        if len(below) and abs(a[k, k]) < ALPHA * below.max():
            r, most = k + 1 + int(below.argmax()), below.max()
            across = np.abs(a[k:, r])
            across[r - k] = 0.0
            if abs(a[k, k]) * across.max() < ALPHA * most**2:
                step = 1 if abs(a[r, r]) >= ALPHA * across.max() else 2
                swap(k + step - 1, r)
        if step == 1:
            d = a[k, k]
            if d != 0:  # else its column is zero, and so is an eigenvalue
                count += d > 0
                c = a[k + 1 :, k].copy()
                a[k + 1 :, k + 1 :] -= np.outer(c, c / d)
        else:
            e, c = a[k : k + 2, k : k + 2].copy(), a[k + 2 :, k : k + 2].copy()
            count += 1 if e[0, 0] * e[1, 1] < e[0, 1] ** 2 else 2 * int(e[0, 0] > 0)
            a[k + 2 :, k + 2 :] -= c @ np.linalg.solve(e, c.T)
        k += step
    return int(count)


class Spectrum:
    """The leading eigenpairs of a covariance. ``counts`` remembers how many eigenvalues lie above each shift tried."""

    def __init__(self, covariance: np.ndarray):
        self.v = (covariance + covariance.T) / 2
        self.d = len(self.v)
        self.reach = float(np.abs(self.v).sum(1).max(initial=0.0))  # no eigenvalue is beyond it
        self.noise = 4 * self.d * np.finfo(float).eps * self.reach
        self.counts: dict[float, int] = {-2 * self.reach: self.d, 2 * self.reach: 0}

    def above(self, shift: float) -> int:
        if shift not in self.counts:
            self.counts[shift] = positives(self.v - shift * np.eye(self.d))
        return self.counts[shift]

    def bracket(self, number: int) -> tuple[float, float]:
        """The narrowest interval known to hold eigenvalue ``number`` (from 1, falling)."""
        return max(s for s, n in self.counts.items() if n >= number), min(s for s, n in self.counts.items() if n < number)

    def isolate(self, number: int, width: float = float("inf")) -> tuple[float, float]:
        """Bisect until the interval holds that eigenvalue alone and is no wider than ``width``, or is as narrow as rounding allows."""
        low, high = self.bracket(number)
        while high - low > self.noise and (self.counts[low] - self.counts[high] > 1 or high - low > width):
            self.above((low + high) / 2)
            low, high = self.bracket(number)
        return low, high

    def solve(self, shift: float, right: np.ndarray) -> np.ndarray:
        for nudge in (0.0, self.noise, 3 * self.noise):
            try:
                made = np.linalg.solve(self.v - (shift + nudge) * np.eye(self.d), right)
            except np.linalg.LinAlgError:
                continue
            if np.isfinite(made).all():
                return made
        return right

    def refine(self, low: float, high: float, before: np.ndarray) -> tuple[float, np.ndarray]:
        """Inverse iteration from the interval's middle, then Rayleigh quotient iteration; orthogonal to the vectors found before."""

        def clean(y: np.ndarray) -> np.ndarray:
            for _ in range(2):
                y = y - before @ (before.T @ y)
                y = y / max(np.linalg.norm(y), np.finfo(float).tiny)
            return y

        y = clean(np.random.default_rng(self.d).standard_normal(self.d))
        for _ in range(3):
            y = clean(self.solve((low + high) / 2, y))
        e = float(y @ self.v @ y)
        for _ in range(12):
            if np.linalg.norm(self.v @ y - e * y) <= self.noise / 4:
                break
            y = clean(self.solve(e, y))
            e = float(y @ self.v @ y)
        return e, y

    def leading(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """At most ``k`` largest eigenvalues, falling, and their unit vectors as columns; none that is rounding noise."""
        values, vectors = [], np.zeros((self.d, 0))
        for number in range(1, min(k, self.d) + 1 if self.reach > 0 else 1):
            low, high = self.isolate(number)
            if high <= 4 * self.noise or self.above(4 * self.noise) < number:
                break
            while True:
                e, y = self.refine(low, high, vectors)
                # the count above just over e is less than the number, that just below it is not
                if self.above(e - 2 * self.noise) >= number > self.above(e + 2 * self.noise):
                    break
                if high - low <= self.noise:
                    raise ArithmeticError(f"eigenvalue {number} of the covariance is not certified")
                low, high = self.isolate(number, (high - low) / 8)
            values.append(e)
            vectors = np.column_stack([vectors, y])
        return np.array(values), vectors


@dataclass
class Whitening:
    """n points, their integer sums, eigenvalues and unit vectors (columns), the covariance's trace, and how far whitening is from one."""

    n: int = 0
    sums: list[int] = field(default_factory=list)
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    trace: float = 0.0
    identity_error: float = 0.0

    @property
    def d(self) -> int:
        return len(self.sums)

    def centre(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whole part and remainder of sums / n, and the remainder as a fraction: x - sums / n loses no digits."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], np.int64)
        return whole, rest, rest / self.n

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened coordinates of fixed-point rows."""
        whole, _, part = self.centre()
        return ((x - whole) - part) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - sums) ** 2, exact; None where a long does not hold it."""
        whole, rest, _ = self.centre()
        apart = x - whole
        if float(np.abs(apart).max(initial=0) + 1) ** 2 * self.n**2 * self.d < 2.0**62:
            return ((self.n * apart - rest) ** 2).sum(1).tolist()
        exact = (sum((self.n * int(a) - int(r)) ** 2 for a, r in zip(row, rest)) for row in apart)
        return [v if v < 1 << 63 else None for v in exact]


def by_partition(df: DataFrame, d: int, start: Callable[[], np.ndarray], add: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """cell, v: numbers that ``add`` gathers over each partition's rows, summed over partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = start(), False
        for batch in batches:
            if batch.num_rows:
                held, seen = add(held, matrix(batch.column(0), d)), True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(held)), pa.int32()), pa.array(held)], ["cell", "v"])

    kind = "long" if start().dtype == np.int64 else "double"
    return df.select("x").mapInArrow(run, f"cell int, v {kind}").groupBy("cell").agg(F.sum(F.col("v").cast("decimal(38,0)") if kind == "long" else "v").alias("v"))


def numbers(sums: DataFrame) -> list:
    """The cells' values in order: of the size of the covariance at most."""
    return [r["v"] for r in sums.orderBy("cell").collect()]


def fit(rows: DataFrame, k: int = COMPONENTS) -> Whitening:
    """Components of the distinct ``x`` of ``rows`` (``points``). Three passes over the stored distinct points."""
    fitted = staged(rows.select("x").distinct(), "whitening-points")
    try:
        lengths = fitted.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
        if not lengths:
            return Whitening()
        d, n = int(lengths[0]["d"]), int(lengths[0]["count"])
        if d > MAX_DIMENSION:
            raise ValueError(f"vectors of {d} entries; the driver holds a covariance of {MAX_DIMENSION} at most")
        own = fitted.where(F.size("x") == d)
        high_low = numbers(by_partition(own, d, lambda: np.zeros(2 * d, np.int64), lambda held, x: held + np.concatenate([(x >> 20).sum(0), (x & 0xFFFFF).sum(0)])))
        made = Whitening(n, [(int(h) << 20) + int(low) for h, low in zip(high_low[:d], high_low[d:])])
        whole, _, part = made.centre()
        upper = np.triu_indices(d)

        def products(held: np.ndarray, x: np.ndarray) -> np.ndarray:
            z = (x - whole) - part
            return held + (z.T @ z)[upper]

        cells = np.array(numbers(by_partition(own, d, lambda: np.zeros(len(upper[0])), products))) / n
        v = np.zeros((d, d))
        v[upper] = cells
        v = v + np.triu(v, 1).T
        made.trace = float(np.trace(v))
        made.values, made.vectors = Spectrum(v).leading(k)
        made.identity_error = identity_error(own, made)
        return made
    finally:
        discard(fitted)


def identity_error(own: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened points' covariance (centred on their own mean) less the identity.

    A partition adds its rows' products about a mean of its own; the means' products are added over partitions.
    """
    k = len(model.values)
    if not k:
        return 0.0
    mean = np.array(numbers(by_partition(own, model.d, lambda: np.zeros(k), lambda held, x: held + model.project(x).sum(0)))) / model.n

    def products(held: np.ndarray, x: np.ndarray) -> np.ndarray:
        y = model.project(x) - mean
        return held + (y.T @ y).ravel()

    made = np.array(numbers(by_partition(own, model.d, lambda: np.zeros(k * k), products))).reshape(k, k) / model.n
    return float(np.abs(made - np.eye(k)).max())


def whitened(rows: DataFrame, model: Whitening, key: str) -> DataFrame:
    """key, component (from 1), deviation, whitened: a row for each of ``rows`` (key, x) of the model's length and each component."""
    k, d = len(model.values), model.d

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1024):
                x = matrix(part.column("x"), d)
                at = pa.array(np.repeat(np.arange(len(x)), k))
                deviation = pa.array(model.deviations(x), pa.int64()).take(at)
                yield pa.RecordBatch.from_arrays(
                    [part.column(key).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), deviation, pa.array(model.project(x).ravel())], [key, "component", "deviation", "whitened"]
                )

    schema = f"{key} {rows.select(key).dtypes[0][1]}, component int, deviation long, whitened double"
    if not k:
        return rows.sparkSession.createDataFrame([], schema)
    return rows.where(F.size("x") == d).select(key, "x").mapInArrow(run, schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for every usable row of ``embeddings``."""
    rows = points(table(spark, sf_dir, "embeddings"), "embedding", "vec_id")
    model = fit(rows)
    shares = [float(e / model.trace) for e in model.values]
    explained = F.element_at(F.array(*[F.lit(s) for s in shares]), F.col("component")) if shares else F.lit(None).cast("double")
    return whitened(rows, model, "vec_id").select(
        "vec_id", "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(float(model.identity_error)).alias("identity_error")
    )
