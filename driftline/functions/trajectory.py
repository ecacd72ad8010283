"""Column expressions over trajectories: slopes, shape flags, scaling, arrays.

``traj`` and ``grid`` are arrays of equal length. A slope over no time is null and counts for no share or mean.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Classifier = Callable[..., dict[str, Column]]


def slopes(traj: Column, grid: Column) -> Column:
    """Differences of values over differences of times."""
    n = F.size(traj)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.try_divide(F.get(traj, i) - F.get(traj, i - 1), F.get(grid, i) - F.get(grid, i - 1)))).otherwise(F.array().cast("array<double>"))


def known(values: Column) -> Column:
    return F.filter(values, lambda x: x.isNotNull())


def mean(values: Column) -> Column:
    """Mean of an array, null if it is empty."""
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values).cast("double"))


def share(values: Column, hit: Callable[[Column], Column]) -> Column:
    return F.try_divide(F.size(F.filter(values, hit)).cast("double"), F.size(values).cast("double"))


def halves_apart(s: Column) -> Column:
    """Distance between the means of the lower and the upper half of the sorted slopes."""
    half = F.floor(F.size(s) / 2).cast("int")
    ordered = F.array_sort(s)
    lower = F.when(half > 0, F.slice(ordered, F.lit(1), half)).otherwise(F.array().cast("array<double>"))
    return F.abs(mean(lower) - mean(F.slice(ordered, half + 1, F.size(s) - half)))


def yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def decline_flags(traj: Column, grid: Column, flat: float = -1.0, decline: float = -2.0, gap: float = 3.0) -> dict[str, Column]:
    """Shapes where lower is worse."""
    s = known(slopes(traj, grid))
    return {
        "prolonged_nonprogression": yes((share(s, lambda x: x >= decline) >= 0.8) & (mean(s) >= flat)),
        "linear_decline": yes(share(s, lambda x: x < decline) >= 0.8),
        "nonlinear": yes(halves_apart(s) > gap),
    }


def increase_flags(traj: Column, grid: Column, flat: float = 0.5, decline: float = 1.0, gap: float = 2.0) -> dict[str, Column]:
    """Shapes where higher is worse; the steep class keeps the name ``linear_decline``."""
    s = known(slopes(traj, grid))
    return {
        "prolonged_nonprogression": yes((share(s, lambda x: x <= decline) >= 0.8) & (mean(s) <= flat)),
        "linear_decline": yes(share(s, lambda x: x > decline) >= 0.8),
        "nonlinear": yes(halves_apart(s) > gap),
    }


def four_class_flags(traj: Column, grid: Column, flat: float = -0.3, decline: float = -1.5, gap: float = 1.0, aging: float = -0.5) -> dict[str, Column]:
    """Stable, slow and fast decline, and nonlinear."""
    s = known(slopes(traj, grid))
    return {
        "prolonged_nonprogression": yes((share(s, lambda x: x >= aging) >= 0.8) & (mean(s) >= flat)),
        "slow_linear_decline": yes(share(s, lambda x: (x >= decline) & (x < aging)) >= 0.8),
        "fast_linear_decline": yes(share(s, lambda x: x < decline) >= 0.8),
        "nonlinear": yes(halves_apart(s) > gap),
    }


def prediction_grid(tmin: Column, tmax: Column, frequency: int, least: int | None = None) -> Column:
    """Evenly spaced times over a window: ``frequency`` a unit of time, and ``least`` (``frequency`` by default) at least."""
    n = F.greatest(F.lit(least if least is not None else frequency), F.round((tmax - tmin) * frequency).cast("int"), F.lit(2))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: tmin + i * (tmax - tmin) / (n - 1))


def unit_time(t: Column, tmin: Column, tmax: Column, least: float = 1e-12) -> Column:
    return (t - tmin) / F.greatest(tmax - tmin, F.lit(least))


def one_if_zero(sd: Column) -> Column:
    return F.coalesce(F.nullif(sd, F.lit(0.0)), F.lit(1.0))


def back_transform(z: Column, mu: Column, sd: Column) -> Column:
    """A standardised curve in its own units."""
    return F.transform(z, lambda x: x * sd + mu)


def padded(values: Column, size: Column, fill: Column) -> Column:
    """An array filled up to a size."""
    return F.concat(values, F.array_repeat(fill, F.greatest(size - F.size(values), F.lit(0))))


def coefficient_columns(name: str, coefficients: Column, splines: int) -> list[Column]:
    """``<name>_beta_intercept, <name>_beta_s1..``: an intercept and spline coefficients, 0 where there are fewer."""
    labels = ["intercept", *(f"s{i}" for i in range(1, splines + 1))]
    return [F.coalesce(F.get(coefficients, F.lit(i)), F.lit(0.0)).alias(f"{name}_beta_{x}") for i, x in enumerate(labels)]


def gather(rows: Column, index: Column, width: int) -> Column:
    """The row of an array of rows at a 0-based index, zeros where the index is negative."""
    zeros = F.array_repeat(F.lit(0.0), F.lit(width))
    return F.when(index >= 0, F.get(rows, index)).otherwise(zeros)


def sigmoid(eta: Column) -> Column:
    return F.when(eta >= 0, 1 / (1 + F.exp(-eta))).otherwise(F.exp(eta) / (1 + F.exp(eta)))


def linear_predictor(columns: list[str], beta: list[float], means: list[float] | None = None) -> Column:
    """Sum of products of centred columns, as one expression."""
    eta = F.lit(0.0)
    for c, b, m in zip(columns, beta, means or [0.0] * len(columns), strict=True):
        eta = eta + (F.col(c).cast("double") - F.lit(float(m))) * F.lit(float(b))
    return eta


def dealt(key: Column | str, parts: int, seed: str = "") -> Column:
    """A number below ``parts`` from the MD5 of a key as text: the same on any engine and partitioning."""
    text = F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(F.concat(text, F.lit(seed)).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(parts)).cast("int")
