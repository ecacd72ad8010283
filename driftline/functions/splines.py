"""Numpy kernels on one short trajectory: spline bases, penalised fits, posterior curves. No Spark here."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def bspline_basis(x: np.ndarray, knots: np.ndarray, degree: int) -> np.ndarray:
    """Columns of the B-spline basis on a full knot vector; the last interval is closed. Leading axes are further curves."""
    x = np.clip(x, knots[..., degree, None], knots[..., -degree - 1, None])[..., None]
    at = knots[..., None, :]
    there = knots[..., :-1] < knots[..., 1:]
    last = there.shape[-1] - 1 - there[..., ::-1].argmax(-1)
    end = np.take_along_axis(knots, last[..., None] + 1, -1)[..., None]
    b = np.where(x >= end, np.arange(there.shape[-1]) == last[..., None, None], (x >= at[..., :-1]) & (x < at[..., 1:])).astype(float)
    for d in range(1, degree + 1):
        n = knots.shape[-1] - d - 1
        left, right = at[..., d : d + n] - at[..., :n], at[..., d + 1 : d + 1 + n] - at[..., 1 : 1 + n]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(left > 0, (x - at[..., :n]) / left, 0.0)
            down = np.where(right > 0, (at[..., d + 1 : d + 1 + n] - x) / right, 0.0)
        b = up * b[..., :n] + down * b[..., 1 : n + 1]
    return b


def quantile_knots(x: np.ndarray, df: int, degree: int) -> np.ndarray:
    """Knots for ``df`` functions, the inner ones at quantiles of the data. Leading axes are further curves."""
    lead = x.shape[:-1]
    inner = np.moveaxis(np.quantile(x, np.linspace(0, 1, df - degree + 1)[1:-1], axis=-1), 0, -1) if df > degree + 1 else np.zeros((*lead, 0))
    low, high = x.min(-1), np.maximum(x.max(-1), x.min(-1) + 1e-9)
    ends = [np.repeat(v[..., None], degree + 1, -1) for v in (low, high)]
    return np.concatenate([ends[0], inner, ends[1]], -1)


def even_knots(n_splines: int, degree: int) -> np.ndarray:
    """Evenly spaced knots on [0, 1] that reach beyond it."""
    step = 1.0 / (n_splines - degree)
    return np.arange(-degree, n_splines + 1) * step


@dataclass
class PenalisedFit:
    coefficients: np.ndarray
    n_splines: int
    lam: float
    gcv: float


def penalised_fit(x: np.ndarray, y: np.ndarray, n_splines: int, lam: float, degree: int = 3) -> PenalisedFit | None:
    """P-spline with an intercept and a second-difference penalty; None where the basis is too small or the fit not finite."""
    if n_splines <= degree:
        return None
    basis = bspline_basis(x, even_knots(n_splines, degree), degree)
    design = np.column_stack([np.ones(len(x)), basis])
    difference = np.diff(np.eye(n_splines), 2, axis=0)
    penalty = np.zeros((n_splines + 1, n_splines + 1))
    penalty[1:, 1:] = lam * difference.T @ difference + 1e-6 * np.eye(n_splines)
    gram = design.T @ design
    try:
        inverse = np.linalg.inv(gram + penalty)
    except np.linalg.LinAlgError:
        return None
    beta = inverse @ (design.T @ y)
    edof = np.trace(inverse @ gram)
    rss = float(((y - design @ beta) ** 2).sum())
    room = len(x) - 1.4 * edof
    gcv = len(x) * rss / room**2 if room > 0 else np.inf
    return PenalisedFit(beta, n_splines, lam, gcv) if np.isfinite(beta).all() else None


def penalised_predict(fit: PenalisedFit, x: np.ndarray, degree: int = 3) -> np.ndarray:
    return fit.coefficients[0] + bspline_basis(x, even_knots(fit.n_splines, degree), degree) @ fit.coefficients[1:]


def candidates(n: int, low: int, high: int, degree: int) -> list[int]:
    """Basis sizes that n points allow, never below the least."""
    return list(range(low, max(low, min(high, n - (degree + 1))) + 1))


def choose_by_gcv(x: np.ndarray, y: np.ndarray, low: int, high: int, lams: list[float], degree: int) -> tuple[PenalisedFit | None, int]:
    """The candidate of least GCV (of equal ones the first), and how many were tried."""
    tried = [penalised_fit(x, y, k, lam, degree) for k in candidates(len(x), low, high, degree) for lam in lams]
    there = [f for f in tried if f is not None]
    return (min(there, key=lambda f: f.gcv) if there else None), len(tried)


def choose_by_folds(x: np.ndarray, y: np.ndarray, low: int, high: int, lams: list[float], degree: int, folds: int, rng: np.random.Generator) -> tuple[PenalisedFit | None, int]:
    """The candidate of least held-out error over shuffled folds, fitted to all points."""
    fold = rng.permutation(len(x)) % folds
    best, least, tried = None, np.inf, 0
    for k in candidates(len(x), low, high, degree):
        for lam in lams:
            tried += 1
            error, whole = 0.0, penalised_fit(x, y, k, lam, degree)
            for i in range(folds):
                part = penalised_fit(x[fold != i], y[fold != i], k, lam, degree)
                error += np.inf if part is None else float(((y[fold == i] - penalised_predict(part, x[fold == i], degree)) ** 2).sum())
            if whole is not None and error < least:
                best, least = whole, error
    return best, tried


def choose_first_good(x: np.ndarray, y: np.ndarray, low: int, high: int, lams: list[float], degree: int) -> tuple[PenalisedFit | None, int]:
    """From large to small bases, penalties in their order: the first finite fit that is not zero."""
    tried = 0
    for k in reversed(candidates(len(x), low, high, degree)):
        for lam in lams:
            tried += 1
            fit = penalised_fit(x, y, k, lam, degree)
            if fit is not None and np.linalg.norm(fit.coefficients) > 1e-12:
                return fit, tried
    return None, tried


@dataclass
class ChosenFits:
    """The chosen fit of each window: coefficients (intercept first, 0 beyond the basis), basis size and penalty (0 without a fit), candidates tried."""

    coefficients: np.ndarray
    n_splines: np.ndarray
    lam: np.ndarray
    tried: np.ndarray

    @classmethod
    def none(cls, windows: int, high: int) -> ChosenFits:
        return cls(np.zeros((windows, high + 1)), np.zeros(windows, int), np.zeros(windows), np.zeros(windows, int))

    def take(self, rows: np.ndarray, which: np.ndarray, beta: np.ndarray, n_splines: int, lams: list[float]) -> None:
        """``rows`` have their fit of penalty number ``which`` with ``n_splines`` functions."""
        self.coefficients[rows] = 0.0
        self.coefficients[rows, : n_splines + 1] = beta[rows, which]
        self.n_splines[rows], self.lam[rows] = n_splines, np.array(lams)[which]


def penalised_fits(x: np.ndarray, y: np.ndarray, n_splines: int, lams: list[float], degree: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """``penalised_fit`` of many windows of one length and all penalties: coefficients (window, penalty, function), GCV (window, penalty).

    The Gram matrices are made once; coefficients that are not finite, or a basis that is too small, have NaN for both.
    """
    w, size = len(x), n_splines + 1
    if n_splines <= degree:
        return np.full((w, len(lams), size), np.nan), np.full((w, len(lams)), np.nan)
    design = np.concatenate([np.ones((*x.shape, 1)), bspline_basis(x, even_knots(n_splines, degree), degree)], -1)
    difference = np.diff(np.eye(n_splines), 2, axis=0)
    penalty = np.zeros((len(lams), size, size))
    penalty[:, 1:, 1:] = np.array(lams)[:, None, None] * (difference.T @ difference) + 1e-6 * np.eye(n_splines)
    across = np.swapaxes(design, 1, 2)
    gram, right = across @ design, across @ y[:, :, None]
    whole = gram[:, None] + penalty
    try:
        inverse = np.linalg.inv(whole)
    except np.linalg.LinAlgError:  # one of them is singular: the others are not its fault
        inverse = np.full_like(whole, np.nan)
        for i, j in np.ndindex(w, len(lams)):
            try:
                inverse[i, j] = np.linalg.inv(whole[i, j])
            except np.linalg.LinAlgError:
                continue
    beta = (inverse @ right[:, None])[..., 0]
    edof = np.einsum("wlij,wji->wl", inverse, gram)
    rss = ((y[:, None] - np.einsum("wni,wli->wln", design, beta)) ** 2).sum(-1)
    room = x.shape[1] - 1.4 * edof
    gcv = np.where(room > 0, x.shape[1] * rss / np.where(room > 0, room, 1.0) ** 2, np.inf)
    fine = np.isfinite(beta).all(-1)
    return np.where(fine[..., None], beta, np.nan), np.where(fine, gcv, np.nan)


def choose_all_by_gcv(x: np.ndarray, y: np.ndarray, low: int, high: int, lams: list[float], degree: int) -> ChosenFits:
    """``choose_by_gcv`` of windows of one length."""
    out, least = ChosenFits.none(len(x), high), np.full(len(x), np.nan)
    for k in candidates(x.shape[1], low, high, degree):
        beta, gcv = penalised_fits(x, y, k, lams, degree)
        out.tried += len(lams)
        for j in range(len(lams)):
            better = ~np.isnan(gcv[:, j]) & (np.isnan(least) | (gcv[:, j] < least))
            rows = np.flatnonzero(better)
            out.take(rows, np.full(len(rows), j), beta, k, lams)
            least[rows] = gcv[rows, j]
    return out


def choose_all_by_folds(x: np.ndarray, y: np.ndarray, low: int, high: int, lams: list[float], degree: int, folds: int, rngs: list[np.random.Generator]) -> ChosenFits:
    """``choose_by_folds`` of windows of one length, each dealt by its own random numbers: folds are as large in all of them."""
    n = x.shape[1]
    fold = np.stack([rng.permutation(n) % folds for rng in rngs])
    out, least = ChosenFits.none(len(x), high), np.full(len(x), np.inf)
    for k in candidates(n, low, high, degree):
        beta, _ = penalised_fits(x, y, k, lams, degree)
        error = np.zeros((len(x), len(lams)))
        for i in range(folds):
            on = fold == i
            parts, _ = penalised_fits(x[~on].reshape(len(x), -1), y[~on].reshape(len(x), -1), k, lams, degree)
            if k > degree:
                basis = bspline_basis(x[on].reshape(len(x), -1), even_knots(k, degree), degree)
                made = parts[:, :, :1] + np.einsum("wni,wli->wln", basis, parts[:, :, 1:])
                error += ((y[on].reshape(len(x), 1, -1) - made) ** 2).sum(-1)
        error = np.where(np.isnan(error), np.inf, error)
        out.tried += len(lams)
        for j in range(len(lams)):
            rows = np.flatnonzero(~np.isnan(beta[:, j, 0]) & (error[:, j] < least))
            out.take(rows, np.full(len(rows), j), beta, k, lams)
            least[rows] = error[rows, j]
    return out


def choose_all_first_good(x: np.ndarray, y: np.ndarray, low: int, high: int, lams: list[float], degree: int) -> ChosenFits:
    """``choose_first_good`` of windows of one length: smaller bases are fitted only to windows without a fit."""
    out = ChosenFits.none(len(x), high)
    left = np.arange(len(x))
    for k in reversed(candidates(x.shape[1], low, high, degree)):
        beta, _ = penalised_fits(x[left], y[left], k, lams, degree)
        good = np.nan_to_num(np.linalg.norm(beta, axis=-1)) > 1e-12
        some, first = good.any(1), good.argmax(1)
        out.tried[left] += np.where(some, first + 1, len(lams))
        wide = np.zeros((len(x), len(lams), k + 1))
        wide[left] = beta
        out.take(left[some], first[some], wide, k, lams)
        left = left[~some]
        if not len(left):
            break
    return out


def effective_df(df: int, n: int) -> int:
    return min(df, max(2, n - 1), 8)


@dataclass
class Posterior:
    """Draws of curves on a grid (a row each) and of sigma, in the fit's units."""

    curves: np.ndarray
    sigma: np.ndarray


@dataclass
class Posteriors:
    """Draws for some curves at once: coefficients (curve, function, draw), functions on the grids (curve, place, function), sigma (curve, draw)."""

    beta: np.ndarray
    at: np.ndarray
    sigma: np.ndarray

    @property
    def curves(self) -> np.ndarray:
        """curve, draw, place."""
        return np.swapaxes(self.at @ self.beta, 1, 2)

    def moments(self) -> tuple[np.ndarray, np.ndarray]:
        """Means and standard deviations over draws at each place of the grid, from those of the coefficients: no curve is made."""
        middle = self.beta.mean(2)
        apart = self.beta - middle[:, :, None]
        spread = apart @ np.swapaxes(apart, 1, 2) / self.beta.shape[2]
        return (self.at @ middle[:, :, None])[:, :, 0], np.sqrt(np.maximum(((self.at @ spread) * self.at).sum(-1), 0.0))


def spline_posterior(x: np.ndarray, y: np.ndarray, grid: np.ndarray, df: int, draws: int, rng: np.random.Generator) -> Posterior:
    """``spline_posteriors`` of one curve."""
    fit = spline_posteriors(x[None], y[None], grid[None], df, draws, [rng])
    return Posterior(fit.curves[0], fit.sigma[0])


def spline_posteriors(x: np.ndarray, y: np.ndarray, grid: np.ndarray, df: int, draws: int, rngs: list[np.random.Generator]) -> Posteriors:
    """Exact draws for y = B b + e with b ~ N(0, 1) and a half-normal sigma; a row of x, y and grid for each curve.

    With the singular values of B the likelihood of sigma is known in closed form; sigma is drawn from a grid by its
    distribution function, and b given sigma is normal in the singular directions, which the coefficients are kept in. Each curve
    has its own random numbers.
    """
    degree = min(3, df - 1)
    knots = quantile_knots(x, df, degree)
    ones = lambda z: np.ones((*z.shape, 1))
    design = np.concatenate([ones(x), bspline_basis(x, knots, degree)], -1)
    at = np.concatenate([ones(grid), bspline_basis(grid, knots, degree)], -1)
    n, p = design.shape[1:]
    m = min(n, p)
    u, s, vt = np.linalg.svd(design, full_matrices=True)
    z = np.einsum("wnm,wn->wm", u[:, :, :m], y)
    rest = np.maximum((y * y).sum(-1) - (z * z).sum(-1), 0.0)
    sigma = np.exp(np.linspace(np.log(1e-3), np.log(4.0), 200))
    var = s[:, :m, None] ** 2 + sigma**2
    log_p = -(sigma**2) / 2 - 0.5 * (np.log(var).sum(1) + (n - m) * np.log(sigma**2) + (z[:, :, None] ** 2 / var).sum(1) + rest[:, None] / sigma**2) + np.log(sigma)
    weight = np.cumsum(np.exp(log_p - log_p.max(-1, keepdims=True)), -1)
    s, zz = (np.pad(v[:, :m], ((0, 0), (0, p - m)))[:, :, None] for v in (s, z))
    spread = s**2 + sigma**2
    middle, sd = s * zz / spread, sigma / np.sqrt(spread)  # of each direction, at each sigma of the grid
    beta, drawn = np.empty((len(x), p, draws)), np.empty((len(x), draws))
    for i, rng in enumerate(rngs):
        which = np.searchsorted(weight[i], rng.uniform(size=draws) * weight[i, -1]).clip(0, len(sigma) - 1)
        drawn[i] = sigma[which]
        rng.standard_normal(out=beta[i])
        beta[i] *= sd[i].take(which, 1)
        beta[i] += middle[i].take(which, 1)
    return Posteriors(beta, at @ np.swapaxes(vt, 1, 2), drawn)
