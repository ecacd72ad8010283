"""The shape flags of ``functions.trajectory`` over many numpy curves at once. No Spark here.

Slopes lie along the last axis but one, draws along the last.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np


@lru_cache
def exchanges(n: int) -> list[tuple[int, int]]:
    """Batcher's odd-even merge sort of n places: pairs whose lesser goes to the first place."""
    pairs, p = [], 1
    while p < n:
        k = p
        while k >= 1:
            pairs += [(j + i, j + i + k) for j in range(k % p, n - k, 2 * k) for i in range(min(k, n - j - k)) if (i + j) // (2 * p) == (i + j + k) // (2 * p)]
            k //= 2
        p *= 2
    return pairs


#: Longer curves are sorted one by one.
NETWORK = 32


def sum_of_least(s: np.ndarray, half: int) -> np.ndarray:
    """Sum of the ``half`` least along the last axis but one. A few slopes of many draws are sorted by exchanging whole rows of draws."""
    n = s.shape[-2]
    if n > NETWORK:
        return np.sort(np.ascontiguousarray(np.swapaxes(s, -1, -2)), -1)[..., :half].sum(-1)
    rows = [s[..., i, :] for i in range(n)]
    for a, b in exchanges(n):
        rows[a], rows[b] = np.minimum(rows[a], rows[b]), np.maximum(rows[a], rows[b])
    return np.sum(rows[:half], axis=0)


def halves_apart(s: np.ndarray) -> np.ndarray:
    """Distance between the means of the lower and the upper half of the sorted slopes; of a single one less than any."""
    n = s.shape[-2]
    half = n // 2
    if not half:
        return np.full((*s.shape[:-2], s.shape[-1]), -np.inf)
    lower = sum_of_least(s, half)
    return np.abs(lower / half - (s.sum(-2) - lower) / (n - half))


def share(hit: np.ndarray) -> np.ndarray:
    return hit.sum(-2, dtype=np.int16) / hit.shape[-2]


def decline(s: np.ndarray, flat: float = -1.0, decline: float = -2.0, gap: float = 3.0) -> dict[str, np.ndarray]:
    return {
        "prolonged_nonprogression": (share(s >= decline) >= 0.8) & (s.mean(-2) >= flat),
        "linear_decline": share(s < decline) >= 0.8,
        "nonlinear": halves_apart(s) > gap,
    }


def increase(s: np.ndarray, flat: float = 0.5, decline: float = 1.0, gap: float = 2.0) -> dict[str, np.ndarray]:
    return {
        "prolonged_nonprogression": (share(s <= decline) >= 0.8) & (s.mean(-2) <= flat),
        "linear_decline": share(s > decline) >= 0.8,
        "nonlinear": halves_apart(s) > gap,
    }


def four_class(s: np.ndarray, flat: float = -0.3, decline: float = -1.5, gap: float = 1.0, aging: float = -0.5) -> dict[str, np.ndarray]:
    return {
        "prolonged_nonprogression": (share(s >= aging) >= 0.8) & (s.mean(-2) >= flat),
        "slow_linear_decline": share((s >= decline) & (s < aging)) >= 0.8,
        "fast_linear_decline": share(s < decline) >= 0.8,
        "nonlinear": halves_apart(s) > gap,
    }
