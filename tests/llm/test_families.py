"""A family of near copies that is one component already costs a few rows a set, whatever its size."""

import numpy as np
import pytest

from driftline.llm import minhash_dedup as md


def family(spark, n, outsiders, seed=3):
    """rep, root, tokens: n sets of one component that share nine of ten tokens with a centre, and some of their own components."""
    rng = np.random.default_rng(seed)
    centre = rng.integers(0, 1 << 16, md.TOKENS)
    rows = []
    for i in range(n + outsiders):
        own = np.where(rng.random(md.TOKENS) < (0.1 if i < n else 0.4), rng.integers(0, 1 << 16, md.TOKENS), centre).astype(np.uint16)
        rows.append((i, 0 if i < n else i, bytearray(own.tobytes())))
    return spark.createDataFrame(rows, "rep long, root long, tokens binary")


@pytest.fixture(scope="module")
def counted(spark):
    made = {}
    for n in (200, 1600):
        sets = md.staged(family(spark, n, 4), "family")
        small, whole = md.leaves(sets, range(2, 5), 16)
        made[n] = (sets, small if whole is None else small.unionByName(whole))
    return made


def test_rows_grow_with_the_family(counted):
    few, many = (counted[n][1].count() for n in (200, 1600))
    assert many <= 1.5 * 8 * few and many <= 40 * 1600


def test_connected_copies_give_no_clusters(counted):
    sets, nodes = counted[200]
    found = md.clusters(nodes, sets).collect()
    assert all(r["rep"] >= 0 for r in found)
    by = {}
    for r in found:
        by.setdefault(r["cluster"], set()).add(0 if r["rep"] < 200 else r["rep"])
    assert all(len(v) > 1 for v in by.values())
