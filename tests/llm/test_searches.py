"""Neighbour graph, lexical search and whitening against brute force: whole tables, then nulls, ties, copies, empty tables, clashing names."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from driftline.llm import lexical_search, neighbour_graph, whitening

SF = "/root/testdata/sf0.1"
VECTORS = "vec_id long, embedding array<float>, label int, x string, node string, unit string, q string, score string"


def vector_rows(spark, rows):
    return spark.createDataFrame([(i, v, 0, None, None, None, None, None) for i, v in rows], VECTORS)


@pytest.fixture(scope="module")
def odd_vectors(spark):
    """Nulls, non-finite and zero entries, another length, one vector for a third of the rows, scaled copies, repeated rows, a null id."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)]
    hot = rng.normal(size=8).tolist()
    rows += [(i, hot) for i in range(400, 600)]
    rows += [(600, None), (601, []), (602, [float("nan")] + [1.0] * 7), (603, [float("inf")] * 8), (604, [None] + [1.0] * 7), (605, [0.0] * 8), (606, [1.0, 2.0]), (None, rows[5][1])]
    rows += [(650, rows[7][1]), (650, rows[7][1]), (651, [2 * c for c in rows[8][1]]), (700, [1e-30] * 8), (750, [3e30] * 8)]
    return rows


def brute(rows, picked, top=5):
    """Per query id the (score, id) of its nearest rows, in double precision."""
    kept = [(i, np.array(np.float32(v), float)) for i, v in rows if i is not None and v and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)]
    v = np.array([x for _, x in kept])
    v = v / np.abs(v).max(1, keepdims=True)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    out = {}
    for k, (i, _) in enumerate(kept):
        if picked(i):
            s = u @ u[k]
            out[i] = sorted((-round(float(s[j]), 9), kept[j][0]) for j in range(len(kept)) if j != k)[:top]
    return out


def test_neighbours_of_odd_vectors(spark, odd_vectors):
    rows = neighbour_graph.rows_of(vector_rows(spark, odd_vectors), "vec_id", "embedding")
    index = neighbour_graph.build(rows)
    found = neighbour_graph.search(index, rows, neighbour_graph.F.col("id") % 50 == 0).collect()
    want = brute(odd_vectors, lambda i: i % 50 == 0)
    got = {}
    for r in found:
        got.setdefault(r["query_id"], []).append((r["rank"], -round(r["score"], 9), r["vec_id"]))
    assert set(got) == set(want)
    hits = 0
    for q, best in want.items():
        assert [k for k, _, _ in sorted(got[q])] == [1, 2, 3, 4, 5]
        hits += len({i for _, _, i in got[q]} & {i for _, i in best})
    assert hits >= 0.95 * 5 * len(want)
    for q in (400, 450, 500, 550):  # copies of the hot vector: the smallest other ids
        assert [i for _, _, i in sorted(got[q])] == [i for i in range(400, 406) if i != q][:5]
    assert [i for _, _, i in sorted(got[650])][:2] == [7, 650]


@pytest.mark.parametrize("n", [0, 1, 3])
def test_fewer_vectors_than_asked_for(spark, n):
    rows = neighbour_graph.rows_of(vector_rows(spark, [(50 * i, [1.0 * i + 1, 2.0]) for i in range(n)]), "vec_id", "embedding")
    found = neighbour_graph.search(neighbour_graph.build(rows), rows, neighbour_graph.F.col("id") % 50 == 0).collect()
    assert len(found) == n * (n - 1)


def test_neighbour_recall(spark):
    rows = neighbour_graph.op11_neighbour_graph(spark, SF).toPandas()
    table = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    want = brute([(i, list(v[:8])) for i, v in zip(table["vec_id"], table["embedding"])], lambda i: False)
    assert want == {}
    x = np.stack(table["embedding"]).astype(float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    at = {int(i): k for k, i in enumerate(table["vec_id"])}
    hits = total = 0
    for q, own in rows.groupby("query_id"):
        s = u @ u[at[q]]
        assert np.allclose(own["score"], s[[at[i] for i in own["vec_id"]]], atol=1e-12) and q not in set(own["vec_id"]) and own.sort_values("rank")["score"].is_monotonic_decreasing
        s[at[q]] = -9
        hits += (own["score"] >= np.sort(s)[-5] - 1e-12).sum()
        total += 5
    assert total == 5 * sum(i % 50 == 0 for i in at) and hits >= 0.9 * total


DOCS = "doc_id long, text string, n long, at string, tf string, score string, item string, id string"


def plain_search(docs, items, top=10):
    """(item row, rank, doc_id, score) by the contract's words."""
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    known = [(d, Counter(terms(t))) for d, t in docs]
    known = [(d, c) for d, c in known if c]
    n, length = len(known), sum(sum(c.values()) for _, c in known)
    df = Counter(t for _, c in known for t in c)
    out = []
    for item, text in items:
        rows = []
        for d, c in known:
            m = 25 + (75 * sum(c.values()) * n) // length
            score = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t, k in Counter(terms(text)).items() if c[t])
            if score > 0:
                rows.append((-score, d is None, d or 0, d))
        out += [(item, k + 1, r[3], -r[0]) for k, r in enumerate(sorted(rows, key=lambda r: r[:3])[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_lexical_search_on_edges(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(lexical_search, "LEAF_DOCS", 3)
    monkeypatch.setattr(lexical_search, "TREE_DOCS", 64)
    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)] + ["É", "é", "日本", "Ab3", "aB3"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 40)))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, " .,; "), (None, docs[3][1]), (303, docs[3][1]), (303, docs[3][1]), (304, "w1," * 20_000), (305, "w2\x00W2 w3")]
    items = [(1, "w1 w2 w2 é"), (2, None), (3, "..."), (4, "nowhere"), (5, docs[3][1]), (5, docs[3][1]), (None, "AB3 日本 w59"), (6, " ".join(words))]
    table = spark.createDataFrame([(*d, *[None] * 6) for d in docs], DOCS).repartition(3)
    found = lexical_search.search(table, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    assert sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found.collect()), key=str) == plain_search(docs, items)


def test_lexical_search_of_nothing(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    none = spark.createDataFrame([], DOCS)
    assert lexical_search.search(none, items).count() == 0
    assert lexical_search.search(spark.createDataFrame([(1, "a", *[None] * 6)], DOCS), items.limit(0)).count() == 0


def test_bounds_hold_for_every_document():
    rng = np.random.default_rng(0)
    dims, size = 300, 500
    weight = rng.integers(0, 9000, dims)
    weight[0] = 0
    lengths = rng.integers(1, 60, size)
    at = np.concatenate([rng.choice(np.arange(1, dims), k, replace=False) for k in lengths])
    value = rng.integers(1, 1_000_000, lengths.sum())
    tree = lexical_search.BallTree(np.arange(size), np.zeros(size, bool), lexical_search.spans(lengths), at, value, weight)
    for _ in range(20):
        own, count = rng.choice(np.arange(1, dims), 12, replace=False), rng.integers(1, 4, 12)
        bounds = tree.bounds(own, count)
        q = np.zeros(dims, np.int64)
        q[own] = count * weight[own]
        score = np.array([q[tree.at[a:b]] @ tree.value[a:b] for a, b in zip(tree.ends, tree.ends[1:])])
        for node in range(len(bounds)):
            level = (node + 1).bit_length() - 1
            ends = tree.halves(size, level)
            lo, hi = ends[node + 1 - (1 << level)], ends[node + 2 - (1 << level)]
            assert bounds[node] >= score[lo:hi].max()


def test_whitening_is_numpys(spark):
    rows = whitening.op13_whitening(spark, SF).toPandas().sort_values(["vec_id", "component"])
    table = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().sort_values("vec_id")
    x = np.floor(np.stack(table["embedding"]).astype(float) * 64).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    z = fit - sums / n
    values, vectors = np.linalg.eigh(z.T @ z / n)
    values, vectors = values[::-1][:16], vectors[:, ::-1][:, :16]
    want = (x - sums / n) @ vectors / np.sqrt(values)
    got = rows["whitened"].to_numpy().reshape(-1, 16)
    assert np.allclose(got * np.sign((got * want).sum(0)), want, atol=1e-8)
    assert (rows["deviation"].to_numpy().reshape(-1, 16) == ((n * x - sums) ** 2).sum(1)[:, None]).all() and set(rows["n"]) == {n}
    assert np.allclose(rows["explained"].to_numpy()[:16], values / np.trace(z.T @ z / n), rtol=1e-10) and rows["identity_error"].max() < 1e-10


def test_whitening_of_odd_vectors(spark, odd_vectors):
    rows = whitening.points(vector_rows(spark, odd_vectors), "embedding", "vec_id")
    model = whitening.fit(rows)
    kept = [(i, v) for i, v in odd_vectors if v and len(v) == 8 and None not in v and np.isfinite(v).all()]
    made = whitening.whitened(rows, model, "vec_id").collect()
    assert len(made) == len(kept) * len(model.values) and {r["vec_id"] for r in made} == {i for i, _ in kept}
    exact = {(i, tuple(math.floor(min(max(64 * float(np.float32(c)), -(2.0**53)), 2.0**53)) + 1_000_000 for c in v)) for i, v in kept}
    points = {p for _, p in exact}
    assert model.n == len(points) and model.sums == [sum(p[k] for p in points) for k in range(8)]
    for r in made:
        sizes = {sum((model.n * p[k] - model.sums[k]) ** 2 for k in range(8)) for i, p in exact if i == r["vec_id"]}
        assert r["deviation"] in sizes or (r["deviation"] is None and max(sizes) >= 1 << 63)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_whitening_without_variance(spark, rows):
    made = whitening.points(vector_rows(spark, rows), "embedding", "vec_id")
    assert whitening.whitened(made, whitening.fit(made), "vec_id").count() == 0


def test_slices_of_hard_spectra():
    q, _ = np.linalg.qr(np.random.default_rng(2).normal(size=(40, 40)))
    for values in ([5, 5, 5, 4, 4 - 1e-13, 3, 3 - 1e-9, 2] + [1] * 32, [1] * 40, [7, 1e-9] + [0] * 38, list(range(40, 0, -1))):
        v = (q * np.array(values, float)) @ q.T
        e, u = whitening.Spectrum(v).leading(16)
        assert len(e) == min(16, sum(x > 1e-12 for x in values)) and np.allclose(e, sorted(values, reverse=True)[: len(e)], atol=1e-11)
        assert np.allclose(u.T @ u, np.eye(len(e)), atol=1e-12) and np.allclose(v @ u, u * e, atol=1e-11)
        for shift in (0.5, 2.5, 4.0000001):
            assert whitening.positives(v - shift * np.eye(40)) == sum(x > shift for x in values)
