"""Approximate nearest neighbours by cosine: NN-descent builds a neighbour graph, queries walk it greedily.

Equal vectors are one node, so that thousands of copies do not fill each other's lists. A node starts with neighbours from a random deal and
from chunks of nodes in the order of random hyperplanes' signs. A round of NN-descent then joins neighbours of neighbours: every
node gathers some of its neighbours and of those that it is a neighbour of (new ones and old ones apart), with their vectors, compares
each new one with all of them, and offers what is nearer than their farthest. Rounds end when few lists change.

A query starts from its own node, or from the best of a bounded sample of nodes, and keeps a pool of the nearest nodes seen. Each step
expands the nearest ones not yet expanded of every query at once, as joins, until no pool has any. The pool's nodes are then
scored on the original vectors in double precision, and their rows are listed.

Vectors travel as half floats of unit length; every step is written to the shared folder and the one before is deleted. No task
holds a node's incoming links with their vectors: those beyond ``SAMPLE`` are left to other rounds, as NN-descent has it.

Edges: vectors that are null, empty, zero, or hold null or non-finite entries take no part, nor do those of another length than the
most common one or without a key. Rows that repeat a key are rows of their own; a query leaves out one row of its own key and vector.
Of rows with equal vectors the smallest keys count. Fewer candidates than asked for are all returned. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, grouped, least_by_hash, matched, slices, staged, table
from .whitening import usable

#: Neighbours of a node, and how many new and old ones of either direction meet in a round.
DEGREE, SAMPLE = 32, 10
#: Orders by hyperplanes that first neighbours come from, signs in an order, nodes of a chunk, and nodes of a random deal's chunk.
ORDERS, SIGNS, CHUNK, DEAL = 6, 30, 512, 16
#: Rounds at most, and the share of list places whose change keeps them going.
ROUNDS, CHANGE = 12, 0.02
#: A query's pool, how many of it are expanded at once, and the sampled nodes that a query may start from.
POOL, EXPAND, ENTRIES = 200, 64, 256
#: Queries whose vectors are broadcast at once.
BLOCK = 1 << 16
TOP = 5

GRAPH = "node long, unit binary, vs array<long>, sims array<float>, fresh array<boolean>, pick array<byte>, added int"


def rows_of(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id and v, the original vector, of rows that take part."""
    fine = usable(F.col("v").cast("array<double>")) & F.exists("v", lambda c: c != 0)
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where(fine & F.col("id").isNotNull())
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("v") == (lengths[0]["d"] if lengths else 0))


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that squares neither overflow nor vanish."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1])


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)


def halves(units: list[bytes]) -> np.ndarray:
    """Stored unit vectors as rows of floats."""
    return np.frombuffer(b"".join(units), np.float16).astype(np.float32).reshape(len(units), -1 if units else 0)


def with_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 1024):
            if part.num_rows:
                column = part.column("v")
                v = scaled(matrix(column, len(column.flatten()) // len(column)))
                v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float16)
                yield pa.RecordBatch.from_arrays([column, part.column("ids"), pa.array([r.tobytes() for r in v], pa.binary())], ["v", "ids", "unit"])


def nodes_of(rows: DataFrame, top: int = TOP) -> DataFrame:
    """node, v, ids, unit: each distinct vector with the smallest ``top`` + 1 ids of its rows. Copies are cut down before they are shuffled."""
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = rows.withColumn("place_", place).where(F.col("place_") <= top + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    kind = rows.select("v").dtypes[0][1]
    made = few.select("v", "ids").mapInArrow(with_unit, f"v {kind}, ids array<long>, unit binary")
    return staged(made.select(F.monotonically_increasing_id().alias("node"), "v", "ids", "unit"), "ann-nodes")


def nested(keys: np.ndarray, columns: list[np.ndarray], kinds: list[pa.DataType]) -> tuple[np.ndarray, list[pa.Array]]:
    """Distinct keys of sorted ``keys``, and each column's values by key as lists."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    ends = pa.array(np.append(starts, len(keys)), pa.int32())
    return keys[starts], [pa.ListArray.from_arrays(ends, pa.array(c, k)) for c, k in zip(columns, kinds)]


def nearest_in(ids: np.ndarray, x: np.ndarray, k: int) -> pa.RecordBatch:
    """node, vs, sims: the k nearest others of each node of a chunk."""
    sims = x @ x.T
    np.fill_diagonal(sims, -2.0)
    k = min(k, len(ids) - 1)
    best = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k else np.zeros((len(ids), 0), int)
    _, lists = nested(np.repeat(np.arange(len(ids)), k), [ids[best].ravel(), np.take_along_axis(sims, best, 1).ravel()], [pa.int64(), pa.float32()])
    return pa.RecordBatch.from_arrays([pa.array(ids if k else ids[:0]), *lists], ["node", "vs", "sims"])


def first_neighbours(nodes: DataFrame, n: int, degree: int) -> DataFrame:
    """node, vs, sims from chunks of the nodes in several orders at once: by random signs, and (order 0) dealt by hash."""

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, node = halves(batch.column("unit").to_pylist()), batch.column("node").to_numpy().astype(np.uint64)
            with np.errstate(over="ignore"):
                mixed = (node + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(x), np.int32)), pa.array(((mixed ^ mixed >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(2)).astype(np.int64)), batch.column("node"), batch.column("unit")], ["turn", "code", "node", "unit"])
            for order in range(1, ORDERS + 1):
                signs = x @ np.random.default_rng(order).standard_normal((x.shape[1], SIGNS)).astype(np.float32) > 0
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), order, np.int32)), pa.array(signs @ (1 << np.arange(SIGNS, dtype=np.int64))), batch.column("node"), batch.column("unit")], ["turn", "code", "node", "unit"])

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches):
            order, ids, units = part.column("turn")[0].as_py(), part.column("node").to_numpy(), part.column("unit").to_pylist()
            size = CHUNK if order else DEAL
            starts = list(range(0, max(1, len(ids) - size + 1), size))
            if starts[-1] + size < len(ids):  # the rest, with some of the chunk before
                starts.append(len(ids) - size)
            for at in starts:
                yield nearest_in(ids[at : at + size], halves(units[at : at + size]), degree // 2 if order else degree)

    coded = nodes.select("node", "unit").mapInArrow(codes, "turn int, code long, node long, unit binary")
    dealt = coded.repartitionByRange(max(1, (ORDERS + 1) * n // (16 * CHUNK)), "turn", "code").sortWithinPartitions("turn", "code", "node")
    return dealt.mapInArrow(chunks, "node long, vs array<long>, sims array<float>")


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one order in a row, 32 chunks at most at once."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        ends = np.flatnonzero(np.diff(batch.column("turn").to_numpy())) + 1 if batch.num_rows else []
        for at, end in zip([0, *ends], [*ends, batch.num_rows]):
            part = batch.slice(at, end - at)
            if held and (not part.num_rows or held[-1].column("turn")[0] != part.column("turn")[0] or sum(x.num_rows for x in held) >= 32 * CHUNK):
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held += [part] if part.num_rows else []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def rank_in_runs(keys: np.ndarray) -> np.ndarray:
    """Places within runs of equal keys, from 0."""
    starts = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
    return np.arange(len(keys)) - np.maximum.accumulate(np.where(starts, np.arange(len(keys)), 0))


def nearest_lists(u: np.ndarray, v: np.ndarray, s: np.ndarray, late: np.ndarray, most: int) -> np.ndarray:
    """Places of each u's ``most`` nearest distinct v, nearest first. Of equal pairs one counts that is not ``late``."""
    keep = np.lexsort((late, v, u))
    same = np.zeros(len(keep), bool)
    same[1:] = (u[keep][1:] == u[keep][:-1]) & (v[keep][1:] == v[keep][:-1])
    keep = keep[~same]
    keep = keep[np.lexsort((v[keep], -s[keep], u[keep]))]
    return keep[rank_in_runs(u[keep]) < most]


def lists_of(part: pa.Table, *names: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Lengths of the rows' lists, and the lists of each name end to end."""
    lists = [part.column(c).combine_chunks() for c in names]
    return lists[0].value_lengths().to_numpy(zero_copy_only=False), [x.flatten().to_numpy(zero_copy_only=False) for x in lists]


def merged(graph: DataFrame, offers: DataFrame, degree: int, sample: int, turn: int) -> DataFrame:
    """The graph with the nearest of each node's list and what it was offered, and the picks of the next round.

    ``pick``: 1 for new neighbours that meet in the next round, 2 for old ones, dealt by hash; what was picked before is old now.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in grouped(batches, "node"):
            own = part.column("unit").is_valid().to_numpy()
            lengths, (v, s, fresh, pick) = lists_of(part, "vs", "sims", "fresh", "pick")
            u, offered = np.repeat(part.column("node").to_numpy(), lengths), np.repeat(~own, lengths)
            fresh = fresh.astype(bool) & (pick != 1)
            keep = nearest_lists(u, v, s, offered, degree)
            u, v, s, fresh, offered = u[keep], v[keep], s[keep], fresh[keep], offered[keep]
            with np.errstate(over="ignore"):
                mixed = (u.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ v.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) ^ np.uint64(turn + 1)) * np.uint64(0xD6E8FEB86659FD93)
            order = np.lexsort((mixed >> np.uint64(20), ~fresh, u))
            picked = np.empty(len(u), bool)
            picked[order] = rank_in_runs(u[order] * 2 + fresh[order]) < sample
            ids, units = part.column("node").filter(pa.array(own)), part.column("unit").filter(pa.array(own))
            at = np.searchsorted(u, np.append(ids.to_numpy(), np.iinfo(np.int64).max))
            ends = pa.array(at, pa.int32())
            added = np.concatenate([[0], np.cumsum(offered)])
            values = [pa.array(v), pa.array(s, pa.float32()), pa.array(fresh), pa.array(np.where(picked, np.where(fresh, 1, 2), 0), pa.int8())]
            columns = [pa.ListArray.from_arrays(ends, x) for x in values]
            yield from pa.table([ids, units, *columns, pa.array((added[at[1:]] - added[at[:-1]]).astype(np.int32))], ["node", "unit", "vs", "sims", "fresh", "pick", "added"]).combine_chunks().to_batches()

    n = F.size("vs")
    offers = offers.select("node", F.lit(None).cast("binary").alias("unit"), "vs", "sims", F.array_repeat(F.lit(True), n).alias("fresh"), F.array_repeat(F.lit(0).cast("byte"), n).alias("pick"))
    both = graph.select(*offers.columns).unionByName(offers).repartition("node").sortWithinPartitions("node")
    return staged(both.mapInArrow(run, GRAPH), "ann-graph")


def meetings(graph: DataFrame, sample: int, turn: int) -> DataFrame:
    """c, x, pick: who meets at node c: its picked neighbours, and ``sample`` at most of either kind of those that picked it."""
    picked = graph.select("node", F.explode(F.arrays_zip("vs", "pick")).alias("e")).select("node", F.col("e.vs").alias("v"), F.col("e.pick").alias("pick")).where("pick > 0")
    back = picked.select(F.col("v").alias("c"), F.col("node").alias("x"), "pick")
    place = F.row_number().over(Window.partitionBy("c", "pick").orderBy(F.xxhash64("x", F.lit(turn)), "x"))
    back = back.withColumn("place_", place).where(F.col("place_") <= sample).drop("place_")
    return picked.select(F.col("node").alias("c"), F.col("v").alias("x"), "pick").unionByName(back)


def offers(graph: DataFrame, degree: int, sample: int, turn: int) -> DataFrame:
    """node, vs, sims: of the nodes that meet, pairs with a new one that are nearer than the farthest in their lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in grouped(batches, "c"):
            c = part.column("c").to_numpy()
            new = part.column("pick").to_numpy() == 1
            starts = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
            group = np.cumsum(np.concatenate([[0], c[1:] != c[:-1]]))
            live = np.bitwise_or.reduceat(new, starts)[group]  # nothing new, nothing to compare
            if not live.any():
                continue
            x, worst = part.column("x").to_numpy()[live], part.column("worst").to_numpy()[live]
            units, new, group = halves(part.column("unit").filter(pa.array(live)).to_pylist()), new[live], group[live]
            group = np.unique(group, return_inverse=True)[1]
            for first in range(0, int(group[-1]) + 1, 1024):
                some = slice(*np.searchsorted(group, [first, first + 1024]))
                g, slot = group[some] - first, rank_in_runs(group[some])
                shape = (int(g[-1]) + 1, int(slot.max()) + 1)
                vectors = np.zeros((*shape, units.shape[1]), np.float32)
                ids, far, fresh = np.full(shape, -1), np.full(shape, 4.0, np.float32), np.zeros(shape, bool)
                vectors[g, slot], ids[g, slot], far[g, slot], fresh[g, slot] = units[some], x[some], worst[some], new[some]
                sims = vectors @ vectors.transpose(0, 2, 1)
                pair = (ids[:, None, :] >= 0) & (ids[:, :, None] != ids[:, None, :]) & (fresh[:, :, None] | fresh[:, None, :]) & (sims > far[:, :, None])
                a, i, j = np.nonzero(pair)
                if len(a):
                    starts, lists = nested(a * shape[1] + i, [ids[a, j], sims[a, i, j]], [pa.int64(), pa.float32()])
                    yield pa.RecordBatch.from_arrays([pa.array(ids.ravel()[starts]), *lists], ["node", "vs", "sims"])

    held = graph.select(F.col("node").alias("x_"), "unit", F.when(F.size("sims") < degree, F.lit(-2.0)).otherwise(F.array_min("sims")).cast("float").alias("worst"))
    joined = meetings(graph, sample, turn).join(held, F.col("x") == F.col("x_")).select("c", "x", "pick", "unit", "worst")
    return joined.repartition("c").sortWithinPartitions("c").mapInArrow(run, "node long, vs array<long>, sims array<float>")


@dataclass
class Index:
    """nodes (node, v, ids, unit) and graph (node, unit, vs, sims, ...), both stored."""

    nodes: DataFrame
    graph: DataFrame
    rounds: int = 0

    def drop(self) -> None:
        discard(self.nodes, self.graph)


def build(rows: DataFrame, degree: int = DEGREE, sample: int = SAMPLE, rounds: int = ROUNDS, change: float = CHANGE, top: int = TOP) -> Index:
    """The neighbour graph of all distinct vectors of ``rows`` (id, v)."""
    nodes = nodes_of(rows, top)
    n = nodes.count()
    empty = [F.array().cast(f"array<{k}>").alias(c) for c, k in (("vs", "long"), ("sims", "float"), ("fresh", "boolean"), ("pick", "byte"))]
    bare = nodes.select("node", "unit", *empty)
    graph, done = merged(bare, first_neighbours(nodes, n, degree), degree, sample, 0), 0
    for turn in range(1, rounds + 1):
        now = merged(graph, offers(graph, degree, sample, turn), degree, sample, turn)
        discard(graph)
        graph, done = now, turn
        if (graph.agg(F.sum("added")).first()[0] or 0) <= change * degree * n:
            break
    return Index(nodes, graph, done)


STATE = "q long, vs array<long>, sims array<float>, done array<boolean>, front array<long>, worst float"


def advanced(rows: DataFrame, pool: int, expand: int) -> DataFrame:
    """Pools with what they were offered: the nearest ``pool`` nodes of a query, and as ``front`` the first that are yet to be expanded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in grouped(batches, "q"):
            lengths, (v, s, done) = lists_of(part, "vs", "sims", "done")
            u, done = np.repeat(part.column("q").to_numpy(), lengths), done.astype(bool)
            keep = nearest_lists(u, v, s, ~done, pool)
            u, v, s, done = u[keep], v[keep], s[keep], done[keep]
            front = np.zeros(len(u), bool)
            front[~done] = rank_in_runs(u[~done]) < expand
            ids, lists = nested(u, [v, s, done | front], [pa.int64(), pa.float32(), pa.bool_()])
            ends = np.append(np.searchsorted(u, ids), len(u))
            cut = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(front)])[ends], pa.int32()), pa.array(v[front]))
            worst = np.where(ends[1:] - ends[:-1] < pool, np.float32(-2), s[ends[1:] - 1])
            yield pa.RecordBatch.from_arrays([pa.array(ids), *lists, cut, pa.array(worst, pa.float32())], [c.split()[0] for c in STATE.split(", ")])

    return staged(rows.select("q", "vs", "sims", "done").repartition("q").sortWithinPartitions("q").mapInArrow(run, STATE), "ann-pools")


def pools(index: Index, queries: DataFrame, pool: int = POOL, expand: int = EXPAND, entries: int = ENTRIES) -> DataFrame:
    """q, vs: the nearest nodes that greedy search finds for a block of ``queries`` (q, unit, node: where it starts, or null)."""
    sampled = least_by_hash(index.graph.select("node", "unit"), entries, "node").collect()
    asked = queries.select("q", "unit").orderBy("q").collect()  # BLOCK rows at most
    send = queries.sparkSession.sparkContext.broadcast
    starts, units = send(([r["node"] for r in sampled], [bytes(r["unit"]) for r in sampled])), send((np.array([r["q"] for r in asked]), [bytes(r["unit"]) for r in asked]))

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = np.array(starts.value[0], np.int64), halves(starts.value[1])
        for batch in batches:
            if not batch.num_rows:
                continue
            sims = halves(batch.column("unit").to_pylist()) @ x.T
            best = np.argsort(-sims, 1, kind="stable")[:, :expand]
            own = batch.column("node").is_valid().to_numpy(zero_copy_only=False)
            v = np.column_stack([batch.column("node").fill_null(-1).to_numpy(), ids[best]])
            s = np.column_stack([np.ones(len(v)), np.take_along_axis(sims, best, 1)])
            there = np.column_stack([own, np.ones(best.shape, bool)])
            _, lists = nested(np.nonzero(there)[0], [v[there], s[there], np.zeros(there.sum(), bool)], [pa.int64(), pa.float32(), pa.bool_()])
            yield pa.RecordBatch.from_arrays([batch.column("q"), *lists], ["q", "vs", "sims", "done"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = units.value
        x, held = halves(x), []

        def offered() -> pa.RecordBatch:
            q, v, sims = (np.concatenate(c) for c in zip(*held))
            order = np.argsort(q, kind="stable")
            own, lists = nested(q[order], [v[order], sims[order], np.zeros(len(q), bool)], [pa.int64(), pa.float32(), pa.bool_()])
            return pa.RecordBatch.from_arrays([pa.array(own), *lists], ["q", "vs", "sims", "done"])

        for batch in batches:
            if batch.num_rows:
                q = batch.column("q").to_numpy()
                sims = np.einsum("ij,ij->i", x[np.searchsorted(ids, q)], halves(batch.column("unit").to_pylist()))
                keep = sims > batch.column("worst").to_numpy()
                held.append((q[keep], batch.column("node").to_numpy()[keep], sims[keep]))
            if sum(len(h[0]) for h in held[-256:]) >= 1 << 18 or len(held) >= 256:
                yield offered()
                held = []
        if held:
            yield offered()

    lists = "q long, vs array<long>, sims array<float>, done array<boolean>"
    state = advanced(queries.select("q", "unit", "node").mapInArrow(begin, lists), pool, expand)
    while not (frontier := state.where(F.size("front") > 0).select("q", "worst", F.explode("front").alias("at_"))).isEmpty():
        links = staged(frontier.join(index.graph.select("node", "vs"), F.col("node") == F.col("at_")).select("q", "worst", F.explode("vs").alias("v_")).distinct(), "ann-links")
        found = links.join(index.graph.select("node", "unit"), F.col("node") == F.col("v_")).select("q", "worst", "node", "unit").mapInArrow(near, lists)
        now = advanced(state.select("q", "vs", "sims", "done").unionByName(found), pool, expand)
        discard(state, links)
        state = now
    return state


def scored(index: Index, found: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """q, id, score, own (of the query's own node): the first ``top`` + 1 rows by exact cosine among the nodes of each pool. ``queries``: q, v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in grouped(batches, "q"):
            q, kind = part.column("q").to_numpy(), part.column("kind").to_numpy()
            column = part.column("v").combine_chunks()
            v = scaled(matrix(column, len(column.flatten()) // len(column)))
            length, own, ids = np.sqrt((v * v).sum(1)), np.flatnonzero(kind == 0), part.column("ids").to_pylist()
            node, out_q, out = part.column("node").to_pylist(), [], []
            for at, end in zip(own, [*own[1:], len(q)]):
                score = (v[at + 1 : end] * v[at]).sum(1) / (length[at + 1 : end] * length[at])
                rows = sorted((-float(s), i, node[k] == q[at]) for s, k in zip(score, range(at + 1, end)) for i in ids[k])[: top + 1]
                out_q += [int(q[at])] * len(rows)
                out += rows
            score, found_ids, same = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(found_ids, pa.int64()), pa.array(-np.array(score, float)), pa.array(same, pa.bool_())], ["q", "id", "score", "own"])

    pairs = staged(found.select("q", F.explode("vs").alias("at_")), "ann-pairs")
    there = matched(index.nodes.select("node", "v", "ids"), "node", pairs, "at_").select("q", F.lit(1).alias("kind"), "node", "v", "ids")
    asked = queries.select("q", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("node"), "v", F.lit(None).cast("array<long>").alias("ids"))
    made = staged(asked.unionByName(there).repartition("q").sortWithinPartitions("q", "kind", "node").mapInArrow(run, "q long, id long, score double, own boolean"), "ann-scores")
    discard(pairs)
    return made


def search(index: Index, rows: DataFrame, asked: Column, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest ``top`` rows of each indexed row that ``asked`` (of id) picks, its own row left out."""
    some = rows.where(asked).select(F.col("id").alias("query_id"), F.col("v").alias("v_"))
    some = staged(some.join(index.nodes.select("v", "node"), F.col("v_") == F.col("v")).select("query_id", F.col("node").alias("of_")).distinct(), "ann-queries")
    kinds = staged(some.select(F.col("of_").alias("asked_")).distinct(), "ann-query-nodes")
    queries = staged(matched(index.nodes.select("node", "unit", "v"), "node", kinds, "asked_").select(F.col("node").alias("q"), "unit", "node", "v"), "ann-query-vectors")
    blocks, best = max(1, -(-queries.count() // BLOCK)), None
    for b in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b)
        found = pools(index, block)
        rows_ = scored(index, found, block, top)
        best = rows_ if best is None else best.unionByName(rows_)
        discard(found)
    discard(queries, kinds)
    query = ("query_id", "of_")
    own = F.col("own") & (F.col("id") == F.col("query_id"))
    near = matched(some, "of_", best, "q").withColumn("own_", own)
    near = near.withColumn("copy_", F.row_number().over(Window.partitionBy(*query, "own_").orderBy("id"))).where(~F.col("own_") | (F.col("copy_") > 1))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy(*query).orderBy(F.desc("score"), "id"))).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op11_neighbour_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the five nearest rows of each row of ``embeddings`` whose id is divisible by 50."""
    rows = rows_of(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    index = build(rows)
    made = staged(search(index, rows, F.col("id") % 50 == 0), "ann-found")
    index.drop()
    return made
