"""Near-duplicates by a chosen-path set similarity join.

A document is the set of its word shingles, and its 128 minwise tokens stand for the set. Copies of a set are one set from
the start, whatever their number. Independent trees branch the distinct sets: a node picks one coordinate of the tokens by
its own hash, every fourth one two, and each set goes to the child that its token there names, so a pair of similarity
0.8 keeps about one common path a level. A tree's first two levels need no counts and are made at once.

The first ``FIRST_TREES`` trees go first: their nodes of at most ``NODE`` sets are compared exhaustively, larger ones in blocks,
each with the node's pivots, and confirmed links give first components. The other trees then count a node's sets and its
components: what one component has to itself is closed, since its links would join nothing. Of the open nodes small ones are
compared exhaustively and large ones branch on, until they are small, or few of their sets are outside the largest component, or
branching does not part them any more (``parted``).
Those are compared in full: the sets outside a node's largest component, in blocks, meet every block of the node.

Comparison first parts a node's sets by how many tokens agree across components, with a margin of four and a half standard deviations. What
is left are small clusters, mostly the same ones from all trees; each distinct cluster is compared once, on full sets read
again from the texts, and confirmed links that join it make edges. Links inside what is already connected need no edge, so
no group gives all its pairs. The edges' connected components are the classes.

Defined results: null and empty texts have no shingles and are linked with nothing. A null doc_id comes after all others
where the smallest id counts; a class of null ids alone has a null component_id. Rows that repeat an id are rows of their
own; of equal ids one row is kept. Very long texts are taken whole, as one set each. An empty table gives an empty result.
Extra columns, whatever their names, are ignored by ``near_duplicates`` and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, bounds, discard, free_name, grouped, looked_up, matched, only_rows, slices, staged, table, with_row_keys, without
from .components import components

#: Minwise tokens; trees, and those of them that go first; levels that are made at once; sets of a node that are compared exhaustively.
TOKENS, TREES, FIRST_TREES, LEVELS, NODE = 128, 10, 2, 2, 256
#: A large node branches on while its pairs across components are fewer than these shares of its parent's: of any node, and of one
#: that has at most WHOLE sets, so that comparing them in full costs less than further levels would.
STUCK, STUCK_WHOLE, WHOLE = 0.8, 0.5, 16_384
#: Pivots of a block; sets that two blocks of a large node make up together, in nodes' sizes.
PIVOTS, CROSSED = 8, 1
#: Least similarity in percent, and standard deviations of the estimate below it that are still compared.
PERCENT, DEVIATIONS = 80, 4.5

BASE = np.uint64(0x9FB21C651E98DF25)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


FACTORS = mix(np.arange(1, TOKENS + 1, dtype=np.uint64)) | np.uint64(1)
SHIFTS = mix(np.arange(TOKENS + 1, 2 * TOKENS + 1, dtype=np.uint64))


def powers(n: int) -> list[np.ndarray]:
    """Powers of BASE and of its inverse, n of them at least."""
    if len(_powers[0]) < n:
        size = 1 << int(n).bit_length()
        with np.errstate(over="ignore"):
            for k, base in enumerate((BASE, INVERSE)):
                steps = np.full(size, base)
                steps[0] = 1
                _powers[k] = np.cumprod(steps)
    return _powers


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles; of all its words if they are fewer."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    plain = b" ".join(words)
    codes = np.frombuffer(plain, np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(lengths[:-1] + 1)])
    ends = starts + lengths
    k = min(k, len(words))
    first, last = starts[: len(words) - k + 1], ends[k - 1 :]
    up, down = powers(len(codes) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)])])
        return np.unique(mix((sums[last] - sums[first]) * down[first]))


def minwise(hashes: np.ndarray) -> np.ndarray:
    """The least value of each of TOKENS hash functions over a set, 16 bits of it."""
    least = np.full(TOKENS, np.iinfo(np.uint32).max, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 2048):
            made = ((hashes[at : at + 2048, None] ^ SHIFTS) * FACTORS) >> np.uint64(32)
            np.minimum(least, made.min(0).astype(np.uint32), out=least)
    return least.astype(np.uint16)  # the high bits of a minimum are zeros


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """tag, doc_id, n, d1, d2, tokens: each document's set size, digest and minwise tokens. ``docs``: tag, doc_id, text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = [shingles(x, k) for x in as_bytes(part.column("text"))]
                with np.errstate(over="ignore"):
                    one = [int(mix(s).sum().astype(np.int64)) for s in sets]
                    two = [int(np.bitwise_xor.reduce(mix(s ^ BASE)).astype(np.int64)) if len(s) else 0 for s in sets]
                tokens = [minwise(s).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("tag"), part.column("doc_id"), pa.array(map(len, sets), pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(tokens, pa.binary())],
                    ["tag", "doc_id", "n", "d1", "d2", "tokens"],
                )

    return docs.select("tag", "doc_id", "text").mapInArrow(rows, "tag long, doc_id long, n long, d1 long, d2 long, tokens binary")


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, TOKENS)


def descend(node: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of nodes and the rows they hold; every fourth node branches on two coordinates."""
    pick = mix(node)
    one, two = (pick % np.uint64(TOKENS)).astype(np.int64), ((pick >> np.uint64(20)) % np.uint64(TOKENS)).astype(np.int64)
    twice = np.flatnonzero(((pick >> np.uint64(60)) < 4) & (one != two))
    row, at = np.concatenate([np.arange(len(node)), twice]), np.concatenate([one, two[twice]])
    with np.errstate(over="ignore"):
        return mix(node[row] + mix((at.astype(np.uint64) << np.uint64(32)) + tokens[row, at])), row


def paths(sets: DataFrame, trees: range, levels: int = LEVELS) -> DataFrame:
    """node, rep, root of the nodes after a tree's first levels, for ``sets`` (rep, root, tokens)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 4096):
                m, rep, root = matrix(part.column("tokens")), part.column("rep"), part.column("root")
                for t in trees:
                    node, row = mix(np.full(len(m), t + 1, np.uint64)), np.arange(len(m))
                    for _ in range(levels):
                        node, at = descend(node, m[row])
                        row = row[at]
                    yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), rep.take(pa.array(row)), root.take(pa.array(row))], ["node", "rep", "root"])

    return sets.select("rep", "root", "tokens").mapInArrow(rows, "node long, rep long, root long")


def branched(large: DataFrame, sets: DataFrame) -> DataFrame:
    """node, rep, root, above of the children of large nodes (node, rep, root, cross); ``above`` is the parent's cross."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 4096):
                node, row = descend(part.column("node").to_numpy().view(np.uint64), matrix(part.column("tokens")))
                rep, root, above = (part.column(c).take(pa.array(row)) for c in ("rep", "root", "cross"))
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), rep, root, above], ["node", "rep", "root", "above"])

    return with_tokens(large, sets).select("node", "rep", "root", "cross", "tokens").mapInArrow(rows, "node long, rep long, root long, above double")


def with_tokens(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """``rows`` (a stored table with a column rep) and each set's tokens. Of ``sets`` only what is wanted is shuffled."""
    return matched(sets.select(F.col("rep").alias("of_"), "tokens"), "of_", rows, "rep").drop("of_")


def members(rows: DataFrame, above: Column | None = None) -> DataFrame:
    """node, rep, root, n, above of the open nodes of ``rows`` (node, rep, root), stored.

    A node is open if it holds more than one component. Nodes of the same sets, which trees or parents give again, are there once.
    """
    sizes = rows.groupBy(F.col("node").alias("of")).agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.bit_xor(F.xxhash64("rep")).alias("same"), F.max(above if above is not None else F.lit(None).cast("double")).alias("above"))
    wanted = staged(sizes.where("lo < hi").groupBy("n", "lo", "hi", "same").agg(F.min("of").alias("of"), F.max("above").alias("above")).select("of", "n", "above"), "open-nodes")
    found = staged(matched(rows.select("node", "rep", "root"), "node", wanted, "of").drop("of"), "members")
    discard(wanted)
    return found


def blocks(large: DataFrame, most: int) -> DataFrame:
    """node, rep, root: blocks of half a node's size of the large nodes' sets, with the node's pivots in each. Each set is its own root."""
    order = [F.xxhash64("rep", "node", F.lit(i)) for i in range(PIVOTS)]
    pivots = large.groupBy(F.col("node").alias("of")).agg(F.max("n").alias("n_"), F.array(*[F.min_by("rep", o) for o in order]).alias("pivots"))
    count = lambda n: F.ceil(n / F.lit(max(most // 2 - PIVOTS, 1))).cast("int")
    own = large.select(F.xxhash64("node", F.pmod(F.xxhash64("rep", "node"), count(F.col("n")).cast("long"))).alias("node"), "rep")
    shared = pivots.select("of", F.explode(F.sequence(F.lit(0), count(F.col("n_")) - 1)).alias("block"), "pivots")
    shared = shared.select(F.xxhash64("of", F.col("block").cast("long")).alias("node"), F.explode("pivots").alias("rep"))
    return own.unionByName(shared).distinct().withColumn("root", F.col("rep"))


def outside(large: DataFrame) -> DataFrame:
    """of, n, giant, most: each node's size, its largest component, and how many sets that has."""
    by_root = large.groupBy("node", "root").agg(F.count("*").alias("n"))
    found = by_root.groupBy(F.col("node").alias("of")).agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n"))
    return found.select("of", "n", F.col("top.root").alias("giant"), F.col("top.n").alias("most"))


def crossed(large: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """node, rep, root that bring together all pairs of a large node's sets but those inside its largest component.

    The node's sets are dealt to blocks, and so are those outside its largest component (``sizes``, of ``outside``). Each
    block of the latter meets each of the former, once where the two are blocks of outsiders alone.
    """
    count = lambda n: F.ceil(n / F.lit(max(most // 2, 1))).cast("int")
    dealt = sizes.select(F.col("of").alias("at_"), "giant", count(F.col("most")).alias("inside"), count(F.col("n") - F.col("most")).alias("outside"))
    joined = large.select("node", "rep", "root").join(dealt, F.col("node") == F.col("at_"))
    inner = F.col("root") == F.col("giant")
    at = F.pmod(F.xxhash64("rep", "node", F.lit("block")), F.when(inner, F.col("inside")).otherwise(F.col("outside")).cast("long")).cast("int")
    every = F.sequence(F.lit(0), F.col("outside") - 1)
    within = F.concat(
        F.transform(every, lambda x: F.struct(F.least(x, F.col("at")).alias("a"), F.greatest(x, F.col("at")).alias("b"))),
        F.transform(F.sequence(F.lit(0), F.col("inside") - 1), lambda x: F.struct(F.col("at").alias("a"), (-1 - x).alias("b"))),
    )
    met = F.when(F.col("inner"), F.transform(every, lambda x: F.struct(x.alias("a"), (-1 - F.col("at")).alias("b")))).otherwise(within)
    pairs = joined.select("node", "rep", "root", inner.alias("inner"), "outside", "inside", at.alias("at")).select("node", "rep", "root", F.explode(met).alias("pair"))
    return pairs.select(F.xxhash64("node", "pair.a", "pair.b").alias("node"), "rep", "root")


def first_leaves(sets: DataFrame, trees: range, most: int) -> DataFrame:
    """node, rep, root to compare from trees whose large nodes are only compared in blocks."""
    found = members(paths(sets, trees))
    return found.where(F.col("n") <= most).select("node", "rep", "root").unionByName(blocks(found.where(F.col("n") > most), most))


def leaves(sets: DataFrame, trees: range, most: int) -> tuple[DataFrame, DataFrame | None]:
    """node, rep, root of all small open nodes, and of the blocks of nodes that branching does not part (None if there are none).

    A node with at most ``most`` sets outside its largest component does not branch on: comparing these with all of it takes some
    four rows a set, while branching would list a family of near copies again at every level.
    """
    small, whole = [], []
    found = members(paths(sets, trees))
    while True:
        small.append(found.where(F.col("n") <= most).select("node", "rep", "root"))
        large = found.where(F.col("n") > most)
        if large.isEmpty():
            break
        sizes = staged(outside(large), "large-nodes").withColumn("cross", F.col("n").cast("double") * (F.col("n") - F.col("most")))
        rows = large.drop("n").join(sizes.select("of", F.col("n"), "giant", "most", "cross"), F.col("node") == F.col("of")).drop("of")
        on = parted(F.col("n"), F.col("cross"), F.col("above")) & (F.col("n") - F.col("most") > most)
        rows = staged(rows.withColumn("parted", on).drop("most"), "large-members")
        if not rows.where("not parted").isEmpty():
            whole.append(rows.where("not parted").select("node", "rep", "root", "giant"))
        children = staged(branched(rows.where("parted"), sets), "paths")
        found = members(children, F.col("above"))
        discard(children)
    if not whole:
        return reduce(DataFrame.unionByName, small), None
    large = staged(merged(staged(reduce(DataFrame.unionByName, whole), "whole-nodes"), CROSSED * most), "merged-nodes")
    return reduce(DataFrame.unionByName, small), crossed(large, outside(large), CROSSED * most)


def merged(whole: DataFrame, most: int) -> DataFrame:
    """node, rep, root of the nodes ``whole`` (node, rep, root, giant), those of one largest component as one where that takes fewer rows to cross.

    Trees bring the same outsiders to the same family again and again; together they meet it once.
    """
    inner, half = F.col("root") == F.col("giant"), max(most // 2, 1)
    rows = lambda n, m: n * F.ceil((n - m) / half) + (n - m) * F.ceil(m / half)
    sizes = [F.count("*").alias("n"), F.count_if(inner).alias("m")]
    apart = whole.groupBy("node", "giant").agg(*sizes).groupBy("giant").agg(F.sum(rows(F.col("n"), F.col("m"))).alias("apart"))
    families = whole.select("giant", "rep", "root").distinct()
    together = families.groupBy("giant").agg(*sizes).select("giant", rows(F.col("n"), F.col("m")).alias("together"))
    fewer = staged(together.join(apart, "giant").where("together < apart").select(F.col("giant").alias("of")), "merged-families")
    on = F.col("giant") == F.col("of")
    one = families.join(fewer, on, "left_semi").select(F.xxhash64("giant", F.lit("family")).alias("node"), "rep", "root")
    return whole.join(fewer, on, "left_anti").select("node", "rep", "root").unionByName(one)


def parted(n: Column, cross: Column, above: Column) -> Column:
    """Whether branching has left a node so few of its parent's pairs across components that it should go on."""
    least = F.when(n <= WHOLE, STUCK_WHOLE).otherwise(STUCK)
    return F.coalesce(cross <= least * above, F.lit(True))


def roots_of(n: int, pairs: np.ndarray) -> np.ndarray:
    """The least member of each of n things' component under pairs."""
    label = np.arange(n)
    while len(pairs):
        a, b = label[pairs[:, 0]], label[pairs[:, 1]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        if (low == high).all():
            break
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
    return label


def clusters(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """cluster, rep, root: sets of a node (node, rep, root) that estimated similarities of different components connect.

    Similarities inside a component join nothing, so a family that is already connected gives no rows by itself. A cluster's
    name is a hash of its sets.
    """
    least = int(np.ceil(TOKENS * (PERCENT / 100 - DEVIATIONS * np.sqrt(PERCENT * (100 - PERCENT) / 1e4 / TOKENS))))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in grouped(batches, "node"):
            m, rep, own = matrix(part.column("tokens")), part.column("rep").to_numpy(), part.column("root").to_numpy()
            ends, names, reps, roots = bounds(part.column("node").to_numpy()), [], [], []
            for lo, hi in zip(ends[:-1], ends[1:]):
                near = [np.zeros((0, 2), int)]
                for at in range(lo, hi, 32):
                    i, j = np.nonzero(own[at : min(at + 32, hi), None] < own[None, lo:hi])  # each pair of different components once
                    for k in range(0, len(i), 8192):
                        a, b = i[k : k + 8192] + at - lo, j[k : k + 8192]
                        hit = (m[lo + a] == m[lo + b]).sum(1) >= least
                        near.append(np.column_stack([a[hit], b[hit]]))
                label = roots_of(hi - lo, np.concatenate(near))
                for root in np.flatnonzero(np.bincount(label) > 1):
                    inside = lo + np.flatnonzero(label == root)
                    with np.errstate(over="ignore"):
                        names.append(np.full(len(inside), mix(rep[inside].view(np.uint64)).sum(), np.uint64))
                    reps.append(rep[inside])
                    roots.append(own[inside])
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names).view(np.int64)), pa.array(np.concatenate(reps)), pa.array(np.concatenate(roots))], ["cluster", "rep", "root"])

    nodes = staged(nodes, "compared")
    held = with_tokens(nodes, sets).select("node", "rep", "root", "tokens").repartition("node").sortWithinPartitions("node")
    found = staged(held.mapInArrow(rows, "cluster long, rep long, root long").distinct(), "clusters")
    discard(nodes)
    return found


def intersections(sets: list[np.ndarray], asked: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of some of a few sets (a row each) with all of them."""
    if len(sets) == 2 and len(asked) == 2:
        n = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), n], [n, len(sets[1])]])
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    if len(asked) < len(sets):  # what no asked set holds is in no intersection
        wanted = np.unique(np.concatenate([sets[i] for i in asked]))
        there = wanted[np.searchsorted(wanted, values).clip(0, len(wanted) - 1)] == values
        values, owner = values[there], owner[there]
    _, column, times = np.unique(values, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    column, owner = np.unique(column[shared], return_inverse=True)[1], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(asked), len(sets)))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 16384):
        lo, hi = np.searchsorted(column, [at, at + 16384])
        there = np.zeros((len(sets), 16384), np.float32)
        there[owner[lo:hi], column[lo:hi] - at] = 1
        out += there[asked] @ there.T
    out[np.arange(len(asked)), asked] = [len(sets[i]) for i in asked]
    return out.astype(np.int64)


def links(found: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """(u, v): edges that connect the components in each cluster (cluster, rep, root) as far as confirmed links do.

    ``whole``: rep, hashes. Only sets outside the cluster's largest component are compared, with all of it.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in grouped(batches, "cluster"):
            roots, ends, u, v = part.column("root").to_numpy(), bounds(part.column("cluster").to_numpy()), [], []
            hashes = part.column("hashes")
            for lo, hi in zip(ends[:-1], ends[1:]):
                held = [np.frombuffer(x.as_py(), np.uint64) for x in hashes.slice(lo, hi - lo)]
                kinds, root, times = np.unique(roots[lo:hi], return_inverse=True, return_counts=True)
                asked = np.flatnonzero(root != times.argmax()) if len(kinds) < hi - lo else np.arange(hi - lo)
                both = intersections(held, asked)
                n = np.array([len(s) for s in held])
                linked = np.argwhere(100 * both >= percent * (n[asked, None] + n[None, :] - both))
                label = roots_of(len(kinds), np.unique(np.column_stack([root[asked[linked[:, 0]]], root[linked[:, 1]]]), axis=0))
                moved = np.flatnonzero(label != np.arange(len(kinds)))
                u.append(kinds[moved])
                v.append(kinds[label[moved]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])

    held = found.join(whole, "rep").select("cluster", "root", "hashes").repartition("cluster").sortWithinPartitions("cluster")
    return held.mapInArrow(rows, "u long, v long")


def full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """rep, hashes: the whole sets of the wanted documents (rep), from their texts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                made = [shingles(x, k).tobytes() for x in as_bytes(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("tag"), pa.array(made, pa.large_binary()).cast(pa.binary())], ["rep", "hashes"])

    return only_rows(docs.select("tag", "text"), wanted, "tag", "rep").mapInArrow(rows, "rep long, hashes binary")


def joined_by(found: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Stored edges of the clusters ``found`` (cluster, rep, root; a stored table)."""
    whole = full_sets(docs, found, k)
    return staged(links(found, whole, percent), "links")


def classes(docs: DataFrame, k: int, percent: int = PERCENT, trees: int = TREES, node: int = NODE) -> DataFrame:
    """tag, doc_id, n_shingles, root: each row's class as the least tag in it; a stored table. ``docs``: tag, doc_id, text."""
    base = staged(sketches(docs, k), "sketches")
    # copies combine before the shuffle; one row stands for a set
    sets = staged(base.where("n > 0").groupBy("d1", "d2").agg(F.min("tag").alias("rep"), F.count("*").alias("copies"), F.first("tokens").alias("tokens")), "sets")
    narrow = staged(base.drop("tokens"), "documents")
    discard(base)
    first = clusters(first_leaves(sets.withColumn("root", F.col("rep")), range(min(FIRST_TREES, trees)), node), sets)
    edges = joined_by(first, docs, k, percent)
    done = components(edges)
    discard(first, edges)
    known = done.select(F.col("u").alias("of"), F.col("v").alias("known"))
    rooted = staged(looked_up(sets, "rep", known, "of").select("rep", "tokens", F.coalesce("known", "rep").alias("root")), "rooted-sets")
    small, whole = leaves(rooted, range(FIRST_TREES, trees), node)
    open_ = clusters(small if whole is None else small.unionByName(whole), sets)
    discard(rooted)
    if not open_.isEmpty():
        edges, before = joined_by(open_, docs, k, percent), done
        done = components(done.unionByName(edges))
        discard(edges, before)
    discard(open_)
    copies = sets.select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), "rep", "copies")
    of_set = looked_up(copies, "rep", done.select(F.col("u").alias("of"), F.col("v").alias("root")), "of").where("copies > 1 or root is not null")
    of_set = staged(of_set.select("e1", "e2", F.coalesce("root", "rep").alias("root")), "set-roots")
    discard(sets, done)
    rows = looked_up(narrow, "d1", of_set, "e1", F.col("d2") == F.col("e2")).withColumn("root", F.when(F.col("n") > 0, F.col("root")))
    made = staged(rows.select("tag", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "tag").alias("root")), "classes")
    discard(narrow, of_set)
    return made


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = PERCENT) -> DataFrame:
    """tag, doc_id, n_shingles, component_id, kept: one row per document."""
    rows = classes(with_row_keys(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "tag"), k, percent)
    return represented(rows)


def represented(rows: DataFrame) -> DataFrame:
    """near_duplicates' columns from the stored rows of ``classes``."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")
    least = rows.groupBy(F.col("root").alias("of")).agg(F.min(order).alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = looked_up(rows, "root", staged(least, "class-heads"), "of")
    alone = F.col("least").isNull()
    kept = alone | (F.col("least.tag") == F.col("tag"))
    return joined.select("tag", "doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"), kept.alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each class."""
    tag = free_name(docs.columns, "tag")
    keyed = with_row_keys(docs, tag)
    rows = classes(keyed.select(F.col(tag).alias("tag"), F.col("doc_id").cast("long").alias("doc_id"), "text"), k, percent)
    dropped = staged(represented(rows).where("not kept").select(F.col("tag").alias(tag)), "near-dropped")
    discard(rows)
    return without(keyed, dropped, tag).select(*docs.columns)


def op4_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all documents by 4-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=4).select("doc_id", "n_shingles", "component_id", "kept")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(l[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, l, unnest(range(1, greatest(len(l) - 3, 1) + 1)) AS i FROM w WHERE len(l) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_ >= 80 * (x.n + y.n - both_)
), r(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.other
), c AS (
  SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id
)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept
FROM c LEFT JOIN n ON n.doc_id = c.doc_id
"""
