"""Ranked lexical search: exact maximum inner products of sparse documents and queries by ball trees.

A document is a sparse vector of saturated term counts, an item of term weights times the item's counts; the score is their
integer inner product. One pass over the texts keeps each document's terms that some item of the block holds. Their document
frequencies give the weights. Then each task packs its documents into ball trees of bounded size: a node is a centroid and
radii about it, so that no document in it scores above <item, centroid> + |item| * radius. Subtrees are searched best bound
first and are left out once their bound, rounded up safely, lies below the item's tenth score so far; leaves are
scored in integers. The best rows of each task meet in one window by item, which Spark limits before it shuffles.

Items go in blocks of bounded size, all documents against each; what is broadcast is a block's terms and items.

Edges: null texts and texts without terms are in no count and no result. Rows that repeat a ``doc_id`` are documents of their own; a
null ``doc_id`` comes after all others among equal scores. Each row of the items is an item of its own, repeated or null ids too;
an item without terms, or whose terms no document holds, has no rows. Other columns are not read. Very long texts are taken whole.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, discard, slices, staged, table

#: Bytes that split terms as a space and A-Z as a-z; ASCII letters, digits and all bytes beyond ASCII are a term's.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of items' texts in a block.
BLOCK_BYTES = 1 << 20
#: A tree's documents and entries at most, documents of a leaf, and numbers that its centroids take.
TREE_DOCS, TREE_ENTRIES, LEAF_DOCS, TREE_CELLS = 1 << 13, 1 << 21, 16, 1 << 21
#: Groups of terms whose radii a node keeps beside the radius over all terms: an item's bound takes its own groups' alone.
GROUPS = 4096
TOP = 10
#: How much a bound is raised, relative to its size, so that rounding in doubles never lowers it below a true score.
SLACK = 1e-9


def terms(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


@dataclass
class Items:
    """A block of items: each term's place from 1, and per item its id, places and counts."""

    place: dict[bytes, int]
    ids: list[int | None]
    own: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, rows: list) -> Items:
        place: dict[bytes, int] = {}
        ids, own = [], []
        for r in rows:
            counts = Counter(terms((r["text"] or "").encode("utf-8", "replace")))
            at = [place.setdefault(t, len(place) + 1) for t in counts]
            ids.append(r["id"])
            own.append((np.array(at, np.int64), np.array(list(counts.values()), np.int64)))
        return cls(place, ids, own)


def counted(docs: DataFrame, place: dict[bytes, int], key: str, text: str) -> DataFrame:
    """key, n and the places and counts of the known terms, for each document with a term."""
    held = docs.sparkSession.sparkContext.broadcast(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = held.value.get
        for batch in batches:
            for part in slices(batch):
                rows, n, ends, at, tf = [], [], [0], [], []
                for i, t in enumerate(as_bytes(part.column(1))):
                    words = terms(t)
                    if not words:
                        continue
                    found = Counter(map(get, words))
                    found.pop(None, None)
                    rows.append(i)
                    n.append(len(words))
                    at.extend(found)
                    tf.extend(found.values())
                    ends.append(len(at))
                ends = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, kind)) for x, kind in ((at, pa.int32()), (tf, pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(n, pa.int64()), *lists], [key, "n", "at", "tf"])

    kind = docs.select(key).dtypes[0][1]
    return docs.select(key, text).where(F.col(text).isNotNull()).mapInArrow(run, f"{key} {kind}, n long, at array<int>, tf array<long>")


@dataclass
class Scoring:
    """Weights of the places, and what a term's count is worth in a document."""

    weight: np.ndarray
    documents: int
    length: int

    @classmethod
    def of(cls, sparse: DataFrame, places: int) -> Scoring:
        row = sparse.agg(F.count("*").alias("n"), F.sum(F.col("n").cast("decimal(38,0)")).alias("l")).first()
        n, length = int(row["n"]), int(row["l"] or 0)
        weight = np.zeros(places + 1, np.int64)
        for r in sparse.select(F.explode("at").alias("at")).groupBy("at").count().collect():  # a row for each term of the block
            weight[r["at"]] = math.floor(1000 * math.log((2 * n + 2) / (2 * r["count"] + 1)))
        return cls(weight, n, length)

    def values(self, n: np.ndarray, tf: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Saturated counts of entries; ``of`` is an entry's document."""
        m = np.array([25 + 75 * int(x) * self.documents // self.length for x in n], np.int64)
        return 1_000_000_000 * tf // (1000 * tf + 8 * m[of])


def by_group(cells: np.ndarray) -> np.ndarray:
    """Sums of rows by group: a row for each term becomes one for each group."""
    return np.pad(cells, ((0, -len(cells) % GROUPS), (0, 0))).reshape(-1, GROUPS, cells.shape[1]).sum(0)


def spans(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])


class BallTree:
    """Documents in a binary tree of equal halves. Vectors are scaled by each term's weight, an item's counts are not.

    ``ids``, ``nulls``: the documents' keys; ``ends``, ``at``, ``value``: their entries. Every document has an entry.
    """

    def __init__(self, ids: np.ndarray, nulls: np.ndarray, ends: np.ndarray, at: np.ndarray, value: np.ndarray, weight: np.ndarray):
        size, dims = len(ids), len(weight)
        self.depth = max(0, min(math.ceil(math.log2(size / LEAF_DOCS)) if size > LEAF_DOCS else 0, int(math.log2(max(1, TREE_CELLS // dims)))))
        order = self.ordered(ends, at, value * weight[at].astype(float), dims)
        lengths = np.diff(ends)[order]
        pick = np.repeat(ends[:-1][order], lengths) + np.arange(lengths.sum()) - np.repeat(spans(lengths)[:-1], lengths)
        self.ids, self.nulls, self.ends, self.at, self.value, self.weight = ids[order], nulls[order], spans(lengths), at[pick], value[pick], weight
        self.balls()

    def halves(self, size: int, level: int) -> np.ndarray:
        """First places of the nodes of a level, and the end: whole parts of equal fractions."""
        return (np.arange((1 << level) + 1) * size) >> level

    def ordered(self, ends: np.ndarray, at: np.ndarray, x: np.ndarray, dims: int) -> np.ndarray:
        """Documents in the order of the leaves: each level parts a node at the median between two distant documents of it."""
        size, of = len(ends) - 1, np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        square = np.bincount(of, x * x, size)
        order = np.arange(size)

        def dot(node: np.ndarray, pivots: np.ndarray) -> np.ndarray:
            dense = np.zeros((len(pivots), dims))
            for i, p in enumerate(pivots):
                dense[i, at[ends[p] : ends[p + 1]]] = x[ends[p] : ends[p + 1]]
            return np.bincount(of, dense[node[of], at] * x, size)

        for level in range(self.depth):
            bounds = self.halves(size, level)
            node = np.empty(size, np.int64)
            node[order] = np.repeat(np.arange(1 << level), np.diff(bounds))

            def farthest(pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                product = dot(node, pivots)
                far = (square - 2 * product)[order]
                best = [int(lo + far[lo:hi].argmax()) for lo, hi in zip(bounds, bounds[1:])]
                return order[best], product

            first, _ = farthest(order[bounds[:-1]])
            second, product = farthest(first)
            along = dot(node, second) - product
            order = order[np.lexsort((along[order], node[order]))]
        return order

    def balls(self) -> None:
        """Centroids and radii of all nodes, level below level: node k of a level follows the 2 ** level - 1 nodes above.

        Leaves' radii come from their documents; a node's are at most those of its halves and the way to their centroids.
        """
        size, dims, leaves = len(self.ids), len(self.weight), 1 << self.depth
        bounds = self.halves(size, self.depth)
        node = np.repeat(np.arange(leaves), np.diff(bounds))
        of = np.repeat(np.arange(size), np.diff(self.ends))
        x = self.value * self.weight[self.at].astype(float)
        c = np.bincount(self.at * leaves + node[of], x, dims * leaves).reshape(dims, leaves) / np.diff(bounds)
        mine = c[self.at, node[of]]
        alone = by_group(c * c)  # squared distance of a document without the group's terms
        # with some: changed where the document has an entry
        pair, back = np.unique(of * GROUPS + self.at % GROUPS, return_inverse=True)
        doc, group = pair // GROUPS, pair % GROUPS
        changed = np.bincount(back, (x - mine) ** 2 - mine**2)
        some = np.bincount(group * leaves + node[doc], minlength=GROUPS * leaves).reshape(GROUPS, leaves)
        part = np.where(some < np.diff(bounds), alone, 0.0)
        np.maximum.at(part, (group, node[doc]), alone[group, node[doc]] * (1 + SLACK) + changed)
        total = alone.sum(0)[node] * (1 + SLACK) + np.bincount(doc, changed, size)
        radius = np.sqrt(np.maximum(np.maximum.reduceat(total, bounds[:-1]), 0.0))
        part = np.sqrt(part)
        levels = [(c, part, radius)]
        weight = np.diff(bounds).astype(float)
        while len(weight) > 1:
            both = weight.reshape(-1, 2)
            up = (c * weight).reshape(dims, -1, 2).sum(2) / both.sum(1)
            way = by_group((c - np.repeat(up, 2, 1)) ** 2)
            part = (np.sqrt(way) + part).reshape(GROUPS, -1, 2).max(2)
            radius = (np.sqrt(way.sum(0)) + radius).reshape(-1, 2).max(1)
            c, weight = up, both.sum(1)
            levels.append((c, part, radius))
        self.centre, self.part, self.radius = (np.ascontiguousarray(np.concatenate([row[i] for row in reversed(levels)], -1)) for i in range(3))

    def bounds(self, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        """For every node what no document's score in it exceeds."""
        q = count.astype(float)
        groups, back = np.unique(at % GROUPS, return_inverse=True)
        reach = np.minimum(np.linalg.norm(q) * self.radius, np.sqrt(np.bincount(back, q * q)) @ self.part[groups])
        middle = q @ self.centre[at]
        return (middle + reach) * (1 + SLACK) + 1.0

    def search(self, at: np.ndarray, count: np.ndarray, best: Best) -> int:
        """Offer ``best`` all documents that may be among the item's top ones; how many leaves were scored."""
        bound = self.bounds(at, count)
        q = np.zeros(len(self.weight), np.int64)
        q[at] = count * self.weight[at]
        leaves, first, size, scored = 1 << self.depth, (1 << self.depth) - 1, len(self.ids), 0
        heap = [(-bound[0], 0)]
        while heap and -heap[0][0] >= best.least:
            _, node = heapq.heappop(heap)
            if node < first:
                for child in (2 * node + 1, 2 * node + 2):
                    if bound[child] >= best.least:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            lo, hi = (node - first) * size >> self.depth, (node - first + 1) * size >> self.depth
            e = slice(self.ends[lo], self.ends[hi])
            score = np.add.reduceat(q[self.at[e]] * self.value[e], self.ends[lo:hi] - self.ends[lo])
            best.offer(score, self.nulls[lo:hi], self.ids[lo:hi])
            scored += 1
        return scored


class Best:
    """The top documents of an item so far: score falling, null ids last, ids rising. ``least``: what a further one must reach."""

    def __init__(self, top: int = TOP):
        self.top, self.least = top, 1
        self.score, self.nulls, self.ids = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def offer(self, score: np.ndarray, nulls: np.ndarray, ids: np.ndarray) -> None:
        may = score >= self.least
        if not may.any():
            return
        score, nulls, ids = (np.concatenate([a, b[may]]) for a, b in ((self.score, score), (self.nulls, nulls), (self.ids, ids)))
        keep = np.lexsort((ids, nulls, -score))[: self.top]
        self.score, self.nulls, self.ids = score[keep], nulls[keep], ids[keep]
        if len(keep) == self.top:
            self.least = int(self.score[-1])


def trees(batches: Iterator[pa.RecordBatch], scoring: Scoring) -> Iterator[BallTree]:
    """Trees of bounded size over a task's documents; those without a term of weight are in none, as they score 0."""
    held: list[tuple[np.ndarray, ...]] = []
    docs = entries = 0

    def tree() -> BallTree:
        ids, nulls, lengths, at, value = (np.concatenate(x) for x in zip(*held))
        return BallTree(ids, nulls, spans(lengths), at, value, scoring.weight)

    for whole in batches:
        for batch in slices(whole, 1024):
            if not batch.num_rows:
                continue
            key, n, lists = batch.column(0), batch.column(1).to_numpy(), batch.column(2)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(len(n)), lengths)
            at, tf = lists.flatten().to_numpy().astype(np.int64), batch.column(3).flatten().to_numpy()
            value = scoring.values(n, tf, of)
            on = scoring.weight[at] > 0
            lengths = np.bincount(of[on], minlength=len(n))
            some = lengths > 0
            nulls = key.is_null().to_numpy(zero_copy_only=False)
            ids = key.fill_null(0).to_numpy().astype(np.int64)
            held.append((ids[some], nulls[some], lengths[some], at[on], value[on]))
            docs, entries = docs + int(some.sum()), entries + int(on.sum())
            if docs >= TREE_DOCS or entries >= TREE_ENTRIES:
                yield tree()
                held, docs, entries = [], 0, 0
    if docs:
        yield tree()


def best_of(sparse: DataFrame, items: Items, scoring: Scoring, key: str, top: int) -> DataFrame:
    """item (place in the block), id, key, score: each task's top documents of every item."""
    held = sparse.sparkSession.sparkContext.broadcast((items, scoring))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, scoring = held.value
        found = [Best(top) for _ in items.ids]
        for tree in trees(batches, scoring):
            for (at, count), best in zip(items.own, found):
                if len(at):
                    tree.search(at, count, best)
        for i, best in enumerate(found):
            if n := len(best.ids):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * n, pa.int32()), pa.array([items.ids[i]] * n, pa.int64()), pa.array(best.ids, mask=best.nulls), pa.array(best.score)], ["item", "id", key, "score"]
                )

    return sparse.select(key, "n", "at", "tf").mapInArrow(run, f"item int, id long, {key} long, score long")


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: every item's ``top`` documents by score, above 0, equal ones by rising key."""
    asked = items.select(F.col(item).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(size) // block_bytes))
    made = None
    for b in range(blocks):
        rows = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("text", "id"), F.lit(blocks)) == b)
        block = Items.of(rows.orderBy("id", "text").collect())
        docs_ = docs.select(F.col(key).cast("long").alias(key), text)
        sparse = staged(counted(docs_, block.place, key, text), "sparse-documents")
        scoring = Scoring.of(sparse, len(block.place))
        some = staged(best_of(sparse, block, scoring, key, top), "best-documents")
        discard(sparse)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last(key))
        ranked = some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        ranked = ranked.select(F.col("id").alias(item), "rank", key, "score")
        made = ranked if made is None else made.unionByName(ranked)
    return made


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id, score: the ten best documents for each benchmark item."""
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH words AS (
  SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)
), tf AS (SELECT r, doc_id, t, count(*) AS tf FROM words GROUP BY r, doc_id, t
), lengths AS (SELECT r, count(*) AS n FROM words GROUP BY r
), totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS len FROM lengths
), df AS (SELECT t, count(*) AS df FROM tf GROUP BY t
), asked AS (
  SELECT item, item_id, t, count(*) AS c FROM (
    SELECT item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
    FROM (SELECT row_number() OVER () AS item, item_id, text FROM benchmark)
  ) GROUP BY item, item_id, t
), scores AS (
  SELECT item, item_id, r, doc_id, sum(c * floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // len))))::BIGINT AS score
  FROM asked JOIN tf USING (t) JOIN df USING (t) JOIN lengths USING (r), totals GROUP BY item, item_id, r, doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
