"""Toxicity by class-conditional Kneser-Ney models.

Two character models, one of toxic and one of ordinary texts, give each word a log-likelihood under both. Each
class counts the longest contexts by itself; what it does not know backs off to a Kneser-Ney model whose counts both
classes share, so an expression that is rare in both says nothing. A text's features are all one comparison: its toxic less its ordinary
log-likelihood, normalised by length, over all words, over the distinct words that are likeliest toxic, and by how much distinct
words stand out. A logistic curve turns these into a score.

The curve is cross-fitted: all learnable rows are dealt to ``FOLDS`` folds, and each fold's rows are scored by models that have not
counted them. Of ``CLASS_DISCOUNTS`` the one is taken whose curve has the least log loss over these scores: single counts
of a class are kept where labelled rows are few, and left to the shared counts where they are many. The curve's
coefficients are held to 0 by a normal prior, so with few rows scores stay near the share of toxic rows.

The classes count the words of all learnable rows, and the shared counts come from all texts: each task counts in how many of its
texts a word is, and Spark adds up the n-grams of all tasks' words. Where every order has ``MOST_GRAMS`` at most the driver gets them and
tasks look them up; otherwise the same models stay tables (``gram_tables``), and words meet them by joins. The curve's Newton steps are sums over all learnable rows.

Defined results: a null text counts as empty, and an empty text's score is the share of toxic rows. Repeated rows get
equal scores. Very long texts are scored whole. Without learnable rows of both classes all scores are that share (0 without
labels). An empty table gives an empty result. Labels outside 0 and 1 are ignored. Extra columns are kept; those whose
names would clash with new ones make the new names longer by underscores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, types as T
from pyspark.sql import functions as F

from .common import bounds, discard, fold, free_name, least_by_hash, matched, slices, staged, table
from .gram_tables import GramTables, KnownWords, gram_tables, with_word_values
from .words import CodedTable, KeyIndex, blocks, coded, framed, gram_keys, ngram_hashes, strings

#: Characters of an n-gram, and n-grams of one order that tasks look up.
ORDER, MOST_GRAMS = 6, 1 << 20
#: Words whose likelihoods a task keeps.
MOST_WORDS = 300_000
#: Off each count of a class: one of these. At 4 what four or fewer of a class's texts have is left to the shared counts.
CLASS_DISCOUNTS = (1.0, 2.0, 4.0)
#: Folds of the cross-fitting, and the inverse variance of the curve's coefficients.
FOLDS, RIDGE = 3, 1.0
#: What a character that no text has had gets.
UNSEEN = 1e-5
#: The likeliest toxic words that are compared by themselves: a share of a text's distinct words, and how many at least.
TOP_SHARE, TOP_LEAST = 0.02, 3
#: Difference from which a word stands out, how far it counts beyond, and characters that a short text is filled up by.
MARGIN, REACH, SHORT = 2.0, 4.0, 450
#: Numbers that ``text_features`` gives.
FEATURES = 5
EDGE = ".,;:!?\"'()[]{}«»„“”…#*$%&|<>~_-"


def split(text: str | None) -> list[str]:
    return (text or "").lower().split()


@dataclass
class Grams:
    """The n-grams of one order: sorted keys, those of what comes before their last character and of what comes after their first.

    ``initial``: at a word's start. ``counts``: a shared count (kinds of what comes before, but at the highest order and at
    words' starts), then each class's, where contexts are as long as they can be: there only.
    """

    keys: np.ndarray
    before: np.ndarray
    after: np.ndarray
    initial: np.ndarray
    counts: np.ndarray


def word_grams(words: list[str], counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The n-grams in ``words`` by order, a row of code points each, which are at a word's start, and the sums of the words' rows of ``counts``."""
    points, starts, distance = framed([w.strip(EDGE) for w in words])
    of_word = np.repeat(np.arange(len(words), dtype=np.int32), np.diff(np.append(starts, len(points))))
    for n, key, there in ngram_hashes(points, distance, ORDER):
        at = np.flatnonzero(there)
        at = at[np.argsort(key[at])]
        first = bounds(key[at])[:-1] if len(at) else np.zeros(0, np.int64)
        sums = np.add.reduceat(counts[of_word[at]], first) if len(at) else counts[:0]
        initial = np.logical_or.reduceat(distance[at] == n - 1, first) if len(at) else np.zeros(0, bool)
        yield points[at[first][:, None] + np.arange(1 - n, 1)], initial, sums


def grams_of(points: np.ndarray, initial: np.ndarray, counts: np.ndarray) -> Grams:
    """Sorted by key."""
    keys = gram_keys(points)
    shorter = [gram_keys(p) if points.shape[1] > 1 else np.zeros(len(keys), np.uint64) for p in (points[:, :-1], points[:, 1:])]
    order = np.argsort(keys)
    return Grams(keys[order], *(k[order] for k in shorter), initial[order], counts[order])


def shortened(keys: np.ndarray, n: int, cut: np.uint64) -> np.ndarray:
    """Keys of order ``n`` by their first bits alone; the order stays part of them."""
    return (keys >> cut << cut) | np.uint64(n) if cut else keys


@dataclass
class Counted:
    """The shared model, and class counts that may be taken from other rows: ``counts`` has them for each fold and class.

    ``keys`` of all orders are sorted; ``parent`` is the place of what comes before the last character. ``counts`` has rows for the n-grams
    at the places ``counted`` alone; all others have none. ``cut``: by order, how many bits ``shortened`` takes off.
    """

    keys: np.ndarray
    p: np.ndarray
    backoff: np.ndarray
    parent: np.ndarray
    counted: np.ndarray
    counts: np.ndarray
    cut: np.ndarray

    @classmethod
    def of(cls, orders: Iterator[Grams], cut: np.ndarray) -> Counted:
        """Orders from the lowest to the highest. An n-gram's likelihood is the interpolated one of all shorter ones.

        This is the driver's work, so of an order only what the model needs outlasts it, and lists end as they are put together.
        """
        keys, ps, backoffs, parents, counted, counts, base = [], [], [], [], [], [], 0
        for n, grams in enumerate(orders, 1):
            count = grams.counts[:, 0].astype(float)
            if n == 1:
                count[grams.initial] = 0  # the frame's start is given
                parent, size = np.zeros(len(count), np.int64), 1
            else:
                parent, size = np.searchsorted(keys[-1], grams.before), len(keys[-1])
            total = np.bincount(parent, count, size)
            ones, twos = (count == 1).sum(), (count == 2).sum()
            d = float(np.clip(ones / max(ones + 2 * twos, 1) if ones else 0.5, 0.1, 0.9))
            # a share above 1 can come of merged keys alone
            p = np.minimum(np.maximum(count - d, 0) / np.maximum(total[parent], 1e-9), 1.0)
            if n == 1:
                p += UNSEEN
            else:  # what the discount takes off is what backing off gives
                off = np.bincount(parent, np.minimum(count, d), size)
                backoffs[-1] = np.where(total > 0, off / np.maximum(total, 1e-9), 1.0).astype(np.float32)
                p += backoffs[-1][parent] * ps[-1][np.searchsorted(keys[-1], grams.after)]
            parents.append((parent + base - size).astype(np.int32) if n > 1 else np.full(len(count), -1, np.int32))
            some = np.flatnonzero(grams.counts[:, 1:].any(1))
            counted.append((some + base).astype(np.int32))
            counts.append(grams.counts[some, 1:].astype(np.int32 if grams.counts.max(initial=0) < 1 << 31 else np.int64))
            base += len(count)
            keys.append(grams.keys)
            ps.append(p.astype(np.float32))
            backoffs.append(np.ones(len(count), np.float32))
            del grams, count, parent, total, p, some

        def whole(parts: list[np.ndarray]) -> np.ndarray:
            out = np.concatenate(parts)
            parts.clear()
            return out

        key = whole(keys)
        order = np.argsort(key).astype(np.int32)
        place = np.empty(len(order) + 1, np.int32)
        place[order], place[-1] = np.arange(len(order), dtype=np.int32), -1
        at = place[whole(counted)]
        by_place = np.argsort(at)
        return cls(key[order], whole(ps)[order], whole(backoffs)[order], place[whole(parents)[order]], at[by_place], whole(counts)[by_place], cut)

    def model(self, class_discounts: tuple[float, ...], but: int | None = None) -> KneserNey:
        """With the class counts of all folds, ``but`` of one."""
        by_fold = self.counts.reshape(len(self.counts), -1, 2)
        of = by_fold.sum(1) - (by_fold[:, but] if but is not None else 0)
        some = (self.parent[self.counted] >= 0) & of.any(1)
        inner = self.counted[some]
        count = np.tile(of[some], (1, len(class_discounts))).astype(np.float32)
        d = np.repeat(np.array(class_discounts, np.float32), 2)
        contexts, parent = np.unique(self.parent[inner], return_inverse=True)
        sums = lambda values: np.stack([np.bincount(parent, v, len(contexts)) for v in values.T], 1) if len(contexts) else np.zeros((0, len(d)))
        total = sums(count)
        weight = np.where(total > 0, sums(np.minimum(count, d)) / np.maximum(total, 1e-9), 1.0)
        share = np.maximum(count - d, 0) / np.maximum(total[parent], 1e-9)
        some = share.any(1)
        at_share, at_weight = np.zeros(len(self.keys), np.int32), np.zeros(len(self.keys), np.int32)
        at_share[inner[some]] = np.arange(1, some.sum() + 1)
        at_weight[contexts] = np.arange(1, len(contexts) + 1)
        row = lambda first, rest: np.vstack([np.full((1, len(d)), first), rest]).astype(np.float32)
        return KneserNey(self.keys, self.p, self.backoff, self.parent, at_share, row(0.0, share[some]), at_weight, row(1.0, weight), self.cut)


@dataclass
class KneserNey:
    """An interpolated model of all texts, and of each class at the highest order above it.

    ``p`` is the likelihood by all orders of an n-gram's last character, ``backoff`` and ``weight`` what backing off from an n-gram as a
    context costs. Columns of ``share`` and ``weight``: for each discount an ordinary and a toxic one; their rows 0 are those of all n-grams that no class has.
    """

    keys: np.ndarray
    p: np.ndarray
    backoff: np.ndarray
    parent: np.ndarray
    at_share: np.ndarray
    share: np.ndarray
    at_weight: np.ndarray
    weight: np.ndarray
    cut: np.ndarray

    @classmethod
    def fit(cls, words: list[str], counts: np.ndarray, class_discounts: tuple[float, ...] = (2.0,), shared: np.ndarray | None = None) -> KneserNey:
        """A model of words at hand. ``counts``: a row per word, a column per class (0 ordinary, 1 toxic). ``shared``: a count per word, by default both classes'."""
        made = [grams_of(*x) for x in word_grams(words, np.column_stack([counts.sum(1) if shared is None else shared, counts]))]
        for n, (grams, longer) in enumerate(zip(made, [*made[1:], None]), 1):
            if n < ORDER:
                kinds = np.bincount(np.searchsorted(grams.keys, longer.after), minlength=len(grams.keys))
                grams.counts[:, 0] = np.where(grams.initial, grams.counts[:, 0], kinds)
                grams.counts[~grams.initial, 1:] = 0
        return Counted.of(iter(made), np.zeros(ORDER + 1, np.uint64)).model(class_discounts)

    def own(self) -> KneserNey:
        """With the same arrays; an index that it makes ends with it, not with the arrays, which Spark keeps with the worker."""
        return replace(self)

    def index(self) -> KeyIndex:
        if not hasattr(self, "_index"):
            self._index = KeyIndex(self.keys)
        return self._index

    def words(self, words: list[str]) -> np.ndarray:
        """Ordinary and toxic log-likelihood (for each class discount) and length of each word."""
        index = self.index()
        points, starts, distance = framed([w.strip(EDGE) for w in words])
        key = np.stack([shortened(k, n, self.cut[n]) for n, k, _ in ngram_hashes(points, distance, ORDER)])
        left = np.flatnonzero(distance)
        n = np.minimum(distance[left] + 1, ORDER)
        p, factor = np.full(len(points), UNSEEN), np.ones(len(points))
        at_share, at_weight = np.zeros(len(points), np.int32), np.zeros(len(points), np.int32)
        longest = True  # classes speak where the context is as long as it can be
        while len(left):
            found = index.find(key[n - 1, left])
            hit = found >= 0
            there, of = left[hit], found[hit]
            p[there] = self.p[of]
            if longest:
                at_share[there], at_weight[there] = self.at_share[of], self.at_weight[self.parent[of]]
            more = ~hit & (n > 1)
            left, n = left[more], n[more]
            context = index.find(key[n - 2, left - 1])
            known = context >= 0
            factor[left[known]] *= self.backoff[context[known]]
            if longest:
                at_weight[left[known]] = self.at_weight[context[known]]
            n, longest = n - 1, False
        logs = np.log(self.share[at_share] + self.weight[at_weight] * (p * factor)[:, None])
        logs[starts] = 0
        return np.column_stack([np.add.reduceat(logs, starts), np.diff(np.append(starts, len(points))) - 1.0])


def text_features(words: list[str], values: np.ndarray) -> tuple[float, ...]:
    """Both log-likelihoods a character; then what the curve weighs, differences a character too.

    These are the one over the whole text, the one over the distinct words where it is greatest, and, for each character of
    the text, what distinct words have beyond ``MARGIN``.
    """
    last = dict(zip(words, range(len(words))))
    codes = np.fromiter(map(last.__getitem__, words), np.int64, len(words))
    return tuple(features_of(codes, np.array([0, len(words)]), values)[0])


def features_of(codes: np.ndarray, starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A row of ``text_features`` for each text. ``codes``: the rows of ``values`` of all texts' words in turn; ``starts``: where each text's begin, and the end."""
    out = np.zeros((len(starts) - 1, FEATURES))
    some = np.flatnonzero(np.diff(starts))
    if not len(some):
        return out
    ordinary, toxic, length = np.add.reduceat(values[codes], starts[some]).T
    # numbered by difference: the distinct words of a text, sorted, begin with those where it is greatest
    apart = values[:, 1] - values[:, 0]
    order = np.lexsort([values[:, 2], -apart])
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    kinds = np.sort(np.repeat(np.arange(len(some)) * len(order), np.diff(starts)[some]) + place[codes])
    kinds = kinds[bounds(kinds)[:-1]]
    of_text, kinds = kinds // len(order), order[kinds % len(order)]
    ends = bounds(of_text)
    first, many = ends[:-1], np.diff(ends)
    taken = np.maximum(np.ceil(TOP_SHARE * many), TOP_LEAST)
    top = np.arange(len(kinds)) - np.repeat(first, many) < np.repeat(taken, many)
    apart = apart[kinds]
    likeliest = np.add.reduceat(np.where(top, apart, 0), first) / np.add.reduceat(np.where(top, values[kinds, 2], 0), first)
    clear = np.add.reduceat(np.clip(apart - MARGIN, 0, REACH), first) / (length + SHORT)
    out[some] = np.column_stack([ordinary / length, toxic / length, (toxic - ordinary) / length, likeliest, clear])
    return out


def features(texts: list[str | None], kept: CodedTable | KnownWords, many: int) -> np.ndarray:
    """``features_of`` texts for ``many`` class discounts, side by side. ``kept`` has the likelihoods of words without ``EDGE`` at either end."""
    found = [np.zeros((0, FEATURES * many))]
    for some in blocks(texts):
        codes, words, starts = coded([split(x) for x in some])
        if not len(words):
            found.append(np.zeros((len(some), FEATURES * many)))
            continue
        values = kept(pc.utf8_trim(words, EDGE))
        found.append(np.hstack([features_of(codes, starts, values[:, [k, k + 1, -1]]) for k in range(0, 2 * many, 2)]))
    return np.concatenate(found)


def newton_sums(x: np.ndarray, y: np.ndarray, weight: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Curvature, gradient and log loss of a logistic curve's rows, in one row."""
    x = np.column_stack([np.ones(len(x)), x])
    at = np.clip(x @ beta, -30, 30)
    p = 1 / (1 + np.exp(-at))
    loss = (weight * np.logaddexp(0, np.where(y == 1, -at, at))).sum()
    return np.concatenate([((x * (weight * p * (1 - p))[:, None]).T @ x).ravel(), x.T @ (weight * (y - p)), [loss]])


def newton_step(sums: np.ndarray, beta: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """A damped step, coefficients held to 0 by a normal prior."""
    size = len(beta)
    penalty = ridge * np.eye(size)
    penalty[0, 0] = 1e-6
    step = np.linalg.solve(sums[: size * size].reshape(size, size) + penalty, sums[size * size : -1] - penalty @ beta)
    return step / max(1.0, np.abs(step).max() / 5)


@dataclass
class TableModel:
    """A model that stays tables, with one class discount."""

    tables: GramTables
    discount: int

    def values(self, words: DataFrame) -> DataFrame:
        return self.tables.words(words, class_columns(FOLDS)[2 * self.discount : 2 * self.discount + 2])


def class_columns(but: int) -> list[int]:
    """Places of the classes' numbers in ``GramTables`` without fold ``but`` (``FOLDS``: without none)."""
    each = 2 * len(CLASS_DISCOUNTS)
    return list(range(but * each, (but + 1) * each))


@dataclass
class ToxicityModel:
    """``share``: of toxic rows. Without ``models`` it is every text's score."""

    share: float
    models: KneserNey | TableModel | None = None
    middle: np.ndarray | None = None
    scale: np.ndarray | None = None
    beta: np.ndarray | None = None

    def score(self, features: np.ndarray, empty: np.ndarray) -> np.ndarray:
        """Scores of rows of text_features."""
        if self.beta is None:
            return np.full(len(features), self.share)
        z = self.beta[0] + ((features[:, 2:] - self.middle) / self.scale) @ self.beta[1:]
        return np.where(empty, self.share, 1 / (1 + np.exp(-np.clip(z, -30, 30))))


def with_columns(docs: DataFrame, more: dict[str, T.DataType], values) -> DataFrame:
    """``docs`` with columns of ``values(texts)``, a function made once in each task by ``values``'s maker."""
    schema = T.StructType([*docs.schema.fields, *(T.StructField(k, v) for k, v in more.items())])
    at = docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = values()
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([*part.columns, *made(part.column(at).to_pylist())], [*part.schema.names, *more])

    return docs.mapInArrow(rows, schema)


ADDED = ("ordinary_ll", "toxic_ll", "excess", "top", "clear", "score")


def new_names(columns: list[str], wanted: tuple[str, ...] = ADDED) -> tuple[str, ...]:
    """Free names for new columns, and for none the name of another."""
    names: list[str] = []
    for name in wanted:
        names.append(free_name([*columns, *names], name))
    return tuple(names)


def score_columns(model: ToxicityModel, texts: list[str | None], kept: CodedTable | KnownWords | None) -> list[pa.Array]:
    """Texts' features and scores; ``kept`` has the likelihoods of words."""
    found = features(texts, kept, 1) if kept is not None else np.zeros((len(texts), FEATURES))
    score = model.score(found, np.array([not (x and x.strip()) for x in texts], bool))
    return [pa.array(c, pa.float64()) for c in (*found.T, score)]


def scored(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with each text's log-likelihoods a character, features and score, under ``new_names`` of its columns."""
    names = new_names(docs.columns)
    if isinstance(model.models, TableModel):
        curve_, at = replace(model, models=None), docs.columns.index("text")

        def rows(part: pa.RecordBatch, kept: KnownWords) -> list[pa.Array]:
            return score_columns(curve_, part.column(at).to_pylist(), kept)

        return with_word_values(docs, dict.fromkeys(names, T.DoubleType()), split, EDGE, model.models.values, rows)
    held = docs.sparkSession.sparkContext.broadcast(model)  # written to a file as it is: the driver makes no second copy

    def values():
        model = held.value
        kept = CodedTable(model.models.own().words, MOST_WORDS) if model.models is not None else None

        return lambda texts: score_columns(model, texts, kept)

    return with_columns(docs, dict.fromkeys(names, T.DoubleType()), values)


def curve_inputs(texts: list[str | None], kept: CodedTable | KnownWords) -> pa.Array:
    """What the curve weighs of each text, for each class discount; null for empty texts."""
    found = features(texts, kept, len(CLASS_DISCOUNTS)).reshape(len(texts), len(CLASS_DISCOUNTS), FEATURES)[:, :, 2:].reshape(len(texts), -1)
    return pa.array([list(x) if text and text.strip() else None for text, x in zip(texts, found)], pa.list_(pa.float64()))


def unseen_features(rows: DataFrame, models: KneserNey) -> DataFrame:
    """label and x, what the curve weighs for each class discount, of ``rows`` (text, label) that are not empty; stored."""
    held = rows.sparkSession.sparkContext.broadcast(models)

    def values():
        kept = CodedTable(held.value.own().words, MOST_WORDS)
        return lambda texts: [curve_inputs(texts, kept)]

    out = staged(with_columns(rows.select("text", "label"), {"x": T.ArrayType(T.DoubleType())}, values).where("x is not null").select("label", "x"), "toxic-features")
    held.destroy()
    return out


def unseen_by_tables(rows: DataFrame, tables: GramTables) -> DataFrame:
    """``unseen_features`` of ``rows`` (text, label, fold) of all folds by a model that stays tables."""
    columns = [k for f in range(FOLDS) for k in class_columns(f)]
    own = [[*class_columns(f), len(columns)] for f in range(FOLDS)]

    def made(part: pa.RecordBatch, kept: KnownWords) -> list[pa.Array]:
        texts, fold_of = part.column(0).to_pylist(), part.column(2).to_numpy()
        at = [np.flatnonzero(fold_of == f) for f in range(FOLDS)]
        found = pa.concat_arrays([curve_inputs([texts[k] for k in some], kept.columns(c)) if len(kept.words) else pa.nulls(len(some), pa.list_(pa.float64())) for some, c in zip(at, own)])
        return [found.take(pa.array(np.argsort(np.concatenate(at))))]

    some = with_word_values(rows.select("text", "label", "fold"), {"x": T.ArrayType(T.DoubleType())}, split, EDGE, lambda words: tables.words(words, columns), made)
    return staged(some.where("x is not null").select("label", "x"), "toxic-features")


def sample_rows(docs: DataFrame, labels: DataFrame, label: str, learnable: Column, max_rows: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, label) of at most ``max_rows`` learnable rows of either class, and how many there are."""
    known = labels.where(learnable & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    ids = least_by_hash(known.where("label = 0"), max_rows, "doc_id").unionByName(least_by_hash(known.where("label = 1"), max_rows, "doc_id"))
    # at most 2 * max_rows ids
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), sizes


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, learnable: Column) -> tuple[DataFrame, dict[int, int]]:
    """(text, label, fold) of all learnable rows, stored, and how many labels there are of either class."""
    part = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int")
    known = labels.where(learnable & F.col(label).isin(0, 1)).select(F.col("doc_id").alias("labelled_"), F.col(label).cast("int").alias("label"), part.alias("fold"))
    known = staged(known, "toxic-labels")
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    rows = staged(matched(docs.select("doc_id", "text"), "doc_id", known, "labelled_").select("text", "label", "fold"), "toxic-rows") if len(sizes) == 2 else known
    if rows is not known:
        discard(known)
    return rows, sizes


def counted_words(batches: Iterator[pa.RecordBatch], kinds: int, edge: str, most: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Words and in how many texts of each kind they are, as ``word_counts`` says, whenever over ``most`` different ones are there."""

    def added(held: list[tuple[pa.Array, np.ndarray]]) -> tuple[pa.Array, np.ndarray]:
        """Words put together, each once, and the sums of their rows."""
        found = pa.concat_arrays([w for w, _ in held]).dictionary_encode()
        at, every = found.indices.to_numpy(), np.concatenate([n for _, n in held])
        order = np.argsort(at, kind="stable")
        return found.dictionary, np.add.reduceat(every[order], bounds(at[order])[:-1]) if len(at) else every

    held, size = [], 0
    for batch in batches:
        for part in slices(batch):
            of = part.column("kind").to_numpy() if kinds > 1 else np.zeros(part.num_rows, np.int64)
            at = 0
            for some in blocks(part.column("text").to_pylist()):
                codes, words, starts = coded([split(x) for x in some])
                once = np.sort(np.repeat(np.arange(len(some)) * len(words), np.diff(starts)) + codes)
                once = once[bounds(once)[:-1]] if len(once) else once
                kind = of[at : at + len(some)][once // max(len(words), 1)]
                n = np.bincount(once % max(len(words), 1) * kinds + kind, minlength=len(words) * kinds).reshape(-1, kinds)
                held.append((pc.utf8_trim(words, edge) if edge else words, n))
                size, at = size + len(words), at + len(some)
                if size > 2 * most:
                    held = [added(held)]
                    size = len(held[0][0])
                    if size > most:
                        yield held[0]
                        held, size = [], 0
    if held:
        yield added(held)


def word_counts(rows: DataFrame, kinds: int = 1, edge: str = "", most: int = 400_000) -> DataFrame:
    """word and its counts n0, n1, ...: in how many texts of each kind it is. ``rows``: text, and kind (less than ``kinds``) if there are several.

    Words are taken without characters of ``edge`` at either end; a text counts for each word that becomes one. Each task adds up
    over ``most`` different words before it passes them on, so a word may have several rows.
    """
    names = [f"n{k}" for k in range(kinds)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, n in counted_words(batches, kinds, edge, most):
            for k in range(0, len(words), 20_000):
                yield pa.RecordBatch.from_arrays([words[k : k + 20_000].cast(pa.string()), *(pa.array(c[k : k + 20_000]) for c in n.T)], ["word", *names])

    return rows.select("text", *["kind"][: kinds - 1]).mapInArrow(count, "word string, " + ", ".join(f"{c} long" for c in names))


def gram_counts(rows: DataFrame, names: list[str], most: int = 400_000, at_once: int = 100_000) -> DataFrame:
    """gram, initial (whether it is at a word's start) and counts under ``names``, one for each kind, as ``word_counts`` gives them.

    An n-gram's count is the sum of its words', so each task makes n-grams of the words that it has counted, and no word is
    shuffled. An n-gram may have several rows.
    """

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, counts in counted_words(batches, len(names), EDGE, most):
            for k in range(0, len(words), at_once):
                for points, initial, sums in word_grams(words[k : k + at_once].to_numpy(zero_copy_only=False).tolist(), counts[k : k + at_once]):
                    arrays = [strings(points), pa.array(initial), *(pa.array(c) for c in sums.astype(np.int64).T)]
                    yield from pa.Table.from_arrays(arrays, ["gram", "initial", *names]).to_batches(20_000)

    return rows.select("text", *["kind"][: len(names) - 1]).mapInArrow(grams, "gram string, initial boolean, " + ", ".join(f"{c} long" for c in names))


def corpus_counts(docs: DataFrame, words: list[str]) -> np.ndarray:
    """In how many of all texts each of the words is."""
    found = {r["word"]: r["n"] for r in word_counts(docs).where(F.col("word").isin(words)).groupBy("word").agg(F.sum("n0").alias("n")).collect()}
    return np.array([found.get(w, 0) for w in words], np.int64)


def counted_grams(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """All n-grams of all words, stored: n, key, before, after, initial, and the counts of ``Grams`` as n0 (shared) and k0, k1, ... by fold and class."""
    classes = 2 * FOLDS
    own = [f"k{k}" for k in range(classes)]
    zero = F.lit(0).cast("long")
    every = gram_counts(docs, ["n0"]).select("gram", "initial", "n0", *(zero.alias(c) for c in own))
    taught = gram_counts(rows.select("text", (2 * F.col("fold") + F.col("label")).alias("kind")), own).select("gram", "initial", zero.alias("n0"), *own)
    names = ["gram", "initial", "n0", *own]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("n").to_numpy()
            for n in np.unique(lengths):
                some = batch.filter(pa.array(lengths == n))
                points = np.frombuffer("".join(some.column("gram").to_pylist()).encode("utf-32-le"), "<u4").astype(np.uint64).reshape(-1, n)
                none = np.zeros(len(points), np.uint64)
                made = (gram_keys(points), *(gram_keys(p) if n > 1 else none for p in (points[:, :-1], points[:, 1:])))
                yield pa.RecordBatch.from_arrays([some.column("n"), *(pa.array(k.view(np.int64)) for k in made), *(some.column(c) for c in names[1:])], ["n", "key", "before", "after", *names[1:]])

    longs = ", ".join(f"{c} long" for c in ("n0", *own))
    every = every.unionByName(taught).groupBy("gram").agg(F.max("initial").alias("initial"), *(F.sum(c).alias(c) for c in ("n0", *own)))
    made = staged(every.withColumn("n", F.length("gram")), "toxic-grams")
    kinds = made.where("n > 1").groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("kinds"))
    full = F.col("initial") | (F.col("n") == ORDER)
    counts = [F.when(full, F.col("n0")).otherwise(F.coalesce("kinds", F.lit(0))).alias("n0"), *(F.when(full, F.col(c)).otherwise(0).alias(c) for c in own)]
    out = staged(made.join(kinds, "gram", "left").select("n", "gram", "initial", *counts).mapInArrow(keys, f"n int, key long, before long, after long, initial boolean, {longs}"), "toxic-counts")
    discard(made)
    return out


def collected(grams: DataFrame, most: int = MOST_GRAMS) -> Counted:
    """The n-grams for tasks to look up. Of an order with more than ``most``, those with equal first bits of their keys count as one: ``fit`` takes tables then."""
    own = [f"k{k}" for k in range(2 * FOLDS)]
    found = grams.groupBy("n").agg(F.count("*").alias("size"), F.max(F.greatest("n0", *own)).alias("most")).collect()
    sizes, kinds = {r["n"]: r["size"] for r in found}, {r["n"]: "int" if r["most"] < 1 << 31 else "long" for r in found}
    cut = [65 - most.bit_length() if sizes.get(n, 0) > most else 0 for n in range(ORDER + 1)]

    def merged(key: str, n: int) -> Column:
        """As ``shortened``."""
        return F.call_function("shiftleft", F.shiftright(key, cut[n]), F.lit(cut[n])).bitwiseOR(F.lit(n).cast("long")).alias(key) if cut[n] else F.col(key)

    def grams_at(n: int) -> Grams:
        some = grams.where(F.col("n") == n).select(merged("key", n), merged("before", n - 1), merged("after", n - 1), "initial", "n0", *own)
        if cut[n]:
            some = some.groupBy("key").agg(F.min("before").alias("before"), F.min("after").alias("after"), F.max("initial").alias("initial"), *(F.sum(c).alias(c) for c in ("n0", *own)))
        # most rows at most
        kind = kinds.get(n, "int") if not cut[n] else "long"
        table_ = some.select("key", "before", "after", "initial", *(F.col(c).cast(kind) for c in ("n0", *own))).toArrow()
        key = table_.column("key").to_numpy().view(np.uint64)
        order = np.argsort(key)
        before, after = (table_.column(c).to_numpy().view(np.uint64)[order] for c in ("before", "after"))
        counts = np.empty((len(order), 1 + len(own)), np.int32 if kind == "int" else np.int64)
        for k, c in enumerate(("n0", *own)):
            counts[:, k] = table_.column(c).to_numpy()[order]
        return Grams(key[order], before, after, table_.column("initial").to_numpy()[order], counts)

    def orders() -> Iterator[Grams]:
        for n in range(1, ORDER + 1):
            yield grams_at(n)
            pa.default_memory_pool().release_unused()

    return Counted.of(orders(), np.array(cut, np.uint64))


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, most: int = MOST_GRAMS) -> ToxicityModel:
    """Models of all texts and all learnable rows, and the curve over all of these. With over ``most`` n-grams of an order the models stay tables."""
    rows, sizes = labelled_rows(docs, labels, "toxic", learnable)
    share = sizes.get(1, 0) / max(sum(sizes.values()), 1)
    if len(sizes) < 2:
        discard(rows)
        return ToxicityModel(share)
    grams = counted_grams(docs, rows)
    taught = grams.where("n = 1 AND initial").agg(*(F.sum(f"k{k}") for k in range(2 * FOLDS))).first()
    by_fold = np.array([x or 0 for x in taught]).reshape(FOLDS, 2)  # each word starts with the frame
    if not (by_fold.sum(0) - by_fold).all():  # a class without words outside a fold
        discard(rows, grams)
        return ToxicityModel(share)
    if not grams.groupBy("n").count().where(F.col("count") > most).isEmpty():
        tables = gram_tables(grams, ORDER, FOLDS, CLASS_DISCOUNTS, UNSEEN)
        found = unseen_by_tables(rows, tables)
        discard(rows, grams)
        which, *curve_ = curve(found, sizes)
        discard(found)
        return ToxicityModel(share, TableModel(tables, which), *curve_)
    counted = collected(grams, most)
    unseen = [unseen_features(rows.where(F.col("fold") == f), counted.model(CLASS_DISCOUNTS, f)) for f in range(FOLDS)]
    found = staged(reduce(DataFrame.unionByName, unseen), "toxic-curve")  # read in each step: one table has fewer parts
    discard(rows, grams, *unseen)
    which, *curve_ = curve(found, sizes)
    discard(found)
    return ToxicityModel(share, counted.model(CLASS_DISCOUNTS[which : which + 1]), *curve_)


def curve(rows: DataFrame, sizes: dict[int, int], steps: int = 40) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """The class discount of least log loss over all ``rows`` (label, x), and middle, scale and coefficients of its logistic curve."""
    width, many = FEATURES - 2, len(CLASS_DISCOUNTS)

    def summed(values: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
        """Sums over all rows of what ``values`` adds up of a batch's x and labels."""

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                if batch.num_rows:
                    total += values(batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1), batch.column("label").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], [f"s{k}" for k in range(size)])

        made = rows.mapInArrow(sums, ", ".join(f"s{k} double" for k in range(size)))
        return np.array([x or 0.0 for x in made.agg(*(F.sum(f"s{k}") for k in range(size))).first()])

    first = summed(lambda x, y: np.concatenate([np.bincount(y, minlength=2), x.sum(0)]), 2 + width * many)
    of_class, middle = first[:2], first[2:] / first[:2].sum()
    scale = np.sqrt(summed(lambda x, y: ((x - middle) ** 2).sum(0), width * many) / of_class.sum()) + 1e-9
    # rows weigh as often as their class does among all labelled rows
    weight = np.array([sizes[c] for c in (0, 1)]) / np.maximum(of_class, 1)
    weight *= of_class.sum() / (weight * of_class).sum()
    beta, size = np.zeros((many, width + 1)), (width + 1) * (width + 2) + 1
    for _ in range(steps):

        def values(x: np.ndarray, y: np.ndarray, beta=beta) -> np.ndarray:
            z = (x - middle) / scale
            return np.concatenate([newton_sums(z[:, k * width : (k + 1) * width], y, weight[y], beta[k]) for k in range(many)])

        found = summed(values, size * many).reshape(many, size)
        step = np.stack([newton_step(f, b) for f, b in zip(found, beta)])
        beta = beta + step
        if np.abs(step).max() < 1e-7:
            break
    which = int(np.argmin(found[:, -1]))
    some = slice(which * width, (which + 1) * width)
    return which, middle[some], scale[some], beta[which]


def learnable() -> Column:
    return fold(5) != 0


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored; rows with crc32(doc_id) mod 5 = 0 teach nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = scored(docs, fit(docs, table(spark, sf_dir, "labels"), learnable()))
    return made.select("doc_id", (~learnable()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "ordinary_ll", "toxic_ll")
