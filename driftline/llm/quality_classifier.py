"""Quality classifier: supervised subword embeddings.

Each word and each character n-gram of it has a learned vector, found by hash; so have pairs of one word up to ``APART``
places apart, which are hashed by their distance alone. A text's vector is the mean over all its
words' features; a softmax over two linear outputs gives the probability of quality. Vectors and outputs are trained
together by stochastic gradient descent in numpy, on a bounded sample of labelled rows: ``MAX_ROWS`` of either class,
those of least hash, with texts of at most ``max_chars`` characters. Both bounds are parameters of ``fit`` and bound what the
driver holds; class shares are those of all learnable rows, and longer texts are scored whole like all others.

The softmax of a mean is linear in the features up to its end, so a trained model needs one number a feature; a word's
sum is kept by word while a task runs.

Defined results: a null text counts as empty, and an empty text's score is the share of good rows. Repeated rows get
equal scores. Without learnable rows of both classes all scores are that share (0 without labels). An empty table gives
an empty result. Labels outside 0 and 1 are ignored. Extra columns are kept; where one is named as the score, that gets underscores.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, types as T
from pyspark.sql import functions as F

from .common import fold, free_name, table
from .toxicity import sample_rows, with_columns
from .words import WordTable, framed, ngram_hashes

#: Hash buckets, vector length, lengths of n-grams.
BUCKETS, DIM, SHORTEST, LONGEST = 1 << 17, 12, 3, 5
MAX_ROWS, MAX_CHARS = 2_000, 50_000
#: Passes at most, passes without a better loss on the share of rows held out that end training, step, and pull of weights to 0.
EPOCHS, PATIENCE, HELD_OUT, RATE, DECAY, SEED = 20, 2, 8, 0.1, 1e-4, 11
#: Word pairs up to so many places apart whose second word is the first again are n-grams too, hashed by their distance alone, as a
#: back-reference: each has one of the last buckets and counts as any other feature.
APART = 4


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words, and the word that each belongs to."""
    points, starts, distance = framed(words)
    of = np.repeat(np.arange(len(words)), np.diff(np.append(starts, len(points))))
    ids, owner = [np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.int64, len(words)) % (BUCKETS - APART)], [np.arange(len(words))]
    for n, key, there in ngram_hashes(points, distance, LONGEST):
        if n >= SHORTEST:
            ids.append((key[there] % np.uint64(BUCKETS - APART)).astype(np.int64))
            owner.append(of[there])
    return np.concatenate(ids), np.concatenate(owner)


def repeats(words: list[str]) -> np.ndarray:
    """How many words of a text are the one 1, 2, ... ``APART`` places before again."""
    return np.array([sum(map(eq, words, words[k:])) for k in range(1, APART + 1)])


def text_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a text and how often it has them."""
    words = (text or "").split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    kinds, inverse = np.unique(np.array(words, object), return_inverse=True)
    times = np.bincount(inverse)
    ids, owner = word_features(kinds.tolist())
    features, back = np.unique(np.append(ids, BUCKETS - 1 - np.arange(APART)), return_inverse=True)
    return features, np.bincount(back, np.append(times[owner], repeats(words)))


@dataclass
class QualityModel:
    """``weights``: a feature's part of the log odds; ``shift``: what class shares add. Without weights the share is every score.

    ``loss`` is that of the training rows held out.
    """

    share: float
    weights: np.ndarray | None = None
    shift: float = 0.0
    loss: float = float("nan")

    def words(self, words: list[str]) -> np.ndarray:
        """Sum of weights and number of features of each word."""
        ids, owner = word_features(words)
        return np.column_stack([np.bincount(owner, self.weights[ids], len(words)), np.bincount(owner, minlength=len(words))])


def train(texts: list[str], y: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> tuple[np.ndarray, list[float]]:
    """Feature weights from SGD over the texts, and the loss on held-out ones (one in ``HELD_OUT``) after each pass.

    Steps are divided by the root of the squared gradients that a feature has had, so none grows without bound, and weights decay.
    The weights of the pass of least held-out loss count; training ends ``PATIENCE`` passes after it.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    outputs = np.zeros((2, DIM), np.float32)
    had, had_out = np.full(BUCKETS, 1e-3, np.float32), np.full((2, DIM), 1e-3, np.float32)
    rows = [text_counts(t) for t in texts]
    rows = [(ids, (n / max(n.sum(), 1)).astype(np.float32)) for ids, n in rows]
    order = rng.permutation(len(rows))
    tests, own = (order[: len(rows) // HELD_OUT], order[len(rows) // HELD_OUT :]) if len(rows) >= 4 * HELD_OUT else (order, order)
    losses: list[float] = []
    best = np.zeros(BUCKETS)
    for _ in range(epochs):
        for i in rng.permutation(own):
            ids, part = rows[i]
            if not len(ids):
                continue
            hidden = part @ vectors[ids]
            out = outputs @ hidden
            p = np.exp(out - out.max())
            error = p / p.sum()
            error[y[i]] -= 1
            step, step_out = part[:, None] * (error @ outputs), np.outer(error, hidden)
            had_out += step_out**2
            outputs -= rate * (step_out / np.sqrt(had_out) + DECAY * outputs)
            had[ids] += (step**2).sum(1)
            vectors[ids] -= rate * (step / np.sqrt(had[ids])[:, None] + DECAY * vectors[ids])
        weights = vectors @ (outputs[1] - outputs[0])
        margins = np.array([part @ weights[ids] for ids, part in (rows[i] for i in tests)])
        losses.append(float(np.logaddexp(0, np.where(y[tests] == 1, -margins, margins)).mean()))
        if losses[-1] <= min(losses):
            best = weights
        if len(losses) - 1 - int(np.argmin(losses)) >= PATIENCE:
            break
    return best, losses


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> QualityModel:
    """A model from learnable labelled rows: at most ``max_rows`` of a class, of texts of at most ``max_chars`` characters."""
    short = docs.where(F.length(F.coalesce("text", F.lit(""))) <= max_chars)
    sample, sizes = sample_rows(short, labels, "quality", learnable, max_rows)
    share = sizes.get(1, 0) / max(sum(sizes.values()), 1)
    if len(sizes) < 2:
        return QualityModel(share)
    rows = sample.select("doc_id", "text", "label").toPandas().sort_values(["doc_id", "text"], ignore_index=True)
    y = rows["label"].to_numpy()
    if len(set(y)) < 2:
        return QualityModel(share)
    weights, losses = train(rows["text"].tolist(), y)
    there = np.bincount(y, minlength=2)
    return QualityModel(share, weights, float(np.log(sizes[1] / sizes[0]) - np.log(there[1] / there[0])), min(losses))


def scored(docs: DataFrame, model: QualityModel, name: str = "score") -> DataFrame:
    """``docs`` with a score, under ``name`` with underscores if a column has that name."""
    name = free_name(docs.columns, name)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def values():
        kept = WordTable(held.value.words) if held.value.weights is not None else None

        def score(words: list[str], values: np.ndarray) -> float:
            total, n = values.sum(0)
            again = repeats(words)
            total, n = total + again @ held.value.weights[BUCKETS - 1 - np.arange(APART)], n + again.sum()
            return 1 / (1 + float(np.exp(-np.clip(total / n + held.value.shift, -30, 30))))

        def made(texts: list[str | None]) -> list[pa.Array]:
            words = [(x or "").split() for x in texts]
            if kept is None:
                return [pa.array([held.value.share] * len(words), pa.float64())]
            return [pa.array([score(w, v) if w else held.value.share for w, v in zip(words, kept.many(words))], pa.float64())]

        return made

    return with_columns(docs, {name: T.DoubleType()}, values)


def learnable() -> Column:
    return fold(4) != 2


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored; rows with crc32(doc_id) mod 4 = 2 teach nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = scored(docs, fit(docs, table(spark, sf_dir, "labels"), learnable()))
    return made.select("doc_id", (~learnable()).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
