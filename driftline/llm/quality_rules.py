"""Quality rules: hard limits on counts, then an isolation forest on rule statistics.

Each whole text gives a row of statistics. Documents that break a hard limit are dropped. For the rest an isolation
forest tells how few random splits separate a document's statistics from those of others: short paths are anomalies. The
forest's trees draw 256 rows each, from a bounded sample of all documents; the score from which documents are dropped is
calibrated on all labelled rows so that at most ``max_loss`` of the good ones go.

Defined results: a null text has no words and fails the limits. Repeated rows get equal rows. Without labelled rows of
both kinds nothing is dropped but by the limits. Very long texts are counted whole, one at a time. An empty table gives an
empty result. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, discard, least_by_hash, slices, staged, table

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = re.compile(r"[#*$%&|<>]")
BARE = string.punctuation.encode()
#: Documents that the trees draw from.
SAMPLE_ROWS = 20_000
TREES, PER_TREE, SEED = 100, 256, 17
#: Parts of the scores' range whose rows are put in order by themselves.
PARTS = 1 << 14
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Further statistics for the forest alone.
MORE = ("n_upper", "n_symbol_words", "n_upper_words", "n_bare_words", "n_echo_words", "n_lines")
SCHEMA = ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS + MORE)])


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window that the text has twice or more."""
    spans = list(zip(*(words[i:] for i in range(window))))
    if len(set(spans)) == len(spans):
        return 0
    times, hit = Counter(spans), np.zeros(len(words) + 1, np.int64)
    for at, span in enumerate(spans):
        if times[span] > 1:
            hit[at] += 1
            hit[at + window if at + window <= len(words) else len(words)] -= 1
    return int((np.cumsum(hit[:-1]) > 0).sum())


def line_counts(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that are equal to an earlier one."""
    lines = [x for x in text.split(b"\n") if x.split()]
    return len(lines), len(lines) - len(set(lines))


def statistics(text: bytes) -> tuple[int, ...]:
    """COUNTS and MORE of one text: capitals, words with a symbol, in capitals, without letter or digit, equal to the word before, and lines."""
    lines, again = line_counts(text)
    words = text.split()
    plain = b"".join(words).decode()
    symbols = len(SYMBOLS.findall(plain))
    return (
        len(words), len(plain), symbols, again, repeated_words(words), sum(map(str.isupper, plain)), sum(x.translate(None, b"#*$%&|<>") != x for x in words) if symbols else 0,
        sum(map(bytes.isupper, words)), sum(not x.translate(None, BARE) for x in words), sum(map(eq, words, words[1:])), lines,
    )


def rule_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every whole text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", *COUNTS, *MORE]
        for batch in batches:
            for part in slices(batch):
                columns = zip(*map(statistics, as_bytes(part.column("text"))))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in columns)], names)

    return docs.select("doc_id", "text").mapInArrow(rows, SCHEMA)


def features(rows: dict[str, np.ndarray]) -> np.ndarray:
    """Shares, which do not grow with a text as counts do, and the mean word length; short texts are held to the middle."""
    words, chars = rows["n_words"] + 8.0, rows["word_chars"] + 40.0
    of_words = [np.sqrt(rows[c] / words) for c in ("n_symbol_words", "n_upper_words", "n_bare_words", "n_echo_words", "n_repeat_words")]
    lines = np.sqrt(rows["n_dup_lines"] / (rows["n_lines"] + 2.0))
    return np.column_stack([np.sqrt(rows["n_symbols"] / chars), np.sqrt(rows["n_upper"] / chars), *of_words, lines, chars / words])


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of a failed search among n points."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as arrays of nodes: split feature (-1: leaf), split value, left child (right: the next), depth or path."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    path: np.ndarray
    roots: np.ndarray
    size: int

    @classmethod
    def grow(cls, x: np.ndarray, trees: int = TREES, per_tree: int = PER_TREE, seed: int = SEED) -> Forest:
        rng = np.random.default_rng(seed)
        feature, value, left, path, roots = [], [], [], [], []
        size = min(per_tree, len(x))
        limit = int(np.ceil(np.log2(max(size, 2))))

        def node() -> int:
            for column, nothing in ((feature, -1), (value, 0.0), (left, 0), (path, 0.0)):
                column.append(nothing)
            return len(feature) - 1

        for _ in range(trees):
            root = node()
            roots.append(root)
            work = [(root, x[rng.choice(len(x), size, replace=False)], 0)]
            while work:
                at, rows, depth = work.pop()
                low, high = rows.min(0), rows.max(0)
                open_ = np.flatnonzero(high > low)
                if depth >= limit or len(rows) < 2 or not len(open_):
                    path[at] = depth + float(mean_path(len(rows)))
                    continue
                f = int(rng.choice(open_))
                cut = rng.uniform(low[f], high[f])
                feature[at], value[at], left[at] = f, cut, node()
                node()
                less = rows[:, f] < cut
                work += [(left[at], rows[less], depth + 1), (left[at] + 1, rows[~less], depth + 1)]
        return cls(np.array(feature), np.array(value), np.array(left), np.array(path), np.array(roots), size)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly scores from 0 to 1: 2 ** -(mean path / expected path)."""
        total = np.zeros(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            live = np.arange(len(x))
            while len(live):
                f = self.feature[at[live]]
                live, f = live[f >= 0], f[f >= 0]
                at[live] = self.left[at[live]] + (x[live, f] >= self.value[at[live]])
            total += self.path[at]
        return 2.0 ** (-total / len(self.roots) / max(float(mean_path(self.size)), 1e-9))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def columns(frame) -> dict[str, np.ndarray]:
    return {c: frame[c].to_numpy() for c in COUNTS + MORE}


def anomalies(stats: DataFrame, forest: Forest | None) -> DataFrame:
    """doc_id, the counts and each row's anomaly score."""
    held = stats.sparkSession.sparkContext.broadcast(forest)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features({c: batch.column(c).to_numpy() for c in COUNTS + MORE})
            score = held.value.score(x) if held.value is not None else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *COUNTS)), pa.array(score)], ["doc_id", *COUNTS, "anomaly"])

    return stats.mapInArrow(rows, ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS), "anomaly double"]))


def best_limit(known: DataFrame, max_loss: float) -> float:
    """The score that best parts good from bad among all rows of ``known`` (anomaly, bad: 0 or 1), 2 if none does.

    It has the greatest true less false positive rate of those that lose at most ``max_loss`` of the good rows. Equal scores go together.
    """
    part = F.floor(F.col("anomaly") * PARTS).cast("int").alias("part")
    by_score = staged(known.groupBy("anomaly").agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good")).withColumn("part", part), "quality-scores")
    parts = by_score.groupBy("part").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).orderBy(F.desc("part")).collect()  # PARTS + 1 rows at most
    bad, good = sum(r["bad"] for r in parts), sum(r["good"] for r in parts)
    if not bad or not good:
        discard(by_score)
        return 2.0
    above, before = [], (0, 0)
    for r in parts:
        above.append((r["part"], *before))
        before = (before[0] + r["bad"], before[1] + r["good"])
    above = by_score.sparkSession.createDataFrame(above, "part int, bad_above long, good_above long")
    down = Window.partitionBy("part").orderBy(F.desc("anomaly"))
    sums = by_score.join(F.broadcast(above), "part").select("anomaly", (F.col("bad_above") + F.sum("bad").over(down)).alias("caught"), (F.col("good_above") + F.sum("good").over(down)).alias("lost"))
    gain = sums.where(F.col("lost") / good <= max_loss).select("anomaly", (F.col("caught") / bad - F.col("lost") / good).alias("gain")).where("gain > 0")
    best = gain.agg(F.max(F.struct("gain", "anomaly")).alias("best")).first()["best"]
    discard(by_score)
    return float(best["anomaly"]) if best is not None else 2.0


def fit(stats: DataFrame, labels: DataFrame, max_loss: float = 0.01, sample_rows: int = SAMPLE_ROWS) -> tuple[Forest | None, float]:
    """A forest on a sample of the documents within the limits, and the score from which documents go: of all labelled rows."""
    inside = stats.where(~base_failed())
    sample = least_by_hash(inside, sample_rows, "doc_id").toPandas()
    marked = labels.where("quality is not null").select(F.col("doc_id").alias("labelled_"), F.when(F.col("quality") == 0, 1).otherwise(0).alias("bad"))
    if not len(sample):
        return None, 2.0
    forest = Forest.grow(features(columns(sample)))
    known = anomalies(inside, forest).select("doc_id", "anomaly").join(marked, F.col("doc_id") == F.col("labelled_"))
    return forest, best_limit(known.select("anomaly", "bad"), max_loss)


def judge(docs: DataFrame, labels: DataFrame, max_loss: float = 0.01) -> DataFrame:
    """doc_id, the counts, base_failed, anomaly (0 to 1), kept: one row per document."""
    stats = staged(rule_statistics(docs), "rule-statistics")
    forest, limit = fit(stats, labels, max_loss)
    scored = anomalies(stats, forest).withColumn("base_failed", base_failed())
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < limit))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under the limits and the forest."""
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
