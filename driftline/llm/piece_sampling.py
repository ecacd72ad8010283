"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice, and lossless decoding.

A text's lattice has all ways to write it as pieces of the vocabulary. Forward filtering sums, for each place, the
weights of all paths up to it; backward sampling then walks from the end and picks each piece in proportion to the paths
through it, so whole segmentations come with the probability that the pieces' weights give them. A piece weighs
``1 / (rank + 2)``, by its rank in the vocabulary, to the power ``theta``; byte pieces stand in for characters that are
no piece. Random numbers are a hash of the seed, the row's key, the word's place and the step, so a row is segmented
alike on any executor, in any order, at any try.

No piece reaches over a space into the next word, so the lattice falls apart into words; the tables of a word serve all
its occurrences. Arrays of a slice of rows are sampled together.

Spaces are kept as they are, with no dummy prefix and no normalisation: decoding the pieces gives the text back, to the
byte. Control pieces are never used.

Defined results: a null text counts as empty, and has no pieces. A null key counts as a key of its own. Repeated rows
are segmented alike. Very long texts are segmented whole, a few texts at a time. An empty table gives an empty result. Extra
columns are kept; a new column whose name is taken gets underscores.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, types as T
from pyspark.sql import functions as F

from .common import free_name, slices, table
from .minhash_dedup import mix
from .token_counts import tokenizer_path
from .words import CHUNK, KeyIndex, framed, ngram_hashes

MODEL, THETA, SEED = "piece_bpe_32k.model", 0.8, 7
#: Words whose tables are kept.
MAX_WORDS = 60_000
RUNS = re.compile(r" *[^ ]+| +")


def chunks(text: str) -> list[str]:
    """Words with the spaces before them."""
    if "  " in text or text.endswith(" "):
        return RUNS.findall(text)
    first, *rest = text.split(" ")
    return ([first] if first else []) + [f" {x}" for x in rest]


class GrowingArray:
    """An array that grows at its end."""

    def __init__(self, dtype: type):
        self.values, self.used = np.zeros(1024, dtype), 0

    def append(self, more: np.ndarray) -> None:
        if self.used + len(more) > len(self.values):
            self.values = np.concatenate([self.values[: self.used], np.zeros(self.used + 2 * len(more), self.values.dtype)])
        self.values[self.used : self.used + len(more)] = more
        self.used += len(more)


class Lattice:
    """The vocabulary of a model file, and the tables of the words that came so far."""

    def __init__(self, path: str, theta: float = THETA, most: int = MAX_WORDS):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.most = most
        self.bytes_of = [b""] * model.get_piece_size()
        self.byte_ids = np.zeros(256, np.int32)
        pieces: list[tuple[int, str]] = []
        for i in range(model.get_piece_size()):
            name = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(name[1:-1], 16)] = i
                self.bytes_of[i] = bytes([int(name[1:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces.append((i, name.replace("▁", " ")))
                self.bytes_of[i] = pieces[-1][1].encode()
        self.longest = max(len(p) for _, p in pieces)
        points, starts, distance = framed([p for _, p in pieces])
        lengths, ids = np.array([len(p) for _, p in pieces]), np.array([i for i, _ in pieces], np.int32)
        ranks = np.argsort(np.argsort([-model.get_score(int(i)) for i in ids], kind="stable"))
        log_weight = -theta * np.log(ranks + 2.0)
        self.bytes_weight = -theta * np.log(len(ids) + 2.0)
        self.by_length: list[tuple[KeyIndex, np.ndarray, np.ndarray]] = []
        for n, key, _ in ngram_hashes(points, distance, self.longest):
            own = np.flatnonzero(lengths == n)
            keys = key[starts[own] + n]
            order = np.argsort(keys)
            self.by_length.append((KeyIndex(keys[order]), ids[own][order], log_weight[own][order]))
        self.clear()

    def clear(self) -> None:
        self.end_of: dict[str, int] = {}
        self.first, self.start = GrowingArray(np.int64), GrowingArray(bool)
        self.upto, self.back, self.piece = GrowingArray(np.float32), GrowingArray(np.int16), GrowingArray(np.int32)

    def choices(self, points: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, ...]:
        """state, length, log weight and id of every piece that ends at a state."""
        state, length, weight, piece = [], [], [], []
        alone = distance > 0
        for n, key, _ in ngram_hashes(points, distance, self.longest):
            at = np.flatnonzero(distance >= n)
            index, ids, weights = self.by_length[n - 1]
            found = index.find(key[at])
            hit = np.flatnonzero(found >= 0)
            at, found = at[hit], found[hit]
            if n == 1:
                alone[at] = False
            for column, values in ((state, at), (length, np.full(len(at), n)), (weight, weights[found]), (piece, ids[found])):
                column.append(values)
        lone = np.flatnonzero(alone)  # characters that are no piece
        for column, values in ((state, lone), (length, np.ones(len(lone), int)), (weight, np.full(len(lone), self.bytes_weight * 3)), (piece, -1 - points[lone].astype(np.int32))):
            column.append(values)
        return tuple(map(np.concatenate, (state, length, weight, piece)))

    def tables(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Ends of the words among states; each state's first choice and whether it is a start; choices, likeliest first."""
        points, starts, distance = framed(words)
        n_states = len(points)
        distance[starts[1:] - 1], distance[-1] = -1, -1  # the frame's end is no state
        choices = self.choices(points, distance)
        order = np.argsort(distance[choices[0]] * n_states + choices[0])
        state, length, weight, piece = (x[order] for x in choices)
        before = state - length
        heads = np.flatnonzero(np.concatenate([[True], state[1:] != state[:-1]]))
        sizes = np.diff(np.append(heads, len(state)))
        level = distance[state[heads]]
        edges = np.flatnonzero(np.concatenate([[True], level[1:] != level[:-1], [True]]))
        forward, chance = np.zeros(n_states), np.empty(len(state))
        for lo, hi in zip(edges[:-1], edges[1:]):  # states at one distance from their word's start
            a, b = heads[lo], heads[hi] if hi < len(heads) else len(state)
            ways = weight[a:b] + forward[before[a:b]]
            cut, size = heads[lo:hi] - a, sizes[lo:hi]
            top = np.maximum.reduceat(ways, cut)
            part = np.exp(ways - np.repeat(top, size))
            total = np.add.reduceat(part, cut)
            forward[state[heads[lo:hi]]] = top + np.log(total)
            chance[a:b] = part / np.repeat(total, size)
        order = np.argsort(2.0 * state - chance)
        state, length, piece, chance = state[order], length[order], piece[order], chance[order]
        first = np.searchsorted(state, np.arange(n_states + 1))
        sums = np.cumsum(chance)
        upto = sums - np.concatenate([[0.0], sums])[first[state]]
        upto[first[1:][first[1:] > first[:-1]] - 1] = 2.0
        return np.append(starts[1:], n_states) - 2, first[:-1], distance == 0, upto, length.astype(np.int16), piece

    def learn(self, words: list[str]) -> None:
        new = [w for w in set(words) if w not in self.end_of]
        if not new:
            return
        if len(self.end_of) + len(new) > self.most:
            self.clear()
            new = list(set(words))
        for k in range(0, len(new), CHUNK):
            some = new[k : k + CHUNK]
            ends, first, start, *more = self.tables(some)
            self.end_of.update(zip(some, (ends + self.first.used).tolist()))
            for column, values in zip((self.first, self.start, self.upto, self.back, self.piece), (first + self.upto.used, start, *more)):
                column.append(values)

    def sample(self, texts: list[str], keys: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts in a row, and where each text's begin (and the last one's end)."""
        split = [chunks(x) for x in texts]
        words = [w for x in split for w in x]
        many = np.array([len(x) for x in split], np.int64)
        if not words:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        self.learn(words)
        now = np.fromiter(map(self.end_of.__getitem__, words), np.int64, len(words))
        place = np.arange(len(words)) - np.repeat(np.cumsum(many) - many, many)
        with np.errstate(over="ignore"):
            key = mix(np.repeat(mix(keys.astype(np.int64).view(np.uint64) ^ mix(np.array([seed], np.uint64))), many) + place.astype(np.uint64))
        steps, live, found = np.zeros(len(words), np.int64), np.arange(len(words)), []
        first, start, upto, back, piece = (x.values for x in (self.first, self.start, self.upto, self.back, self.piece))
        while len(live):
            with np.errstate(over="ignore"):
                u = (mix(key[live] + steps[live].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(float) * 2.0**-53
            choice = first[now[live]]
            over = np.flatnonzero(upto[choice] <= u)
            while len(over):
                choice[over] += 1
                over = over[upto[choice[over]] <= u[over]]
            found.append((live, steps[live], piece[choice]))
            now[live] -= back[choice]
            steps[live] += 1
            live = live[~start[now[live]]]
        ends = np.cumsum(steps)
        ids = np.zeros(int(ends[-1]), np.int32)
        for word, step, piece in found:
            ids[ends[word] - 1 - step] = piece
        offsets = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(many)])]
        return self.with_bytes(ids, offsets)

    def with_bytes(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte pieces in the place of characters that are no piece."""
        lone = np.flatnonzero(ids < 0)
        if not len(lone):
            return ids, offsets
        raw = [chr(-1 - int(x)).encode("utf-8", "surrogatepass") for x in ids[lone]]
        times = np.ones(len(ids), np.int64)
        times[lone] = [len(x) for x in raw]
        ends = np.cumsum(times)
        out = np.repeat(ids, times)
        out[out < 0] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        return out, np.concatenate([[0], ends])[offsets]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def lattice(path: str, theta: float) -> Lattice:
    return Lattice(path, theta)


def row_key(column: str = "doc_id") -> Column:
    return F.xxhash64(F.col(column))


def encode(docs: DataFrame, model: str, theta: float = THETA, seed: int = SEED, key: Column | None = None, name: str = "pieces") -> DataFrame:
    """``docs`` with the sampled piece ids of each whole text. ``model`` is the path of a file that all executors have."""
    name = free_name(docs.columns, name)
    keyed = free_name([*docs.columns, name], "row_key")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))])
    at = docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = lattice(model, theta)
        for batch in batches:
            for part in slices(batch, 64):
                texts = [x or "" for x in part.column(at).to_pylist()]
                ids, offsets = held.sample(texts, part.column(part.num_columns - 1).to_numpy(), seed)
                pieces = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pieces], [*part.schema.names[:-1], name])

    return docs.withColumn(keyed, key if key is not None else row_key()).mapInArrow(rows, schema)


def decode(encoded: DataFrame, model: str, pieces: str = "pieces", name: str = "decoded") -> DataFrame:
    """``encoded`` with the text that its pieces spell."""
    name = free_name(encoded.columns, name)
    schema = T.StructType([*encoded.schema.fields, T.StructField(name, T.StringType())])
    at = encoded.columns.index(pieces)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = lattice(model, THETA)
        for batch in batches:
            for part in slices(batch, 64):
                made = [held.decode(x.values.to_numpy()).decode() if x.is_valid else None for x in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.string())], [*part.schema.names, name])

    return encoded.mapInArrow(rows, schema)


def round_trip(docs: DataFrame, model: str, theta: float = THETA, seed: int = SEED) -> DataFrame:
    """doc_id, n_chars, n_pieces, pieces_sha256, lossless: encoding and decoding in one pass, without the pieces' way through Spark."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = lattice(model, theta)
        for batch in batches:
            for part in slices(batch, 64):
                texts = [x or "" for x in part.column("text").to_pylist()]
                ids, offsets = held.sample(texts, part.column("row_key").to_numpy(), seed)
                own = [ids[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(map(len, own), pa.int64()),
                     pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in own]), pa.array([held.decode(x) == t.encode() for x, t in zip(own, texts)], pa.bool_())],
                    ["doc_id", "n_chars", "n_pieces", "pieces_sha256", "lossless"],
                )

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key().alias("row_key"))
    return keyed.mapInArrow(rows, "doc_id long, n_chars long, n_pieces long, pieces_sha256 string, lossless boolean")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents segmented by sampling and spelled back."""
    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path(MODEL))
