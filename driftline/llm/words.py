"""Per-word values of a model, kept for the words that come again, and n-grams of words in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PRIME = np.uint64(0x100000001B3)
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Words scored at once: arrays stay within a core's cache.
CHUNK = 4096
#: Characters of texts whose words are numbered together.
BLOCK = 1 << 20


class WordTable:
    """Rows of ``score`` by word. Past ``most`` words the table starts afresh, so its size is bounded."""

    def __init__(self, score: Callable[[list[str]], np.ndarray], most: int = 150_000):
        self.score, self.most, self.at, self.rows = score, most, {}, None

    def learn(self, words: Iterable[str]) -> None:
        """Score the words that are new, some thousand at a time."""
        words = set(words)
        new = [w for w in words if w not in self.at]
        if not new:
            return
        if len(self.at) + len(new) > self.most:
            self.at, self.rows, new = {}, None, list(words)  # those that it knew too: all are asked for
        made = np.concatenate([self.score(new[k : k + CHUNK]) for k in range(0, len(new), CHUNK)])
        used = len(self.at)
        if self.rows is None or used + len(made) > len(self.rows):
            grown = np.zeros((max(1024, 2 * (used + len(made))), made.shape[1]), made.dtype)
            if self.rows is not None:
                grown[:used] = self.rows[:used]
            self.rows = grown
        self.rows[used : used + len(made)] = made
        self.at.update(zip(new, range(used, used + len(made))))

    def many(self, texts: list[list[str]]) -> Iterator[np.ndarray]:
        """The rows of each text's words."""
        self.learn(chain.from_iterable(texts))
        for words in texts:
            yield self(words)

    def __call__(self, words: list[str]) -> np.ndarray:
        at = np.fromiter(map(self.at.get, words, repeat(-1)), np.int64, len(words))
        if (at < 0).any():  # new words, or the table has started afresh since
            self.learn(words)
            at = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        return self.rows[at] if len(at) else np.zeros((0, 1))


def blocks(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Texts in turn, as many as have ``BLOCK`` characters, one at least."""
    first, size = 0, 0
    for k, text in enumerate(texts):
        if size and size + len(text or "") > BLOCK:
            yield texts[first:k]
            first, size = k, 0
        size += len(text or "")
    if first < len(texts):
        yield texts[first:]


def coded(texts: list[list[str]]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """A number for each word of all texts in turn, the word of each number, and where each text starts, and the end."""
    found = pa.array(chain.from_iterable(texts), pa.large_string()).dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary, np.cumsum([0, *map(len, texts)])


def strings(points: np.ndarray) -> pa.Array:
    """Rows of code points as strings."""
    sizes = 1 + (points > 0x7F).sum(1) + (points > 0x7FF).sum(1) + (points > 0xFFFF).sum(1) + (points.shape[1] - 1)
    ends = np.cumsum(np.concatenate([[0], sizes])).astype(np.int32)
    return pa.StringArray.from_buffers(len(points), pa.py_buffer(ends), pa.py_buffer(points.astype("<u4").tobytes().decode("utf-32-le").encode()))


class CodedTable:
    """Rows of ``score`` by word, as ``WordTable`` has them, of and for Arrow arrays of words."""

    def __init__(self, score: Callable[[list[str]], np.ndarray], most: int = 150_000):
        self.score, self.most, self.words, self.rows = score, most, pa.array([], pa.large_string()), None

    def __call__(self, words: pa.Array) -> np.ndarray:
        found = words.dictionary_encode()
        codes, words = found.indices.to_numpy(), found.dictionary
        at = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy().astype(np.int64)
        if (at < 0).any() and len(self.words) + (at < 0).sum() > self.most:
            self.words, self.rows, at = self.words[:0], None, np.full(len(words), -1)
        new = np.flatnonzero(at < 0)
        if len(new):
            asked = words.take(pa.array(new))
            list_ = asked.to_numpy(zero_copy_only=False).tolist()
            made = [self.score(list_[k : k + CHUNK]) for k in range(0, len(list_), CHUNK)]
            at[new] = np.arange(len(self.words), len(self.words) + len(new))
            self.words = pa.concat_arrays([self.words, asked])
            self.rows = np.concatenate([*([] if self.rows is None else [self.rows]), *made])
        return self.rows[at[codes]]


def framed(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of ``<word>`` for all words in a row, each word's first place, each place's distance from it."""
    points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    return points, starts, np.arange(len(points)) - np.repeat(starts, lengths)


def keyed(h: np.ndarray, n: int) -> np.ndarray:
    """Keys of n-grams' sums."""
    with np.errstate(over="ignore"):
        key = (h ^ np.uint64(n) * MIX) * MIX
        return key ^ (key >> np.uint64(29))


def gram_keys(points: np.ndarray) -> np.ndarray:
    """The keys that ``ngram_hashes`` gives to n-grams, a row of code points each."""
    h = np.zeros(len(points), np.uint64)
    with np.errstate(over="ignore"):
        for column in points.T:
            h = h * PRIME + column + np.uint64(1)
    return keyed(h, points.shape[1])


def ngram_hashes(points: np.ndarray, distance: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For n from 1 to ``most``: n, 64-bit keys of the n-grams that end at each place, and where the word reaches so far back."""
    h = np.zeros(len(points), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, most + 1):
            before = np.zeros(len(points), np.uint64)
            before[1:] = h[:-1]
            h = before * PRIME + points + np.uint64(1)
            yield n, keyed(h, n), distance >= n - 1


class KeyIndex:
    """Places of 64-bit keys in a sorted array, found by their high bits and a few steps."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, np.uint64(0))
        bits = max(1, int(np.ceil(np.log2(max(len(keys), 1)))) + 1)
        self.shift = np.uint64(64 - bits)
        self.start = np.zeros((1 << bits) + 1, np.int32)
        np.cumsum(np.bincount((keys >> self.shift).astype(np.int64), minlength=1 << bits), out=self.start[1:])

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each wanted key, -1 if it is not there."""
        bucket = (wanted >> self.shift).astype(np.int64)
        at, end = self.start[bucket], self.start[bucket + 1]
        out = np.where((at < end) & (self.keys[at] == wanted), at, np.int32(-1))
        left = np.flatnonzero((out < 0) & (at + 1 < end))
        while len(left):
            at[left] += 1
            hit = self.keys[at[left]] == wanted[left]
            out[left[hit]] = at[left[hit]]
            left = left[~hit & (at[left] + 1 < end[left])]
        return out
