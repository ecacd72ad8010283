"""What the operators share: table readers, staged tables, row keys, bit tables, Arrow batch helpers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import discard, ship, staged

#: A word: a run of anything but ASCII white space. ``bytes.split()`` splits alike.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(modulus: int) -> Column:
    """crc32 of doc_id as text, modulo; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def least_by_hash(df: DataFrame, rows: int, *columns: Column | str) -> DataFrame:
    """At most ``rows`` rows, those whose columns hash least: the same ones at any try.

    A count comes first, so that only about twice as many rows are sorted, whatever the table's size.
    """
    order = F.pmod(F.xxhash64(*columns), F.lit(1 << 40))
    total = df.count()
    if total > 2 * rows:
        df = df.where(order < int((1 << 40) * 2 * rows / total))
    return df.orderBy(order, *columns).limit(rows)


#: Bits of a row key that count rows of a file.
ROW_BITS = 40


def whole_files(rows: DataFrame) -> bool:
    """Whether ``rows`` (file_, place_) has each of a file's places 0 to n - 1 once, by their number, greatest, sum and sum of squares.

    These are added up where the rows are: what is shuffled is a row a task and file, and no row meets another.
    A row that is there twice in place of others would have to keep both sums.
    """
    n, whole = F.col("n").cast("decimal(12,0)"), F.col("place_").cast("decimal(12,0)")
    sums = rows.groupBy("file_").agg(F.count("*").alias("n"), F.max("place_").alias("last"), F.sum(whole).alias("first_power"), F.sum(whole * whole).alias("second_power"))
    once = (F.col("last") == F.col("n") - 1) & (2 * F.col("first_power") == n * (n - 1)) & (6 * F.col("second_power") == n * (n - 1) * (2 * n - 1))
    return sums.where(~F.coalesce(once, F.lit(False))).isEmpty()


def with_row_keys(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a long column ``name`` that tells its rows apart and is the same in every scan.

    A row's key is its file's number, by the files' order, and its place in that file, so it does not change with the
    number of executors. Rows that do not come straight from stored files (or are there twice, after a join) are stored
    first, and so are files read in part (see ``whole_files``). The table of files, a row for each, is broadcast; the driver has listed them anyway.
    """
    file, place = (F.xxhash64("_metadata.file_path"), F.col("_metadata.row_index"))
    try:
        rows = docs.select(file.alias("file_"), place.alias("place_"))
    except AnalysisException:
        docs = staged(docs, "rows")
    else:
        docs = docs if whole_files(rows) else staged(docs, "rows")
    own = free_name(docs.columns, "file_")
    files = docs.select(file.alias(own)).distinct()
    number, taken = free_name([*docs.columns, own], "number_"), free_name([*docs.columns, own], "of_file_")
    files = staged(files.select(F.col(own).alias(taken), (F.row_number().over(Window.orderBy(own)) - 1).cast("long").alias(number)), "files")
    at = free_name([*docs.columns, own, number, taken], "place_")
    marked = docs.select("*", file.alias(own), place.alias(at)).join(F.broadcast(files), F.col(own) == F.col(taken))
    return marked.select(*[f"`{c}`" for c in docs.columns], (F.shiftleft(number, ROW_BITS) + F.col(at)).alias(name))


#: Rows of a narrow table at most that is broadcast as it is, once it has been counted.
SMALL_ROWS = 100_000
#: Bits of a bit table for each key, and 64-bit words of a table at most: 2 million rows of 12 bytes.
BITS_PER_KEY, MOST_WORDS = 16, 1 << 21


@dataclass
class BitTable:
    """``words``: word_, mask_, the bits that keys set, or None where they are too many for a table to help.

    Without ``bits`` a key is its own bit, and the table is exact; else it is a hash of ``bits`` values.
    """

    words: DataFrame | None
    bits: int = 0

    def slot(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.bits)) if self.bits else F.col(key)


def words_of(keys: DataFrame, slot: Column) -> DataFrame:
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    return keys.groupBy(F.shiftright(slot, 6).alias("word_")).agg(F.bit_or(bit).alias("mask_"))


def bit_table(keys: DataFrame, key: str, most: int = MOST_WORDS) -> BitTable:
    """A table of as many bits as the keys need, within ``most`` words: so it may be broadcast. ``keys`` is a stored table."""
    n = keys.count()
    made = BitTable(None, min(1 << max(12, (BITS_PER_KEY * n - 1).bit_length()), 64 * most))
    if n <= made.bits:  # else over 6 of 10 bits would be set
        made.words = words_of(keys, made.slot(key))
    return made


def row_bit_table(keys: DataFrame, key: str, most: int = MOST_WORDS) -> BitTable:
    """An exact table of row keys (of ``with_row_keys``; those of one file are close), if it has at most ``most`` words."""
    words = staged(words_of(keys, F.col(key)), "row-bits")
    if words.count() <= most:
        return BitTable(words)
    discard(words)
    return bit_table(keys, key, most)


def split_by_bits(df: DataFrame, key: str, bits: BitTable) -> tuple[DataFrame, DataFrame]:
    """Rows whose key may be among those of ``bits`` (is, if the table is exact), and all others; nothing is shuffled.

    Without a table all rows may be: what follows is as right, and shuffles all rows.
    """
    if bits.words is None:
        return df, df.where(F.lit(False))
    names = df.columns
    slot, word, mask, may = (free_name(names, f"bits_{x}") for x in ("slot", "word", "mask", "may"))
    marked = df.withColumn(slot, bits.slot(key))
    marked = marked.join(F.broadcast(bits.words.toDF(word, mask)), F.shiftright(slot, 6) == F.col(word), "left")
    hit = F.call_function("shiftright", F.col(mask), F.col(slot).bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) != 0
    marked = marked.withColumn(may, F.coalesce(hit, F.lit(False)))
    quoted = [f"`{c}`" for c in names]
    return marked.where(F.col(may)).select(*quoted), marked.where(~F.col(may)).select(*quoted)


def only_rows(df: DataFrame, wanted: DataFrame, key: str, at: str) -> DataFrame:
    """Rows of ``df`` whose row key is in ``wanted``, a stored table. Nothing is shuffled if ``wanted`` is small or its bit table is exact."""
    keys = wanted.select(F.col(at).alias("wanted_"))
    on = F.col(key) == F.col("wanted_")
    if wanted.count() <= SMALL_ROWS:
        return df.join(F.broadcast(keys), on, "left_semi")
    bits = row_bit_table(wanted, at)
    may, _ = split_by_bits(df, key, bits)
    return may if bits.words is not None and not bits.bits else may.join(keys, on, "left_semi")


def without(df: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """``df`` less the rows whose row key is in ``dropped``, a stored table. Nothing is shuffled if that is small or its bit table
    is exact, else not the rows that surely stay."""
    if dropped.count() <= SMALL_ROWS:
        return df.join(F.broadcast(dropped), key, "left_anti").select(*[f"`{c}`" for c in df.columns])
    bits = row_bit_table(dropped, key)
    may, stays = split_by_bits(df, key, bits)
    if bits.words is not None and not bits.bits:
        return stays
    return stays.unionByName(may.join(dropped, key, "left_anti").select(*[f"`{c}`" for c in df.columns]))


def matched(df: DataFrame, key: str, found: DataFrame, at: str) -> DataFrame:
    """``df`` joined to ``found``, a stored narrow table: rows whose ``key`` is an ``at`` there. Few rows are broadcast.

    Beyond ``SMALL_ROWS`` only those rows of ``df`` are shuffled that may have a match, and both sides come straight from
    the join's shuffle, so that Spark splits a hot key's rows over tasks.
    """
    on = F.col(key) == F.col(at)
    if found.count() <= SMALL_ROWS:
        return df.join(F.broadcast(found), on)
    may, _ = split_by_bits(df, key, bit_table(found, at))
    return may.join(found, on)


def looked_up(df: DataFrame, key: str, found: DataFrame, at: str, also: Column | None = None) -> DataFrame:
    """``df`` with the columns of ``found``, a stored narrow table with one row at most for each ``at`` (and for what else
    the condition ``also`` compares); nulls where there is none.

    As in ``matched``, few rows are broadcast, and of more rows those that surely have no match are not shuffled.
    """
    on = (F.col(key) == F.col(at)) & (also if also is not None else F.lit(True))
    if found.count() <= SMALL_ROWS:
        return df.join(F.broadcast(found), on, "left")
    may, none = split_by_bits(df, key, bit_table(found, at))
    empty = none.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in found.schema.fields])
    return may.join(found, on, "left").unionByName(empty)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A batch in shorter ones, so that what Python holds at once stays small; what Arrow no longer needs is given back."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def grouped(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold whole groups each, of input sorted by ``key``; at most one group is carried over."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        if rest is not None:
            now = pa.concat_tables([rest, now])
        keys = now.column(key).to_numpy()
        cut = int(np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[-1])
        if cut:
            yield now.slice(0, cut).combine_chunks()
        rest = now.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks()


def bounds(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts, and the end."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def free_name(columns: Iterable[str], wanted: str) -> str:
    """``wanted``, with underscores until no column has that name."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
