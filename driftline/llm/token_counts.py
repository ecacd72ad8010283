"""Token counts with a digest cache.

Counts are stored by the SHA-256 of the normalised content and the digest of the tokenizer's file. A run joins the
documents' digests to the stored counts, encodes each distinct text that is missing once, and appends the new counts to
the cache. Byte-level tokenizers tell all texts apart, so their normalised content is the text itself, null as empty.

The cache is a Parquet table that only grows: its key makes a repeated append harmless, since readers take any row of a
key. Of each missing text one row is encoded, where it is stored; whole texts are never shuffled.

Defined results: a null text counts as empty, with 0 tokens. Repeated rows give a row each. Very long texts are encoded
whole. An empty table gives an empty result. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from .common import discard, only_rows, slices, staged, table, with_row_keys

LIMIT = 512
CACHE = "digest string, tokenizer string, n_bytes long, n_tokens long"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def counter(path: str):
    """A function from texts to token counts, by the library that the file is for."""
    if path.endswith(".json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.no_truncation()
        made.no_padding()
        return lambda texts: [len(x.ids) for x in made.encode_batch_fast(texts, add_special_tokens=False)]
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]


def encode(texts: DataFrame, path: str) -> DataFrame:
    """tag, n_bytes and n_tokens of rows (tag, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            for part in slices(batch, 64):
                found = part.column("text").to_pylist()
                yield pa.RecordBatch.from_arrays([part.column("tag"), pa.array([len(x.encode()) for x in found], pa.int64()), pa.array(count(found), pa.int64())], ["tag", "n_bytes", "n_tokens"])

    return texts.mapInArrow(rows, "tag long, n_bytes long, n_tokens long")


def read_cache(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(CACHE).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def count_tokens(docs: DataFrame, cache_path: str, tokenizer: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document; what the cache lacked is in it afterwards.

    ``tokenizer`` is the path of a vocabulary file that all executors have. Texts are digested and encoded where they are
    read; what is shuffled are digests, row keys and counts.
    """
    spark = docs.sparkSession
    version = hashlib.sha256(Path(tokenizer).read_bytes()).hexdigest()
    keyed = with_row_keys(docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")), "tag")
    digests = staged(keyed.select("doc_id", "tag", F.sha2("text", 256).alias("digest")), "digests")
    # one row stands for each text that the cache lacks
    firsts = digests.groupBy("digest").agg(F.min("tag").alias("first"))
    stored = read_cache(spark, cache_path)
    if stored is not None:
        firsts = firsts.join(stored.where(F.col("tokenizer") == version).select("digest"), "digest", "left_anti")
    firsts = staged(firsts, "missing")
    made = encode(only_rows(keyed.select("tag", "text"), firsts, "tag", "first"), tokenizer)
    new = firsts.join(made, F.col("first") == F.col("tag")).select("digest", F.lit(version).alias("tokenizer"), "n_bytes", "n_tokens")
    new.write.mode("append").parquet(cache_path)
    discard(firsts)
    counts = spark.read.schema(CACHE).parquet(cache_path).where(F.col("tokenizer") == version)
    # stored, so that both sides of the join come straight from its shuffle and a hot text's rows are split
    counts = staged(counts.groupBy("digest").agg(F.first("n_bytes").alias("n_bytes"), F.first("n_tokens").alias("n_tokens")), "token-counts")
    return digests.select("doc_id", "digest").join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents, from an empty cache of the run's own."""
    return count_tokens(table(spark, sf_dir, "documents"), f"{shared_dir(spark).rstrip('/')}/token-cache-{uuid.uuid4().hex}", tokenizer_path())
