"""Exact dedup by progressive refinement: length, then a prefix hash, then the full hash.

Texts are equal when identical after each run of ASCII white space becomes one space. One scan gives a narrow row per
document; documents are grouped by length, those of shared lengths by a hash of the first characters, and only those
that still share a group by the SHA-256 of the whole text. Counts combine before their shuffle and are stored; what is
joined to them comes straight from its own shuffle, so that Spark splits the rows of a hot group over tasks.

Defined results: a null text equals the empty text. A null doc_id comes after all others. Rows with the same doc_id and
text are copies like others: one of them stays. Very long texts are read whole where they are and never shuffled. An empty
table gives an empty result. Extra columns, whatever their names, are ignored by ``exact_groups`` and kept by
``drop_copies``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, free_name, looked_up, matched, only_rows, staged, table, with_row_keys, without

#: Characters of the second step's prefix.
PREFIX = 256


def normalised(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def shared(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (a stored table) whose key another row has too."""
    counts = rows.groupBy(F.col(key).alias("of_")).agg(F.count("*").alias("n_")).where("n_ > 1").select("of_")
    found = staged(counts, f"shared-{key}")
    return matched(rows, key, found, "of_").drop("of_")


def exact_groups(docs: DataFrame, every_digest: bool = False, prefix: int = PREFIX) -> DataFrame:
    """One row per document: doc_id, tag (its row key), keep_id, group_size, kept, text_sha256.

    The digest of a document that is alone by length or prefix is computed only where ``every_digest`` asks for it, else
    it is null.
    """
    return groups_of(with_row_keys(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "tag"), every_digest, prefix)


def groups_of(docs: DataFrame, every_digest: bool, prefix: int = PREFIX) -> DataFrame:
    """``exact_groups`` of documents (tag, doc_id, text) that have their row keys."""
    text = F.col("text_")
    narrow = docs.select("doc_id", "tag", normalised("text").alias("text_"))
    first = narrow.select("doc_id", "tag", F.length(text).alias("k1"), F.xxhash64(F.length(text), F.substring(text, 1, prefix)).alias("k2"),
                          *([F.sha2(text, 256).alias("k3")] if every_digest else []))
    first = staged(first, "dedup-keys")
    same_length = staged(shared(first, "k1"), "same-length")
    same_prefix = staged(shared(same_length, "k2"), "same-prefix")
    if every_digest:
        full = same_prefix.select("doc_id", "tag", "k3")
    else:  # whole texts are read again for the surviving groups alone
        digests = only_rows(narrow.select("tag", "text_"), same_prefix, "tag", "tag").select(F.col("tag").alias("at_"), F.sha2(text, 256).alias("k3"))
        full = staged(same_prefix.select("doc_id", "tag").join(digests, F.col("tag") == F.col("at_")).drop("at_"), "full-digests")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")
    groups = staged(full.groupBy(F.col("k3").alias("of_")).agg(F.min(order).alias("least"), F.count("*").alias("n")).where("n > 1"), "dedup-groups")
    if not every_digest:
        first = looked_up(first.select("doc_id", "tag"), "tag", full.select(F.col("tag").alias("at_"), "k3"), "at_")
    out = looked_up(first, "k3", groups, "of_")
    alone = F.col("n").isNull()
    return out.select(
        "doc_id", "tag", F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("least.tag") == F.col("tag"))).alias("kept"), F.col("k3").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that repeat another row's text."""
    tag = free_name(docs.columns, "tag")
    keyed = with_row_keys(docs, tag)
    rows = keyed.select(F.col(tag).alias("tag"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    dropped = staged(groups_of(rows, False).where("not kept").select(F.col("tag").alias(tag)), "dedup-dropped")
    return without(keyed, dropped, tag).select(*docs.columns)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies among all documents; copies are listed too."""
    return exact_groups(table(spark, sf_dir, "documents"), every_digest=True).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
"""
