"""Mixing sources to target weights by hash-threshold histograms.

Each document has a 60-bit hash of its id. Tokens are summed by source and hash bucket; a running sum over a source's
buckets finds the bucket in which its budget runs out. Only that boundary bucket is refined, by the next bits of the
hash, until the threshold is exact. The mix is then a filter on ``hash <= threshold``; documents are never sorted, and
a larger budget always takes a superset of a smaller one's documents.

Budgets: sources in code point order (null last) weigh 5, 2, 1 and so on round; they share ``share`` of all tokens; a
source takes at most ``most`` times its own tokens, and what is left over is shared again by weight until no source is
above. That fixed point is min(most * size, weight * level), with one level for all sources.

Defined results: a null text has size 0, a null doc_id hashes as the empty text. Documents of one hash are taken or left
together. A budget over a source's size takes all its documents once or twice, and a part of them once more. Documents
of size 0 follow their hash like others and take 0 tokens. Very long texts count whole; one moves whole. An empty table gives
an empty result. Extra columns are kept by ``take_mix``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, free_name, staged, table

WEIGHTS = (5, 2, 1)
#: Bits of the hash, and of a bucket at each step.
BITS, STEP = 60, 12
#: Tables with a row per source are broadcast up to this many rows.
MAX_BROADCAST_SOURCES = 100_000


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def hashed(doc_id: str = "doc_id") -> Column:
    """The first 60 bits of the MD5 of the id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: float = 3.0) -> DataFrame:
    """source, source_size, target: one row per source. The windows run over these rows alone."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    rows = by_source.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    # in the order in which sources reach their caps: what earlier ones take, and the weight of this and later ones
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "weight", F.encode("source", "utf-8"))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    still = F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    total = share * F.sum("source_size").over(whole)
    rows = rows.withColumn("level", (total - before) / still)
    open_ = F.col("weight") * F.col("level") < F.col("cap")
    level = F.min(F.when(open_, F.struct(F.col("cap") / F.col("weight"), "level"))).over(whole)["level"]
    return rows.select("source", "source_size", F.coalesce(F.least("cap", F.col("weight") * level), F.col("cap")).alias("target"))


def small(table: DataFrame, rows: int) -> DataFrame:
    """Broadcast only what has few rows; beyond that Spark joins by a shuffle."""
    return F.broadcast(table) if rows <= MAX_BROADCAST_SOURCES else table


def thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """The targets with full (times that all is taken) and threshold (hashes up to it are taken once more; -1: none)."""
    n = targets.count()
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    edge = targets.select("*", full.alias("full"), (F.col("target") - full * F.col("source_size")).alias("left"), F.lit(0).cast("long").alias("prefix"))
    same = F.col("source").eqNullSafe(F.col("at"))
    for bits in range(BITS - STEP, -1, -STEP):
        budget = small(edge.select(F.col("source").alias("at"), "left", "prefix"), n)
        inside = sizes.join(budget, same & (F.shiftright("h", bits + STEP) == F.col("prefix")))
        bins = inside.groupBy("at", "left", F.shiftright("h", bits).alias("bucket")).agg(F.sum("size").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("at").orderBy("bucket"))
        # the buckets that fit whole, and the first that does not: the boundary
        found = bins.withColumn("upto", upto).groupBy("at").agg(
            F.coalesce(F.max(F.when(F.col("upto") <= F.col("left"), F.col("upto"))), F.lit(0)).alias("used"),
            F.min(F.when(F.col("upto") > F.col("left"), F.col("bucket"))).alias("bound"),
        )
        edge = staged(
            edge.join(small(found, n), same, "left").select(
                *targets.columns, "full", (F.col("left") - F.coalesce("used", F.lit(0))).alias("left"),
                # without a boundary all fits: the threshold goes past this prefix
                F.coalesce("bound", F.shiftleft(F.col("prefix") + 1, STEP)).alias("prefix"),
            ), "mix-edge")
    # where nothing is left, nothing is taken once more, empty documents neither
    none = (F.col("full") > 0) & (F.col("full") * F.col("source_size") >= F.col("target"))
    return edge.select(*targets.columns, "full", F.when(none, F.lit(-1)).otherwise(F.col("prefix") - 1).cast("long").alias("threshold"))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """The documents' sizes and hashes, and each source's limits with its name as ``at``."""
    sizes = staged(docs.select("doc_id", F.col("source").cast("string").alias("source"), hashed().alias("h"), words().alias("size")), "mix-sizes")
    targets = staged(source_targets(sizes, weights, share, most), "mix-targets")
    limits = thresholds(sizes, targets).withColumnRenamed("source", "at")
    return sizes, small(limits, limits.count())


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: float = 3.0) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row per document, left ones too (copies 0)."""
    sizes, limits = mix_plan(docs, weights, share, most)
    copies = (F.col("full") + (F.col("h") <= F.col("threshold")).cast("long")).alias("copies")
    mixed = sizes.join(limits, F.col("source").eqNullSafe(F.col("at"))).select("doc_id", "source", "size", "source_size", "target", copies)
    return mixed.withColumn("taken", F.col("copies") * F.col("size"))


def take_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: float = 3.0) -> DataFrame:
    """The rows of ``docs`` that the mix takes, each as often as it takes them."""
    names = docs.columns
    _, limits = mix_plan(docs.select("doc_id", "source", "text"), weights, share, most)
    at, full, threshold, copies, copy = (free_name(names, f"mix_{x}") for x in ("at", "full", "threshold", "copies", "copy"))
    limits = limits.select(F.col("at").alias(at), F.col("full").alias(full), F.col("threshold").alias(threshold))
    n = (F.col(full) + (hashed() <= F.col(threshold)).cast("long")).cast("int")
    joined = docs.join(small(limits, limits.count()), F.col("source").cast("string").eqNullSafe(F.col(at))).withColumn(copies, n).where(F.col(copies) > 0)
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*names)


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: every source at its target."""
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS weight FROM s
), f AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap,
         (sum(source_size) OVER () - coalesce(sum(3.0::DOUBLE * source_size) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(weight) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), l AS (
  SELECT arg_min(level, cap / weight) AS level FROM f WHERE weight * level < cap
), t AS (
  SELECT f.source, source_size, coalesce(least(cap, weight * l.level), cap) AS target FROM f LEFT JOIN l ON true
), r AS (
  SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS full_,
         sum(size) OVER (PARTITION BY d.source ORDER BY h) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * (full_ + CASE WHEN upto <= target - full_ * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""
