"""Typed readers and writers, and the trajectory views of event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql import functions as F

from ..session import by_key

DYNAMIC = "pid string, time double, feature_name string, value double, treated int"
STATIC = "pid string, age int, sex int, cci int, Tmax double"
#: Day 0 of the event view.
ORIGIN = "2024-01-01"


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing in the inputs; plans here use NULL alone."""
    kinds = (T.DoubleType, T.FloatType)
    return df.select(*[F.when(F.isnan(f.name), None).otherwise(F.col(f.name)).alias(f.name) if isinstance(f.dataType, kinds) else F.col(f.name) for f in df.schema.fields])


def read_parquet(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A Parquet table by path, with the given schema or its own."""
    reader = spark.read.schema(schema) if schema else spark.read
    return nan_to_null(reader.parquet(path))


def read_scores_csv(spark: SparkSession, path: str, id_col: str, time_col: str, value_col: str) -> DataFrame:
    """(patient_id, time, lab_value) of a CSV with a header, whatever its columns are called. Other columns are not kept."""
    raw = spark.read.option("header", True).csv(path)
    number = lambda c: F.expr(f"try_cast(`{c}` as double)")
    return nan_to_null(raw.select(F.col(id_col).alias("patient_id"), number(time_col).alias("time"), number(value_col).alias("lab_value")))


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Write ``df``; ``partition_by`` lets later reads skip files."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write ``df`` with a header; nested columns become JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    flat = [F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields]
    df.select(*flat).write.mode(mode).option("header", True).csv(path)


def event_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as measurements: time in days; errors are a 0/1 medication; a large sign-up starts treatment."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    day = (F.unix_micros(F.col("ts").cast("timestamp")) - F.expr(f"unix_micros(timestamp'{ORIGIN}')")) / F.lit(86400e6)
    e = events.select("user_id", day.alias("time"), "event_type", "value")
    starts = e.where("event_type = 'signup' and value >= 150").groupBy("user_id").agg(F.min("time").alias("t_start"))
    error = F.col("event_type") == "error"
    return e.join(by_key(starts), "user_id", "left").select(
        F.concat(F.lit("P"), F.col("user_id").cast("string")).alias("pid"), "time",
        F.when(error, "Med_error").otherwise(F.col("event_type")).alias("feature_name"),
        F.when(error, F.when(F.col("value") >= 50, 1.0).otherwise(0.0)).otherwise(F.col("value")).alias("value"),
        F.coalesce(F.col("time") >= F.col("t_start"), F.lit(False)).cast("int").alias("treated"),
    )


def event_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer that has events."""
    c, e = spark.read.parquet(f"{sf_dir}/customer.parquet"), spark.read.parquet(f"{sf_dir}/events.parquet")
    key = F.col("c_custkey")
    return c.join(by_key(e.select(F.col("user_id").alias("c_custkey"))), "c_custkey", "left_semi").select(
        F.concat(F.lit("P"), key.cast("string")).alias("pid"), (45 + key % 40).cast("int").alias("age"), (F.col("c_nationkey") % 2).cast("int").alias("sex"),
        (key % 6).cast("int").alias("cci"), (20 + key % 11).cast("double").alias("Tmax"),
    )


def order_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a second set of trajectories: patient_id, time in years, lab_value."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("patient_id"),
        (F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")) / F.lit(365.25)).alias("time"),
        (F.col("o_totalprice").cast("double") / 1000.0).alias("lab_value"),
    )


def embedding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, x: the embedding as doubles."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
