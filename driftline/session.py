"""What a session needs: this package on its executors, and a folder that they share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Rows and bytes of an Arrow batch at most: whole texts go to Python tasks, and a batch is held several times over.
BATCH_ROWS, BATCH_BYTES = 2_000, 32 << 20
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, and bound the session's Arrow batches to BATCH_ROWS and BATCH_BYTES."""
    context = spark.sparkContext
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    if context.applicationId in _shipped:
        return
    here = Path(__file__).parent
    archive = os.path.join(tempfile.mkdtemp(prefix="driftline-"), "driftline.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(here.rglob("*.py")):
            out.write(path, path.relative_to(here.parent))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset (a local session, as in tests) a temporary folder is set instead.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_before.isDefined():
            return set_before.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="driftline-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage ends there, and no executor's loss matters."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    _paths[made] = path
    return made


def by_key(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that grows with the input: rows meet by a shuffle on the key, and none are broadcast.

    Spark broadcasts what its statistics call small, and those of a table are its files' bytes: encoded, columns of patients and bins take
    a small part of what their rows take in the driver, which builds the broadcast.
    """
    return df.hint("merge")


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        path = _paths.pop(df, None)
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
