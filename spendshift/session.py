"""Session settings the operators rely on, and the shared scratch location."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}

# Rows made from a scan are some thirty times the size of the compressed file, so a task that sorts
# or folds those of a 128 MB split spills; those of 16 MB stay in its memory.
SCAN_BYTES = 16 << 20
_SCAN = "spark.sql.files.maxPartitionBytes"


def prepare(spark: SparkSession) -> SparkSession:
    """Set what results depend on, and bound the splits of a scan; safe to call before every query."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_SCAN)) > SCAN_BYTES:
        spark.conf.set(_SCAN, str(SCAN_BYTES))
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a private one only in local mode, where none is set."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = context.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spendshift-checkpoint-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir() or folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written intermediate table in the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/spendshift-{uuid.uuid4().hex}/{name}"


def settle(df: DataFrame) -> DataFrame:
    """Compute a table that several later steps read once, and cut its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Compute a table once, as files in the shared folder.

    Their size tells Spark which side of a join is the small one; of a checkpoint it only has the
    estimate of the plan before, so it would broadcast or shuffle the large side.
    """
    path = scratch_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_once(df: DataFrame, name: str, column: Column) -> DataFrame:
    """Add a costly column that is computed once a row.

    As a generator's output it is not copied into the filters and columns that use it.
    """
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != name], F.explode(F.array(column)).alias(name))
