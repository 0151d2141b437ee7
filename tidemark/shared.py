"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of our own where that is unset (local runs)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", where)
        spark.sparkContext.setCheckpointDir(where)
    return where


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of some MB, whatever the length of texts: it bounds what a Python worker holds."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def bounded_tasks(spark: SparkSession) -> None:
    """Shuffled partitions are merged to tasks of 2 MB (compressed) at most: short texts that repeat take some 70 times that when sorted."""
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(2 << 20))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    """df written to the shared folder and read again: it cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of saved() that nothing reads any more: all that came from them has been written itself."""
    for df in tables:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.saved_path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
