"""Shared folders, written tables and small Spark helpers for the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch handed to Python: bounds a worker's memory whatever the texts' lengths.
ARROW_ROWS, ARROW_BYTES = 1000, 8 << 20


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that a worker's memory does not follow the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a folder of our own in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="quillrank-")
    spark.conf.set("spark.checkpoint.dir", base)
    spark.sparkContext.setCheckpointDir(base)
    return base


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quillrank/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: df as a table in the shared folder, read back."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hadoop(spark: SparkSession, path: str):
    """(file system, path) of Hadoop's API for any store that Spark can reach."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def drop_path(spark: SparkSession, path: str) -> None:
    fs, at = hadoop(spark, path)
    fs.delete(at, True)


def list_files(spark: SparkSession, path: str, suffix: str = "") -> list[tuple[str, int]]:
    """(full name, bytes) of the files below path, by name; nothing if path does not exist."""
    fs, at = hadoop(spark, path)
    if not fs.exists(at):
        return []
    found, it = [], fs.listFiles(at, True)
    while it.hasNext():
        s = it.next()
        name = s.getPath().toString()
        if name.endswith(suffix) and not name.rsplit("/", 1)[1].startswith(("_", ".")):
            found.append((name, s.getLen()))
    return sorted(found)


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))
