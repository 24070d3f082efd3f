"""Raw binary files through Spark's own writers, so that any store and Spark's task commits serve them.

The text writer puts a line separator after each value. Given values without their last byte, and that byte as the separator, it
writes the values themselves, end to end. All values must therefore end in a zero byte.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, hadoop, list_files


def write_raw(rows: DataFrame, path: str, order: list[str]) -> None:
    """One file for each value of rows.file, of rows.value (binary, each without its last, zero byte) in order."""
    rows = rows.sortWithinPartitions("file", *order)
    rows.select("file", F.col("value").cast("string").alias("value")).write.partitionBy("file").option("lineSep", "\0").text(path)


def commit(spark: SparkSession, tmp: str, path: str, suffix: str, about: dict) -> list[str]:
    """Give the files below tmp their final names in path, then write the manifest, which alone makes them valid."""
    fs, at = hadoop(spark, path)
    fs.mkdirs(at)
    names = []
    for name, size in list_files(spark, tmp):
        final = f"{name.rsplit('/', 2)[1].removeprefix('file=')}{suffix}"
        if not fs.rename(hadoop(spark, name)[1], hadoop(spark, f"{path}/{final}")[1]):
            raise OSError(f"cannot rename {name} to {path}/{final}")
        names.append([final, size])
    out = fs.create(hadoop(spark, f"{path}/_MANIFEST.tmp")[1], True)
    out.write(bytearray(json.dumps(about | {"files": sorted(names)}, sort_keys=True).encode()))
    out.close()
    fs.rename(hadoop(spark, f"{path}/_MANIFEST.tmp")[1], hadoop(spark, f"{path}/_MANIFEST.json")[1])
    drop_path(spark, tmp)
    return [f"{path}/{n}" for n, _ in sorted(names)]


def manifest(spark: SparkSession, path: str) -> dict:
    fs, at = hadoop(spark, f"{path}/_MANIFEST.json")
    it = fs.open(at)
    try:
        return json.loads(bytes(it.readAllBytes()))
    finally:
        it.close()


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """file (its final name), content: the files that the manifest names, each whole and of the size that it states."""
    files = manifest(spark, path)["files"]
    if not files:
        return spark.createDataFrame([], "file string, content binary")
    have = {n.rsplit("/", 1)[1]: s for n, s in list_files(spark, path)}
    if wrong := [n for n, s in files if have.get(n) != s]:
        raise OSError(f"{path} lacks files of its manifest, or has others: {wrong[:3]}")
    read = spark.read.format("binaryFile").load([f"{path}/{n}" for n, _ in files])
    return read.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
