"""Stages whose tables are kept under a digest of all that they rest on, and made only where they aren't there yet.

A stage's key is the SHA-256 of its name, its version, its parameters and its inputs: other stages by their keys, files by name, size and time of change. Its
table is written under a name of its own and moved to its key's folder in one rename, with its schema beside it; a stage counts as done where both are
there. So a second run reads what the first one made without a job, a change makes anew what depends on it and nothing else, a stopped
run leaves no half of a table in place, and runs at the same time make the same table.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Stage:
    """A stage's key, its table, and whether this run made it."""

    key: str
    table: DataFrame
    made: bool


class Stages:
    """Stages below a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def files(self, path: str) -> str:
        """A digest of the files that a path (with wildcards, or a folder) stands for: their names, sizes and times of change."""
        fs, names = self._path(path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), []
        for status in fs.globStatus(self._path(path)) or []:
            found = fs.listFiles(status.getPath(), True)
            while found.hasNext():
                f = found.next()
                names.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
        return hashlib.sha256(json.dumps(sorted(names)).encode()).hexdigest()

    def run(self, name: str, make: Callable[..., DataFrame], inputs: dict[str, Stage | str] | None = None, version: int = 1, **params) -> Stage:
        """make(spark, **tables and paths, **params) as a stored table. inputs: stages, or paths of files. version: to be raised when make changes."""
        inputs = inputs or {}
        on = {k: v.key if isinstance(v, Stage) else self.files(v) for k, v in inputs.items()}
        key = hashlib.sha256(json.dumps([name, version, on, params], sort_keys=True).encode()).hexdigest()
        folder = f"{self.root}/{name}/{key}"
        made = not self._done(folder)
        if made:
            given = {k: v.table if isinstance(v, Stage) else v for k, v in inputs.items()}
            self._store(make(self.spark, **given, **params), folder)
        return Stage(key, self.spark.read.schema(self._schema(folder)).parquet(f"{folder}/table"), made)

    def drop(self, name: str, keep: list[Stage]) -> int:
        """Delete the tables of a stage but those of keep; how many there were."""
        keys, gone = {s.key for s in keep}, 0
        for status in self._fs.globStatus(self._path(f"{self.root}/{name}/*")) or []:
            if status.getPath().getName() not in keys:
                self._fs.delete(status.getPath(), True)
                gone += 1
        return gone

    def _done(self, folder: str) -> bool:
        return self._fs.exists(self._path(f"{folder}/schema.json"))

    def _store(self, df: DataFrame, folder: str) -> None:
        draft = f"{folder.rsplit('/', 1)[0]}/_draft-{uuid.uuid4().hex}"
        df.write.parquet(f"{draft}/table")
        stream = self._fs.create(self._path(f"{draft}/schema.json"), True)
        stream.write(bytearray(df.schema.json().encode()))
        stream.close()
        if not self._fs.rename(self._path(draft), self._path(folder)) or not self._done(folder):
            self._fs.delete(self._path(draft), True)
            if not self._done(folder):  # no other run made it meanwhile
                raise OSError(f"no rename to {folder}")

    def _schema(self, folder: str) -> StructType:
        stream = self._fs.open(self._path(f"{folder}/schema.json"))
        text = bytes(stream.readAllBytes()).decode()
        stream.close()
        return StructType.fromJson(json.loads(text))
