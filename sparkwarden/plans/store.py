"""Stage tables: written once, read many times.

Stages cut the lineage between parsing, detection, correlation and enrichment. They are Parquet tables in the shared
folder named by spark.checkpoint.dir, so a lost executor costs a re-read and column pruning and filters reach the scan.
"""

from __future__ import annotations

import hashlib
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

FOLDER = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder. Only where none is named (single machine, tests) a temporary one is used.

    A named folder is shared by agreement, as Spark's own checkpoints take it to be: also a path without a scheme, such as a
    mounted one, and the form file:/path in which Spark gives back what setCheckpointDir was told."""
    named = spark.conf.get(FOLDER, None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{FOLDER} must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="sparkwarden-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def listed(spark: SparkSession, path: str) -> str:
    """A hash of the names, sizes and times of the files at `path`, at any depth; empty if there are none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return ""
    found, seen = files.listFiles(at, True), []
    while found.hasNext():
        f = found.next()
        seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest() if seen else ""


class Store:
    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or f"{shared_folder(spark)}/stages-{uuid.uuid4().hex[:12]}"
        self._done: dict[str, DataFrame] = {}
        self._kept: dict[str, str] = {}
        self._locks: dict[str, threading.RLock] = {}

    def keep(self, path: str) -> str:
        """Notes what is at `path`, which later reads rely on."""
        self._kept[path] = listed(self.spark, path)
        return path

    def whole(self) -> bool:
        """Whether all that was written is still there: shared folders may be cleared between jobs."""
        return all(listed(self.spark, path) == was for path, was in list(self._kept.items()))

    def has(self, name: str) -> bool:
        return name in self._done

    def table(self, name: str, build) -> DataFrame:
        """The stage table, built by build() on first use. Queries that run at once wait for the one that writes it."""
        with self._locks.setdefault(name, threading.RLock()):
            if name not in self._done:
                path = f"{self.folder}/{name}"
                build().write.mode("overwrite").parquet(path)
                self._done[name] = self.spark.read.parquet(self.keep(path))
            return self._done[name]
