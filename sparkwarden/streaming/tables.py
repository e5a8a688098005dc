"""Tables that grow a batch at a time, with a commit record per batch.

A batch writes its changes of every table into a folder of its own (a repeated batch replaces it), and then its record, by
renaming one file. Readers take what is recorded: a batch that failed between its writes leaves nothing to be seen. Keyed
tables are merged when read: the newest row of a key wins. Every COMPACT batches the merged table becomes the new base, so
a read merges a bounded number of changes.
"""

from __future__ import annotations

import json
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col
COMPACT = 8


class BatchTables:
    def __init__(self, spark: SparkSession, folder: str, compact: int = COMPACT):
        self.spark, self.folder, self.compact_every = spark, folder, compact
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def records(self) -> dict[int, dict]:
        """What is recorded of each batch: the schemas of its changes, and of which tables it has the base."""
        at = self._path(f"{self.folder}/_commits")
        if not self._fs.exists(at):
            return {}
        out = {}
        for f in self._fs.listStatus(at):
            name = f.getPath().getName()
            if name.isdigit():
                stream = self._fs.open(f.getPath())
                try:
                    text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                finally:
                    stream.close()
                out[int(name)] = json.loads(text)
        return out

    def write(self, batch_id: int, changes: dict[str, DataFrame], keys: dict[str, str]) -> None:
        """Writes a batch and its record. keys: of the tables that are merged, the column that names a row."""
        known = self.records()
        if batch_id in known:
            return
        record = {"changes": {}, "bases": []}
        for name, d in changes.items():
            d.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch_id={batch_id}")
            record["changes"][name] = d.schema.json()
        # A new base holds this batch as well; it counts from this record on.
        for name, key in keys.items():
            if sum(name in r["changes"] for b, r in known.items() if b > self._base(known, name)) + 1 >= self.compact_every:
                whole = self._merged(known | {batch_id: record}, name, key)
                whole.write.mode("overwrite").parquet(f"{self.folder}/{name}/base={batch_id}")
                record["bases"].append(name)
        self._record(batch_id, record)

    def _record(self, batch_id: int, record: dict) -> None:
        spare = self._path(f"{self.folder}/_commits/.{uuid4().hex}")
        out = self._fs.create(spare, True)
        try:
            out.write(bytearray(json.dumps(record).encode()))
        finally:
            out.close()
        if not self._fs.rename(spare, self._path(f"{self.folder}/_commits/{batch_id}")):
            raise OSError(f"batch {batch_id} could not be recorded")

    def _base(self, records: dict[int, dict], name: str) -> int:
        return max((b for b, r in records.items() if name in r["bases"]), default=-1)

    def _read(self, records: dict[int, dict], name: str, batches: list[int]) -> DataFrame:
        from pyspark.sql.types import StructType

        parts = [self.spark.read.schema(StructType.fromJson(json.loads(records[b]["changes"][name]))).parquet(f"{self.folder}/{name}/batch_id={b}")
                 .withColumn("batch_id", F.lit(b).cast("bigint")) for b in batches]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out

    def log(self, name: str) -> DataFrame | None:
        """All recorded changes of a table, with their batch_id; None before the first."""
        records = self.records()
        batches = sorted(b for b, r in records.items() if name in r["changes"])
        return self._read(records, name, batches) if batches else None

    def merged(self, name: str, key: str) -> DataFrame | None:
        """The newest row of each key, with the batch_id that wrote it; None before the first."""
        return self._merged(self.records(), name, key)

    def _merged(self, records: dict[int, dict], name: str, key: str) -> DataFrame | None:
        base = self._base(records, name)
        batches = sorted(b for b, r in records.items() if name in r["changes"] and b > base)
        parts = [self._read(records, name, batches)] if batches else []
        if base >= 0:
            parts.insert(0, self.spark.read.parquet(f"{self.folder}/{name}/base={base}"))
        if not parts:
            return None
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
        rest = [x for x in rows.columns if x != key]
        return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "batch_id").alias("u")).select(key, "u.*")
