"""Line dedup: lines found in many documents are dropped from all of them.

Documents per line are counted by a grouped sum over the lines' 128-bit hashes. The frequent ones are cut into shards, and
each shard is laid out as a minimal perfect hash with arrays of fingerprints and counts (about 13 bytes a line). Documents
probe these arrays: there is no join of lines. Shards are broadcast in groups of a fixed number of bytes, one narrow pass
over the documents for each group; the groups, not their size, grow with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwarden.llm.common import LOWER, UPPER, staged
from sparkwarden.llm.perfect_hash import CountedKeys

c = F.col
MIN_DOCS, SHARD_KEYS, GROUP_BYTES = 10, 1 << 18, 64 << 20
TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
BLANK = b" \t\n\x0b\x0c\r"


def hashes_of(lines: list[bytes]) -> np.ndarray:
    """Two 64-bit numbers per line's key; zeros for an empty key."""
    keys = [x.strip(BLANK).translate(TO_LOWER) for x in lines]
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(k) if k else b"\0" * 16 for k in keys]), dtype=np.uint64).reshape(-1, 2)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's distinct keys."""
    for b in batches:
        found = []
        for t in b["text"]:
            h = hashes_of((t.as_py() or "").encode().split(b"\n"))
            found.append(np.unique(h[(h != 0).any(axis=1)], axis=0) if len(h) > 1 else h[(h != 0).any(axis=1)])
        h = np.concatenate(found) if found else np.zeros((0, 2), dtype=np.uint64)
        h = np.ascontiguousarray(h).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1])], ["key", "print"])


def frequent(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """key, print, n_docs of the lines found in at least `min_docs` rows of `docs` (text)."""
    lines = docs.select(c("text").cast("string")).mapInArrow(_lines, "key bigint, print bigint")
    return lines.groupBy("key", "print").agg(F.count(F.lit(1)).alias("n_docs")).where(c("n_docs") >= min_docs)


def _arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard; a shard has about SHARD_KEYS rows."""
    def laid(shard: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        a = np.concatenate(parts, axis=1)
        packed = CountedKeys.build(a[0].view(np.uint64), a[1].view(np.uint64), a[2]).packed()
        return pa.RecordBatch.from_pylist([{"shard": shard, "starts": packed[0], "bits": packed[1], "prints": packed[2], "counts": packed[3]}])

    held, of = [], None
    for b in batches:
        a = np.stack([b[k].to_numpy() for k in ("key", "print", "n_docs")])
        shard = b["shard"].to_numpy()
        for s in np.unique(shard).tolist():
            if of is not None and s != of:
                yield laid(of, held)
                held = []
            of = s
            held.append(np.ascontiguousarray(a[:, shard == s]))
    if held:
        yield laid(of, held)


def arrays(lines: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """One row per shard (the perfect hash and its arrays), and the number of shards that keys are dealt over.

    Different lines with the same first 64 bits cannot share a perfect hash: they go to shards of the next layer."""
    one = staged(lines.withColumn("layer", F.row_number().over(Window.partitionBy("key").orderBy("print")) - 1), "lines")
    shards = max(1, -(-one.count() // shard_keys))
    dealt = one.select((F.pmod("key", F.lit(shards)) + c("layer") * shards).cast("bigint").alias("shard"), "key", "print", "n_docs")
    return staged(dealt.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(
        _arrays, "shard bigint, starts binary, bits binary, prints binary, counts binary"), "arrays"), shards


def _dropped(shards: int, group) -> object:
    """A pass over documents that drops the lines counted in the broadcast group of shards."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {int(k): CountedKeys.unpacked(*v) for k, v in group.value.items()}
        for b in batches:
            texts, n, gone = [], [], []
            for t in b["text"]:
                lines = (t.as_py() or "").encode().split(b"\n")
                h = hashes_of(lines)
                drop = np.zeros(len(h), dtype=bool)
                home = h[:, 0].view(np.int64) % shards
                for k, x in tables.items():
                    at = np.flatnonzero((home == k % shards) & (h != 0).any(axis=1))
                    if len(at):
                        drop[at] |= x.count(h[at, 0], h[at, 1]) > 0
                n.append(len(lines))
                gone.append(int(drop.sum()))
                texts.append(b"\n".join([x for x, d in zip(lines, drop.tolist(), strict=True) if not d]).decode()
                             if gone[-1] else t.as_py())
            columns = [pa.array(texts, pa.string()) if k == "text" else b[k] for k in b.schema.names if k not in ("_n", "_gone")]
            first, before = ("_n" not in b.schema.names), pa.array(gone, pa.int64())
            columns += [pa.array(n, pa.int64()) if first else b["_n"], before if first else pc.add(b["_gone"], before)]
            yield pa.RecordBatch.from_arrays(columns, [k for k in b.schema.names if k not in ("_n", "_gone")] + ["_n", "_gone"])

    return run


def deduplicated(docs: DataFrame, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """All rows and columns of `docs` (text), the text without frequent lines, and n_lines (before dropping) and n_dropped.

    Lines end at \\n. A line's key is the line without `[\\x20\\x09-\\x0D]` at both ends, A-Z lower-cased; empty keys are never
    dropped. A key counts once per row, however often a row has it; repeated rows count each. Lines with keys found in at
    least `min_docs` rows go, in every row; the others stay as they are, joined by \\n. A null or empty text is one empty
    line and stays as it is. No rows give no rows. Columns named n_lines, n_dropped, _n or _gone are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped", "_n", "_gone").withColumn("text", c("text").cast("string"))
    table, shards = arrays(frequent(docs, min_docs), shard_keys)
    size = F.octet_length("starts") + F.octet_length("bits") + F.octet_length("prints") + F.octet_length("counts")
    groups: list[list[int]] = [[]]
    room = group_bytes
    for r in table.select("shard", size.alias("bytes")).orderBy("shard").toLocalIterator():
        if groups[-1] and r.bytes > room:
            groups.append([])
            room = group_bytes
        groups[-1].append(r.shard)
        room -= r.bytes
    schema = T.StructType([*docs.schema.fields, T.StructField("_n", T.LongType()), T.StructField("_gone", T.LongType())])
    out = docs
    for group in groups:
        rows = table.where(c("shard").isin(group)).collect() if group else []
        held = spark.sparkContext.broadcast({r.shard: (bytes(r.starts), bytes(r.bits), bytes(r.prints), bytes(r.counts)) for r in rows})
        out = out.mapInArrow(_dropped(shards, held), schema)
    return out.withColumnsRenamed({"_n": "n_lines", "_gone": "n_dropped"})
