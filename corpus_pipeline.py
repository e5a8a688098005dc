"""From raw documents to shards of a training mix: five stages, each written as Parquet and read again by the next.

In every stage rows keep all their columns as they are, whatever these are called; rows without a doc_id take part; null and
empty texts are texts without words; texts of any length are read whole; no rows give no rows. What is special to a
stage is said there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkwarden.llm import mixing, resampling, sharding, simhash, tiling
from sparkwarden.llm.common import removed, step, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
SHARDS = 8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the draw by importance weights rejects go. Rows without words are like any other; repeated rows and ties at
    the cut are decided alike, row by row. Labels of ids that no document has are not used."""
    return resampling.drawn(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays: one row of it, if it is repeated. A row without
    doc_id stays only where its group has no id. All texts without words are one group."""
    return simhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go, repeated rows and all. Texts without words contain none; no items, no leaks."""
    return tiling.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that the sources meet their targets. A null source is a source. Rows without words are
    left out; repeated rows count each and are repeated together."""
    return mixing.remixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its shard and its slot there. Repeated rows are counted each; ties are ordered by the text's crc32.
    Columns named shard or slot are replaced."""
    return sharding.sharded(docs, SHARDS)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", decontamination),
    ("mixing sources", mix),
    ("sharding", shards),
]

#: Fingerprints and hashed n-gram models have no SQL form; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`: its columns, and shard and slot."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = step(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:  # the next stage reads what this one wrote
            removed(before)
        before = docs
    return docs
