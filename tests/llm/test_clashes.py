"""Columns of the caller come through untouched, whatever they are called."""

import math

import numpy as np

from sparkwarden.llm import hnsw, mixing, sharding, simhash

NAMES = ["_size", "_from", "_arc", "_hash", "_cell", "_rank", "_times", "_n", "_id", "_key", "_mark", "_row", "_row_id", "_row_mark", "row", "hash", "cell", "arc",
         "crc", "rank", "low", "high", "first", "mark", "id", "n", "times", "time", "key", "size", "of_id", "of_mark", "start", "begin", "set", "root"]


def test_columns_of_the_caller(spark):
    rows = [(i, f"some words of row {i} and more", "s", *[f"{n}-{i}" for n in NAMES]) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, " + ", ".join(f"`{n}` string" for n in NAMES))
    want = {r[0]: r for r in rows}
    for got, columns in ((sharding.sharded(docs, 3), [*docs.columns, "shard", "slot"]), (mixing.remixed(docs), docs.columns), (simhash.deduplicated(docs), docs.columns)):
        assert got.columns == columns
        out = [tuple(r)[: len(docs.columns)] for r in got.collect()]
        assert out and all(r == want[r[0]] for r in out)


def test_cosines_of_very_large_and_very_small_vectors():
    v = np.array([[1e200, 1.1e200], [1e-200, 1e-200], [3.0, 4.0], [5e-324, 0.0]])
    got = hnsw.cosines(v, np.array([1e200, 1e200]))
    want = [2.1 / math.sqrt(2 * 2.21), 1.0, 7 / math.sqrt(50), 1 / math.sqrt(2)]
    assert np.allclose(got, want, rtol=1e-12)
    one = np.array([0.3, -0.7, 0.11])
    assert hnsw.cosines(one[None], np.array([0.2, 0.5, -0.9]))[0] == (one @ np.array([0.2, 0.5, -0.9])) / (np.linalg.norm(one) * np.linalg.norm([0.2, 0.5, -0.9]))
