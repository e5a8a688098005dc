import random
import re
from collections import Counter

import numpy as np

from sparkwarden.llm import line_dedup as L
from sparkwarden.llm.perfect_hash import CountedKeys, PerfectHash


def plain(texts, min_docs):
    strip = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x)
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in strip(x))
    found = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if found[key(x)] < min_docs or not key(x)]
        out.append(("\n".join(kept) if len(kept) < len(lines) else t, len(lines), len(lines) - len(kept)))
    return out


def rows(n=80):
    r = random.Random(5)
    pool = [f"Line {i}" for i in range(30)] + ["", "  ", "ÉTÉ", "été", "x\r", " x", "long " * 5000]
    texts = ["\n".join(r.choice([p, p.upper(), f" {p}\t"]) for p in r.choices(pool, k=r.randint(1, 12))) for _ in range(n)]
    return [*texts, None, "", "\n", "\n\n", texts[0], texts[0]]


def test_rows_equal_brute_force(docs):
    texts = rows()
    given = docs([(i if i % 7 else None, t, None) for i, t in enumerate(texts)])
    want = sorted(((i if i % 7 else None, *x) for i, x in enumerate(plain(texts, 10))), key=str)
    for shard_keys, group_bytes in ((1 << 18, 64 << 20), (3, 1)):  # one group; one group for each of several shards
        got = L.deduplicated(given, 10, shard_keys, group_bytes)
        assert got.columns == [*given.columns, "n_lines", "n_dropped"]
        assert sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=str) == want


def test_empty(docs):
    assert L.deduplicated(docs([])).count() == 0


def test_perfect_hash_is_minimal_and_fingerprints_reject():
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 1 << 63, 30_000).astype(np.uint64))
    assert sorted(PerfectHash.build(keys).index(keys).tolist()) == list(range(len(keys)))
    prints = r.integers(0, 1 << 63, len(keys)).astype(np.uint64)
    counted = CountedKeys.unpacked(*CountedKeys.build(keys, prints, np.arange(len(keys)) + 1).packed())
    assert (counted.count(keys, prints) == np.arange(len(keys)) + 1).all()
    assert not counted.count(keys + np.uint64(1), prints + np.uint64(1)).any() and not counted.count(keys, prints + np.uint64(1)).any()
    empty = CountedKeys.build(keys[:0], prints[:0], prints[:0])
    assert not empty.count(keys, prints).any()


def test_lines_with_equal_first_hashes(spark, docs):
    """Two frequent lines that share their first 64 bits go to two layers and are both found."""
    lines = spark.createDataFrame([(7, 1, 10), (7, 2, 12), (-9, 3, 11)], "key bigint, print bigint, n_docs bigint")
    table, shards = L.arrays(lines, 2)
    found = {r.shard: CountedKeys.unpacked(r.starts, r.bits, r.prints, r.counts) for r in table.collect()}
    probe = lambda k, p: sum(int(t.count(np.array([k], np.int64).view(np.uint64), np.array([p], np.uint64))[0])
                             for s, t in found.items() if s % shards == k % shards)
    assert (probe(7, 1), probe(7, 2), probe(-9, 3), probe(7, 3)) == (10, 12, 11, 0)
