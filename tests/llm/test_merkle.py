"""Merkle manifests against their definition, with odd rows."""

from collections import Counter

import numpy as np
import pytest

from sparkwarden.llm import merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def audit(spark, rows, schema=SCHEMA):
    docs = spark.createDataFrame(rows, schema)
    return Counter(map(tuple, merkle.audited(merkle.manifest(merkle.tampered(docs))).collect()))


def wanted(rows):
    return Counter(merkle.plain(rows))


def test_many_leaves(spark):
    # Sources with 1, 2, 3, 4, 729, 730 and 1500 leaves; ids are neither dense nor in order.
    rows, sizes = [], {"a": 1, "b": 2, "c": 3, "d": 4, "e": 729, "f": 730, "g": 1500, None: 5, "": 2}
    n = 0
    for source, size in sizes.items():
        for _ in range(size):
            n += 1
            rows.append((n * 7919 % 300007, source, "en", n, f"text {n}\nmore"))
    got = audit(spark, rows)
    assert got == wanted(rows)
    assert {x[-1] for x in got} == {True, False}


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (None, "s", "en", 0, ""), (1, "s", None, 3, "a\nb"), (1, "s", None, 3, "a\nb"),
            (1, "s", "-", 3, "ab"), (-5, "s", "en", -1, "\n" * 50), (2**62, "s", "en", 1, "x\n" * 20000), (-(2**63), "s", "en", 1, "é\n"), (3, "ß", "", 1, "2:en"),
            (4, "ß", "2", 1, None)] + [(9, "hot", "en", 1, "same\ntext")] * 300 + [(9, "hot", "en", 1, f"other {i}") for i in range(200)]
    assert audit(spark, rows) == wanted(rows)
    assert not audit(spark, [])


def test_hot_ids_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "TASK_ROWS", 50)
    rows = [(9, "hot", "en", 1, f"text\n{i % 170}") for i in range(400)] + [(i, "hot", "en", 1, "x") for i in range(40)]
    assert audit(spark, rows) == wanted(rows)


def test_other_columns_are_not_read(spark):
    names = ["at", "node", "tree", "block", "slots", "total", "path", "claim", "leaf", "high", "low", "n"]
    rows = [(i, "s", "en", i, f"t{i}", *["x"] * len(names)) for i in range(10)]
    assert audit(spark, rows, f"{SCHEMA}, " + ", ".join(f"{x} string" for x in names)) == wanted([r[:5] for r in rows])


@pytest.mark.parametrize("n", [1, 100, 511, 512, 5000, 8192])
def test_containers(n):
    draw = np.random.default_rng(n)
    ids = np.sort(draw.choice(merkle.SPAN, n, replace=False))
    low = np.concatenate([ids, ids[: n // 3], ids[:1]])
    whole = merkle.Container.of(low)
    parts = [merkle.Container.of(p).packed() for p in np.array_split(draw.permutation(low), 5) if len(p)]
    assert merkle.Container.merged(parts).packed() == whole.packed() and whole.rows == len(low)
    rank, many = merkle.ranks(*whole.packed(), ids)
    ordered = np.sort(low)
    assert (rank == np.searchsorted(ordered, ids)).all() and (many == np.searchsorted(ordered, ids, "right") - rank).all()


def test_whole_table(spark, sample):
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in sample.collect()]
    got = Counter(map(tuple, merkle.audited(merkle.manifest(merkle.tampered(sample))).collect()))
    assert got == wanted(rows)
