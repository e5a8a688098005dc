import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkwarden.llm import mixing as M

ODD = [(None, "a b c", "s1"), (None, None, None), (7001, "", "s1"), (7002, "x", None), (7003, "x y z " * 9000, "s2"), (7004, "one two", ""), (7004, "one two", ""),
       (7005, "\x0b\x0c", "only blanks"), (7006, "é ü", "Ünïcode"), (7007, "w", "𐀀"), (7008, "w", "\uffff")]


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, passes=2):
    """Shares of what is left by weight, again and again, until no target is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left, open_ = {}, share * sum(sizes.values()), set(order)
    while open_:
        aim = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if aim[s] >= passes * sizes[s]}
        if not over:
            out |= aim
            break
        for s in over:
            out[s] = float(passes * sizes[s])
            left -= out[s]
        open_ -= over
    return out


def plain(rows):
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    aims = plain_targets(sizes)
    key = lambda r: (hashlib.md5(f"mix:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0, size(r[1]))
    out = []
    for s in sizes:
        quota, at = round(aims[s]), 0
        for r in sorted((x for x in rows if x[2] == s), key=key):
            n = size(r[1])
            taken = sum(max(0, min(at + k * sizes[s] + n, quota) - at - k * sizes[s]) for k in (0, 1))
            out.append((r[0], n, sizes[s], round(aims[s], 6), taken))
            at += n
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows(spark):
    sf = "/root/testdata/sf0.001"
    return [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + ODD


@pytest.mark.parametrize("block", [1024, 7])
def test_rows_equal_brute_force(docs, rows, block):
    got = M.mixed(docs(rows), block=block).collect()
    assert sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got), key=str) == plain(rows)


def test_sources_meet_targets_and_rows_are_repeated(docs, rows):
    got = M.mixed(docs(rows)).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert all(r.taken == round(r.target) for r in got)
    mix = M.remixed(docs(rows))
    assert mix.columns == docs(rows).columns
    times = Counter((r.doc_id, r.text, r.source) for r in mix.collect())
    want = Counter()
    for r in M.mixed(docs(rows).withColumn("_t", F.col("text")), carried=("_t",)).collect():
        want[r.doc_id, r._t, r.source] += int(r.taken / r["size"] + 0.5) if r["size"] else 0
    assert times == +want and max(times[x] / rows.count(x) for x in times) <= 2


def test_schedule_is_even_at_every_prefix(spark):
    """Any first part of the schedule holds each source near its share."""
    sources = spark.createDataFrame([(1, "a", 10**6, 600_000.0), (2, "b", 10**6, 300_000.0), (3, "c", 10**6, 100_000.0)],
                                    "source_no int, source string, source_size bigint, target double")
    slots = M.schedule(sources, 500)
    rows = sorted((r for r in slots.collect() if r.slot is not None), key=lambda r: r.slot)
    seen = Counter()
    for n, r in enumerate(rows, 1):
        assert r["rank"] == seen[r.source_no]
        seen[r.source_no] += 1
        assert all(abs(seen[k] - n * w) < 4 for k, w in ((1, 0.6), (2, 0.3), (3, 0.1)))
    assert Counter(r.source_no for r in slots.collect()) == {1: 1200, 2: 600, 3: 200}


def test_empty(docs):
    assert M.mixed(docs([])).count() == 0 and M.remixed(docs([])).count() == 0
    got = M.mixed(docs([(1, None, "a"), (2, "", None)])).collect()
    assert sorted((r.doc_id, r["size"], r.target, r.taken) for r in got) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
