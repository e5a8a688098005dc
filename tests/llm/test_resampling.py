import math
import random

import numpy as np

from sparkwarden.llm import resampling as R


def plain(rows, labels):
    """Counts, weights and the draw by plain loops, with the operator's own tokens and noise."""
    import xxhash  # the sample's order and halves are those of Spark's xxhash64 of a bigint
    order = sorted(labels, key=lambda d: (np.uint64(xxhash.xxh64_intdigest(int(d).to_bytes(8, "little", signed=True), 42)).astype(np.int64), d))
    good = [d for i, d in enumerate(order) if labels[d] == 1 and i % 2 == 0]
    held = {d: labels[d] for i, d in enumerate(order) if i % 2}
    n = 1 << R.BUCKETS_LOG
    counts = {k: np.ones(n) for k in ("raw", "good")}
    for d, t in rows:
        for b in R.grams((t or "").encode()).tolist():
            counts["raw"][b] += 1
            counts["good"][b] += d in good
    ratio = np.log(counts["good"] / counts["good"].sum()) - np.log(counts["raw"] / counts["raw"].sum())
    weights = [R.weight_of((t or "").encode(), ratio) for _, t in rows]
    pairs = {d: (w, held[d]) for (d, _), w in zip(rows, weights, strict=True) if d in held and w is not None}
    cut = R.best_cut(list(pairs.values()))
    keys = [None if w is None else R.key_of(w, d) for (d, _), w in zip(rows, weights, strict=True)]
    k = sum(w is not None and w >= cut for w in weights)
    least = sorted((x for x in keys if x is not None), reverse=True)[k - 1]
    return [(d, w, x is not None and x >= least) for (d, _), w, x in zip(rows, weights, keys, strict=True)]


def near(a, b):
    return len(a) == len(b) and all(x[0] == y[0] and x[2] == y[2] and (x[1] is None) == (y[1] is None) and (x[1] is None or math.isclose(x[1], y[1], abs_tol=1e-6))
                                    for x, y in zip(sorted(a, key=str), sorted(b, key=str), strict=True))


def test_rows_equal_brute_force_and_labels_are_met(spark, docs, sample):
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    rows += [(None, rows[0][1]), (9001, None), (9002, ""), (9003, "  "), rows[1], rows[1], (9004, rows[2][1] * 40)]
    given = docs([(a, b, None) for a, b in rows])
    table = spark.createDataFrame(list(labels.items()) + [(None, 1), (1, None), (2, 7)], "doc_id bigint, quality int").selectExpr("*", "0 as text")
    want = plain(rows, labels)
    assert near([tuple(r) for r in R.classified(given, table).collect()], want)
    kept = R.drawn(given, table)
    assert kept.columns == given.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(((d, t) for (d, t), w in zip(rows, want, strict=True) if w[2]), key=str)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = R.classified(spark.read.parquet(f"{sf}/documents.parquet"), labels, sample=200)  # the other labels are not seen
    seen = labels.selectExpr("doc_id", "xxhash64(doc_id) as h").orderBy("h", "doc_id").limit(200).select("doc_id")
    rows = got.join(labels, "doc_id").join(seen, "doc_id", "left_anti").collect()
    assert len(rows) > 150
    assert sum(r.drawn == (r.quality == 1) for r in rows) / len(rows) > 0.97
    assert sum(r.drawn for r in rows if r.quality == 1) / sum(r.quality == 1 for r in rows) > 0.99


def test_empty_and_missing_labels(spark, docs):
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert R.classified(docs([]), labels).count() == 0 and R.drawn(docs([]), labels).count() == 0
    got = R.classified(docs([(1, "some words", None), (2, None, None)]), labels).orderBy("doc_id").collect()
    assert [(r.log_weight, r.drawn) for r in got] == [(0.0, True), (None, False)]


def test_kth_largest(spark):
    r = random.Random(1)
    keys = [r.choice([r.randint(-(1 << 51), (1 << 51) - 1), r.randint(-5, 5)]) for _ in range(500)]
    frame = spark.createDataFrame([(k,) for k in keys], "key bigint")
    for k in (1, 2, 77, 250, 500):
        assert R.kth_largest(frame, k) == sorted(keys, reverse=True)[k - 1]
