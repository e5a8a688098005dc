import math
import random

import numpy as np

from sparkwarden.llm import hnsw as H


def plain(rows, asked, k):
    """Exact, over all pairs."""
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in {x for x in good if asked(x[0])}:
        other = [(i, w) for i, w in good if i != q and len(w) == len(v)]
        scores = H.cosines(np.array([w for _, w in other]), np.array(v)).tolist() if other else []
        best = sorted((-s, i) for s, (i, _) in zip(scores, other, strict=True))[:k]
        out[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return out


def result(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def rows_of(n=900, dim=12):
    r = random.Random(8)
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(9)]
    f = lambda x: float(np.float32(x))
    rows = [(i, [f(a + r.gauss(0, 0.6)) for a in centres[i % 9]]) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(200)]  # one vector with many ids
    rows += [(5000, None), (5001, []), (5002, [0.0] * dim), (5003, [None] + [1.0] * (dim - 1)), (5004, [math.nan] * dim), (5005, [math.inf] + [1.0] * (dim - 1)),
             (None, rows[0][1]), (5006, [1.0, 2.0]), (5050, [2.0, 1.0]), rows[0], rows[0], (5007, [f(1e38)] * dim), (5008, [f(1e-30)] * dim)]
    return rows


def test_recall_and_scores(spark):
    rows = rows_of()
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 as shard", "2 as rank", "3 as dim")
    want = plain(rows, lambda i: i % 50 == 0, 5)
    for shard_rows in (200, 4096):
        got = result(H.nearest(frame, frame.where("vec_id % 50 = 0"), 5, shard_rows))
        assert got.keys() == {q for q, x in want.items() if x}
        same = sum(len({(i) for _, i, _ in got[q]} & {i for _, i, _ in want[q]}) for q in got)
        assert same / sum(map(len, want.values())) > 0.99
        assert all(len(got[q]) == len(want[q]) for q in got)
        scores = {(q, i): s for q in want for _, i, s in plain(rows, lambda x: x == q, 10**6)[q]}
        assert all(math.isclose(s, scores[q, i], abs_tol=1e-12) for q in got for _, i, s in got[q])
    # The common vector's nearest are its own copies, the smallest ids first.
    assert [i for _, i, _ in got[900]] == [3, 901, 902, 903, 904]


def test_recall_on_the_given_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = plain([(r.vec_id, r.embedding) for r in rows.collect()], lambda i: i % 50 == 0, 5)
    got = result(H.nearest(rows, rows.where("vec_id % 50 = 0"), 5, 100))
    assert sum(len({i for _, i, _ in got[q]} & {i for _, i, _ in want[q]}) for q in want) / sum(map(len, want.values())) >= 0.95


def test_empty(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert H.nearest(none, none).count() == 0
    one = spark.createDataFrame([(0, [1.0, 0.0])], "vec_id bigint, embedding array<float>")
    assert H.nearest(one, one).count() == 0 and H.nearest(one, none).count() == 0
