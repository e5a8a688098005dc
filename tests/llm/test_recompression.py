"""Substring dedup against its definition, with odd rows and hot passages."""

import random
from collections import Counter

import numpy as np
import pytest

from sparkwarden.llm import recompression as R


def dedup(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    return Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in R.deduplicated(docs).collect())


def prose(draw, n, words=4000):
    return " ".join(f"w{draw.randrange(words)}" for _ in range(n))


def test_passages_and_copies(spark):
    draw = random.Random(1)
    passage, tail = prose(draw, 60), prose(draw, 25)
    rows = [(i, prose(draw, draw.randrange(0, 200))) for i in range(80)]
    rows += [(i, f"{prose(draw, 15)} {passage} {prose(draw, 11)}") for i in range(80, 160)]
    rows += [(i, f"{passage}\n{tail}") for i in range(160, 200)]
    whole = prose(draw, 300).split()
    for i in range(200, 240):
        near = list(whole)
        near[draw.randrange(300)] = "changed"
        rows.append((i, " \t".join(near)))
    rows += [(i, " ".join(whole)) for i in range(240, 300)]
    draw.shuffle(rows)
    got = dedup(spark, rows)
    assert got == Counter(R.plain(rows))
    assert sum(x[2] for x in got) > 10000


def test_few_words_and_long_runs(spark):
    draw = random.Random(2)
    rows = [(i, prose(draw, draw.randrange(1, 120), words=2)) for i in range(60)]
    rows += [(i, "lol " * draw.randrange(1, 90)) for i in range(60, 80)] + [(i, "a b " * draw.randrange(1, 60)) for i in range(80, 100)]
    rows += [(100, "x " * 20000), (101, "p q r " * 8000)]
    assert dedup(spark, rows) == Counter(R.plain(rows))


def test_odd_rows(spark):
    draw = random.Random(3)
    text, other = prose(draw, 50), prose(draw, 40)
    rows = [(None, text), (None, text), (None, f"{other} {text}"), (5, text), (5, text), (5, f"a {text}"), (6, None), (7, ""), (8, " \n\x0b "), (9, "one"),
            (-3, other), (2**62, f"{other} {other} {other}"), (10, prose(draw, 19)), (11, prose(draw, 20)), (-3, other)]
    assert dedup(spark, rows) == Counter(R.plain(rows))
    assert not dedup(spark, [])


def test_columns_stay(spark):
    names = ["row", "doc", "mark", "spans", "at", "symbol", "context", "n_words", "start"]
    docs = spark.createDataFrame([(1, "a " * 30, *names), (2, None, *names)], "doc_id bigint, text string, " + ", ".join(f"{x} string" for x in names))
    got = R.deduplicated(docs).orderBy("doc_id").collect()
    assert set(got[0].asDict()) == {"doc_id", "text", *names, "n_removed"}
    assert [r[x] for r in got for x in names if x != "n_words"] == [x for x in names if x != "n_words"] * 2
    assert [(r.n_words, r.n_removed) for r in got] == [(30, 29), (0, 0)]


@pytest.mark.parametrize("words", [2, 3, 30, 1000])
def test_equal_windows_have_one_anchor(words):
    draw = random.Random(words)
    shared = prose(draw, 70, words).encode().split()
    docs = [prose(draw, draw.randrange(0, 90), words).encode().split() + shared + prose(draw, draw.randrange(0, 90), words).encode().split() for _ in range(40)]
    w = R.Words(docs)
    first, n, symbol, _ = R.segments(w)
    start = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    assert len(start) == w.windows().sum() == len(set(start.tolist()))
    one, two = w.named(start, start + R.WINDOW)
    anchors = {}
    for key, s in zip(zip(one.tolist(), two.tolist(), strict=True), np.repeat(symbol, n).tolist(), strict=True):
        assert anchors.setdefault(key, s) == s


def test_whole_table(spark, sample):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in R.deduplicated(sample).collect())
    assert got == Counter(R.plain([(r.doc_id, r.text) for r in sample.collect()]))
