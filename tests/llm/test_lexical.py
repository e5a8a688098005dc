"""Ranked search against its definition, with odd rows, large classes and several blocks of items."""

import random
from collections import Counter

from sparkwarden.llm import lexical


def search(spark, docs, items, **how):
    got = lexical.ranked(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), **how)
    return Counter(map(tuple, got.collect()))


def prose(draw, n, words=60):
    return " ".join(draw.choice(("W{}", "w{}", "ä-w{}", "{}")).format(int(draw.random() ** 2 * words)) for _ in range(n))


def test_classes_and_blocks(spark):
    draw = random.Random(1)
    docs = [(i, prose(draw, draw.randrange(1, 80))) for i in range(300)]
    docs += [(1000 + i, docs[i % 3][1]) for i in range(200)] + [(2000 - i, "w1 w2 zzz" + str(i)) for i in range(150)]
    items = [(i, prose(draw, draw.randrange(1, 30))) for i in range(40)]
    want = Counter(lexical.plain(docs, items))
    assert search(spark, docs, items) == want
    assert search(spark, docs, items, block=50) == want
    assert search(spark, docs, items, k=3) == Counter(lexical.plain(docs, items, 3))


def test_odd_rows(spark):
    docs = [(None, "alpha beta"), (None, "alpha beta"), (3, None), (4, ""), (5, " .,!"), (6, "alpha"), (6, "alpha"), (-7, "Alpha ALPHA éé"), (8, "x " * 30000 + "alpha"),
            (9, "ÉÉ straße"), (10, "beta " * 5)]
    items = [(1, "alpha"), (1, "alpha"), (2, None), (3, ""), (None, "beta alpha alpha"), (4, "nowhere"), (5, "éé ÉÉ"), (1, "beta")]
    assert search(spark, docs, items) == Counter(lexical.plain(docs, items))
    assert search(spark, docs, items, k=1, block=2) == Counter(lexical.plain(docs, items, 1))
    assert not search(spark, [], items) and not search(spark, docs, []) and not search(spark, [(1, None)], items)


def test_other_columns_are_not_read(spark):
    names = ["no", "score", "m", "bag", "hash", "least", "n", "rank", "block", "cell", "all", "before", "size"]
    wide = ", ".join(f"{x} string" for x in names)
    docs = spark.createDataFrame([(i, f"a b c{i}", *names) for i in range(9)], f"doc_id bigint, text string, {wide}")
    items = spark.createDataFrame([(1, "a c4", *names)], f"item_id bigint, text string, {wide}")
    want = Counter(lexical.plain([(i, f"a b c{i}") for i in range(9)], [(1, "a c4")]))
    assert Counter(map(tuple, lexical.ranked(docs, items).collect())) == want


def test_whole_table(spark, sample):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = Counter(map(tuple, lexical.ranked(sample, items).collect()))
    assert got == Counter(lexical.plain([(r.doc_id, r.text) for r in sample.collect()], [(r.item_id, r.text) for r in items.collect()]))
