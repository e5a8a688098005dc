import random

import numpy as np
import pytest

from sparkwarden.llm import tiling as G


def plain_tiles(item, doc, least):
    """Greedy string tiling by plain loops, of equal lengths the first in the item, then in the document."""
    im, dm, out = [False] * len(item), [False] * len(doc), []
    while True:
        found, top = [], 0
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not im[i + n] and not dm[j + n]:
                    n += 1
                if n > top:
                    found, top = [(i, j)], n
                elif n == top and n:
                    found.append((i, j))
        if top < least:
            return out
        for i, j in found:
            if not any(im[i : i + top]) and not any(dm[j : j + top]):
                im[i : i + top] = dm[j : j + top] = [True] * top
                out.append((i, j, top))


def test_tiles_equal_plain_loops():
    r = random.Random(1)
    for _ in range(150):
        item = [r.randrange(4) for _ in range(r.randint(1, 25))]
        doc = [r.randrange(4) for _ in range(r.randint(0, 15))] + item[r.randint(0, 8) :] + [r.randrange(4) for _ in range(9)] + item[: r.randint(0, 12)]
        assert G.tiles(np.array(item), np.array(doc), 3) == plain_tiles(item, doc, 3)


def plain_leaks(rows, items):
    out = []
    least = {}
    for i, t in items:
        if t is not None:
            least[t] = min(i, least.get(t, i))
    for d, text in rows:
        doc = G.words_of((text or "").encode())
        for t, i in least.items():
            if item := G.words_of(t.encode()):
                found = plain_tiles(item, doc, min(5, len(item)))
                cover = sum(n for _, _, n in found) / len(item)
                if cover >= 0.8:
                    out.append((d, i, cover, len(found), len(item)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def cases():
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)] + ["été", "x-y", "A.B"]
    words = lambda n: [r.choice(vocabulary) for _ in range(n)]
    texts = [" ".join(words(r.randint(12, 40))) for _ in range(12)]
    items = list(enumerate(texts)) + [(20, texts[3]), (21, None), (22, ""), (23, "..."), (24, "three short words"), (25, "lonely"), (26, texts[0] + " tail of it")]
    rows = []
    for i in range(60):
        t = texts[i % 12].split()
        k = len(t) // 2
        part = [t, t[k:] + words(7) + t[:k], t[: len(t) * 9 // 10], t[:k], [x.upper() + "!" for x in t], t[:6] + ["zz"] + t[6:]][i % 6]
        rows.append((i, " ".join(words(20) + part + words(20))))
    rows += [(None, texts[1]), (3, None), (70, ""), (71, "Three, short: WORDS"), (72, "three other short words"), rows[0], rows[0], (73, "lonely " * 3)]
    return rows, items


def test_rows_equal_brute_force(spark, docs, cases):
    rows, items = cases
    given = docs([(a, b, None) for a, b in rows])
    bench = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 as doc_id", "2 as coverage")
    want = plain_leaks(rows, items)
    assert len(want) > 40
    for size in (1 << 20, 50):  # one block; several
        assert sorted((tuple(r) for r in G.leaks(given, bench, block_words=size).collect()), key=str) == want
        kept = G.clean(given, bench, block_words=size)
        gone = {(d, t) for d, t in rows if plain_leaks([(d, t)], items)}
        assert kept.columns == given.columns
        assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted((x for x in rows if x not in gone), key=str)


def test_long_text_and_empty_tables(spark, docs):
    bench = spark.createDataFrame([(1, "one two three four five six seven")], "item_id bigint, text string")
    long = "filler words " * 100_000
    assert [r.n_tiles for r in G.leaks(docs([(1, long + "five six seven x one two three four five six seven", None)]), bench).collect()] == [1]
    assert G.leaks(docs([]), bench).count() == 0 and G.clean(docs([]), bench).count() == 0
    none = bench.where("false")
    assert G.leaks(docs([(1, "a", None)]), none).count() == 0 and G.clean(docs([(1, "a", None)]), none).count() == 1
