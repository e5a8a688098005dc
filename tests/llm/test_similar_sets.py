import random
from functools import partial

import numpy as np
import pytest

from sparkwarden.llm import similar_sets as N
from sparkwarden.llm import simhash as S


def plain_set(text, width=5):
    low = "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in text or "")
    words = low.encode().split()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def plain_groups(texts, similarity=0.8):
    """Group number per text, by exact Jaccard similarity of every pair."""
    found = [plain_set(t) for t in texts]
    of = list(range(len(texts)))

    def top(i):
        while of[i] != i:
            i = of[i]
        return i

    for i, a in enumerate(found):
        for j in range(i):
            b = found[j]
            if a == b or (min(len(a), len(b)) >= similarity * max(len(a), len(b), 1) - 1 and len(a & b) / (len(a | b) or 1) >= similarity):
                x, y = sorted((top(i), top(j)))
                of[y] = x
    return [top(i) for i in range(len(texts))]


def plain_kept(rows):
    """Of each group the least doc_id."""
    least = {}
    for (doc_id, _), g in zip(rows, plain_groups([t for _, t in rows]), strict=True):
        least[g] = min(least.get(g, doc_id), doc_id)
    return sorted(least.values())


def changed(words, r, n):
    out = list(words)
    for i in r.sample(range(len(out)), n):
        out[i] = f"new{r.random()}"
    return out


def kept(docs, rows):
    return sorted(r.doc_id for r in S.deduplicated(docs([(a, b, None) for a, b in rows])).collect())


def test_stage_equals_exact_jaccard_on_documents(spark, docs):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    want = plain_kept(rows)
    assert len(want) < len({r[1] for r in rows})
    assert kept(docs, rows) == want


def test_copies_with_changed_words_and_short_texts(docs):
    r = random.Random(5)
    base = [f"w{i}" for i in range(300)]
    rows = [(k, " ".join(changed(base, r, n))) for k, n in enumerate([0, 2, 4, 6, 8, 10, 12, 20, 40, 80], 1)]
    for k in range(60):  # a cloud: each like the base, most of them less like each other
        rows.append((100 + k, " ".join(changed(base, r, 6))))
    rows += [(300, None), (301, ""), (302, " \n"), (303, "One two"), (304, "one TWO"), (305, "one two three four five"),
             (306, "one two three four five six"), (307, "one two three four five six"), (308, "b" * 9)]
    # Sets of five and four shingles, four in common, are at 0.8 exactly.
    rows += [(400, "a1 a2 a3 a4 a5 a6 a7 a8 a9"), (401, "a1 a2 a3 a4 a5 a6 a7 a8")]
    want = plain_kept(rows)
    assert 401 not in want and 400 in want
    assert kept(docs, rows) == want


def test_a_chain_without_a_common_centre(docs):
    r = random.Random(6)
    words, rows = [f"w{i}" for i in range(200)], []
    for k in range(40):
        rows.append((k, " ".join(words)))
        words = changed(words, r, 3)
    assert kept(docs, rows) == plain_kept(rows)


def test_recall_at_the_threshold():
    """Of pairs at a similarity of 0.80 to 0.85, at least 0.97 share a shard and lie within the radius."""
    r = np.random.default_rng(7)
    for n in (45, 300, 900):
        met = 0
        for _ in range(200):
            drawn = r.integers(0, 1 << 64, n + n // 9, dtype=np.uint64)
            a, b = np.sort(drawn[: n + n // 18]), np.sort(drawn[n // 18 :])
            assert 0.8 <= len(np.intersect1d(a, b)) / len(np.union1d(a, b)) <= 0.91
            near = ((N.fingerprint(a) ^ N.fingerprint(b)) & (1 << 64) - 1).bit_count() <= N.RADIUS
            met += near and (N.bands(a) == N.bands(b)).any()
        assert met >= 194


@pytest.mark.parametrize("radius", [0, 2, 12, 20])
def test_bk_trees_find_all_within_the_radius(radius):
    r = np.random.default_rng(radius)
    centres = r.integers(0, 1 << 64, 6, dtype=np.uint64)
    flips = np.array([int(sum(1 << int(k) for k in r.choice(64, r.integers(0, 14), replace=False))) for _ in range(300)], dtype=np.uint64)
    values = np.unique(centres[r.integers(0, 6, 300)] ^ flips)
    r.shuffle(values)
    who, node, d = N.BKTree(values).near(values[:80], radius)
    got = sorted(zip(who.tolist(), node.tolist(), d.tolist(), strict=True))
    want = [(i, j, int(np.bitwise_count(values[i] ^ values[j]))) for i in range(80) for j in range(len(values))]
    assert got == [x for x in want if x[2] <= radius]


def test_large_shards_are_cut_into_pieces(spark, docs, monkeypatch):
    monkeypatch.setattr(S, "roots", partial(N.roots, shard=7))
    r = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = [(k, " ".join(changed(base, r, 1 + k % 4))) for k in range(60)]
    assert kept(docs, rows) == plain_kept(rows)


def test_rows_without_id_stay_only_for_groups_without_an_id(docs):
    base, other = " ".join(f"w{i}" for i in range(100)), " ".join(f"v{i}" for i in range(100))
    rows = [(7, base, "a"), (None, base, "b"), (None, base + " more", "c"), (None, other, "a"), (None, other, "a"), (None, other.upper(), "b"),
            (None, other + " more", "a"), (None, None, "a"), (None, "", "a"), (8, "alone among many", "a"), (None, "no copy of it", "a")]
    got = S.deduplicated(docs(rows)).collect()
    assert sorted(r.doc_id for r in got if r.doc_id) == [7, 8]
    texts = [r.text for r in got if r.doc_id is None]
    assert len(texts) == 3 and "no copy of it" in texts
    assert sum((t or "").lower().startswith("v0 ") for t in texts) == 1 and sum(not t for t in texts) == 1


@pytest.mark.parametrize("links", [1 << 20, 5])
def test_links_are_united(spark, monkeypatch, links):
    monkeypatch.setattr(N, "LINKS", links)
    r = random.Random(9)
    pairs = [(f"{r.randrange(60):03d}".encode(), f"{r.randrange(60):03d}".encode()) for _ in range(45)]
    pairs = [p for p in pairs if p[0] != p[1]]
    of = {x: x for p in pairs for x in p}
    for a, b in pairs:
        lo, hi = sorted((of[a], of[b]))
        of = {k: lo if v == hi else v for k, v in of.items()}
    got = N.united(spark.createDataFrame(pairs, "a binary, b binary")).collect()
    assert {bytes(x.node): bytes(x.root) for x in got} == of and len(got) == len(of)


def test_sketches_differ_in_no_more_bits_than_sets_do_in_members():
    r = np.random.default_rng(10)
    for n, other in [(0, 5), (1, 1), (60, 3), (60, 40), (900, 120), (9000, 4000)]:
        drawn = r.integers(0, 1 << 64, n + 2 * other, dtype=np.uint64)
        a, b = np.sort(drawn[: n + other]), np.sort(np.concatenate((drawn[:n], drawn[n + other :])))
        bits = sum((x ^ y).bit_count() for x, y in zip(N.sketch(a), N.sketch(b), strict=True))
        assert bits <= 2 * other and len(N.sketch(a)) == N.SKETCH // 8
        assert n > 900 or bits > 1.5 * other or other < 4


def test_sets_that_are_too_far_apart_are_not_asked_one_by_one(docs, monkeypatch):
    """A large group: its sets share every shingle with some others, but most are like none of them."""
    asked, verified = [], N.verified
    monkeypatch.setattr(N, "verified", lambda pairs, *rest: asked.append(pairs.count()) or verified(pairs, *rest))
    r, base = random.Random(11), [f"w{i}" for i in range(300)]
    rows = []
    for k in range(80):
        words = list(base)
        for i in range(0, 300, 10):
            words[i] += r.choice(["", "x"])
        rows.append((k, " ".join(words)))
    rows += [(100 + k, f"{rows[k][1]} end{k}") for k in range(20)]
    want = plain_kept(rows)
    assert kept(docs, rows) == want and 60 < len(want) <= 80
    assert sum(asked) < 200
