import random
import re

import xxhash

from sparkwarden.llm import simhash as S
from sparkwarden.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    low = "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in text or "")
    words = WORD.findall(low)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    prints = [plain(t) for _, t in rows]
    of = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and of[i] != of[j]:
                of = [of[j] if x == of[i] else x for x in of]
    least = {}
    for k, (doc_id, _) in zip(of, rows, strict=True):
        if doc_id is not None:
            least[k] = min(least.get(k, doc_id), doc_id)
    return sorted(((d, f"{p:016x}", least.get(k)) for (d, _), p, k in zip(rows, prints, of, strict=True)), key=str)


ODD = [(9001, None), (9002, ""), (9003, " \t\n"), (9004, "one"), (9005, "One two"), (9006, "one two three"), (9007, "ONE\x0btwo\x0cthree"),
       (None, "one two three"), (None, "a text without an id"), (9008, "ÄÖ é     x y"), (9010, "w " * 90000), (9004, "one"), (9011, "w " * 90000)]


def test_rows_equal_brute_force(spark, docs, sample):
    rows = ODD + [(r.doc_id, r.text) for r in sample.collect()]
    got = S.near_copies(docs([(a, b, None) for a, b in rows])).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == plain_components(rows)


def test_empty(docs):
    assert S.near_copies(docs([])).count() == 0
    assert S.deduplicated(docs([])).count() == 0


def test_links_connect_all_within_radius(spark):
    r = random.Random(3)
    centre = r.getrandbits(64)
    values = {centre}
    while len(values) < 700:
        v = r.choice(list(values)) if r.random() < 0.3 else r.getrandbits(64)
        for _ in range(r.randint(0, 3)):
            v ^= 1 << r.randrange(64)
        values.add(v)
    values |= {v ^ (1 << 63) for v in list(values)[:20]}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    distinct = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    want = {}
    ordered = sorted(signed)
    of = {v: v for v in ordered}
    for i, a in enumerate(ordered):
        for b in ordered[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2 and of[a] != of[b]:
                lo, hi = sorted((of[a], of[b]))
                of = {k: lo if x == hi else x for k, x in of.items()}
    want = {k: v for k, v in of.items() if list(of.values()).count(v) > 1}
    for shard in (4096, 3):  # the second cuts nearly every shard once more
        got = {x.node: x.root for x in components(S.links(distinct, shard)).collect()}
        assert got == want


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 400), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(301)}, 400: 400, 500: 400}


def test_one_of_each_group_stays(docs):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(5, base, "a"), (3, base, "b"), (3, base, "b"), (8, base.upper(), None), (9, "something else entirely here", "a"), (None, "no id", "a")]
    kept = S.deduplicated(docs(rows))
    assert kept.columns == docs(rows).columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 3, 9]
