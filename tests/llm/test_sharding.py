import zlib
from collections import Counter

import pytest
import xxhash

from sparkwarden.llm import sharding as S


def spark_hash(doc_id):
    """xxhash64(7, doc_id) as Spark computes it: an int, then a long, each with the hash so far as seed."""
    seed = xxhash.xxh64_intdigest((7).to_bytes(4, "little"), 42)
    return seed if doc_id is None else xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little", signed=True), seed)


def place_hash(owner, point):
    seed = xxhash.xxh64_intdigest((7).to_bytes(4, "little"), 42)
    seed = xxhash.xxh64_intdigest(owner.to_bytes(4, "little"), seed)
    return xxhash.xxh64_intdigest(point.to_bytes(8, "little"), seed)


def plain(rows, shards, points):
    """Row by row: own arcs first, then what found no room goes on clockwise."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    places = sorted((place_hash(i % shards, i // shards) % S.CELLS, i, i % shards) for i in range(shards * points))
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    arcs = [[] for _ in places]
    for r in rows:
        cell = spark_hash(r[0]) % S.CELLS
        arc = next((k for k, p in enumerate(places) if p[0] >= cell), 0)
        arcs[arc].append((cell, signed(spark_hash(r[0])), r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()), r))
    owner, waiting, lap_full = {}, [], False
    counts = Counter()
    for k, arc in enumerate(arcs):
        arc.sort(key=lambda x: x[:5])
        for n, x in enumerate(arc):
            s = places[k][2]
            if room[s] > 0:
                owner[k, n] = s
                room[s] -= 1
    for lap in range(2):
        for k, arc in enumerate(arcs):
            if not lap:
                waiting += [(k, n) for n in range(len(arc)) if (k, n) not in owner]
            s = places[k][2]
            while waiting and room[s] > 0:
                owner[waiting.pop(0)] = s
                room[s] -= 1
    for key, s in owner.items():
        counts[arcs[key[0]][key[1]][5], s] += 1
    return counts


ODD = [(None, None), (None, ""), (-1, "x"), (5, "same"), (5, "same"), (5, "other"), (1 << 62, "y" * 300_000)]


@pytest.mark.parametrize("shards,points", [(8, 128), (3, 4), (1, 2), (20, 1)])
def test_rows_equal_brute_force(docs, sample, shards, points):
    rows = [(r.doc_id, r.text) for r in sample.collect()] + ODD
    given = docs([(a, b, None) for a, b in rows])
    got = S.sharded(given, shards, points)
    assert got.columns == [n for n in given.columns if n != "shard"] + ["shard", "slot"]
    out = got.collect()
    assert Counter(((r.doc_id, r.text), r.shard) for r in out) == plain(rows, shards, points)
    sizes = Counter(r.shard for r in out)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(shards)) <= 1
    for s in sizes:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s]))


def test_few_rows_move_when_a_shard_is_added(docs, sample):
    """Most rows that move go to the new shard; plain modulo hashing would move eight in nine."""
    before = {r.doc_id: r.shard for r in S.sharded(sample, 8).collect()}
    after = {r.doc_id: r.shard for r in S.sharded(sample, 9).collect()}
    assert sum(before[k] != after[k] for k in before) / len(before) < 0.45


def test_empty_and_fewer_rows_than_shards(docs):
    assert S.sharded(docs([]), 8).count() == 0
    assert sorted(r.slot for r in S.sharded(docs([(1, "a", None), (2, None, None)]), 8).collect()) == [0, 0]
