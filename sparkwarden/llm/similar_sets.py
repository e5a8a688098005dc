"""SimHash near-dedup of whole documents: links between texts whose sets of word shingles have a given Jaccard similarity or more.

A text's set of shingles has a 64-bit SimHash fingerprint. Distinct sets are dealt to shards by BANDS keys, each made of ROWS
least hashes of the set: two sets at similarity 0.8 share a shard with a chance of 0.9987, at 0.5 with one of 0.13. In a
shard a BK-tree over the fingerprints (children keyed by the integer distance to their parent) is searched along the edges
within RADIUS. At similarity 0.8 fingerprints differ in 9.7 bits on average with a standard deviation of 2.9, so the radius
leaves out next to none. What the tree finds is checked on the sets themselves.

Two sets share at most what neither has alone, so sets of a shard that are too far from all others are told by a count (own)
and ask nobody. Each set also has an odd sketch: SKETCH bits, each flipped by every member that falls on it. Members in common
cancel, so two sketches never differ in more bits than the sets do in members; partners whose sketches differ in too many are
passed over, and that loses no link. Pairs are not formed within a shard. In a round every set asks for its nearest partner (by distance, then by number) of
another component beyond those that it asked before, and links that hold unite components. Only sets that were refused ask
again, for MORE times as many; copies of one text are in one component after the first round and never ask again. Shards of
more than SHARD sets are cut into pieces, and pieces meet two at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkwarden.llm.common import LOWER, UPPER, removed, step
from sparkwarden.llm.components import components

c = F.col
BANDS, ROWS, SEED, AT_ONCE, RADIUS, SHARD, BLOCK, MORE, LINKS, SKETCH, PAIRS = 36, 8, 42, 1 << 17, 20, 4096, 128, 4, 1 << 20, 1024, 1 << 15
TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_draw = np.random.Generator(np.random.PCG64(SEED))
FLIPS, FACTORS = (_draw.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) for _ in range(2))
FACTORS |= np.uint32(1)
MIX = _draw.integers(0, 1 << 64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
OWN = _draw.integers(0, 1 << 64, BANDS, dtype=np.uint64)
#: Per byte value, its eight bits in the eight bytes of a word, so that bits are counted eight at a time.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64)[:, 0]


def shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the runs of `width` words; a shorter text is one run, none without words."""
    words = (text or "").encode().translate(TO_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1])).tolist()
    last = (ends - 1).tolist()[width - 1 :] or [len(line)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, last, strict=False)), np.uint64, len(last)))


def bands(hashes: np.ndarray) -> np.ndarray:
    """The set's shard keys, one a band; none of an empty set."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    low = hashes.astype(np.uint32)
    at_once = max(1, AT_ONCE // len(low))
    least = np.concatenate([((low ^ FLIPS[k : k + at_once, None]) * FACTORS[k : k + at_once, None]).min(axis=1)
                            for k in range(0, BANDS * ROWS, at_once)])
    return (least.astype(np.uint64).reshape(BANDS, ROWS) * MIX).sum(axis=1, dtype=np.uint64) + OWN


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half of the hashes."""
    out = np.zeros(64, dtype=np.int64)
    cut = np.arange(0, len(hashes), 255)
    if len(hashes):
        for k, column in enumerate(hashes.view(np.uint8).reshape(-1, 8).T):
            out[8 * k : 8 * k + 8] = np.add.reduceat(LANES[column], cut).view(np.uint8).reshape(-1, 8).sum(axis=0)
    return int(np.packbits(out * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def sketch(hashes: np.ndarray) -> bytes:
    """The parity of the number of members on each of SKETCH bits."""
    return np.packbits((np.bincount((hashes >> np.uint64(40)).astype(np.int64) % SKETCH, minlength=SKETCH) & 1).astype(np.uint8)).tobytes()


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts).view(np.int64)))


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            b = whole.slice(at, 1024)
            found = [shingles(t.as_py(), width) for t in b["text"]]
            ids = [xxhash.xxh3_128_digest(h.tobytes()) for h in found]
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], b["mark"], pa.array(ids, pa.binary()), pa.array([len(h) for h in found], pa.int32()),
                 pa.array([fingerprint(h) for h in found], pa.int64()), pa.array([sketch(h) for h in found], pa.binary()), _lists([bands(h) for h in found])],
                ["doc_id", "mark", "set", "n", "fp", "odd", "keys"])


def sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, mark (a hash of the text), set (a 128-bit hash of the whole set), n, fp (the fingerprint), odd (its sketch), keys of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", c("text").cast("string"), F.xxhash64(c("text").cast("string")).alias("mark")).mapInArrow(
        partial(_sets, width=width), f"doc_id {kind}, mark bigint, set binary, n int, fp bigint, odd binary, keys array<bigint>")


class BKTree:
    """Distinct values in flat arrays: the value of each node, and its edges sorted by (node, distance)."""

    def __init__(self, values: np.ndarray):
        self.values = values
        node, rest = np.zeros(len(values), dtype=np.int64), np.arange(1, len(values))
        edges = [np.zeros((0, 3), dtype=np.int64)]
        while len(rest):
            # All values below one node at one distance hang from the first of them.
            d = np.bitwise_count(values[rest] ^ values[node[rest]]).astype(np.int64)
            of, first, back = np.unique(node[rest] * 65 + d, return_index=True, return_inverse=True)
            edges.append(np.stack([of // 65, of % 65, rest[first]], axis=1))
            node[rest] = rest[first][back]
            rest = rest[node[rest] != rest]
        all_edges = np.concatenate(edges)
        self.key = all_edges[:, 0] * 65 + all_edges[:, 1]
        order = np.argsort(self.key)
        self.key, self.child = self.key[order], all_edges[order, 2]

    def near(self, asked: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(asker, node, distance) of all values within the radius; all askers walk down a level at a time."""
        who, node, out = np.arange(len(asked)), np.zeros(len(asked), dtype=np.int64), []
        if not len(self.values):
            return who[:0], node[:0], node[:0]
        while len(who):
            d = np.bitwise_count(asked[who] ^ self.values[node]).astype(np.int64)
            hit = d <= radius
            out.append((who[hit], node[hit], d[hit]))
            lo = np.searchsorted(self.key, node * 65 + np.maximum(d - radius, 0))
            n = np.searchsorted(self.key, node * 65 + np.minimum(d + radius, 64), side="right") - lo
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            who, node = np.repeat(who, n), self.child[at]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _apart(odd: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """In how many bits the sketches differ."""
    return np.bitwise_count(odd[p] ^ odd[q]).sum(axis=1, dtype=np.int64)


def wishes(shard: dict[str, np.ndarray], ask: int, similarity: float, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(asker, partner, distance), both as places in the shard: for each open set the next `ask` partners of a lower number.

    shard: tie (the number), fp, n, own, odd (sketches, as rows of words), root, open, and last_d, last_tie (asked so far). Two sets
    share at most the members that are not one's own alone, and differ in at least the bits their sketches do; a partner with
    which that cannot reach the similarity is not asked."""
    order = np.argsort(shard["tie"], kind="stable")
    s = {k: v[order] for k, v in shard.items()}
    askers = np.flatnonzero(s["open"])
    values, of = np.unique(s["fp"], return_inverse=True)
    held = np.argsort(of, kind="stable")  # the tree holds distinct fingerprints, and each of them its sets
    start = np.searchsorted(of[held], np.arange(len(values) + 1))
    tree, out = BKTree(values), []
    for at in range(0, len(askers), BLOCK):
        block = askers[at : at + BLOCK]
        who, node, d = tree.near(s["fp"][block], radius)
        n = start[node + 1] - start[node]
        i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[node], n)
        p, q, d = held[i], block[np.repeat(who, n)], np.repeat(d, n)
        shared = np.minimum(s["n"][p] - s["own"][p], s["n"][q] - s["own"][q])
        ok = (s["tie"][p] < s["tie"][q]) & (s["root"][p] != s["root"][q]) & (shared * (1 + similarity) + 1e-9 >= similarity * (s["n"][p] + s["n"][q]))
        ok &= (d > s["last_d"][q]) | ((d == s["last_d"][q]) & (s["tie"][p] > s["last_tie"][q]))
        p, q, d = p[ok], q[ok], d[ok]
        ok = np.concatenate([_apart(s["odd"], p[k : k + PAIRS], q[k : k + PAIRS]) * (1 + similarity) <=
                             (s["n"][p[k : k + PAIRS]] + s["n"][q[k : k + PAIRS]]) * (1 - similarity) + 1e-9 for k in range(0, len(p), PAIRS)] or [np.zeros(0, bool)])
        p, q, d = p[ok], q[ok], d[ok]
        sort = np.lexsort((s["tie"][p], d, q))
        p, q, d = p[sort], q[sort], d[sort]
        first = np.arange(len(q)) - np.searchsorted(q, q) < ask
        out.append((order[q[first]], order[p[first]], d[first]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else tuple(np.zeros(0, dtype=np.int64) for _ in range(3))


def _asked(batches: Iterator[pa.RecordBatch], ask: int, similarity: float, radius: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (key, x, y); a shard of them has at most two pieces of SHARD sets."""
    names = ["set", "tie", "fp", "n", "own", "odd", "root", "open", "last_d", "last_tie"]

    def found(shard: pa.Table) -> pa.RecordBatch | None:
        roots = shard["root"].combine_chunks().dictionary_encode().indices.to_numpy()
        if len(roots) < 2 or (roots == roots[0]).all():
            return None
        a = {k: shard[k].to_numpy() for k in ("tie", "n", "own", "last_d", "last_tie")}
        odd = np.frombuffer(b"".join(shard["odd"].to_pylist()), np.uint64).reshape(len(roots), -1)
        q, p, d = wishes({**a, "fp": shard["fp"].to_numpy().view(np.uint64), "odd": odd, "root": roots, "open": shard["open"].to_numpy()}, ask, similarity, radius)
        if not len(q):
            return None
        sets_ = shard["set"].combine_chunks()
        return pa.RecordBatch.from_arrays([sets_.take(pa.array(q)), sets_.take(pa.array(p)), pa.array(d), pa.array(a["tie"][p])], ["set", "partner", "d", "tie"])

    held: list[pa.RecordBatch] = []
    of = None
    for b in batches:
        at = np.stack([b[k].to_numpy() for k in ("key", "x", "y")])
        cut = np.concatenate(([0], np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1, [b.num_rows])) if b.num_rows else [0]
        rows = b.select(names)
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            if of is not None and of != tuple(at[:, lo]):
                if (out := found(pa.Table.from_batches(held))) is not None:
                    yield out
                held = []
            of = tuple(at[:, lo])
            held.append(rows.slice(lo, hi - lo))
    if held and (out := found(pa.Table.from_batches(held))) is not None:
        yield out


def verified(pairs: DataFrame, members: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of sets that are at least so similar. members: set, hashes."""
    both = (pairs.join(members.select(c("set").alias("a"), c("hashes").alias("of_a")), "a")
            .join(members.select(c("set").alias("b"), c("hashes").alias("of_b")), "b"))
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return (both.select("a", "b", shared.alias("shared"), (F.size("of_a") + F.size("of_b")).alias("all"))
            .where(c("shared") / (c("all") - c("shared")) >= similarity).select("a", "b"))


def _hashed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            b = whole.slice(at, 1024)
            yield pa.RecordBatch.from_arrays([b["set"], _lists([shingles(t.as_py(), width) for t in b["text"]])], ["set", "hashes"])


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task as stars: each set with the least one that it reaches over them."""
    root: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    for batch in batches:
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
            root.setdefault(min(a, b), min(a, b))
    pairs = [(x, r) for x in list(root) if (r := find(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.binary()), pa.array([r for _, r in pairs], pa.binary())], ["a", "b"])


def united(links: DataFrame) -> DataFrame:
    """(node, root) of every set of the links (a, b). Tasks of LINKS links each make stars of theirs; where there are several
    tasks, their stars are joined in rounds."""
    tasks = max(1, -(-links.count() // LINKS))
    stars = step(links.repartition(tasks).mapInArrow(_contracted, "a binary, b binary"), "stars")
    if tasks > 1:
        return components(stars)
    found = stars.select(c("a").alias("node"), c("b").alias("root"))
    return found.unionByName(found.select(c("root").alias("node"), "root").distinct())


def roots(docs: DataFrame, found: DataFrame, width: int, similarity: float, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """(node, root) of every set of `found`, the sets() of `docs`, that is linked to another: root is the least set reachable."""
    distinct = found.groupBy("set").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    keyed = step(distinct.select("set", F.explode("keys").alias("key")), "keyed")
    several = step(keyed.groupBy("key").agg(F.min("set").alias("a"), F.max("set").alias("b"), F.count(F.lit(1)).alias("size"))
                   .where("a <> b").select("key", "size"), "shards")
    dealt = step(keyed.join(several.select("key"), "key", "left_semi"), "dealt")
    removed(keyed)
    met = step(dealt.select("set").distinct(), "met")
    # One text for each set in question, and its hashes; no others are computed again.
    one = found.join(met, "set", "left_semi").groupBy("set").agg(F.min(F.struct("mark", "doc_id")).alias("at"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("odd").alias("odd"))
    one = step(one.select("set", "n", "fp", "odd", "at.mark", "at.doc_id"), "sets-met")
    text = docs.select("doc_id", c("text").cast("string").alias("text"), F.xxhash64(c("text").cast("string")).alias("mark"))
    named = one.select("set", c("mark").alias("m"), c("doc_id").alias("d"))
    texts = text.join(named, (c("mark") == c("m")) & c("doc_id").eqNullSafe(c("d"))).select("set", "text")
    members = step(texts.mapInArrow(partial(_hashed, width=width), "set binary, hashes array<bigint>").dropDuplicates(["set"]), "members")
    # How many of a set's members no other set in question has. They bound what it can share, so sets far from all others,
    # which a large group of near copies always has, need not ask them one by one.
    tie = F.conv(F.hex(F.substring("set", 1, 8)), 16, -10).cast("bigint")
    alone = members.select(tie.alias("tie"), F.explode("hashes").alias("h")).groupBy("h").agg(F.min("tie").alias("tie"), F.count(F.lit(1)).alias("held")).where("held = 1")
    alone = step(alone.groupBy("tie").agg(F.count(F.lit(1)).cast("int").alias("own")), "own")
    pieces = several.where(c("size") > shard).select("key", F.ceil(c("size") / shard).cast("int").alias("pieces"))
    state = one.select("set", tie.alias("tie"), "n", "fp", "odd").join(alone, "tie", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    state = step(state.select("set", "tie", "n", "own", "odd", "fp", c("set").alias("root"), F.lit(True).alias("open"), F.lit(-1).alias("last_d"),
                              F.lit(0).cast("bigint").alias("last_tie")), "asking")
    now, ask = None, 1
    while True:
        rows = dealt.join(state, "set").join(pieces, "key", "left")
        mine = F.pmod(F.xxhash64("set"), F.coalesce("pieces", F.lit(1)))
        rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("pieces", F.lit(1)).cast("bigint") - 1)))
        rows = rows.withColumns({"x": F.least("mine", "other"), "y": F.greatest("mine", "other")})
        rows = rows.select("key", "x", "y", "set", "tie", "fp", "n", "own", "odd", "root", "open", "last_d", "last_tie")
        wished = rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(
            partial(_asked, ask=ask, similarity=similarity, radius=radius), "set binary, partner binary, d bigint, tie bigint")
        # The same partner can be met in several shards; of all shards' partners the nearest are asked.
        place = F.row_number().over(Window.partitionBy("set").orderBy("d", "tie"))
        pairs = step(wished.distinct().withColumn("place", place).where(c("place") <= ask), "pairs")
        if not pairs.take(1):
            break
        links = step(verified(pairs.select(c("set").alias("a"), c("partner").alias("b")), members, similarity), "similar")
        if links.take(1):
            both = links if now is None else now.select(c("node").alias("a"), c("root").alias("b")).unionByName(links)
            before, now = now, step(united(both), "set-roots")
            removed(links, *([before] if before is not None else []))
        last = pairs.groupBy("set").agg(F.max(F.struct(c("d").cast("int").alias("d"), "tie")).alias("last"), F.count(F.lit(1)).alias("asked"))
        after = state.select("set", "tie", "n", "own", "odd", "fp", "open", "last_d", "last_tie", *(["root"] if now is None else []))
        if now is not None:
            after = after.join(now.select(c("node").alias("set"), "root"), "set", "left").withColumn("root", F.coalesce("root", "set"))
        after = after.join(last, "set", "left")
        held, state = state, step(after.select("set", "tie", "n", "own", "odd", "fp", "root", (F.coalesce("asked", F.lit(0)) >= ask).alias("open"),
                                  F.coalesce("last.d", "last_d").alias("last_d"), F.coalesce("last.tie", "last_tie").alias("last_tie")), "asking")
        removed(pairs, held)
        ask *= MORE
    removed(dealt, several, met, one, members, alone, state)
    return now if now is not None else found.select(c("set").alias("node"), c("set").alias("root")).where("false")
