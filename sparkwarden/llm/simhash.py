"""SimHash near-dedup: 64-bit fingerprints of 3-word shingles, linked at 2 or fewer differing bits by BK-trees.

Two fingerprints that differ in at most two bits agree on two of their four quarters. Every distinct fingerprint is sent to
the six shards that its pairs of quarters name, so each link meets in a shard; there a BK-tree (children keyed by the
integer distance to their parent) is searched along the edges within the radius. All trees together have no size bound, so
they are not broadcast: fingerprints go to their trees. Shards above SHARD members are cut once more by pairs of the bytes
left; what then agrees on 48 bits has at most 65536 members. A shard returns one link per member, to the least it reaches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import LOWER, UPPER, removed, staged, step
from sparkwarden.llm.components import components
from sparkwarden.llm.similar_sets import RADIUS as SET_RADIUS
from sparkwarden.llm.similar_sets import roots, sets

c = F.col
SHINGLE, SEED, RADIUS, SHARD = 3, 42, 2, 4096
TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Per byte value, its eight bits in the eight bytes of a word, so that bits are counted eight at a time.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64)[:, 0]


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit numbers have each bit set, least significant first."""
    out = np.zeros(64, dtype=np.int64)
    cut = np.arange(0, len(hashes), 255)
    for k, column in enumerate(hashes.view(np.uint8).reshape(-1, 8).T):
        sums = np.add.reduceat(LANES[column], cut)
        out[8 * k : 8 * k + 8] = sums.view(np.uint8).reshape(-1, 8).sum(axis=0)
    return out


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint; 0 without words."""
    words = (text or "").encode().translate(TO_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1])).tolist()
    last = (ends - 1).tolist()[SHINGLE - 1 :] or [len(line)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, last, strict=False)), np.uint64, len(last))
    over = bit_counts(hashes) * 2 > len(hashes)
    return int(np.packbits(over, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = np.fromiter((fingerprint(t.as_py()) for t in b["text"]), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(found.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (bigint, the fingerprint's bits) of every row."""
    return docs.select("doc_id", c("text").cast("string")).mapInArrow(_fingerprints, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp bigint")


class BKTree:
    """Flat arrays of members and of their children, keyed by distance to the parent."""

    def __init__(self) -> None:
        self.members: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> list[int]:
        """Adds the value; returns the earlier members (by number) within the radius."""
        near, at, members, children = [], 0, self.members, self.children
        if members:
            stack = [0]
            while stack:
                node = stack.pop()
                d = (members[node] ^ value).bit_count()
                if d <= RADIUS:
                    near.append(node)
                edges = children[node]
                for k in range(max(1, d - RADIUS), d + RADIUS + 1):
                    if k in edges:
                        stack.append(edges[k])
            while (d := (members[at] ^ value).bit_count()) in children[at]:
                at = children[at][d]
            children[at][d] = len(members)
        members.append(value)
        children.append({})
        return near


def shard_links(values: list[int]) -> list[tuple[int, int]]:
    """For distinct unsigned values in ascending order: each with the least value that it reaches within the shard."""
    tree, root = BKTree(), list(range(len(values)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, v in enumerate(values):
        for j in tree.add(v):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [(v, values[r]) for i, v in enumerate(values) if (r := find(i)) != i]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (key, sub, fp); a shard may run over several batches."""
    held: list[np.ndarray] = []
    held_of: tuple[int, int] | None = None

    def links(parts: list[np.ndarray]) -> list[tuple[int, int]]:
        values = np.concatenate(parts)
        return shard_links(np.sort(values).tolist()) if len(values) > 1 else []

    def out(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        a = np.array(pairs, dtype=np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["a", "b"])

    for b in batches:
        if not b.num_rows:
            continue
        key, sub = b["key"].to_numpy(), b["sub"].to_numpy()
        fp = b["fp"].to_numpy().view(np.uint64)
        new = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]) | (sub[1:] != sub[:-1])) + 1, [len(key)]))
        pairs: list[tuple[int, int]] = []
        for lo, hi in zip(new[:-1].tolist(), new[1:].tolist(), strict=True):
            of = (int(key[lo]), int(sub[lo]))
            if of != held_of:
                if held:
                    pairs += links(held)
                held, held_of = [], of
            held.append(fp[lo:hi])
        if pairs:
            yield out(pairs)
    if held:
        yield out(links(held))


def pairs_of(value, parts: int, width: int):
    """Per pair of the value's `parts` pieces of `width` bits: the pair's number and both pieces as one number."""
    piece = lambda i: F.shiftrightunsigned(value, i * width).bitwiseAND(F.lit((1 << width) - 1))
    named = [(i, j) for i in range(parts) for j in range(i + 1, parts)]
    return F.array(*[F.lit(n << (2 * width)).cast("bigint").bitwiseOR(F.shiftleft(piece(i), width)).bitwiseOR(piece(j))
                     for n, (i, j) in enumerate(named)])


def links(distinct: DataFrame, shard: int = SHARD) -> DataFrame:
    """Links (a, b) between the distinct fingerprints `fp` that connect all that differ in at most two bits."""
    keyed = distinct.select("fp", F.explode(pairs_of(c("fp"), 4, 16)).alias("key"))
    hot = staged(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(c("n") > shard).select("key", F.lit(True).alias("hot")), "hot")
    # A cut shard is keyed by pairs of bytes of both remaining quarters; a link differs in at most two of these four.
    rest = F.lit(0).cast("bigint")
    named = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    for n, pair in enumerate(named):
        k, m = (x for x in range(4) if x not in pair)
        piece = lambda i: F.shiftrightunsigned(c("fp"), 16 * i).bitwiseAND(F.lit(0xFFFF))
        rest = F.when(F.shiftright(c("key"), 32) == n, F.shiftleft(piece(k), 16).bitwiseOR(piece(m))).otherwise(rest)
    sub = F.when(c("hot"), pairs_of(rest, 4, 8)).otherwise(F.array(F.lit(-1).cast("bigint")))
    dealt = keyed.join(hot, "key", "left").select("fp", "key", F.explode(sub).alias("sub"))
    return (dealt.repartition("key", "sub").sortWithinPartitions("key", "sub").mapInArrow(_shards, "a bigint, b bigint").distinct())


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of `docs` (doc_id, text).

    component_id is the smallest doc_id reachable over links, the row's own included. A text with fewer than three words is
    one shingle; null texts and those without words have fingerprint zero and are linked like any other. Repeated rows give
    a row each. Null doc_ids take part; their component is that of what they are linked with, null if nothing there has an
    id. No documents give no rows; other columns are not read. Copies share a fingerprint and are never paired.
    """
    prints = staged(fingerprints(docs), "prints")
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-prints")
    roots = components(links(distinct))
    rooted = staged(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    names = staged(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "names")
    named = staged(rooted.join(names, "root").select("fp", "component_id"), "named")
    return (prints.join(named, "fp")
            .select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"))


def deduplicated(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int = SET_RADIUS) -> DataFrame:
    """The rows of `docs` (doc_id, text) that stay, all columns as they are: one of each group of near copies, that with the smallest doc_id.

    Near copies are linked where the Jaccard similarity of their sets of `shingle` words in a row is at least `similarity` and
    their fingerprints differ in at most `radius` bits; groups are what links connect. A text with fewer words is one shingle,
    null texts and those without words are copies of each other. A row without doc_id stays only where its group has no id.
    Ties, such as repeated rows or several texts of one doc_id, leave one row: by the least set, then text. Texts are
    compared whole, however long. No rows give no rows. Columns of any other names are carried along untouched.
    """
    found = step(sets(docs, shingle), "sets")
    linked = roots(docs, found, shingle, similarity, radius)
    classes = found.groupBy("doc_id", "mark", "set").agg(F.count(F.lit(1)).alias("n"))
    rooted = step(classes.join(linked.withColumnRenamed("node", "set"), "set", "left").select("doc_id", "mark", "set", "n", F.coalesce("root", "set").alias("root")), "rooted")
    order = F.struct(c("doc_id").isNull().alias("nameless"), "doc_id", "set", "mark")
    first = step(rooted.groupBy("root").agg(F.min(order).alias("first")), "first")
    removed(found)
    judged = rooted.join(first, "root").select("doc_id", "mark", "n", (order == c("first")).alias("stays"))
    same = (c("_row_mark") == c("mark")) & c("_row_id").eqNullSafe(c("doc_id"))
    rows = docs.select(F.struct("*").alias("_row"), c("doc_id").alias("_row_id"), F.xxhash64(c("text").cast("string")).alias("_row_mark"))
    # Rows that go are few; those that stay are not shuffled where Spark can broadcast the others.
    gone = step(judged.where("not stays or n > 1"), "gone")
    removed(rooted, first)
    out = rows.join(gone.select("doc_id", "mark"), same, "left_anti")
    twice = gone.where("stays")
    if twice.take(1):  # of a repeated row that stays, one
        out = out.unionByName(rows.join(twice.select("doc_id", "mark"), same, "left_semi").dropDuplicates(["_row_id", "_row_mark"]))
    return out.select(*[c(f"_row.`{n}`") for n in docs.columns])
