"""Benchmark decontamination by greedy string tiling.

Seeds are the runs of five words of a test item (a shorter item is one run). A document's runs are looked up among the seeds,
and the words of an item that seeds cover bound what tiles can cover, so only pairs that can reach the threshold are tiled:
the longest common run of unmarked words is found by Karp-Rabin hashes, marked in both, and so on down to the seed length. An
item counts as leaked if tiles cover at least `threshold` of its words, in whatever order its parts stand.

Items are taken in blocks of at most `block_words` words; a block's seeds are broadcast, and documents make one narrow pass
for each block. The number of blocks grows with the benchmark, their size does not.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

c = F.col
SEED, THRESHOLD, BLOCK_WORDS = 5, 0.8, 1 << 20
BASE = 0x9E3779B97F4A7C15
FLAGS = 20
#: ASCII letters are lower-cased; other ASCII but digits separates words.
PLAIN = bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or chr(x).isalnum() else 32 for x in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(PLAIN).split()


def runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of each run of so many words."""
    n = max(0, len(hashes) - length + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(length):
        out = out * np.uint64(BASE) + hashes[k : k + n]
    return out ^ (out >> np.uint64(29))


def windows(ids: np.ndarray, marked: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the unmarked runs of that length, and their Karp-Rabin hashes."""
    n = len(ids) - length + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    power = np.cumprod(np.full(len(ids) + 1, BASE, dtype=np.uint64))
    inverse = np.cumprod(np.full(len(ids) + 1, pow(BASE, -1, 1 << 64), dtype=np.uint64))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)))
    used = np.concatenate(([0], np.cumsum(marked)))
    starts = np.flatnonzero(used[length:] == used[:-length])
    return starts, (sums[starts + length] - sums[starts]) * inverse[starts]


def common(item: np.ndarray, doc: np.ndarray, item_marked: np.ndarray, doc_marked: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Places (in item, in doc) of equal unmarked runs of that length; hashes are checked word by word."""
    a, ha = windows(item, item_marked, length)
    b, hb = windows(doc, doc_marked, length)
    order = np.argsort(hb, kind="stable")
    lo, hi = np.searchsorted(hb[order], ha), np.searchsorted(hb[order], ha, side="right")
    return [(int(i), int(j)) for i, x, y in zip(a, lo, hi, strict=True) for j in b[order[x:y]] if (item[i : i + length] == doc[j : j + length]).all()]


def tiles(item: np.ndarray, doc: np.ndarray, least: int, open_doc: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(in item, in doc, length) of the tiles, longest first, of equal lengths by place in the item and then in the document."""
    im, dm = np.zeros(len(item), bool), np.zeros(len(doc), bool) if open_doc is None else ~open_doc
    out, top = [], len(item)
    while True:
        lo, hi, found = least - 1, top, []  # the longest length with a common run, by halving
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if pairs := common(item, doc, im, dm, mid):
                lo, found = mid, pairs
            else:
                hi = mid - 1
        if lo < least:
            return out
        for i, j in found:
            if not im[i : i + lo].any() and not dm[j : j + lo].any():
                im[i : i + lo] = dm[j : j + lo] = True
                out.append((i, j, lo))
        top = lo


class Block:
    """Items of one block: their words, one after the other, and their seeds in sorted arrays."""

    def __init__(self, items: list[tuple], seed: int = SEED):
        kept = [(i, w) for i, t in items if (w := words_of(t))]
        self.item_ids = [i for i, _ in kept]
        self.words = [w for _, w in kept]
        lengths = np.array([len(w) for w in self.words], dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(lengths)))
        self.least = [min(seed, len(w)) for w in self.words]
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        hashes = np.fromiter((zlib.crc32(x) for w in self.words for x in w), np.uint64, int(self.starts[-1]))
        for length in sorted(set(self.least)):
            keys, at = [], []
            for k, s in enumerate(self.starts[:-1].tolist()):
                if self.least[k] == length:
                    keys.append(runs(hashes[s : s + lengths[k]], length))
                    at.append(np.arange(s, s + len(keys[-1])))
            key, place = np.concatenate(keys), np.concatenate(at)
            order = np.argsort(key, kind="stable")
            flags = np.zeros(1 << FLAGS, bool)
            flags[key >> np.uint64(64 - FLAGS)] = True
            self.seeds[length] = key[order], place[order], flags

    def leaks(self, text: bytes | None, threshold: float) -> list[tuple[int, float, int, int]]:
        """(item's number, coverage, tiles, words in the item) for every item of the block that the text covers enough of."""
        words = words_of(text)
        hashes = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
        covered = None
        met: list[tuple[int, np.ndarray, np.ndarray]] = []
        for length, (key, place, flags) in self.seeds.items():
            r = runs(hashes, length)
            at = np.flatnonzero(flags[r >> np.uint64(64 - FLAGS)])
            if not len(at):
                continue
            value = r[at]
            at = at[key[np.minimum(np.searchsorted(key, value), len(key) - 1)] == value]
            if not len(at):
                continue
            value = np.unique(r[at])
            lo, hi = np.searchsorted(key, value), np.searchsorted(key, value, side="right")
            hit = np.concatenate([place[x:y] for x, y in zip(lo.tolist(), hi.tolist(), strict=True)])
            covered = np.zeros(int(self.starts[-1]), bool) if covered is None else covered
            for k in range(length):
                covered[hit + k] = True
            met.append((length, at, r[at]))
        if covered is None:
            return []
        sums = np.add.reduceat(covered, self.starts[:-1], dtype=np.int64)
        size = np.diff(self.starts)
        return [x for k in np.flatnonzero(sums >= threshold * size).tolist() if (x := self._tiled(k, words, met))[1] >= threshold]

    def _tiled(self, k: int, words: list[bytes], met: list) -> tuple[int, float, int, int]:
        item, least = self.words[k], self.least[k]
        number = {w: i for i, w in enumerate(dict.fromkeys(item))}
        ids = np.array([number[w] for w in item])
        # Only words of the document within one of the item's seeds can be part of a tile.
        own = runs(np.fromiter(map(zlib.crc32, item), np.uint64, len(item)), least)
        open_doc = np.zeros(len(words), bool)
        for length, at, value in met:
            if length == least:
                start = at[np.isin(value, own)]
                for j in range(length):
                    open_doc[start + j] = True
        # The document is cut down to those words, with a closed one wherever words were left out.
        keep = np.flatnonzero(open_doc | np.concatenate(([False], open_doc[:-1])))
        doc = np.array([number.get(words[j], -1) if open_doc[j] else -1 for j in keep.tolist()])
        found = tiles(ids, doc, least, open_doc[keep])
        return k, sum(n for _, _, n in found) / len(item), len(found), len(item)


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS, seed: int = SEED) -> Iterator[Block]:
    """Items with equal texts are one, named by the least item_id. Reads them one after the other, a block at a time."""
    items = benchmark.where("text is not null").groupBy(c("text").cast("string").alias("text")).agg(F.min("item_id").alias("item_id"))
    held, n = [], 0
    for r in items.select("item_id", c("text").cast("binary").alias("text")).toLocalIterator():
        size = len(words_of(bytes(r.text)))
        if held and n + size > block_words:
            yield Block(held, seed)
            held, n = [], 0
        held.append((r.item_id, bytes(r.text)))
        n += size
    if held:
        yield Block(held, seed)


def _texts(b: pa.RecordBatch) -> list[bytes | None]:
    return b["text"].cast(pa.binary()).to_pylist()


def _leaks(held, threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value
        for b in batches:
            rows = [(d, block.item_ids[k], cover, n, size) for d, t in zip(b["doc_id"].to_pylist(), _texts(b), strict=True)
                    for k, cover, n, size in block.leaks(t, threshold)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((b["doc_id"].type, pa.int64(), pa.float64(), pa.int64(), pa.int64()))],
                ["doc_id", "item_id", "coverage", "n_tiles", "item_words"])

    return run


def _clean(held, threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = held.value
        for b in batches:
            yield b.filter(pa.array([not block.leaks(t, threshold) for t in _texts(b)], pa.bool_()))

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, seed: int = SEED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles, item_words for every row of `docs` (doc_id, text) and item of `benchmark` (item_id,
    text) whose words tiles cover to at least `threshold`.

    Words are what is left between ASCII signs and blanks, A-Z lower-cased. Items with equal texts are one, under the least
    item_id. Null texts, texts without words and items without words match nothing; items of fewer than five words must
    stand in one piece. Repeated rows, and rows without a doc_id, give their rows each. Empty tables give none. Other
    columns are not read. Whole texts are read, of any length; a passage shared by many documents costs each of them the same.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id bigint, coverage double, n_tiles bigint, item_words bigint"
    out = spark.createDataFrame([], schema)
    rows = docs.select("doc_id", c("text").cast("string"))
    for n, block in enumerate(blocks(benchmark, block_words, seed)):
        found = rows.mapInArrow(_leaks(spark.sparkContext.broadcast(block), threshold), schema)
        out = out.unionByName(found) if n else found
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, seed: int = SEED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of `docs` (text) that cover no item of `benchmark` enough, all columns as they are. Cases as for leaks()."""
    spark = docs.sparkSession
    out = docs.withColumn("text", c("text").cast("string"))
    schema = T.StructType(out.schema.fields)
    for block in blocks(benchmark, block_words, seed):
        out = out.mapInArrow(_clean(spark.sparkContext.broadcast(block), threshold), schema)
    return out
