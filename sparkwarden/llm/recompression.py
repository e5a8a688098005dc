"""Substring dedup by recompression: words covered by a run of WINDOW words that starts somewhere earlier are removed.

Rounds of recompression parse every text the same way wherever it stands. A round names runs of equal symbols and pairs of a
left and a right symbol (a bit of a symbol's name and the round says which it is). A name is a hash of what it stands for, so
every task names alike and no dictionary is needed. Beside each symbol goes its surrounding: the words that decide that it is
there. Equal windows therefore have the same symbols wherever a surrounding lies within them, and the one of the highest
round (then by hash, then the first) is their anchor. Windows in a row with one anchor are a segment, about a word in six.

Spark's rounds then work on segments only:
  1. anchors are counted; segments whose anchor (name and surrounding) is there once cannot repeat and drop out
  2. equal segments (anchor, and all their words) are one context; all occurrences but its first are repeats as a whole
  3. where an anchor has several contexts, windows of the contexts' first occurrences are named (128 bits) and compared
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import removed, step

c = F.col
WINDOW, ROUNDS, RUN_ROUNDS = 20, 3, (0,)
AT_ONCE, MEMORY = 1 << 17, 1 << 20
NO_ID = -(1 << 63)
U = np.uint64


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


#: Multipliers of the two rolling hashes, odd so that they have inverses.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class Names(dict):
    """128-bit hashes of words, kept in a bounded memory."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= MEMORY:
            self.clear()
        self[word] = name = xxhash.xxh3_128_digest(word)
        return name


NAMES = Names()


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + U(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(29))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(32))


def combined(*parts: np.ndarray) -> np.ndarray:
    """One name for several numbers in this order."""
    out = mix(parts[0].astype(U), 1)
    for k, x in enumerate(parts[1:], 2):
        out = mix(out ^ mix(x.astype(U), k), k)
    return out


class Words:
    """Documents' words in a row, a separator before, between and behind them."""

    def __init__(self, docs: list[list[bytes]]):
        sizes = np.array([len(d) for d in docs], dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1] + 1
        self.ends = self.starts + sizes
        data = (b"\0" * 16).join([b"", *[b"".join(map(NAMES.__getitem__, d)) for d in docs], b""])
        self.hashes = np.frombuffer(data, "<u8").reshape(-1, 2)
        n = len(self.hashes)
        self.separator = np.zeros(n, dtype=bool)
        self.separator[0] = True
        self.separator[self.ends] = True
        self.sums, self.back = [], []
        with np.errstate(over="ignore"):
            for k, base in enumerate(BASES):
                powers = np.cumprod(np.concatenate((np.ones(1, U), np.full(n, base, U))))
                back = np.cumprod(np.concatenate((np.ones(1, U), np.full(n, _inverse(base), U))))
                self.sums.append(np.concatenate((np.zeros(1, U), np.cumsum(self.hashes[:, k] * powers[:-1], dtype=U))))
                self.back.append(back)

    def named(self, lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
        """Two independent 64-bit names of the words from lo to hi, the same wherever they stand."""
        with np.errstate(over="ignore"):
            return [(s[hi] - s[lo]) * b[lo] for s, b in zip(self.sums, self.back, strict=True)]

    def windows(self) -> np.ndarray:
        """Whether a window of WINDOW words of one document starts here."""
        ok = np.zeros(len(self.hashes) + 1, dtype=np.int8)
        long = self.ends - self.starts >= WINDOW
        ok[self.starts[long]] += 1
        ok[self.ends[long] - WINDOW + 1] -= 1
        return np.cumsum(ok)[:-1] > 0


class Parse:
    """The symbols of a round: from start to end, their names, and from where to where words decide that they are there."""

    def __init__(self, words: Words):
        n = len(words.hashes)
        self.start, self.end = np.arange(n), np.arange(1, n + 1)
        self.name, self.separator = words.hashes[:, 0].copy(), words.separator
        self.lo, self.hi = self.start.copy(), self.end.copy()

    def runs(self, round_: int) -> None:
        """Runs of equal symbols become one; what stands beside a run decides that it ends there."""
        same = (self.name[1:] == self.name[:-1]) & ~self.separator[1:] & ~self.separator[:-1]
        first = np.flatnonzero(np.concatenate(([True], ~same)))
        length = np.diff(np.concatenate((first, [len(self.name)])))
        lo, hi = np.minimum.reduceat(self.lo, first), np.maximum.reduceat(self.hi, first)
        name = self.name[first]
        self.name = np.where(length > 1, combined(name, length, np.full(len(name), 2 * round_)), name)
        self.start, self.end, self.separator = self.start[first], self.end[first + length - 1], self.separator[first]
        # Of the neighbours only the symbols next to the run matter, not the runs that they belong to.
        before, after = first[1:] - 1, first[1:]
        lo[1:], hi[1:] = np.minimum(lo[1:], self.lo[before]), np.maximum(hi[1:], self.hi[before])
        lo[:-1], hi[:-1] = np.minimum(lo[:-1], self.lo[after]), np.maximum(hi[:-1], self.hi[after])
        self.lo, self.hi = lo, hi

    def pairs(self, round_: int) -> None:
        """A left symbol and the right one behind it become one; others depend on the neighbour they might have met."""
        right = (mix(self.name, 1000 + round_) >> U(63)).astype(bool) & ~self.separator
        left = ~right & ~self.separator
        met = np.concatenate((left[:-1] & right[1:], [False]))
        second = np.concatenate(([False], met[:-1]))
        lo, hi = self.lo.copy(), self.hi.copy()
        after = np.flatnonzero(left[:-1])  # met or not, a left symbol looks at the next one
        lo[after], hi[after] = np.minimum(lo[after], self.lo[after + 1]), np.maximum(hi[after], self.hi[after + 1])
        before = np.flatnonzero(right[1:] & ~second[1:]) + 1
        lo[before], hi[before] = np.minimum(lo[before], self.lo[before - 1]), np.maximum(hi[before], self.hi[before - 1])
        name = self.name.copy()
        at = np.flatnonzero(met)
        name[at] = combined(name[at], name[at + 1], np.full(len(at), 2 * round_ + 1))
        end = self.end.copy()
        end[at] = end[at + 1]
        kept = ~second
        self.start, self.end, self.name, self.separator, self.lo, self.hi = (x[kept] for x in (self.start, end, name, self.separator, lo, hi))

    def symbols(self) -> tuple[np.ndarray, ...]:
        """Symbols that a window can know: name, start, lo, hi."""
        ok = (self.hi - self.lo <= WINDOW) & ~self.separator
        return self.name[ok], self.start[ok], self.lo[ok], self.hi[ok]


def segments(words: Words) -> tuple[np.ndarray, ...]:
    """Windows in a row with the same anchor: first window, number of windows, the anchor's name, the name of all their words."""
    parse, found = Parse(words), []
    found.append((0, parse.symbols()))
    for k in range(ROUNDS):
        if k in RUN_ROUNDS:
            parse.runs(k)
        parse.pairs(k)
        found.append((k + 1, parse.symbols()))
    n = len(words.hashes)
    open_ = words.windows()
    best = np.full(n, -1, dtype=np.int64)
    parts, base = [], 0
    for level, (name, start, lo, hi) in reversed(found):
        left = np.concatenate(([0], np.cumsum(open_)))
        first, last = np.maximum(hi - WINDOW, 0), np.minimum(lo, n - 1)
        use = np.flatnonzero(left[last + 1] > left[first])
        # In order of preference: by hash, then the one further ahead.
        use = use[np.lexsort((-start[use], mix(name[use], 77)))]
        if len(use):
            name, start, lo, hi, first, last = (x[use] for x in (name, start, lo, hi, first, last))
            for at in range(0, len(use), AT_ONCE):  # what is written later stays
                size = (last - first + 1)[at : at + AT_ONCE]
                who = np.repeat(np.arange(at, at + len(size)), size)
                where = np.arange(len(who)) - np.repeat(np.cumsum(size) - size, size) + first[who]
                ok = open_[where]
                best[where[ok]] = who[ok] + base
            open_ &= best < 0
            parts.append((np.full(len(use), level), name, start, lo, hi))
            base += len(use)
        if not open_.any():
            break
    level, name, start, lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, dtype=np.int64)] * 5
    new = np.flatnonzero((best >= 0) & (best != np.concatenate(([-1], best[:-1]))))
    end = np.flatnonzero((best >= 0) & (best != np.concatenate((best[1:], [-1])))) + 1
    a = best[new]
    name, start, lo, hi, size = name[a], start[a], lo[a], hi[a], end - new
    symbol = combined(name, level[a], start - lo, hi - lo, *words.named(lo, hi))
    context = combined(size, start - new, *words.named(new, end - 1 + WINDOW))
    return new, size, symbol, context


def split(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, mark, at (first window and number of windows), symbol, context of every document's segments."""
    for b in batches:
        doc, mark = b["doc"].to_numpy(), b["mark"].to_numpy()
        held, rows, size = [], [], 0
        for i, t in enumerate(b["text"]):
            cut = split(t.as_py())
            if len(cut) >= WINDOW:
                held.append(cut)
                rows.append(i)
                size += len(cut)
            if held and (size >= AT_ONCE or i == b.num_rows - 1):
                words = Words(held)
                new, n, symbol, context = segments(words)
                which = np.searchsorted(words.starts, new, side="right") - 1
                at = np.array(rows)[which]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (doc[at], mark[at], ((new - words.starts[which]) << 8) | n, symbol.view(np.int64), context.view(np.int64))],
                    ["doc", "mark", "at", "symbol", "context"])
                held, rows, size = [], [], 0
        if held:
            raise AssertionError("documents left")


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows that `spans` name, with their 128-bit names."""
    for b in batches:
        for i in range(b.num_rows):
            words = Words([split(b["text"][i].as_py())])
            spans = b["spans"][i].values.to_numpy()
            first, n = spans >> 8, spans & 255
            start = np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            one, two = words.named(start + 1, start + 1 + WINDOW)
            doc, mark = np.full(len(start), b["doc"][i].as_py()), np.full(len(start), b["mark"][i].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, mark, start, one.view(np.int64), two.view(np.int64))],
                                             ["doc", "mark", "start", "one", "two"])


def covered(spans: np.ndarray, n: int) -> np.ndarray:
    """Whether each of n words is covered by a window that the spans (first window and number of windows) name."""
    first, size = spans >> 8, spans & 255
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + size - 1 + WINDOW, -1)
    return np.cumsum(edge)[:-1] > 0


def _kept(batches: Iterator[pa.RecordBatch], others: list[str]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, n, gone = [], [], []
        for t, spans in zip(b["text"], b["spans"], strict=True):
            cut = split(t.as_py())
            drop = covered(spans.values.to_numpy(), len(cut)) if spans.is_valid else np.zeros(len(cut), dtype=bool)
            n.append(len(cut))
            gone.append(int(drop.sum()))
            texts.append(b" ".join([w for w, d in zip(cut, drop.tolist(), strict=True) if not d]).decode())
        yield pa.RecordBatch.from_arrays([b["row"], pa.array(texts, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())],
                                         ["row", "text", "n_words", "n_removed"])


def repeats(docs: DataFrame) -> DataFrame:
    """doc, mark, spans of the documents `docs` (doc, mark, text) that have windows whose words also start earlier.

    A span is a first window, shifted by 8 bits, and a number of windows behind it. (doc, mark) names a row; see repeated()."""
    kind = "doc bigint, mark bigint, at bigint, symbol bigint, context bigint"
    found = step(docs.mapInArrow(_segments, kind), "segments")
    shared = step(found.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("symbol"), "shared")
    seen = step(found.join(shared, "symbol", "left_semi"), "seen")
    removed(found, shared)
    place = F.struct("doc", F.shiftright("at", 8).alias("start"))
    first = step(seen.groupBy("symbol", "context").agg(F.min(place).alias("first")), "contexts")
    forked = step(first.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("symbol"), "forked")
    known = step(seen.join(first, ["symbol", "context"]).select("symbol", "doc", "mark", "at", (place > c("first")).alias("again")), "known")
    removed(seen, first)
    asked = known.where("not again").join(forked, "symbol", "left_semi").select("doc", "mark", "at").distinct()
    asked = step(asked.groupBy("doc", "mark").agg(F.collect_list("at").alias("spans")), "asked")
    named = step(docs.join(asked, ["doc", "mark"]).mapInArrow(_windows, "doc bigint, mark bigint, start bigint, one bigint, two bigint"), "windows")
    earliest = step(named.groupBy("one", "two").agg(F.min(F.struct("doc", "start")).alias("first"), F.count(F.lit(1)).alias("n"))
                    .where("n > 1").drop("n"), "earliest")
    later = named.join(earliest, ["one", "two"]).where(F.struct("doc", "start") > c("first"))
    spans = known.where("again").select("doc", "mark", "at").unionByName(later.select("doc", "mark", (F.shiftleft("start", 8) + 1).alias("at")))
    out = step(spans.distinct().groupBy("doc", "mark").agg(F.collect_list("at").alias("spans")), "spans")
    removed(known, forked, asked, named, earliest)
    return out


def deduplicated(docs: DataFrame) -> DataFrame:
    """All rows and columns of `docs` (doc_id bigint, text): text has the words that stay, joined by one space.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged. A word goes if it lies in WINDOW words in a row of its text that also start at
    a smaller doc_id, or at the same one at an earlier word; windows are judged on the input. Rows of one doc_id are compared by
    where windows start, so repeated rows are treated alike and do not remove each other. No doc_id is the smallest. A null text has
    no words and becomes empty; texts of fewer than WINDOW words lose nothing. n_words (before) and n_removed are added, columns
    of these names replaced; others stay as they are. No rows give no rows.
    """
    others = [k for k in docs.columns if k not in ("text", "n_words", "n_removed")]
    doc = F.coalesce(c("doc_id").cast("bigint"), F.lit(NO_ID).cast("bigint"))
    rows = docs.select(F.struct(*[c(f"`{k}`") for k in others]).alias("row"), doc.alias("doc"), F.xxhash64(c("text").cast("string")).alias("mark"),
                       c("text").cast("string").alias("text"))
    spans = repeats(rows.select("doc", "mark", "text"))
    joined = rows.join(spans, ["doc", "mark"], "left").select("row", "text", "spans")
    kind = joined.schema["row"].dataType.simpleString()
    out = joined.mapInArrow(partial(_kept, others=others), f"row {kind}, text string, n_words bigint, n_removed bigint")
    return out.select(*[c("text") if k == "text" else c(f"row.`{k}`") for k in docs.columns if k not in ("n_words", "n_removed")], "n_words", "n_removed")


def plain(docs: list[tuple[int | None, str | None]], window: int = WINDOW) -> list[tuple]:
    """doc_id, n_words, n_removed, kept text by the definition; for tests."""
    seen: dict[tuple, tuple] = {}
    cut = [(d, (t or "").encode().split()) for d, t in docs]
    for d, words in cut:
        for i in range(len(words) - window + 1):
            key, at = tuple(words[i : i + window]), (NO_ID if d is None else d, i)
            seen[key] = min(seen.get(key, at), at)
    out = []
    for d, words in cut:
        gone = set()
        for i in range(len(words) - window + 1):
            if seen[tuple(words[i : i + window])] < (NO_ID if d is None else d, i):
                gone.update(range(i, i + window))
        out.append((d, len(words), len(gone), b" ".join([w for i, w in enumerate(words) if i not in gone]).decode()))
    return out
