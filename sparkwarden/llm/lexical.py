"""Ranked lexical search by bag deduplication: each item's best documents, scored once per class of alike documents.

Only an item's terms can add to its score. So a narrow pass restricts every document to the vocabulary of the items: its bag,
the tf of each such term. Documents with the same bag and the same m (which stands for their length) score alike in all
items; they are classes, found by a hash and told apart by the bag itself. Each class is scored once against the items. An
item's k best documents lie in its k best classes (by score, then least doc_id), which alone are expanded into members.

Items are taken in blocks of about BLOCK terms. A block's vocabulary and weights are tables in the shared folder, which tasks
open themselves; the driver handles their names, two sums over the documents and the number of blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwarden.llm.common import LOWER, UPPER, fresh, lower_ascii, placed, removed, staged, step
from sparkwarden.llm.token_files import open_folder

c = F.col
K, BLOCK, CELLS = 20, 1 << 18, 1024
#: Bounds of a task's arrays: scores, and (term of a bag, item) pairs, that are held at once.
SCORES, MEETINGS = 1 << 20, 1 << 20
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of terms as they are or lower-cased, all others to blanks.
TO_TERMS = bytes(ord(chr(i).lower()) if chr(i).isalnum() else 32 for i in range(128)) + bytes(range(128, 256))
_OPEN: dict[str, tuple] = {}


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TO_TERMS).split()


def opened(folder: str, load: Callable[[pa.Table], object]) -> object:
    """A block's table as `load` makes it, kept by the worker until it opens another one of that kind."""
    kind = load.__name__
    if _OPEN.get(kind, (None,))[0] != folder:
        fs, root = open_folder(folder)
        _OPEN[kind] = (folder, load(pq.read_table(root, filesystem=fs)))
    return _OPEN[kind][1]


def numbered(t: pa.Table) -> dict[bytes, int]:
    return dict(zip((x.encode() for x in t["term"].to_pylist()), t["id"].to_pylist(), strict=True))


def bag(found: list[int]) -> bytes:
    """The ids in ascending order, and behind them how often each is there; 4 bytes a number."""
    ids, n = np.unique(np.array(found, dtype=np.uint32), return_counts=True)
    return ids.astype("<u4").tobytes() + n.astype("<u4").tobytes()


def _bags(folder: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = opened(folder, numbered).get
        for b in batches:
            cut = [terms(t.as_py()) for t in b["text"]]
            bags = [bag([i for i in map(get, x) if i is not None]) for x in cut]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([len(x) for x in cut], pa.int64()), pa.array(bags, pa.binary())], ["doc_id", "n", "bag"])

    return run


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of a batch's documents hold each id."""
    for b in batches:
        ids = [np.frombuffer(x, "<u4")[: len(x) // 8] for x in b["bag"].to_pylist()]
        found, n = np.unique(np.concatenate([np.zeros(0, "<u4"), *ids]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(n, pa.int64())], ["id", "df"])


class Postings:
    """By term id: the weight, and the items that have it with how often."""

    def __init__(self, t: pa.Table):
        ids, no, q, w = (t[k].to_numpy() for k in ("id", "no", "q", "w"))
        order = np.argsort(ids, kind="stable")
        ids, self.no, self.q = ids[order], no[order], q[order]
        top = int(ids[-1]) + 1 if len(ids) else 0
        self.at = np.searchsorted(ids, np.arange(top + 1))
        self.w = np.zeros(top, dtype=np.int64)
        self.w[ids] = w[order]
        self.items = int(no.max()) + 1 if len(no) else 0

    def cuts(self, bags: list[bytes]) -> list[int]:
        """Where to cut the bags, so that each part stays within the bounds (one bag at least)."""
        met = np.concatenate(([0], np.diff(self.at)))
        cost = [int(met[np.minimum(np.frombuffer(x, "<u4")[: len(x) // 8] + 1, len(met) - 1)].sum()) for x in bags]
        out, held, rows = [0], 0, max(1, SCORES // self.items)
        for i, n in enumerate(cost):
            if i > out[-1] and (held + n > MEETINGS or i - out[-1] >= rows):
                out.append(i)
                held = 0
            held += n
        return [*out, len(bags)]

    def scores(self, bags: list[bytes], m: np.ndarray) -> np.ndarray:
        """A row for each bag, a column for each item."""
        out = np.zeros(len(bags) * self.items, dtype=np.int64)
        halves = [np.frombuffer(x, "<u4").reshape(2, -1) for x in bags]
        ids, tf = np.concatenate(halves, axis=1).astype(np.int64)
        row = np.repeat(np.arange(len(bags)), [h.shape[1] for h in halves])
        known = ids < len(self.w)
        ids, tf, row = ids[known], tf[known], row[known]
        value = self.w[ids] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[row]))
        size = self.at[ids + 1] - self.at[ids]
        post = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.at[ids], size)
        np.add.at(out, np.repeat(row, size) * self.items + self.no[post], np.repeat(value, size) * self.q[post])
        return out.reshape(len(bags), self.items)


class Best:
    """The k best classes of every item so far, by score and then by least doc_id (none comes last)."""

    def __init__(self, items: int, k: int):
        self.k, self.floor = k, np.ones(items, dtype=np.int64)
        self.rows: list[pa.Table] = []

    def add(self, scores: np.ndarray, rows: pa.RecordBatch) -> None:
        floor = self.floor
        if len(scores) > self.k:  # what k of these rows beat need not be looked at
            floor = np.maximum(floor, np.partition(scores, -self.k, axis=0)[-self.k])
        row, no = np.nonzero(scores >= floor)
        if len(row):
            t = pa.table(rows.take(pa.array(row)).to_pydict(), schema=rows.schema)
            self.rows.append(t.append_column("no", pa.array(no, pa.int64())).append_column("score", pa.array(scores[row, no], pa.int64())))
            if sum(map(len, self.rows)) > 4 * self.k * len(self.floor):
                self.cut()

    def cut(self) -> pa.Table | None:
        if not self.rows:
            return None
        t = pa.concat_tables(self.rows)
        t = t.sort_by([("no", "ascending"), ("score", "descending"), ("least", "ascending")])  # nulls last
        no = t["no"].to_numpy()
        rank = np.arange(len(no)) - np.searchsorted(no, no)
        last = rank == self.k - 1
        self.floor[no[last]] = t["score"].to_numpy()[last]
        self.rows = [t.filter(pa.array(rank < self.k))]
        return self.rows[0]


def _scored(folder: str, k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        postings: Postings = opened(folder, Postings)
        best = Best(postings.items, k)
        for b in batches:
            cuts = postings.cuts(b["bag"].to_pylist()) if postings.items and b.num_rows else []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                rows = b.slice(lo, hi - lo)
                best.add(postings.scores(rows["bag"].to_pylist(), rows["m"].to_numpy()), rows)
        if (t := best.cut()) is not None:
            yield from t.combine_chunks().to_batches()

    return run


def in_blocks(items: DataFrame, block: int) -> DataFrame:
    """item_id, text, block, no (from 0 in the block) of every item; a block is closed at `block` terms."""
    text = c("text").cast("string")
    rows = staged(items.select("item_id", text.alias("text"), F.coalesce(F.regexp_count(text, F.lit(TERM)), F.lit(0)).alias("size"), F.lit(0).alias("all"),
                               F.pmod(F.xxhash64("item_id", text), F.lit(CELLS)).alias("cell")), "items")
    rows = placed(rows, "all", "cell", [c("item_id"), c("text")], c("size"), "before").withColumn("block", F.floor(c("before") / block))
    no = F.row_number().over(Window.partitionBy("block").orderBy("before", "cell", "item_id", "text")) - 1
    return staged(rows.select("item_id", "text", "block", no.cast("bigint").alias("no")), "item-blocks")


def _written(df: DataFrame, name: str) -> str:
    """A block's table as one file in the shared folder; its rows are at most the block's terms."""
    path = fresh(df.sparkSession, name)
    df.coalesce(1).write.parquet(path)
    return path


def ranked_of(by: list[str], order: list[Column], k: int, rows: DataFrame) -> DataFrame:
    """The first k rows of each group, and their rank. Spark cuts to k rows per task before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(c("rank") <= k)


def ranked(docs: DataFrame, items: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: the k best of `docs` (doc_id, text) for each row of `items` (item_id, text).

    Terms are the maximal matches of TERM, A-Z lower-cased. With N documents that have a term, L terms in all, n of the document
    and df documents that hold a term: its weight w is floor(1000 ln((2N+2)/(2df+1))), m = 75 + 25 n N div L, and the score
    sums w * (10^9 tf div (1000 tf + 12 m)) over the item's terms, repeats included. Scores above 0 rank, highest first, ties
    by ascending doc_id, those without one last. Repeated rows are documents, or items, each. Null and empty texts have no
    terms: such items have no rows. No documents or no items give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    docs, found = docs.select("doc_id", c("text").cast("string").alias("text")), in_blocks(items, block)
    blocks = (found.agg(F.max("block")).first()[0] or 0) + 1
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = None
    for number in range(blocks):
        mine = found.where(c("block") == number)
        used = staged(mine.select("no", F.explode(F.regexp_extract_all(lower_ascii(c("text")), F.lit(TERM), F.lit(0))).alias("term"))
                      .groupBy("no", "term").agg(F.count(F.lit(1)).alias("q")), "item-terms")
        vocabulary = used.select("term").distinct().withColumn("id", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("term")) - 1).cast("int"))
        folder = _written(vocabulary, "vocabulary")
        bags = step(docs.mapInArrow(_bags(folder), f"doc_id {kind}, n bigint, bag binary"), "bags")
        n_docs, n_terms = bags.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        held = bags.select("bag").mapInArrow(_holders, "id int, df bigint").groupBy("id").agg(F.sum("df").alias("df"))
        weight = F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * c("df") + 1))).cast("bigint")
        names = spark.read.schema("term string, id int").parquet(folder)
        postings = used.join(names, "term").join(held, "id").select("id", "no", "q", weight.alias("w"))
        weights = _written(postings, "postings")
        m = F.lit(75) + F.expr(f"(25 * n * {n_docs}L) div {max(1, n_terms)}L")
        alike = bags.where("octet_length(bag) > 0").select("doc_id", m.cast("bigint").alias("m"), "bag").withColumn("hash", F.xxhash64("m", "bag"))
        classes = step(alike.groupBy("hash", "m", "bag").agg(F.min("doc_id").alias("least")), "classes")
        scored = classes.mapInArrow(_scored(weights, k), f"hash bigint, m bigint, bag binary, least {kind}, no bigint, score bigint")
        top = step(ranked_of(["no"], [c("score").desc(), c("least").asc_nulls_last()], k, scored).select("hash", "m", "bag", "no", "score"), "best-classes")
        key = ["hash", "m", "bag"]
        # Written first: a class with very many members is split by the join, and cut to k members a task before it is ranked.
        asked = step(top.select(key).distinct(), "classes-asked")
        members = step(alike.join(asked, key, "left_semi"), "members")
        few = ranked_of(key, [c("doc_id").asc_nulls_last()], k, members).drop("rank")
        rows = top.join(few, key).select("no", "score", "doc_id")
        best = step(ranked_of(["no"], [c("score").desc(), c("doc_id").asc_nulls_last()], k, rows), "ranked")
        removed(bags, classes, asked, members, top)
        named = mine.select("no", "item_id").join(best, "no").select("item_id", c("rank").cast("int").alias("rank"), "doc_id", "score")
        out = named if out is None else out.unionByName(named)
    return out


def plain(docs: list[tuple], items: list[tuple], k: int = K) -> list[tuple]:
    """item_id, rank, doc_id, score by the definition; for tests."""
    import math
    import re
    from collections import Counter

    lower = str.maketrans(UPPER, LOWER)
    cut = [(d, Counter(x.translate(lower) for x in re.findall(TERM, t or ""))) for d, t in docs]
    n_docs, n_terms = sum(bool(b) for _, b in cut), sum(b.total() for _, b in cut)
    df = Counter(t for _, b in cut for t in b)
    out = []
    for item_id, text in items:
        asked = [x.translate(lower) for x in re.findall(TERM, text or "")]
        scored = []
        for d, b in cut:
            if b:
                m = 100 - 25 + 25 * b.total() * n_docs // n_terms
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 12 * m)) for t in asked if t in b)
                if score > 0:
                    scored.append((-score, d is None, d or 0, d))
        scored.sort(key=lambda x: x[:3])
        out += [(item_id, i, x[3], -x[0]) for i, x in enumerate(scored[:k], 1)]
    return out


ORACLE = r"""
with items as (
  select row_number() over () as no, item_id,
         unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
asked as (select no, item_id, term, count(*) as q from items group by all),
docs as (
  select row_number() over () as row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents),
stats as (select count(*) as docs, sum(len(terms))::bigint as terms from docs where len(terms) > 0),
found as (select row, doc_id, len(terms) as n, unnest(terms) as term from docs),
counted as (select row, doc_id, n, term, count(*) as tf from found where term in (select term from asked) group by all),
weights as (select term, floor(1000 * ln((2 * any_value(s.docs) + 2) / (2 * count(*) + 1)))::bigint as w from counted, stats s group by term),
scored as (
  select a.no, a.item_id, f.row, f.doc_id,
         sum(a.q * w.w * ((1000000000 * f.tf) // (1000 * f.tf + 12 * (75 + (25 * f.n * s.docs) // s.terms))))::bigint as score
  from asked a join counted f using (term) join weights w using (term), stats s group by all),
ranked as (
  select *, row_number() over (partition by no order by score desc, doc_id nulls last)::int as rank from scored where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 20
"""
