"""Quality by importance resampling.

Two generative models over hashed 1- and 2-grams are counted: of the target (documents labelled good) and of the raw text
(all documents). A document's log weight is the mean log ratio of its n-grams, as for a text of LENGTH n-grams, so long and
short texts compare. Documents are then drawn without replacement in proportion to their weights, by Gumbel top-k: the k
largest of log weight plus Gumbel noise, the noise being a function of doc_id. k is the number of documents whose weight
reaches the cut that best tells the labels apart on labelled documents the target was not counted from.

Labels are read from a bounded sample (SAMPLE rows, smallest hashes first); the raw counts and the draw cover all documents.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import staged

c = F.col
BUCKETS_LOG, SAMPLE, LENGTH, SEED, UNITS = 16, 20_000, 1000, 11, 1 << 20
TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\sA-Za-z0-9\x80-\xff]+")
MIX, REPEAT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
#: Keys lie within 2^51 units on either side of zero; they are found ten bits at a time.
BITS, DIGIT = 52, 10


def grams(text: bytes | None) -> np.ndarray:
    """The buckets of a text's tokens and pairs of tokens; a token that follows itself counts as one pair, "repeat"."""
    tokens = TOKEN.findall(text or b"")
    h = np.fromiter(map(zlib.crc32, tokens), np.uint64, len(tokens)) + np.uint64(1)
    pairs = np.where(h[1:] == h[:-1], REPEAT, (h[:-1] * MIX + h[1:]) * MIX)
    return (np.concatenate((h * MIX, pairs)) >> np.uint64(64 - BUCKETS_LOG)).astype(np.int64)


def _binary(b: pa.RecordBatch) -> list[bytes | None]:
    return b["text"].cast(pa.binary()).to_pylist()


def _counted(target: object) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = (np.zeros(1 << BUCKETS_LOG, dtype=np.int64) for _ in range(2))
        for b in batches:
            for doc_id, text in zip(b["doc_id"].to_pylist(), _binary(b), strict=True):
                n = np.bincount(g, minlength=len(raw)) if len(g := grams(text)) > 4000 else None
                for counts in (raw, good) if doc_id in target.value else (raw,):
                    if n is None:
                        np.add.at(counts, g, 1)
                    else:
                        counts += n
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(good[at])], ["bucket", "raw", "good"])

    return run


def key_of(weight: float, doc_id: int | None) -> int:
    """Log weight plus Gumbel noise, in whole units."""
    u = ((xxhash.xxh64_intdigest(str(doc_id), SEED) >> 11) + 0.5) / (1 << 53)
    return int(np.clip(math.floor((weight - math.log(-math.log(u))) * UNITS), -(1 << 51), (1 << 51) - 1))


def weight_of(text: bytes | None, ratio: np.ndarray) -> float | None:
    g = grams(text)
    return float(ratio[g].mean()) * LENGTH if len(g) else None


def _weighed(ratio: object) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b["doc_id"].to_pylist()
            w = [weight_of(t, ratio.value) for t in _binary(b)]
            keys = [None if x is None else key_of(x, d) for x, d in zip(w, ids, strict=True)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(w, pa.float64()), pa.array(keys, pa.int64())], ["doc_id", "log_weight", "key"])

    return run


def _kept(ratio: object, least: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = [weight_of(t, ratio.value) for t in _binary(b)]
            yield b.filter(pa.array([x is not None and key_of(x, d) >= least for x, d in zip(w, b["doc_id"].to_pylist(), strict=True)], pa.bool_()))

    return run


def best_cut(weights: list[tuple[float, int]]) -> float:
    """The cut with the largest mean share of right answers over both classes, halfway to the next weight; of several the
    one in the widest gap. Minus infinity if a class is missing."""
    rows = sorted(weights)
    n_good, n_bad = sum(q for _, q in rows), sum(1 - q for _, q in rows)
    if not n_good or not n_bad:
        return -math.inf
    best, bad, good = (1 / 2, 0.0, -math.inf), 0, 0
    for (w, q), (after, _) in zip(rows, rows[1:], strict=False):
        bad, good = bad + 1 - q, good + q
        if after > w:
            best = max(best, (round((bad / n_bad + 1 - good / n_good) / 2, 9), after - w, (w + after) / 2))
    return best[2]


def kth_largest(keys: DataFrame, k: int) -> int:
    """The k-th largest value of the column key, found digit by digit from counts of at most 1024 prefixes a round."""
    prefix, left = 0, k
    shifted = c("key") + F.lit(1 << (BITS - 1))
    for at in range(BITS, 0, -DIGIT):
        low = max(0, at - DIGIT)
        inside = keys.where(F.shiftright(shifted, at) == prefix) if at < BITS else keys
        counts = {r.p: r.n for r in inside.groupBy(F.shiftright(shifted, low).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
        for p in sorted(counts, reverse=True):
            if left <= counts[p]:
                prefix = p
                break
            left -= counts[p]
    return prefix - (1 << (BITS - 1))


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, np.ndarray, int]:
    """The staged weights (doc_id, log_weight, key), the log ratio per bucket, and the least key that is drawn."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", c("text").cast("string"))
    one = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = one.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(sample).collect()
    target = {r.doc_id for i, r in enumerate(rows) if r.quality == 1 and i % 2 == 0}
    held_out = {r.doc_id: int(r.quality) for i, r in enumerate(rows) if i % 2}
    counted = docs.mapInArrow(_counted(spark.sparkContext.broadcast(target)), "bucket bigint, raw bigint, good bigint")
    raw, good = (np.ones(1 << BUCKETS_LOG) for _ in range(2))
    for r in counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect():  # one row a bucket
        raw[r.bucket] += r.raw
        good[r.bucket] += r.good
    ratio = np.log(good / good.sum()) - np.log(raw / raw.sum()) if (good > 1).any() else np.zeros(len(raw))
    held = spark.sparkContext.broadcast(ratio)
    weights = staged(docs.mapInArrow(_weighed(held), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, log_weight double, key bigint"), "weights")
    asked = spark.createDataFrame(list(held_out.items()), "doc_id bigint, quality int")
    cut = best_cut([(r.log_weight, r.quality) for r in weights.join(F.broadcast(asked), "doc_id").where("key is not null")
                    .groupBy("doc_id").agg(F.min("log_weight").alias("log_weight"), F.min("quality").alias("quality")).collect()])
    keys = weights.where("key is not null")
    k = keys.where(c("log_weight") >= cut).count()
    return weights, ratio, kth_largest(keys, k) if k else 1 << 51


def classified(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, log_weight, drawn of every row of `docs` (doc_id, text); `labels` has doc_id and quality (1 good, 0 bad).

    A null text, or one without tokens, has no weight and is not drawn. Rows whose key equals that of the last one drawn are
    drawn too, so repeated rows share their fate. Rows without a doc_id take part with the same noise. Labels without a
    doc_id or of another value are not read; of several for a doc_id the least counts. Without good labels all weights are
    0; without labels of both kinds every text with tokens is drawn. No documents give no rows. Other columns are not read.
    """
    weights, _, least = fitted(docs, labels, sample)
    return weights.select("doc_id", "log_weight", F.coalesce(c("key") >= least, F.lit(False)).alias("drawn"))


def drawn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of `docs` that are drawn, all columns as they are. Cases as for classified().

    Weights are computed once more where the rows are read, so whole texts are neither joined nor shuffled."""
    _, ratio, least = fitted(docs, labels, sample)
    out = docs.withColumn("text", c("text").cast("string"))
    return out.mapInArrow(_kept(docs.sparkSession.sparkContext.broadcast(ratio), least), out.schema)
