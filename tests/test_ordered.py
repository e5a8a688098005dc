"""Totals and clearings against plain loops, in both plans."""

import random

import pytest
from pyspark.sql import functions as F

from sparkwarden import Config
from sparkwarden.operators import detect, resets
from sparkwarden.operators.ordered import SECOND, Running, Sliding, with_totals


def events(seed, keys=4, n=300, failures=0.8):
    rnd = random.Random(seed)
    rows, seq = [], 0
    for k in range(keys):
        t = 1_700_000_000
        for _ in range(n):
            t += rnd.choice([0, 0, 1, 3, 7, 15, 20, 60, 61])
            rows.append((f"10.0.0.{k}", t * SECOND, seq, rnd.random() < failures, rnd.randint(-5, 5)))
            seq += rnd.choice([1, 1, 2, 1 << 19])
    rnd.shuffle(rows)
    return rows


SCHEMA = "ip string, t bigint, seq bigint, failed boolean, v int"


@pytest.mark.parametrize("plan", ["cells", "keys"])
def test_totals(spark, plan):
    rows = events(1)
    got = with_totals(spark.createDataFrame(rows, SCHEMA), ["ip"], {
        "total": Running(F.col("v")), "low": Running(F.col("v"), "min"), "high": Running(F.col("v"), "max"),
        "open60": Sliding(F.col("failed").cast("int"), 60 * SECOND, True), "closed60": Sliding(F.lit(1), 60 * SECOND, False),
        "open30": Sliding(F.lit(1), 30 * SECOND, True)}, plan=plan).collect()
    assert len(got) == len(rows)
    by_ip = {}
    for r in sorted(got, key=lambda r: (r.ip, r.t, r.seq)):
        seen = by_ip.setdefault(r.ip, [])
        seen.append(r)
        vs = [x.v for x in seen]
        assert (r.total, r.low, r.high) == (sum(vs), min(vs), max(vs))
        assert r.open60 == sum(x.failed for x in seen if x.t > r.t - 60 * SECOND)
        assert r.closed60 == sum(1 for x in seen if x.t >= r.t - 60 * SECOND)
        assert r.open30 == sum(1 for x in seen if x.t > r.t - 30 * SECOND)


def test_equal_positions_see_each_other(spark):
    d = spark.createDataFrame([("a", 5, 1, True, 2), ("a", 5, 1, True, 3), ("a", 5, 2, True, 4)], SCHEMA)
    got = with_totals(d, ["ip"], {"n": Running(F.col("v"))})
    assert sorted(r.n for r in got.collect()) == [5, 5, 9]


@pytest.mark.parametrize("chunk", [4, 7, 64])
def test_clearings(spark, chunk):
    rnd = random.Random(chunk)
    rows, want = [], []
    for k in range(30):
        dense = rnd.choice([0.05, 0.4, 0.9, 1.0])
        numbers = [i for i in range(3, 400) if rnd.random() < dense]
        rows += [(f"k{k}", i) for i in numbers]
        free = 0
        for i in numbers:
            if i >= free:
                want.append((f"k{k}", i))
                free = i + 3
    got = resets.clearings(spark.createDataFrame(rows, "ip string, n bigint"), "ip", "n", 3, chunk=chunk)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_clearings_of_one_source_with_very_many_failures(spark):
    n = 200_000
    got = resets.clearings(spark.range(3, n).selectExpr("'hot' as ip", "id as n").where("n % 7 <> 0"), "ip", "n", 3, cut=lambda name, d: d.checkpoint())
    want, free = [], 0
    for i in range(3, n):
        if i % 7 and i >= free:
            want.append(i)
            free = i + 3
    assert sorted(r.n for r in got.collect()) == want


def model(rows):
    """The rules as one pass over the events of each source."""
    out, kept = [], {}
    for ip, t, seq, failed, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        if failed:
            kept[ip] = [x for x in kept.get(ip, []) + [t] if x > t - 60 * SECOND]
            n = len(kept[ip])
            if n >= 3:
                out.append((seq, "R001" if n >= 5 else "R014", n))
        elif len(kept.get(ip, [])) >= 3:
            out.append((seq, "R002", len(kept[ip]) + 1))
            kept[ip] = []
    return sorted(out)


@pytest.mark.parametrize("seed,failures", [(1, 0.8), (2, 0.5), (3, 0.95), (4, 0.7)])
def test_auth_rules(spark, monkeypatch, seed, failures):
    monkeypatch.setattr(resets, "CHUNK", 16)
    rows = events(seed, failures=failures)
    d = spark.createDataFrame(rows, SCHEMA)
    scanned = d.select(
        "seq", "t", F.timestamp_micros("t").alias("timestamp"), F.col("seq").cast("string").alias("event_id"), F.col("ip").alias("source_ip"),
        F.lit("u").alias("username"), *[F.lit("").alias(x) for x in ("hostname", "service", "process", "event_type", "severity", "source_file")],
        F.lit(False).alias("web_flag"), F.lit("").alias("path"), F.col("failed").alias("is_failure"), (~F.col("failed")).alias("is_login"))
    got = detect.auth_hits(scanned, Config()).select("seq", "rule_id", "event_count").collect()
    assert sorted(map(tuple, got)) == model(rows)


def test_no_job_runs_while_a_plan_is_built(spark):
    """Totals are declared; their input is read only when a result is asked for."""
    rows = spark.createDataFrame(events(1), SCHEMA)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "planning")
    with_totals(rows, ["ip"], {"n": Sliding(F.lit(1), 60 * SECOND, True), "m": Running(F.col("v"))})
    jobs = tracker.getJobIdsForGroup("planning")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert not jobs
