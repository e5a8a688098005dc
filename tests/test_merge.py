"""Merging against the plain double loop over the list."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sparkwarden import Config
from sparkwarden.operators import merge

BASE = dt.datetime(2024, 1, 1)
INCIDENT = ("incident_key string, incident_type string, target_user string, attack_chain_id string, "
            "admitted_pos struct<t:bigint,seq:bigint,ord:int>, first_seen timestamp, last_seen timestamp, status string")


def plain(rows, ips):
    state = [dict(key=r[0], type=r[1], user=r[2], chain=r[3], f=r[5], l=r[6], ips=set(ips[r[0]])) for r in rows]
    done, out = set(), []
    for i, a in enumerate(state):
        if i in done:
            continue
        n = 0
        for j in range(i + 1, len(state)):
            b = state[j]
            if j in done or abs((a["l"] - b["f"]).total_seconds()) > 300:
                continue
            shared = a["ips"] & b["ips"]
            if (shared and a["user"] and a["user"] == b["user"]) or (a["chain"] and a["chain"] == b["chain"]) \
                    or (shared and a["type"] == b["type"]):
                n += 1
                done.add(j)
                out.append((b["key"], a["key"], n))
                a["ips"] |= b["ips"]
                a["f"], a["l"] = min(a["f"], b["f"]), max(a["l"], b["l"])
                a["user"] = a["user"] or b["user"]
    return sorted(out)


def merged(spark, rows, ips):
    sources = spark.createDataFrame([(k, x) for k, v in ips.items() for x in set(v)], "incident_key string, source_ip string")
    got = merge.merge_map(spark.createDataFrame(rows, INCIDENT), sources, Config(), lambda n, d: d.checkpoint())
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize(("seed", "n", "span", "hosts"), [(1, 60, 6000, 15), (2, 150, 9000, 6), (3, 90, 1500, 40)])
def test_merge_map(spark, seed, n, span, hosts):
    rnd = random.Random(seed)
    rows, ips = [], {}
    for i in range(n):
        first = BASE + dt.timedelta(seconds=rnd.randint(0, span))
        key = f"i{i}"
        rows.append((key, rnd.choice("ABC"), rnd.choice(["u1", "u2", "u3", None, ""]), rnd.choice([None, None, f"c{rnd.randint(0, 8)}"]),
                     (i * 10, i, 1), first, first + dt.timedelta(seconds=rnd.randint(0, 400)), rnd.choice(["ACTIVE", "ACTIVE", "INVESTIGATING", "CLOSED"])))
        ips[key] = [f"ip{rnd.randint(0, hosts)}" for _ in range(rnd.randint(0, 2))]
    assert merged(spark, rows, ips) == plain([r for r in rows if r[-1] != "CLOSED"], ips)


def test_an_address_that_is_active_all_day(spark):
    # A third of the incidents follow each other from one address, each reaching the next only through those merged before.
    rnd = random.Random(4)
    times = [("hot", 240 * i) for i in range(100)] + [(f"ip{rnd.randint(0, 30)}", rnd.randint(0, 24000)) for _ in range(200)]
    times.sort(key=lambda x: x[1])
    rows, ips = [], {}
    for i, (ip, t) in enumerate(times):
        first = BASE + dt.timedelta(seconds=t)
        rows.append((f"i{i:03d}", "A" if ip == "hot" else rnd.choice("AB"), None, None, (t, i, 1), first, first + dt.timedelta(seconds=rnd.randint(0, 30)), "ACTIVE"))
        ips[f"i{i:03d}"] = [ip]
    got = merged(spark, rows, ips)
    assert got == plain(rows, ips) and len(got) > 99


def test_nothing_to_merge(spark):
    assert merged(spark, [], {"x": ["ip"]}) == []


def test_pairs_near_in_time_only(spark):
    rows = [("a", "A", "u", None, (1, 1, 1), BASE, BASE, "ACTIVE"),
            ("b", "A", "u", None, (2, 2, 1), BASE + dt.timedelta(seconds=300), BASE + dt.timedelta(seconds=300), "ACTIVE"),
            ("c", "A", "u", None, (3, 3, 1), BASE + dt.timedelta(seconds=601), BASE + dt.timedelta(seconds=700), "ACTIVE")]
    sources = spark.createDataFrame([(k, "ip") for k in "abc"], "incident_key string, source_ip string")
    got = merge.merge_candidates(spark.createDataFrame(rows, INCIDENT), sources, Config()).select(F.array("primary_key", "secondary_key"))
    assert [r[0] for r in got.collect()] == [["a", "b"]]
