"""Tables of batches, and the steps at the end of a batch, when batches fail and run again."""

import pytest
from pyspark.sql import functions as F

from sparkwarden import Engine
from sparkwarden.streaming.batch_end import SLICES, batch_end, published, together
from sparkwarden.streaming.tables import BatchTables


def rows(d):
    return sorted(map(str, d.collect()))


def test_changes_are_merged_and_compacted(spark, tmp_path):
    t = BatchTables(spark, str(tmp_path / "t"), compact=3)
    assert t.log("x") is None and t.merged("x", "k") is None
    want = {}
    for b in range(8):
        new = {f"k{(b + i) % 5}": b * 10 + i for i in range(2)}
        want |= {k: (b, v) for k, v in new.items()}
        t.write(b, {"x": spark.createDataFrame(list(new.items()), "k string, v bigint")}, {"x": "k"})
        assert {r.k: (r.batch_id, r.v) for r in t.merged("x", "k").collect()} == want
    assert sum("x" in r["bases"] for r in t.records().values()) == 2
    t.write(3, {"x": spark.createDataFrame([("k0", -1)], "k string, v bigint")}, {"x": "k"})  # recorded already
    assert t.log("x").count() == 16


def test_a_batch_that_fails_before_its_record_leaves_nothing(spark, tmp_path, monkeypatch):
    t = BatchTables(spark, str(tmp_path / "t"))
    d = spark.createDataFrame([("a", 1)], "k string, v bigint")
    t.write(0, {"x": d}, {"x": "k"})
    with monkeypatch.context() as m:
        m.setattr(BatchTables, "_record", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            t.write(1, {"x": d.withColumn("v", F.lit(2).cast("bigint"))}, {"x": "k"})
    assert [r.v for r in t.merged("x", "k").collect()] == [1]
    t.write(1, {"x": d.withColumn("v", F.lit(3).cast("bigint"))}, {"x": "k"})
    assert [r.v for r in t.merged("x", "k").collect()] == [3]


def test_batch_ends_run_again(spark, lines, tmp_path, monkeypatch):
    values = [f"Jul  5 09:14:{i:02d} h sshd[{i}]: Failed password for bob from 1.2.3.{i % 2} port 22 ssh2" for i in range(30)]
    values += [f"Jul  5 09:15:{i:02d} h svc[{i}]: worker segfault at 0" for i in range(5)] + ["Jul  5 09:15:10 h sshd[1]: Failed password for root from 9.9.9.9 port 22 ssh2"] * 3
    e = Engine(spark, lines(values))
    hits = e.detected.select("*", F.explode("hits").alias("h")).select("*", "h.rule_id", F.col("h.event_count").cast("bigint").alias("event_count")).drop("hits", "h")
    whole = together(e.scanned, hits, e.updates)
    batches = [whole.where("seq < 20"), whole.where("seq >= 20")]
    good, bad = (BatchTables(spark, str(tmp_path / x)) for x in ("good", "bad"))
    for i, b in enumerate(batches):
        batch_end(good, e.config)(b, i)
        with monkeypatch.context() as m:
            m.setattr(BatchTables, "_record", lambda *a: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(OSError, match="lost"):
                batch_end(bad, e.config)(b, i)
        batch_end(bad, e.config)(b, i)
        batch_end(bad, e.config)(b, i)
    assert rows(published(good)) == rows(published(bad))
    assert {r.slice for r in published(good).select("slice").distinct().collect()} == set(SLICES)
    for name, key in (("incidents", "incident_key"), ("observations", "evidence_key")):
        assert rows(good.merged(name, key)) == rows(bad.merged(name, key))
    got = {r.incident_key: (r.total_events, r.batch_id) for r in good.merged("incidents", "incident_key").collect()}
    want = {r.incident_key: r.total_events for r in e.all_incidents.collect()}
    assert {k: v[0] for k, v in got.items()} == want and {v[1] for v in got.values()} == {1}
    last = good.log("queue").where("batch_id = 1").select("incident_key", "priority")
    assert rows(last) == rows(e.ranked.select("incident_key", "priority"))
    with pytest.raises(Exception, match="without its entry"):
        batch_end(BatchTables(spark, str(tmp_path / "torn")), e.config)(whole.where("row_kind <> 'entry'"), 0)
