import json

from pyspark.sql import functions as F

from sparkwarden.operators.parse import detect_format
from sparkwarden.plans.engine import Engine
from sparkwarden.sources import lines as L
from sparkwarden.sources import sinks as K

LINE = "Jul  5 09:14:2{} host sshd[1]: Failed password for bob from 1.2.3.4 port 22 ssh2"


def test_files(spark, tmp_path):
    for name in ("a.log", "syslog", "notes.txt", "plain", "messages", "b.log.gz"):
        (tmp_path / name).write_text("x\n")
    assert [r.name for r in L.discover_files(spark, str(tmp_path)).collect()] == ["a.log", "messages", "syslog"]
    assert [(r.name, r.size_bytes) for r in L.list_log_files(spark, [str(tmp_path)]).collect()] == [
        ("a.log", 2), ("messages", 2), ("plain", 2), ("syslog", 2)]


def test_read_lines(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"  one \n\n\ttwo\x0bthree\r\nbad \xff byte\n")
    (tmp_path / "other.txt").write_text("not a log\n")
    rows = L.read_lines(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r.value for r in rows] == ["one", "two", "three", "bad � byte"]
    assert {r.source_file.rsplit("/", 1)[1] for r in rows} == {"a.log"} and all("/" in r.source_file for r in rows)
    assert L.read_lines(spark, str(tmp_path), modified_after="2999-01-01T00:00:00").count() == 0


def test_exports_and_session(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "auth.log").write_text("\n".join(LINE.format(i) for i in range(8)) + "\n")
    e = Engine(spark, L.read_lines(spark, str(logs)))
    K.write_csv(e.entries, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.count() == 8 and back.columns == ["event_id", "timestamp", "hostname", "source_ip", "username", "service",
                                                  "event_type", "severity", "message", "log_format"]
    from sparkwarden.operators import stats as S
    row = S.session_stats(e.entries, e.alerts, e.updates, e.incidents).first()
    # Alerts start at the third failure, the incident at the seventh; it is listed from its second update on.
    assert (row.source_file.rsplit("/", 1)[1], row.events, row.alerts, row.incidents) == ("auth.log", 8, 6, 1)
    stats = S.dashboard_stats(e.entries, e.alerts, e.incidents, e.every_after_merge)
    K.write_json_report(str(tmp_path / "json"), stats, e.entries, e.incidents, e.alerts)
    assert spark.read.json(str(tmp_path / "json" / "alerts")).count() == 6
    nested = json.loads(K.json_rows(e.with_texts(e.incidents)).first().json)
    assert nested["total_events"] == 2 and nested["smart_recommendations"][0]["priority"] == "CRITICAL"


def test_event_lines_of_any_id(spark, tmp_path):
    """Times of large ids are beyond what a timestamp holds; each row gives a line all the same."""
    last = ((1 << 63) - 1) // 1_000_000
    edge = (last - 1704067200) * 5
    ids = [-7, 0, 7, 5 * 10**13, edge, edge + 5, (1 << 63) - 1, -(1 << 63)]
    kinds = ["error", "purchase", "view", "click", "signup"]
    rows = [(i, k, kind) for i in ids for k, kind in enumerate(kinds)]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    lines = L.event_lines(spark, str(tmp_path))
    seconds = {r.seq: r.s for r in lines.select("seq", F.unix_seconds("modified").alias("s")).collect()}
    assert [seconds[i] - 1704067200 for i in (-7, 0, 7)] == [-2, 0, 1] and seconds[edge] == last
    assert all(0 <= seconds[i] < 1 << 32 for i in ids if i > edge or i < -(1 << 60)) and set(seconds) == set(ids)
    assert detect_format(lines).groupBy("seq").count().where("count = 5").count() == len(ids)
    assert Engine(spark, lines).entries.count() == len(rows)
