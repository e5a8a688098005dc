"""A stream over landed segments gives what the batch gives."""

import random

from sparkwarden import Engine
from sparkwarden.streaming import jobs as J
from sparkwarden.streaming.state import Window


def test_stream_is_batch(spark, lines):
    values = []
    for i in range(60):
        s = f"{i // 2 % 60:02d}"
        kind = i % 6
        if kind < 3:
            values.append(f"Jul  5 09:14:{s} h sshd[{i}]: Failed password for bob from 1.2.3.4 port 22 ssh2")
        elif kind == 3:
            values.append(f"Jul  5 09:14:{s} h sshd[{i}]: Accepted password for bob from 1.2.3.4 port 22 ssh2")
        elif kind == 4:
            values.append(f"Jul  5 09:14:{s} h svc[{i}]: worker segfault at 0")
        else:
            values.append(f'1.2.3.4 - - [05/Jul/2024:09:14:{s} +0000] "GET /p{i} HTTP/1.1" 404 1 "-" "x"')
    e = Engine(spark, lines(values).repartition(3))

    def rows(d, *cols):
        return sorted(tuple(r) for r in d.select(*cols).collect())
    batch = e.detected.selectExpr("seq", "explode(hits) as h").selectExpr("seq", "h.rule_id", "cast(h.event_count as bigint) n")
    assert rows(J.run_detect(e), "seq", "rule_id", "event_count") == rows(batch, "seq", "rule_id", "n")
    assert rows(J.run_correlate(e), "incident_key", "seq", "n") == rows(e.updates, "incident_key", "seq", "n")
    assert {r["rule_id"] for r in J.run_detect(e).select("rule_id").collect()} >= {"R002", "R013", "R014", "R015"}


def test_windows_hold_what_lies_within():
    draw, kept = random.Random(1), []
    for is_open in (True, False):
        w, kept = Window(), []
        for i in range(3000):
            t = i // 3 + draw.randrange(-5, 5)
            kept = [x for x in [*kept, t] if (x > t - 20 if is_open else x >= t - 20)]
            assert w.add(t, 20, is_open) == len(kept) == w.total()
            if i % 500 == 499:
                w = Window(list(w.times), list(w.counts))
            if i % 777 == 776:
                w.clear()
                kept = []
        assert sorted(w.times) == list(w.times)


def test_equal_lines_stay_apart_and_are_read_once(spark, tmp_path):
    """A text stream gives every line of a file once, equal ones too, however often its batches are run."""
    from sparkwarden.sources.lines import stream_lines
    source = tmp_path / "logs"
    source.mkdir()
    (source / "a.log").write_bytes(b"same\nsame\r\n\n  same \nother\x0bsame\n")
    J.to_table(stream_lines(spark, str(source)), "lines", str(tmp_path / "out"))
    (source / "b.log").write_text("same\n")
    J.to_table(stream_lines(spark, str(source)), "lines", str(tmp_path / "out"))
    rows = spark.read.parquet(str(tmp_path / "out" / "lines")).collect()
    assert sorted(r.value for r in rows) == ["other"] + ["same"] * 5 and len({r.seq for r in rows}) == 6
    # The next step follows the sink's log: files that a failed batch left behind are not taken.
    stray = spark.createDataFrame([(1, "stray", "x", None)], "seq bigint, value string, source_file string, modified timestamp")
    stray.write.parquet(str(tmp_path / "stray"))
    for f in (tmp_path / "stray").glob("part-*.parquet"):
        (tmp_path / "out" / "lines" / f.name).write_bytes(f.read_bytes())
    follow = spark.readStream.schema(stray.schema).parquet(str(tmp_path / "out" / "lines")).select("value")
    J.to_table(follow, "copy", str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.parquet(str(tmp_path / "out" / "copy")).collect()) == sorted(r.value for r in rows)
