"""Streams over growing and rotated files."""

import io
import random

from sparkwarden.sources import follow
from sparkwarden.streaming import jobs as J


def run(spark, tmp_path, part=64 << 20):
    stream = follow.follow_lines(spark, str(tmp_path / "logs"), str(tmp_path / "state" / "files.json"), part)
    J.to_table(stream, "lines", str(tmp_path / "out"))
    return sorted((r.seq, r.value) for r in spark.read.parquet(str(tmp_path / "out" / "lines")).collect())


def test_appended_bytes_rotation_and_new_files(spark, tmp_path):
    logs = tmp_path / "logs"
    (logs / "deep").mkdir(parents=True)
    a = logs / "a.log"
    a.write_bytes(b"one\r\nsame\nsame\n\n  \nunfini")
    (logs / "other.txt").write_text("not a log\n")
    rows = run(spark, tmp_path, part=4)
    assert [v for _, v in rows] == ["one", "same", "same"] and len({s for s, _ in rows}) == 3
    with a.open("ab") as f:  # the line that was not finished counts once it is
        f.write("shed\nÄ\x0bb\n".encode() + b"\xff!\n")
    (logs / "deep" / "syslog").write_text("new file\n")
    rows = run(spark, tmp_path, part=5)
    assert sorted(v for _, v in rows) == sorted(["one", "same", "same", "unfinished", "Ä", "b", "�!", "new file"]) and len({s for s, _ in rows}) == 8
    assert run(spark, tmp_path) == rows  # nothing new
    a.write_bytes(b"after rotation\nsame\n")
    rows = run(spark, tmp_path)
    assert len(rows) == 10 and len({s for s, _ in rows}) == 10 and [v for _, v in rows].count("same") == 3
    # A rotated file that has already grown beyond the old one is known by its first line.
    a.write_bytes(b"third\n" + b"more\n" * 100)
    rows = run(spark, tmp_path, part=64)
    assert len(rows) == 111 and len({s for s, _ in rows}) == 111
    a.unlink()
    assert run(spark, tmp_path) == rows


def test_ranges_hold_each_line_once():
    draw = random.Random(3)
    data = b"".join(b"x" * draw.choice([0, 1, 3, 50, 70000]) + b"\n" for _ in range(60))
    want = list(follow.lines_from(io.BytesIO(data), 0, len(data)))
    assert b"".join(x for _, x in want) == data
    for part in (501, 1000, 65536, 200000):
        ranges = [(lo, min(lo + part, len(data))) for lo in range(0, len(data), part)]
        assert [x for lo, hi in ranges for x in follow.lines_from(io.BytesIO(data), lo, hi)] == want


def test_an_empty_folder(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    stream = follow.follow_lines(spark, str(tmp_path / "logs"), str(tmp_path / "state" / "files.json"))
    J.to_table(stream, "lines", str(tmp_path / "out"))
    assert stream.schema.simpleString() == "struct<seq:bigint,value:string,source_file:string,modified:timestamp>"
