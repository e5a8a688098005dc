"""Handwritten lines and what they must parse to."""

import pytest

from sparkwarden import Config
from sparkwarden.operators.detect import with_line_rules
from sparkwarden.operators.parse import detect_format, parse_lines

H = "Jul  5 09:14:23 host "
CASES = [
    (H + "sudo: admin : TTY=pts/0 ; PWD=/ ; USER=root ; COMMAND=/bin/cat /etc/shadow", "auth", ["R007"], {}),
    (H + "su[12]: pam_unix(su:session): session opened for user root by admin", "auth", ["R005"], {"username": "user"}),
    (H + "sshd[12]: pam_unix(sshd:session): session opened for user admin", "auth", [], {}),
    (H + "anacron[1]: Session terminated.", "auth", ["R013"], {"event_type": "System"}),
    (H + "systemd[1]: nginx.service: Main process exited, code=exited, status=1/FAILURE", "auth", [], {}),
    (H + "kernel: BUG: unable to handle page fault", "auth", [], {"event_type": "Kernel"}),
    (H + "kernel: [452.1] Kernel panic - not syncing", "auth", ["R011"], {"severity": "CRITICAL"}),
    (H + "sshd[1]: Failed password for invalid user test from 1.2.3.4 port 22 ssh2", "auth", ["R003"],
     {"username": "test", "source_ip": "1.2.3.4", "process": "1", "severity": "MEDIUM"}),
    ('9.9.9.9 - - [05/Jul/2026:09:14:23 +0200] "GET /search?q=test\' OR 1=1-- HTTP/1.1" 400 100 "-" "sqlmap/1.7"', "unknown",
     ["R006", "R008"], {"source_ip": "9.9.9.9", "event_type": "Unknown"}),
    ('9.9.9.9 - bob [05/Jul/2026:09:14:23 +0200] "GET /../../etc/passwd HTTP/1.1" 400 100 "-" "x"', "apache_access", ["R007"],
     {"message": "GET /../../etc/passwd → 400 [x]", "username": "bob", "hostname": "webserver", "severity": "HIGH"}),
    ('9.9.9.9 - - [05/Jul/2026:09:14:23 +0200] "GET /a HTTP/1.1" 503 -', "apache_access", [],
     {"message": "GET /a → 503", "severity": "HIGH", "username": None}),
    ("[Sun Jul 05 09:14:23.123456 2026] [core:error] [pid 12] [client 1.2.3.4:99] File missing", "apache_error", [],
     {"source_ip": "1.2.3.4", "message": "File missing", "severity": "HIGH"}),
    ("[Sun Jul 05 09:14:23 2026] [core:error] [pid 12:tid 34] [client 1.2.3.4:99] File missing", "apache_error", [],
     {"source_ip": None, "message": "[pid 12:tid 34] [client 1.2.3.4:99] File missing"}),
    (H + "app: No space left on device", "auth", ["R012"], {"severity": "HIGH", "event_type": "System"}),
    (H + "app: error: no space here", "auth", [], {"severity": "MEDIUM"}),
    (H + "app: İNVALİD USER ſegfault", "auth", ["R003", "R013"], {}),
    ("nothing known from 300.1.2.3", "unknown", [], {"source_ip": "300.1.2.3", "message": "nothing known from 300.1.2.3"}),
    (H + "sshd[1]: connection for from 1.2.3.4 by carol", "auth", [], {"username": "carol"}),
]


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [(i, c[0], "t.log") for i, c in enumerate(CASES)]
    d = spark.createDataFrame(rows, "seq bigint, value string, source_file string").selectExpr(
        "*", "timestamp '2024-06-01 00:00:00' as modified")
    return {r.seq: r for r in with_line_rules(parse_lines(d, Config(year=2024))).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_line(parsed, i):
    _, fmt, rules, fields = CASES[i]
    row = parsed[i]
    assert row.log_format == fmt
    assert row.line_rules == rules
    assert {k: row[k] for k in fields} == fields


def test_times(parsed):
    assert str(parsed[0].timestamp) == "2024-07-05 09:14:23"
    assert str(parsed[9].timestamp) == "2026-07-05 09:14:23"
    assert str(parsed[11].timestamp) == "2026-07-05 09:14:23.123456"
    assert str(parsed[16].timestamp) == "2024-06-01 00:00:00"


def test_blank_lines_go_and_long_ones_are_cut_in_the_message_only(spark, lines):
    rows = parse_lines(lines(["", "  \t ", "x" * 600]), Config()).collect()
    assert len(rows) == 1 and len(rows[0].message) == 500 and len(rows[0].raw_log) == 600


def test_given_format_falls_back(spark, lines):
    d = lines([CASES[0][0], CASES[9][0]])
    assert [r.log_format for r in parse_lines(d, Config(), "syslog").orderBy("seq").collect()] == ["syslog", "unknown"]
    assert [r.log_format for r in detect_format(d).orderBy("seq").collect()] == ["auth", "apache_access"]


def test_own_rules(spark, lines):
    d = with_line_rules(parse_lines(lines([H + "app: the word Teapot"]), Config()), [("X1", r"tea\w+", None), ("X2", "coffee", None)])
    assert d.first().line_rules == ["X1"]
