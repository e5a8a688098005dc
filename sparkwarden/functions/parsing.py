"""Columns that take a raw line apart. Built-in functions only, so parsing stays inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Line patterns. Classes are Unicode-aware, as (?U) says.
BSD_LINE = r"(?U)^(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s+(.+)$"
ACCESS_LINE = (r'(?U)^(\S+)\s+\S+\s+(\S+)\s+\[([^\]]+)\]\s+"(\w+)\s+(\S+)\s+\S+"\s+(\d{3})\s+(?:\d+|-)'
               r'(?:\s+"[^"]*"\s+"([^"]*)")?.*$')
ERROR_LINE = r"(?U)^\[([^\]]+)\]\s+\[(?:\w+:)?(\w+)\]\s+(?:\[pid\s+\d+\]\s+)?(?:\[client\s+([^\]]+)\]\s+)?(.+)$"
FIRST_IP = r"(?U)\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b"
USER_FOR = r"(?U)(?:for|user)\s+(?:invalid\s+user\s+)?(\S+)"
USER_BY = r"(?U)by\s+(\S+)"
NOT_USERS = ["port", "from", "on", "to"]
WHITESPACE_ENDS = r"(?U)^\s+|\s+$"
# Line ends that a text source leaves inside a row.
INNER_LINE_ENDS = r"[\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

# One replacement per line instead of one extraction per group: the fields come out joined by line feeds, which
# cannot occur inside a line.
_BSD_FIELDS = "auth\n$1\n$2\n$3\n$4\n$5"
_ACCESS_FIELDS = "apache_access\n$1\n$2\n$3\n$4\n$5\n$6\n$7"
_ERROR_FIELDS = "apache_error\n$1\n$2\n$3\n$4"


def trimmed(line: Column) -> Column:
    return F.regexp_replace(F.call_function("make_valid_utf8", line), WHITESPACE_ENDS, "")


def has_fields(x: Column) -> Column:
    return F.contains(x, F.lit("\n"))


def match_bsd(line: Column) -> Column:
    return F.regexp_replace(line, BSD_LINE, _BSD_FIELDS)


def match_access(line: Column) -> Column:
    return F.regexp_replace(line, ACCESS_LINE, _ACCESS_FIELDS)


def match_error(line: Column) -> Column:
    return F.regexp_replace(line, ERROR_LINE, _ERROR_FIELDS)


def empty_to_null(x: Column) -> Column:
    return F.when(x != "", x)


def first_ip(text: Column) -> Column:
    return empty_to_null(F.regexp_extract(text, FIRST_IP, 1))


def named_user(text: Column) -> Column:
    return F.regexp_extract(text, USER_FOR, 1)


def username_of(text: Column, named: Column | None = None) -> Column:
    """named may be a column that already holds named_user(text)."""
    named = named_user(text) if named is None else named
    usable = (named != "") & ~named.isin(NOT_USERS)
    return F.when(usable, named).otherwise(empty_to_null(F.regexp_extract(text, USER_BY, 1)))


def folded(text: Column) -> Column:
    """Lower case such that an ASCII word is found exactly where a case-insensitive Unicode match finds it.

    Four letters outside ASCII match an ASCII letter when case is ignored: long s, dotless i, dotted I and the Kelvin sign.
    """
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.lower(F.translate(text, "\u017f\u0131\u0130\u212a", "siik")))


def bsd_time(text: Column, year: int) -> Column:
    one_space = F.regexp_replace(text, r"(?U)\s+", " ")
    return F.try_to_timestamp(F.concat(F.lit(f"{year} "), one_space), F.lit("yyyy MMM d HH:mm:ss"))


def access_time(text: Column) -> Column:
    """The zone offset is dropped: the time is taken as written."""
    first = F.regexp_extract(text, r"(?U)^\s*(\S+)", 1)
    return F.try_to_timestamp(first, F.lit("d/MMM/yyyy:HH:mm:ss"))


def error_time(text: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(text, WHITESPACE_ENDS, ""), r"(?U)\s+", " ")
    dated = F.regexp_extract(clean, r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun) (.*)$", 1)
    return F.coalesce(
        F.try_to_timestamp(dated, F.lit("MMM d HH:mm:ss.SSSSSS yyyy")),
        F.try_to_timestamp(dated, F.lit("MMM d HH:mm:ss yyyy")),
    )


def contains_any(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def _first_case(cases: list[tuple[Column, str]], default: str) -> Column:
    out = F.when(cases[0][0], cases[0][1])
    for cond, value in cases[1:]:
        out = out.when(cond, value)
    return out.otherwise(default)


def event_type_of(s: Column, m: Column) -> Column:
    """From lower-case service and message. Keywords of each event type, tested in this order."""
    return _first_case([
        (contains_any(s, ["sshd", "pam", "login", "su", "sudo"]), "Authentication"),
        (contains_any(s, ["ufw", "iptables", "firewalld"]), "Firewall"),
        (contains_any(s, ["kernel"]), "Kernel"),
        (contains_any(s, ["systemd", "cron", "anacron"]), "System"),
        (contains_any(s, ["apache", "nginx", "httpd"]), "Web Server"),
        (contains_any(m, ["network", "interface"]), "Network"),
        (contains_any(m, ["password", "authentication", "login", "session"]), "Authentication"),
        (contains_any(m, ["blocked", "denied", "drop", "reject"]), "Firewall"),
    ], "System")


def message_severity(m: Column) -> Column:
    """From the lower-case message. Keywords of each severity, tested in this order."""
    return _first_case([
        (contains_any(m, ["panic", "oops", "critical", "emergency"]), "CRITICAL"),
        (contains_any(m, ["failed password", "authentication failure", "invalid user", "error", "not allowed"]), "MEDIUM"),
        (contains_any(m, ["warning", "disk full", "no space"]), "HIGH"),
        (contains_any(m, ["accepted", "session opened", "started", "loaded"]), "INFO"),
    ], "LOW")


def request_severity(status: Column, p: Column, a: Column) -> Column:
    """From lower-case path and agent. Tools, path words and status codes, tested in this order."""
    return _first_case([
        (contains_any(a, ["sqlmap", "nikto", "nmap", "masscan", "dirbuster"]), "HIGH"),
        (F.contains(p, F.lit("../")) | F.contains(p, F.lit("etc/passwd")), "HIGH"),
        (contains_any(p, ["union", "select", "drop", "1=1", "or+1"]), "CRITICAL"),
        (status >= 500, "HIGH"),
        (status.isin(401, 403), "MEDIUM"),
        (status == 404, "LOW"),
    ], "INFO")


def level_severity(level: Column) -> Column:
    """Severity of an error log level."""
    v = F.lower(level)
    return _first_case([
        (v.isin("emerg", "alert", "crit"), "CRITICAL"),
        (v == "error", "HIGH"),
        (v == "warn", "MEDIUM"),
        (v == "notice", "LOW"),
        (v.isin("info", "debug"), "INFO"),
    ], "MEDIUM")
