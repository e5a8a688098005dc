"""Indicators found in an entry or in any text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pattern of each indicator type, in the order they are looked for: type, flags, pattern, group, and a piece
# of text without which the pattern cannot match (it spares most texts the pattern).
TEXT_IOCS = [
    ("ipv4", "", r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b", 0, "."),
    ("ipv6", "", r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b|\b(?:[0-9a-fA-F]{1,4}:){1,7}:\b"
                 r"|\b::(?:[0-9a-fA-F]{1,4}:){0,6}[0-9a-fA-F]{1,4}\b", 0, ":"),
    ("url", "i", r"https?://[^\s\"'<>]+", 0, "://"),
    ("email", "", r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b", 0, "@"),
    ("domain", "i", r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.)"
                    r"+(?:com|net|org|io|dev|xyz|ru|cn|info|biz|me|co|uk|de|fr|example)\b", 0, "."),
    ("filepath", "", r"(?:/(?:etc|var|tmp|usr|home|opt|bin|sbin|root|www|proc|dev)(?:/[^\s\"'<>;|&]+)+)", 0, "/"),
    ("command", "md", r"COMMAND=(.+?)$", 1, "COMMAND="),
    ("port", "", r"\bDPT=(\d+)\b", 1, "DPT="),
    ("hash", "", r"\b[0-9a-fA-F]{64}\b", 0, ""),
    ("hash", "", r"\b[0-9a-fA-F]{32}\b", 0, ""),
]
# Indicator type of each entry field, in order.
FIELD_IOCS = [("ipv4", "source_ip"), ("ipv4", "destination_ip"), ("username", "username"), ("hostname", "hostname"),
              ("service", "service"), ("process", "process")]
_TYPE = "array<struct<ioc_type:string,value:string>>"


def _pair(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("ioc_type"), F.regexp_replace(value, r"(?U)^\s+|\s+$", "").alias("value"))


def _text_pairs(text: Column) -> list[Column]:
    """In plain ASCII text the Unicode classes mean the same as the plain ones, which match faster."""
    plain = F.octet_length(text) == F.length(text)

    def found(kind: str, flags: str, pattern: str, group: int, piece: str) -> Column:
        def by(more: str) -> Column:
            prefix = f"(?{flags}{more})" if flags + more else ""
            return F.regexp_extract_all(text, F.lit(prefix + pattern), F.lit(group))
        values = F.when(~F.contains(text, F.lit(piece)), F.array().cast("array<string>")).when(plain, by("")).otherwise(by("U"))
        return F.transform(values, lambda v: _pair(kind, v))
    return [found(*x) for x in TEXT_IOCS]


def _distinct(parts: list[Column]) -> Column:
    return F.array_distinct(F.filter(F.concat(*parts), lambda x: F.coalesce(x["value"], F.lit("")) != ""))


def entry_iocs() -> Column:
    """Distinct indicators of an entry: its fields first, then its text."""
    text = F.when(F.col("raw_log") != "", F.col("raw_log")).otherwise(F.col("message"))
    fields = F.array(*[_pair(k, F.col(f)) for k, f in FIELD_IOCS])
    return _distinct([fields.cast(_TYPE), *_text_pairs(text)])


def text_iocs(text: Column) -> Column:
    """Distinct indicators of a whole text."""
    return _distinct(_text_pairs(text))
