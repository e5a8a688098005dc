"""Raw lines to entries: one narrow pass, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.config import Config
from sparkwarden.functions import parsing as P
from sparkwarden.schema import ENTRY_COLUMNS


def split_fields(lines: DataFrame, fmt: str | None = None) -> DataFrame:
    """Adds log_format and the array f with the fields of the first matching format.

    With fmt, only that format is tried. The format named syslog has the same pattern as auth.
    """
    def miss(col: str) -> Column:
        return ~P.has_fields(F.col(col))

    value = F.col("value")
    d = lines.withColumn("value", P.trimmed(value)).where(value != "")
    nothing = F.lit("")
    # Separate projections, so that each replacement runs once per line and only where the earlier ones failed.
    d = d.withColumn("_m1", P.match_bsd(value) if fmt in (None, "auth", "syslog") else nothing)
    if fmt in (None, "apache_access"):
        d = d.withColumn("_m2", F.when(miss("_m1"), P.match_access(value)).otherwise(F.col("_m1")))
    else:
        d = d.withColumn("_m2", F.col("_m1"))
    if fmt in (None, "apache_error"):
        d = d.withColumn("_m3", F.when(miss("_m2"), P.match_error(value)).otherwise(F.col("_m2")))
    else:
        d = d.withColumn("_m3", F.col("_m2"))
    d = d.withColumn("f", F.when(P.has_fields(F.col("_m3")), F.split(F.col("_m3"), "\n", -1)))
    name = F.get("f", F.lit(0))
    if fmt == "syslog":
        name = F.when(name.isNotNull(), F.lit("syslog"))
    return d.withColumn("log_format", F.coalesce(name, F.lit("unknown"))).drop("_m1", "_m2", "_m3")


def detect_format(lines: DataFrame) -> DataFrame:
    return split_fields(lines).select("seq", "value", "log_format")


def parse_lines(lines: DataFrame, config: Config, fmt: str | None = None) -> DataFrame:
    """lines(seq, value, source_file, modified) to entries."""
    d = split_fields(lines, fmt)

    def f(i: int) -> Column:
        return F.get("f", F.lit(i))

    kind = F.col("log_format")
    bsd, access, error = kind.isin("auth", "syslog"), kind == "apache_access", kind == "apache_error"
    web = access | error

    def pick(on_bsd, on_access, on_error, otherwise) -> Column:
        return (F.when(bsd, on_bsd).when(access, on_access).when(error, on_error).otherwise(otherwise))

    raw = F.col("value")
    agent = F.coalesce(f(7), F.lit(""))
    request = F.concat(f(4), F.lit(" "), f(5), F.lit(" → "), f(6).try_cast("int").cast("string"))
    shown = F.when(agent != "", F.concat(request, F.lit(" ["), F.substring(agent, 1, 60), F.lit("]"))).otherwise(request)
    client = P.empty_to_null(F.get(F.split(f(3), ":"), F.lit(0)))
    fallback_ts = F.lit(config.fallback_ts).cast("timestamp") if config.fallback_ts else F.col("modified")
    message = pick(f(5), shown, f(4), F.substring(raw, 1, 500))
    time = F.coalesce(pick(P.bsd_time(f(1), config.year), P.access_time(f(3)), P.error_time(f(1)), F.lit(None)), fallback_ts)

    # Fields used by other fields first, in a projection of their own.
    d = d.select(
        "seq", "source_file", "log_format", "f", raw.alias("raw_log"), time.alias("timestamp"), message.alias("message"),
        pick(f(3), F.lit("apache"), F.lit("apache"), F.lit("")).alias("service"),
    )
    text = F.col("message")
    # Parts that several columns test, computed once per line.
    d = d.select(
        "*", F.lower(text).alias("_message"), F.lower("service").alias("_service"), F.lower(F.when(access, f(5))).alias("_path"),
        F.lower(F.when(access, agent)).alias("_agent"), F.when(bsd, P.named_user(text)).alias("_named"),
        F.when(~web, P.first_ip(F.when(bsd, text).otherwise(F.col("raw_log")))).alias("_ip"))
    message, service = F.col("_message"), F.col("_service")
    return d.select(
        "*",
        F.md5(F.concat_ws("#", F.col("source_file"), F.col("seq").cast("string"))).alias("event_id"),
        F.when(bsd, f(2)).when(web, "webserver").otherwise("").alias("hostname"),
        pick(F.col("_ip"), f(1), client, F.col("_ip")).alias("source_ip"),
        F.lit(None).cast("string").alias("destination_ip"),
        F.when(bsd, P.username_of(text, F.col("_named"))).when(access & (f(2) != "-"), f(2)).alias("username"),
        F.when(bsd, f(4)).when(web, "httpd").otherwise("").alias("process"),
        F.when(bsd, P.event_type_of(service, message)).when(web, "Web Server").otherwise("Unknown").alias("event_type"),
        pick(P.message_severity(message), P.request_severity(f(6).try_cast("int"), F.col("_path"), F.col("_agent")),
             P.level_severity(f(2)), F.lit("INFO")).alias("severity"),
    ).select(*ENTRY_COLUMNS)
