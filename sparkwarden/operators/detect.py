"""Entries to alerts."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden import dims
from sparkwarden.config import Config
from sparkwarden.functions.parsing import WHITESPACE_ENDS, folded
from sparkwarden.operators.ordered import SECOND, Running, Sliding, with_totals
from sparkwarden.operators.resets import clearings, last_cleared
from sparkwarden.schema import SLIM_COLUMNS

UNKNOWN = "unknown"
WEB_RULES = ["R006", "R007", "R008"]


def rules_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(dims.RULES, dims.RULE_COLUMNS)


def _words(text: Column, groups: list[list[str]]) -> Column:
    """All words of at least one group are in the text."""
    return reduce(or_, [reduce(and_, [F.contains(text, F.lit(w)) for w in g]) for g in groups])


def _matches(pattern: str, groups: list[list[str]] | None) -> Column:
    by_pattern = F.col("message").rlike("(?iU)" + pattern)
    return _words(F.col("_folded"), groups) & by_pattern if groups else by_pattern


def with_line_rules(entries: DataFrame, line_rules=dims.LINE_RULES) -> DataFrame:
    """Adds what one line alone decides: line_rules (array of rule ids), is_failure, is_login, is_404, t and web_flag.

    The rules are rows (rule_id, pattern, word groups or None); callers may pass their own.
    """
    found = F.concat_ws("\n", *[F.when(_matches(p, words), F.lit(rule)) for rule, p, words in line_rules])
    d = entries.withColumn("_folded", folded(F.col("message"))).select(
        "*", found.alias("_found"), F.contains("_folded", F.lit(dims.FAILED_PASSWORD)).alias("is_failure"),
        F.contains("_folded", F.lit(dims.ACCEPTED_PASSWORD)).alias("is_login"),
        (F.contains("message", F.lit("→")) & F.col("message").rlike("(?U)" + dims.NOT_FOUND)).alias("is_404"),
        F.unix_micros("timestamp").alias("t")).drop("_folded")
    rules = F.when(F.col("_found") == "", F.array().cast("array<string>")).otherwise(F.split("_found", "\n"))
    web = (F.col("event_type") == "Web Server") | _words(F.col("_found"), [[r] for r in WEB_RULES])
    d = d.withColumn("line_rules", rules).withColumn("web_flag", web).drop("_found")
    # Request methods. The path of a request is its second word.
    d = d.withColumn("_words", F.when(F.col("web_flag") | F.col("is_404"), F.split(
        F.regexp_replace("message", WHITESPACE_ENDS, ""), r"(?U)\s+", 3)))
    first, second = F.get("_words", F.lit(0)), F.get("_words", F.lit(1))
    path = F.when(first.isin("GET", "POST", "PUT", "DELETE", "HEAD"), second).otherwise(first)
    return d.withColumn("path", F.when(F.size("_words") >= 2, path).when(F.col("_words").isNotNull(), "")).drop("_words")


def _slim(scanned: DataFrame, *more: str) -> DataFrame:
    return scanned.select(*SLIM_COLUMNS, *more, F.coalesce("source_ip", F.lit(UNKNOWN)).alias("ip"))


def line_hits(scanned: DataFrame) -> DataFrame:
    """One row per entry and rule decided by the line alone. Narrow."""
    return (scanned.where(F.size("line_rules") > 0)
            .select(*SLIM_COLUMNS, F.explode("line_rules").alias("rule_id"), F.lit(1).alias("event_count"),
                    F.lit(None).cast("bigint").alias("fail_no")))


def no_cut(name: str, df: DataFrame) -> DataFrame:
    return df


def auth_hits(scanned: DataFrame, config: Config, cut=no_cut) -> DataFrame:
    """Failed logins within the window, and logins that follow them and clear them.

    Only failures and logins are shuffled, with slim columns. fail_no is the number of the source's last failure.
    cut(name, df) may write df as a stage table, since both steps are read more than once.
    """
    c = F.col
    auth = _slim(scanned.where("is_failure or is_login"), "is_failure", "is_login")
    one = c("is_failure").cast("int")
    auth = with_totals(auth, ["ip"], {
        "fail_no": Running(one),
        "in_window": Sliding(one, config.auth_window_s * SECOND, open=True)})
    auth = cut("auth_scan", auth)
    failures = auth.where("is_failure")
    medium = config.auth_failures_medium

    # Only the first login after a failure can clear.
    logins = (auth.where("is_login and fail_no >= %d" % medium).groupBy("ip", "fail_no")
              .agg(F.min_by(F.struct(*SLIM_COLUMNS), F.struct("t", "seq")).alias("login")))
    numbered = failures.where(c("in_window") >= medium).select("ip", "fail_no", "in_window")
    candidates = cut("auth_candidates", logins.join(numbered, ["ip", "fail_no"]))
    cleared = cut("auth_clearings", clearings(candidates.select("ip", "fail_no"), "ip", "fail_no", medium, cut=cut))

    # A login sees the clearings before it; the largest one below its own number.
    before = c("fail_no") - 1
    r002 = last_cleared(candidates.join(cleared, ["ip", "fail_no"]).withColumn("_no", c("fail_no"))
                        .withColumn("fail_no", before), cleared, "ip", "fail_no", "_last")
    r002 = r002.select("login.*", F.lit("R002").alias("rule_id"),
                       (F.least("in_window", c("_no") - F.coalesce("_last", F.lit(0))) + 1).cast("int").alias("event_count"),
                       c("_no").alias("fail_no"))

    counted = last_cleared(failures.where(c("in_window") >= medium).withColumn("_no", c("fail_no"))
                           .withColumn("fail_no", before), cleared, "ip", "fail_no", "_last")
    counted = counted.withColumn("event_count", F.least("in_window", c("_no") - F.coalesce("_last", F.lit(0))).cast("int"))
    burst = counted.where(c("event_count") >= medium).select(
        *SLIM_COLUMNS, F.when(c("event_count") >= config.auth_failures_high, "R001").otherwise("R014").alias("rule_id"),
        "event_count", c("_no").alias("fail_no"))
    return burst.unionByName(r002)


def not_found_hits(scanned: DataFrame, config: Config) -> DataFrame:
    rows = _slim(scanned.where("is_404"))
    counted = with_totals(rows, ["ip"], {"n": Sliding(F.lit(1), config.not_found_window_s * SECOND, open=True)})
    return counted.where(F.col("n") >= config.not_found_min).select(
        *SLIM_COLUMNS, F.lit("R015").alias("rule_id"), F.col("n").cast("int").alias("event_count"),
        F.lit(None).cast("bigint").alias("fail_no"))


def port_scan_hits(scanned: DataFrame, config: Config) -> DataFrame:
    """Distinct destination ports per source in (t - window, t].

    A port counts from its first probe until window after its last; probes closer than window form one such span. The
    number of open spans is a running sum of span starts and ends.
    """
    c = F.col
    width = config.port_scan_window_s * SECOND
    probes = (_slim(scanned.withColumn("port", F.regexp_extract("message", r"DPT=(\d+)", 1)), "port")
              .where(c("port") != ""))
    times = probes.groupBy("ip", "port", "t").agg(F.min("seq").alias("seq")).withColumn("back", -c("t"))
    near = Sliding(F.lit(1), width, open=True)
    starts = with_totals(times, ["ip", "port"], {"n": near}).where("n = 1").select("ip", "t", "seq", F.lit(1).alias("d"))
    ends = (with_totals(times, ["ip", "port"], {"n": near}, t="back").where("n = 1")
            .select("ip", (c("t") + width).alias("t"), F.lit(-1).cast("bigint").alias("seq"), F.lit(-1).alias("d")))
    steps = (probes.withColumn("d", F.lit(0)).withColumn("real", F.lit(True))
             .unionByName(starts, allowMissingColumns=True).unionByName(ends, allowMissingColumns=True))
    counted = with_totals(steps, ["ip"], {"n": Running(c("d"))}).where(c("real"))
    return counted.where(c("n") >= config.port_scan_min).select(
        *SLIM_COLUMNS, F.lit("R009").alias("rule_id"), c("n").cast("int").alias("event_count"),
        F.lit(None).cast("bigint").alias("fail_no"))


def _description() -> Column:
    """Texts of counted rules; all others take the rule's own text."""
    c = F.col
    n, ip = c("event_count"), F.coalesce("source_ip", F.lit(UNKNOWN))

    def text(*parts) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return (
        F.when(c("rule_id") == "R001", text("SSH brute force: ", n, " failed login attempts from ", ip, " in 60 seconds."))
        .when(c("rule_id") == "R014", text("Multiple authentication failures: ", n, " from ", ip, "."))
        .when(c("rule_id") == "R002", text("Successful login from ", ip, " after ", n - 1,
                                           " failed attempts. Possible credential compromise."))
        .when(c("rule_id") == "R015", text("Excessive 404 errors: ", n, " from ", ip,
                                           " in 30 seconds. Possible directory enumeration."))
        .otherwise(c("rule_description")))


def detected_entries(scanned: DataFrame, config: Config, cut=no_cut) -> DataFrame:
    """One row per entry with at least one rule hit; hits are in the order of checks (at most one per rule)."""
    hits = line_hits(scanned).unionByName(auth_hits(scanned, config, cut)).unionByName(
        not_found_hits(scanned, config))
    if config.port_scan_rule:
        hits = hits.unionByName(port_scan_hits(scanned, config))
    order = F.create_map(*[F.lit(x) for pair in dims.RULE_ORD.items() for x in pair])
    hit = F.struct(F.coalesce(order[F.col("rule_id")], F.lit(99)).alias("ord"), "rule_id", "event_count", "fail_no")
    return (hits.groupBy("seq")
            .agg(F.first(F.struct(*[c for c in SLIM_COLUMNS if c != "seq"])).alias("e"),
                 F.sort_array(F.collect_list(hit)).alias("hits"))
            .select("seq", "e.*", "hits"))


def has_rule(*rules: str) -> Column:
    return F.exists("hits", lambda h: h["rule_id"].isin(*rules))


def alerts_of(detected: DataFrame, rules: DataFrame) -> DataFrame:
    """One alert per rule hit. Spark broadcasts the rules table while it is small.

    Columns of the alert's entry stay along; entry_severity is the line's own severity.
    """
    hits = (detected.select("*", F.explode("hits").alias("h"))
            .select("*", "h.rule_id", "h.event_count", "h.fail_no").drop("h", "hits"))
    dim = rules.select("rule_id", "rule_ord", F.col("name").alias("rule_name"), F.col("severity").alias("rule_severity"),
                       "mitre", F.col("description").alias("rule_description"))
    d = hits.join(dim, "rule_id")
    return d.select(
        F.concat_ws("-", "event_id", "rule_id").alias("alert_id"), "rule_id", "rule_ord", "rule_name",
        F.col("rule_severity").alias("severity"), "source_ip", "username", _description().alias("description"),
        F.col("event_id").alias("matched_event_id"), "timestamp", F.lit("ACTIVE").alias("status"), "mitre", "event_count",
        "seq", "t", "hostname", "service", "process", "event_type", F.col("severity").alias("entry_severity"),
        "source_file", "web_flag", "fail_no")
