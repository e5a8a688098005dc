"""Evidence of incidents and observations of the other alerting entries.

Both are the same collection over rows (evidence_key, t, seq, entry columns, hits). What has no bound per key
(addresses, users, indicators, event and alert ids) is a table of its own; a record keeps counts and bounded lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.functions.iocs import entry_iocs
from sparkwarden.operators.ordered import Running, first_rows, with_totals

c = F.col
TEXTS = ["message", "raw_log"]
# Kind of a context value and the entry column it comes from.
CONTEXT = [("source_ip", "source_ip"), ("hostname", "hostname"), ("username", "username"), ("process", "process"),
           ("service", "service"), ("port", "port")]


def incident_rows(updates: DataFrame) -> DataFrame:
    return updates.withColumn("evidence_key", c("incident_key"))


def observation_rows(detected: DataFrame, updates: DataFrame) -> DataFrame:
    """Alerting entries that are in no incident, keyed by their first alert's rule and their source."""
    alone = detected.join(updates.select("seq"), "seq", "left_anti")
    key = F.concat_ws(":", F.get("hits", F.lit(0))["rule_id"], F.coalesce("source_ip", F.lit("unknown")))
    return alone.withColumn("evidence_key", key).withColumnRenamed("severity", "entry_severity")


def with_texts(rows: DataFrame, scanned: DataFrame) -> DataFrame:
    """Adds message and raw_log. seq is unique in scanned, so no key is hot."""
    return rows.join(scanned.select("seq", *TEXTS), "seq")


def line_facts(scanned: DataFrame) -> DataFrame:
    """What evidence needs of a line's text, for lines that can alert: seq, port, request, command, tool, iocs.

    One narrow pass; evidence, observations and their indicators join these few small columns, not the text."""
    source = F.when(c("raw_log") != "", c("raw_log")).otherwise(c("message"))
    can_alert = (F.size("line_rules") > 0) | c("is_failure") | c("is_login") | c("is_404") | c("web_flag") | F.contains("message", F.lit("DPT="))
    return scanned.where(can_alert).select(
        "seq", F.regexp_extract(source, r"(?U)DPT=(\d+)", 1).alias("port"), F.substring("message", 1, 80).alias("request"),
        F.regexp_extract(source, r"(?mdU)COMMAND=(.+?)$", 1).alias("command"),
        F.regexp_extract("message", r"(?iU)(sqlmap|nikto|nmap|dirbuster|gobuster|wfuzz|hydra|medusa)", 1).alias("tool"), entry_iocs().alias("iocs"))


def context_values(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Distinct (evidence_key, kind, value) with the position of the first use. Combines before the shuffle."""
    d = rows.join(facts.select("seq", "port"), "seq")
    values = F.array(*[F.struct(F.lit(k).alias("kind"), c(f).alias("value")) for k, f in CONTEXT])
    return (d.select("evidence_key", "t", "seq", F.explode(values).alias("x"))
            .where(c("x.value") != "").groupBy("evidence_key", c("x.kind").alias("kind"), c("x.value").alias("value"))
            .agg(F.min(F.struct("t", "seq")).alias("first_pos")))


def evidence_iocs(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Distinct indicators per key, with the event that showed each first."""
    d = rows.select("evidence_key", "t", "seq", "event_id").join(facts.select("seq", "iocs"), "seq")
    found = d.select("evidence_key", "t", "seq", "event_id", F.posexplode("iocs").alias("i", "x"))
    return (found.groupBy("evidence_key", c("x.ioc_type").alias("ioc_type"), c("x.value").alias("value"))
            .agg(F.min(F.struct("t", "seq", "i", "event_id")).alias("f"))
            .select("evidence_key", "ioc_type", "value", c("f.event_id").alias("source_event_id"),
                    F.struct("f.t", "f.seq", "f.i").alias("first_pos")))


def raw_refs(rows: DataFrame, scanned: DataFrame, n: int) -> DataFrame:
    """The first n lines per key, with the rules they hit."""
    first = first_rows(rows, ["evidence_key"], ["t", "seq"], n)
    return with_texts(first, scanned).select(
        "evidence_key", "rn", "event_id", "raw_log", "timestamp", "hostname", "source_ip",
        F.lit(None).cast("string").alias("destination_ip"), "username", "service", "process", "event_type", "message",
        c("entry_severity").alias("severity"), F.transform("hits", lambda h: h["rule_id"]).alias("detection_rule_ids"))


def related_events(rows: DataFrame) -> DataFrame:
    return rows.select("evidence_key", "seq", "event_id")


def related_alerts(rows: DataFrame) -> DataFrame:
    return (rows.select("evidence_key", "seq", "event_id", F.explode("hits").alias("h"))
            .select("evidence_key", "seq", F.concat_ws("-", "event_id", "h.rule_id").alias("alert_id"),
                    c("h.rule_id").alias("rule_id")))


def _cond(name, matched, value) -> Column:
    def lit(x):
        return x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(name).alias("condition"), lit(matched).alias("matched"), lit(value).alias("value"))


def matched_conditions() -> Column:
    """Conditions of a record's first entry, with its facts, by its first alert. Names and texts are fixed values."""
    hit = F.get("hits", F.lit(0))
    rule, n = hit["rule_id"], hit["event_count"]
    ip, user = F.coalesce("source_ip", F.lit("")), F.coalesce("username", F.lit(""))
    has_ip, has_user = ip != "", user != ""
    request, command, port, tool = c("request"), c("command"), c("port"), c("tool")
    source = _cond("Source IP", has_ip, ip)
    external = _cond("External source", has_ip, ip)
    same_ip = _cond("Same source IP", has_ip, ip)
    attempt = _cond("Login attempt", True, "Failed password")
    generic = F.array_compact(F.array(
        F.when(has_ip, _cond("Source IP", True, ip)), F.when(has_user, _cond("Username", True, user)),
        F.when(c("service") != "", _cond("Service", True, c("service"))), _cond("Pattern match", True, request)))
    return (
        F.when(rule.isin("R001", "R014"), F.array(
            same_ip, _cond("Same username", has_user, user),
            _cond(F.concat(n.cast("string"), F.lit(" failures")), n >= 3, n.cast("string")),
            _cond("Within 60 seconds", True, "60s window"), _cond("Authentication success", False, "No")))
        .when(rule == "R002", F.array(
            _cond("Prior failed logins", True, F.concat((n - 1).cast("string"), F.lit(" failures"))),
            _cond("Successful login", True, "Accepted password"), same_ip, _cond("Within 120 seconds", True, "120s window")))
        .when(rule == "R003", F.array(
            _cond("User does not exist", True, F.when(has_user, user).otherwise("unknown")), attempt, external))
        .when(rule == "R004", F.array(_cond("Target user is root", True, "root"), attempt, external))
        .when(rule == "R005", F.array(
            _cond("Privilege escalation command", True, "sudo/su"), _cond("User identified", has_user, user),
            _cond("Command executed", command != "", F.trim(command))))
        .when(rule == "R006", F.array(
            _cond("SQL keyword detected", True, "UNION/SELECT/OR 1=1"), _cond("Web request", True, request), source))
        .when(rule == "R007", F.array(
            _cond("Path traversal pattern", True, "../ or %2f"), _cond("Target path", True, request), source))
        .when(rule == "R008", F.array(
            _cond("Known attack tool UA", tool != "", tool), _cond("Web request", True, "HTTP request"), source))
        .when(rule == "R010", F.array(
            _cond("Firewall action", True, "BLOCK"), source, _cond("Destination port", port != "", port),
            _cond("Protocol", True, "TCP")))
        .otherwise(generic))


def collection_confidence(events: Column, sources: Column, alerts: Column) -> Column:
    return F.least(F.least(events * 5, F.lit(40)) + F.least(sources * 10, F.lit(20)) + F.least(alerts * 10, F.lit(30)) + 10,
                   F.lit(100)).cast("double")


def _records(rows: DataFrame, facts: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per key: counts, time range, and rule and conditions of the first entry."""
    base = rows.groupBy("evidence_key").agg(
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.count("*").alias("event_count"),
        F.sum(F.size("hits")).alias("alert_count"),
        # The first source and user that any entry names, not those of the first entry.
        F.min_by("source_ip", F.when(c("source_ip") != "", F.struct("t", "seq"))).alias("first_ip"),
        F.min_by("username", F.when(c("username") != "", F.struct("t", "seq"))).alias("first_user"))
    sources = (rows.where(c("source_ip") != "").select("evidence_key", "source_ip").distinct()
               .groupBy("evidence_key").agg(F.count("*").alias("unique_source_count")))
    first = first_rows(rows, ["evidence_key"], ["t", "seq"], 1).join(facts.select("seq", "request", "command", "port", "tool"), "seq").select(
        "evidence_key", F.get("hits", F.lit(0))["rule_id"].alias("rule_id"), matched_conditions().alias("matched_conditions"))
    names = rules.select("rule_id", c("name").alias("rule_name"), c("severity").alias("rule_severity"))
    d = base.join(sources, "evidence_key", "left").join(first, "evidence_key").join(names, "rule_id", "left")
    d = d.withColumn("unique_source_count", F.coalesce("unique_source_count", F.lit(0)))
    return (d.withColumn("rule_id", F.coalesce("rule_id", F.lit(""))).withColumn("rule_name", F.coalesce("rule_name", F.lit("")))
            .withColumn("collection_confidence",
                        collection_confidence(c("event_count"), c("unique_source_count"), c("alert_count"))))


def evidence(updates: DataFrame, facts: DataFrame, incidents: DataFrame, rules: DataFrame) -> DataFrame:
    d = _records(incident_rows(updates), facts, rules)
    own = incidents.select(c("incident_key").alias("evidence_key"), "severity")
    return d.join(own, "evidence_key").select(
        F.concat(F.lit("EV-"), "evidence_key").alias("evidence_id"), c("evidence_key").alias("incident_key"), "rule_id",
        "rule_name", "severity", "matched_conditions", "first_seen", "last_seen", "event_count", "alert_count",
        "unique_source_count", F.lit(0).alias("unique_dest_count"), "collection_confidence", "first_ip", "first_user")


def observations(detected: DataFrame, updates: DataFrame, facts: DataFrame, rules: DataFrame) -> DataFrame:
    """All observations, before promotion."""
    d = _records(observation_rows(detected, updates), facts, rules)
    return d.select(
        F.concat(F.lit("OBS-"), "evidence_key").alias("observation_id"), "evidence_key", F.lit("OPEN").alias("status"),
        "rule_id", "rule_name", c("rule_severity").alias("severity"), "matched_conditions", "first_seen", "last_seen",
        "event_count", "alert_count", "unique_source_count", "collection_confidence", F.lit(False).alias("promoted"),
        F.lit(None).cast("string").alias("promoted_to_incident_id"), "first_ip", "first_user")


def promote(observations: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """Promote by event or alert count at the end of a batch, and those of manual(observation_id, incident_id)."""
    grown = (c("status") == "OPEN") & ((c("event_count") >= 3) | (c("alert_count") >= 2))
    d = (observations.withColumn("promoted", c("promoted") | grown)
         .withColumn("status", F.when(grown, "PROMOTED").otherwise(c("status"))))
    if manual is None:
        return d
    by_hand = manual.groupBy("observation_id").agg(F.max("incident_id").alias("_incident"))
    d = d.join(by_hand, "observation_id", "left")
    given = c("_incident").isNotNull()
    return (d.withColumn("status", F.when(given, "PROMOTED").otherwise(c("status"))).withColumn("promoted", c("promoted") | given)
            .withColumn("promoted_to_incident_id", F.coalesce("_incident", "promoted_to_incident_id")).drop("_incident"))


def search_evidence(evidence: DataFrame, context: DataFrame, iocs: DataFrame, rule_id=None, severity=None, source_ip=None,
                    username=None, service=None, ioc=None, keyword=None) -> DataFrame:
    """Evidence that fits every given condition. Memberships are semi-joins with the value tables."""
    d = evidence
    if rule_id:
        d = d.where(c("rule_id") == rule_id)
    if severity:
        d = d.where(c("severity") == severity.upper())

    def having(d: DataFrame, matches: DataFrame) -> DataFrame:
        return d.join(matches.select(c("evidence_key").alias("incident_key")), "incident_key", "left_semi")
    for kind, value in (("source_ip", source_ip), ("username", username), ("service", service)):
        if value:
            d = having(d, context.where((c("kind") == kind) & (c("value") == value)))
    if ioc:
        d = having(d, iocs.where(c("value") == ioc))
    if keyword:
        d = _with_keyword(d, context, keyword)
    return d


def _with_keyword(d: DataFrame, context: DataFrame, keyword: str) -> DataFrame:
    """Keyword in the text "rule name, sources, users" joined by spaces.

    A keyword without a space can only lie inside one of the parts. With a space it may span parts, so neighbours are
    joined by their number.
    """
    word = keyword.lower()
    parts = context.where(c("kind").isin("source_ip", "username"))
    if " " not in word:
        hit = parts.where(F.contains(F.lower("value"), F.lit(word))).select(c("evidence_key").alias("incident_key")).distinct()
        hit = hit.withColumn("_hit", F.lit(True))
        d = d.join(hit, "incident_key", "left")
        return d.where(F.contains(F.lower("rule_name"), F.lit(word)) | c("_hit")).drop("_hit")
    # Number the parts of each text: rule name 0, then sources, then users, each by first use.
    kind = F.when(c("kind") == "source_ip", 1).otherwise(2)
    ranked = with_totals(parts.select("evidence_key", kind.alias("g"), "first_pos.t", "first_pos.seq", "value"),
                         ["evidence_key", "g"], {"n": Running(F.lit(1))})
    sources = ranked.where("g = 1").groupBy("evidence_key").agg(F.count("*").alias("sources"))
    ranked = ranked.join(sources, "evidence_key", "left").select(
        "evidence_key", "value", (c("n") + F.when(c("g") == 2, F.coalesce("sources", F.lit(0))).otherwise(0)).alias("n"))
    listed = ranked.unionByName(d.select(c("incident_key").alias("evidence_key"), c("rule_name").alias("value"),
                                         F.lit(0).cast("bigint").alias("n")))
    # The keyword spans at most as many parts as it has words.
    joined = listed
    for i in range(1, len(word.split(" "))):
        following = listed.select("evidence_key", (c("n") - i).alias("n"), c("value").alias(f"v{i}"))
        joined = joined.join(following, ["evidence_key", "n"], "left")
        joined = joined.withColumn("value", F.concat_ws(" ", "value", f"v{i}")).drop(f"v{i}")
    hit = (joined.where(F.contains(F.lower("value"), F.lit(word)))
           .select(c("evidence_key").alias("incident_key")))
    return d.join(hit, "incident_key", "left_semi")
