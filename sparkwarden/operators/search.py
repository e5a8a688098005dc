"""Filters, paging and detail views over the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.functions.scoring import severity_rank
from sparkwarden.functions.texts import affected_services, duration_label, narrative_line
from sparkwarden.operators.ordered import Running, first_rows, with_totals

c = F.col


def _has(text: Column, part: str) -> Column:
    return F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(part.lower()))


def search_entries(entries: DataFrame, search=None, severity=None, event_type=None, source_ip=None, username=None,
                   service=None) -> DataFrame:
    """Entries that fit every given condition. Equalities reach the table's scan."""
    d = entries
    if search:
        hit = F.lit(False)
        for f in ("message", "source_ip", "username", "service", "raw_log"):
            hit = hit | _has(c(f), search)
        d = d.where(hit)
    if severity:
        d = d.where(c("severity") == severity.upper())
    if event_type:
        d = d.where(c("event_type") == event_type)
    if source_ip:
        d = d.where(c("source_ip") == source_ip)
    if username:
        d = d.where(_has(c("username"), username))
    if service:
        d = d.where(_has(c("service"), service))
    return d


def page(found: DataFrame, limit: int = 200, offset: int = 0) -> DataFrame:
    """Newest first; ties by arrival. The limit (1 to 1000) keeps a page small, so only tops of partitions are gathered."""
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit must be 1 to 1000 and offset not negative")
    return found.orderBy(c("timestamp").desc(), "seq").offset(offset).limit(limit)


def filter_alerts(alerts: DataFrame, status: str | None = None, limit: int = 500) -> DataFrame:
    d = alerts.where(c("status") == status.upper()) if status else alerts
    return d.orderBy(c("timestamp").desc(), "seq", "rule_ord").limit(limit)


def active_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.where(c("status") == "ACTIVE")


def active_incidents(incidents: DataFrame) -> DataFrame:
    return incidents.where(c("status").isin("ACTIVE", "INVESTIGATING"))


def latest_n(table: DataFrame, n: int) -> DataFrame:
    return table.orderBy(c("seq").desc()).limit(n)


def entry_detail(entries: DataFrame, alerts: DataFrame, rules: DataFrame, seqs: DataFrame) -> DataFrame:
    """One row per asked entry (seqs) and triggered rule; entries without alerts have nulls there."""
    entry = entries.join(seqs.select("seq").distinct(), "seq", "left_semi")
    alert = alerts.select("seq", "alert_id", "rule_id", "rule_ord", "event_count", c("description").alias("alert_description"))
    rule = rules.select("rule_id", c("name").alias("rule_name"), "recommendation")
    return entry.join(alert, "seq", "left").join(rule, "rule_id", "left")


def sort_incidents(incidents: DataFrame) -> DataFrame:
    """List order: lowest severity first, then newest."""
    return incidents.orderBy(severity_rank(c("severity")).asc(), c("last_seen").desc(), "admitted_pos")


def timeline_preview(timeline: DataFrame, n: int) -> DataFrame:
    """The first n timeline rows per incident."""
    return first_rows(timeline, ["incident_key"], ["t", "seq", "sub"], n)


def incident_list_view(incidents: DataFrame, timeline: DataFrame, n: int = 5) -> DataFrame:
    shown = (timeline_preview(timeline, n).groupBy("incident_key")
             .agg(F.sort_array(F.collect_list(F.struct("rn", "timestamp", "event_type", "description", "severity"))).alias("timeline")))
    return incidents.join(shown, "incident_key", "left")


def attack_narrative(incidents: DataFrame, timeline: DataFrame, n: int = 15) -> DataFrame:
    """(incident_key, attack_narrative): the first n timeline rows and the number of the others."""
    lines = (timeline_preview(timeline, n).select("incident_key", "rn", narrative_line().alias("line"))
             .groupBy("incident_key").agg(F.sort_array(F.collect_list(F.struct("rn", "line"))).alias("l")))
    sizes = timeline.groupBy("incident_key").agg(F.count("*").alias("n"))
    d = incidents.select("incident_key", "incident_type").join(lines, "incident_key").join(sizes, "incident_key")
    head = F.concat(F.lit("Attack narrative for "), "incident_type", F.lit(":"))
    rest = F.when(c("n") > n, F.concat(F.lit("  ... and "), (c("n") - n).cast("string"), F.lit(" additional events.")))
    return d.select("incident_key", F.concat_ws("\n", head, F.transform("l", lambda x: x["line"]), rest).alias("attack_narrative"))


def affected_assets(incidents: DataFrame, sources: DataFrame, description: Column) -> DataFrame:
    """(incident_key, part, at, asset): sources, user, services. Rows, as the sources of an incident have no bound."""
    at = "struct<t:bigint,seq:bigint>"
    ips = sources.select("incident_key", F.lit(1).alias("part"), c("first_pos").alias("at"),
                         F.concat(F.lit("IP: "), "source_ip", F.lit(" (attacker)")).alias("asset"))
    users = incidents.where(c("target_user") != "").select(
        "incident_key", F.lit(2).alias("part"), F.lit(None).cast(at).alias("at"),
        F.concat(F.lit("User: "), "target_user", F.lit(" (target)")).alias("asset"))
    services = incidents.select("incident_key", F.lit(3).alias("part"), F.lit(None).cast(at).alias("at"),
                                F.explode(affected_services(description)).alias("s"))
    services = services.select("incident_key", "part", "at", F.concat(F.lit("Service: "), "s").alias("asset"))
    return ips.unionByName(users).unionByName(services)


def timeline_gaps(timeline: DataFrame) -> DataFrame:
    """Time since the previous timeline row of the incident. Neighbours meet by number, not on one task per incident."""
    d = with_totals(timeline.withColumn("_seq", c("seq") * 2 + c("sub")), ["incident_key"], {"n": Running(F.lit(1))}, seq="_seq")
    before = d.select("incident_key", (c("n") + 1).alias("n"), c("timestamp").alias("before"))
    d = d.join(before, ["incident_key", "n"], "left").drop("_seq")
    return d.withColumn("gap", F.when(c("before").isNotNull(), duration_label(c("before"), c("timestamp"))))


def related_logs(entries: DataFrame, updates: DataFrame, keys: DataFrame) -> DataFrame:
    """Entries of the asked incidents."""
    asked = updates.join(keys.select("incident_key").distinct(), "incident_key", "left_semi").select("incident_key", "seq")
    return asked.join(entries, "seq")


def alerts_without_incident(detected: DataFrame, updates: DataFrame) -> DataFrame:
    return detected.join(updates.select("seq"), "seq", "left_anti")
