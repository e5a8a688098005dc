"""Dashboard panels. Each is a lazy aggregate over the tables; partial aggregation runs before every shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.operators.ordered import SECOND, Running, Sliding, with_totals

c = F.col
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"]


def entry_totals(entries: DataFrame) -> DataFrame:
    s = c("severity")
    return entries.agg(
        F.count("*").alias("total_logs"), F.count_if(s == "INFO").alias("info_events"),
        F.count_if(s.isin("MEDIUM", "LOW")).alias("warning_events"), F.count_if(s == "HIGH").alias("high_events"),
        F.count_if(s == "CRITICAL").alias("critical_events"))


def dashboard_stats(entries: DataFrame, alerts: DataFrame, listed: DataFrame, every: DataFrame) -> DataFrame:
    """One row. listed holds the incidents shown in lists, every also those filtered out. Four one-row sides meet."""
    a = alerts.agg(F.count("*").alias("total_alerts"), F.count_if(c("status") == "ACTIVE").alias("active_alerts"))
    i = listed.agg(F.count("*").alias("total_incidents"))
    o = every.agg(F.count_if(c("status").isin("ACTIVE", "INVESTIGATING")).alias("active_incidents"))
    one = F.lit(1).alias("one")
    d = entry_totals(entries).select("*", one)
    for side in (a, i, o):
        d = d.join(F.broadcast(side.select("*", one)), "one")
    return d.drop("one")


def top_values(rows: DataFrame, column: str, name: str, order: list[str], n: int = 10) -> DataFrame:
    """Most frequent values; ties by first appearance."""
    return (rows.where(c(column) != "").groupBy(c(column).alias(name))
            .agg(F.count("*").alias("count"), F.min(F.struct(*order)).alias("_first"))
            .orderBy(c("count").desc(), "_first").limit(n).drop("_first"))


def severity_distribution(spark: SparkSession, entries: DataFrame) -> DataFrame:
    order = spark.createDataFrame([(s, i) for i, s in enumerate(SEVERITIES)], "severity string, ord int")
    counted = entries.groupBy("severity").agg(F.count("*").alias("count"))
    return F.broadcast(order).join(counted, "severity", "left").select(
        "severity", "ord", F.coalesce("count", F.lit(0)).alias("count")).orderBy("ord")


def per_minute_of_day(rows: DataFrame) -> DataFrame:
    """Counts by HH:mm; days fall together."""
    return rows.groupBy(F.date_format("timestamp", "HH:mm").alias("time")).agg(F.count("*").alias("count")).orderBy("time")


def per_minute(rows: DataFrame) -> DataFrame:
    return (rows.groupBy(F.window("timestamp", "1 minute").alias("w")).agg(F.count("*").alias("count"))
            .select(c("w.start").alias("minute"), "count"))


def rule_frequency(alerts: DataFrame, rules: DataFrame, n: int = 10) -> DataFrame:
    top = top_values(alerts, "rule_id", "rule_id", ["t", "seq", "rule_ord"], n)
    return top.join(rules.select("rule_id", c("name").alias("rule_name")), "rule_id").select(
        "rule_id", "rule_name", "count")


def threat_summary(incidents: DataFrame, sources: DataFrame, alerts: DataFrame) -> DataFrame:
    one = F.lit(1).alias("one")
    i = incidents.agg(
        F.count_if(c("status") == "ACTIVE").alias("active_threats"), F.count_if(c("severity") == "CRITICAL").alias("critical_incidents"),
        F.count("*").alias("investigations"), F.count("*").alias("evidence_items")).select("*", one)
    # The panel shows the number of alerts under extracted indicators, and that of incidents under evidence.
    a = alerts.agg(F.count("*").alias("extracted_iocs"), F.count_if(c("status") == "ACTIVE").alias("open_alerts"),
                   F.count_if(c("status") == "RESOLVED").alias("resolved_alerts")).select("*", one)
    ips = sources.join(incidents.select("incident_key"), "incident_key", "left_semi").select("source_ip").distinct().agg(
        F.count("*").alias("suspicious_ips")).select("*", one)
    users = incidents.where(c("target_user") != "").select("target_user").distinct().agg(
        F.count("*").alias("tracked_users")).select("*", one)
    mitre = incidents.select(F.explode("mitre_techniques").alias("m")).distinct().agg(
        F.count("*").alias("mitre_techniques")).select("*", one)
    d = i
    for side in (a, ips, users, mitre):
        d = d.join(F.broadcast(side), "one")
    return d.drop("one")


def live(incidents: DataFrame) -> DataFrame:
    return incidents.where(~c("is_merged")) if "is_merged" in incidents.columns else incidents


def most_dangerous(incidents: DataFrame) -> DataFrame:
    """Highest threat score; the first listed one among equals."""
    return (live(incidents).orderBy(c("threat_score").desc(), "admitted_pos").limit(1)
            .select("incident_key", "incident_type", "threat_score", "severity", "confidence"))


def most_active_attacker(incidents: DataFrame, sources: DataFrame) -> DataFrame:
    d = live(incidents).select("incident_key", "total_events", "admitted_pos").join(sources, "incident_key")
    return (d.groupBy("source_ip").agg(F.sum("total_events").alias("event_count"), F.min("admitted_pos").alias("p"))
            .orderBy(c("event_count").desc(), "p").limit(1).drop("p"))


def most_targeted_user(incidents: DataFrame) -> DataFrame:
    return (live(incidents).where(c("target_user") != "").groupBy(c("target_user").alias("user"))
            .agg(F.sum("total_events").alias("event_count"), F.min("admitted_pos").alias("p"))
            .orderBy(c("event_count").desc(), "p").limit(1).drop("p"))


def service_of_rule() -> Column:
    """Service a rule points at."""
    r = c("rule_id")
    return (F.when(r.isin("R001", "R002", "R003", "R004", "R014"), "sshd").when(r.isin("R006", "R007", "R008", "R015"), "web")
            .when(r == "R005", "sudo").when(r == "R010", "firewall"))


def most_targeted_service(alerts: DataFrame) -> DataFrame:
    return top_values(alerts.withColumn("svc", service_of_rule()), "svc", "service", ["t", "seq", "rule_ord"], 1).select(
        "service", c("count").alias("event_count"))


def soc_queue(ranked: DataFrame, n: int = 10) -> DataFrame:
    return ranked.orderBy("priority").limit(n).select(
        "incident_key", "incident_type", "severity", "threat_score", "priority", "confidence")


def merged_count(incidents: DataFrame) -> DataFrame:
    return incidents.agg(F.count_if(~c("is_merged")).alias("total_incidents"), F.count_if("is_merged").alias("merged_incidents"))


def latest_critical(incidents: DataFrame) -> DataFrame:
    """The critical active incident that was updated last."""
    return (incidents.where((c("severity") == "CRITICAL") & (c("status") == "ACTIVE"))
            .orderBy(F.struct("last_pos", "ord").desc()).limit(1)
            .select("incident_key", "incident_type", "threat_score", "total_events"))


def recent_incidents(incidents: DataFrame, n: int = 8) -> DataFrame:
    return incidents.where(c("status") == "ACTIVE").orderBy("admitted_pos").limit(n)


def ioc_panel(iocs: DataFrame, key: str, n: int = 25) -> DataFrame:
    """Indicators of one evidence record by count. Records hold distinct indicators, so order is by first appearance."""
    return (iocs.where(c("evidence_key") == key).groupBy("ioc_type", "value")
            .agg(F.count("*").alias("occurrences"), F.min("first_pos").alias("p"))
            .orderBy(c("occurrences").desc(), "p").limit(n).drop("p"))


def investigation_queue(evidence: DataFrame, observations: DataFrame, n: int = 8) -> DataFrame:
    """Evidence and open observations as one list, most events first."""
    def items(d: DataFrame, kind: str, ident: str) -> DataFrame:
        clock = F.concat_ws(" - ", F.date_format("first_seen", "HH:mm:ss"), F.date_format("last_seen", "HH:mm:ss"))
        return d.select(
            c(ident).alias("id"), F.lit(kind).alias("type"), "rule_name", "severity", F.coalesce("first_ip", F.lit("-")).alias("source_ip"),
            F.coalesce("first_user", F.lit("-")).alias("username"), "event_count",
            F.size(F.filter("matched_conditions", lambda x: x["matched"])).alias("conditions_met"),
            F.size("matched_conditions").alias("conditions_total"), clock.alias("time_window"),
            c("collection_confidence").alias("confidence"))
    return (items(evidence, "evidence", "evidence_id")
            .unionByName(items(observations.where(c("status") == "OPEN"), "observation", "observation_id"))
            .orderBy(c("event_count").desc(), "type", "id").limit(n))


def session_stats(entries: DataFrame, alerts: DataFrame, updates: DataFrame, incidents: DataFrame) -> DataFrame:
    """Per ingested file: entries, alerts, incidents admitted while it was read (by the file of the admitting line)."""
    e = entries.groupBy("source_file").agg(F.count("*").alias("events"))
    a = alerts.groupBy("source_file").agg(F.count("*").alias("alerts"))
    admitting = updates.select("incident_key", F.struct("t", "seq", "ord").alias("admitted_pos"), "source_file")
    i = (incidents.select("incident_key", "admitted_pos").join(admitting, ["incident_key", "admitted_pos"])
         .groupBy("source_file").agg(F.count("*").alias("incidents")))
    return e.join(a, "source_file", "left").join(i, "source_file", "left").na.fill(0, ["alerts", "incidents"])


def session_history(monitoring: DataFrame, uploads: DataFrame, others: tuple[DataFrame, ...] = (), newest_uploads: int = 50) -> DataFrame:
    """Sessions of all kinds in one list; columns a kind does not have are null. Only of uploads just the newest are kept."""
    d = monitoring.unionByName(uploads.orderBy(c("start_time").desc(), "session_id").limit(newest_uploads), allowMissingColumns=True)
    for more in others:
        d = d.unionByName(more, allowMissingColumns=True)
    return d


def pipeline_health(entries: DataFrame, alerts: DataFrame, incidents: DataFrame, monitoring: bool = False) -> DataFrame:
    """One row per stage: rows out and whether it is active. monitoring says whether a monitor runs.

    An investigation is active while there are incidents that are not merged; its rows out are those under investigation,
    and total has all of them.
    """
    def stage(ord_: int, name: str, d: DataFrame, processed: Column | None = None) -> DataFrame:
        n = F.count(F.lit(1))
        return d.agg(n.alias("n"), n.alias("processed") if processed is None else processed.alias("processed")).select(
            F.lit(ord_).alias("ord"), F.lit(name).alias("stage"),
            F.when((c("n") > 0) & F.lit(ord_ > 0 or monitoring), "active").otherwise("idle").alias("status"), "processed",
            F.when(F.lit(processed is not None), c("n")).alias("total"))
    shown = live(incidents)
    every = stage(0, "monitoring", entries)
    for row in (stage(1, "parser", entries), stage(2, "detection", alerts), stage(3, "correlation", incidents), stage(4, "analysis", shown),
                stage(5, "investigation", shown, F.count_if(c("status") == "INVESTIGATING"))):
        every = every.unionByName(row)
    return every.orderBy("ord")


def notifications(alerts: DataFrame, updates: DataFrame, admitted: DataFrame, promoted: DataFrame | None = None) -> DataFrame:
    """Notices sent for alerts, incident updates and promotions: (ts, type, category, title). Others are not announced.

    An incident is announced from the update that lets it into the lists on (admitted: incident_key, admitted_pos), so one
    that the false-positive filter keeps out never is. promoted has the time of each promotion, as ts.
    """
    a = alerts.where(c("severity").isin("CRITICAL", "HIGH")).select(
        c("timestamp").alias("ts"), F.when(c("severity") == "CRITICAL", "critical").otherwise("warning").alias("type"),
        F.lit("detection").alias("category"), F.concat(c("severity"), F.lit(" Alert: "), c("rule_name")).alias("title"))
    kind = F.when(c("severity") == "CRITICAL", "critical").when(c("severity") == "HIGH", "warning").otherwise("info")
    name = F.when(c("severity") == "CRITICAL", "Critical Incident: ").otherwise("Incident: ")
    told = (updates.join(admitted.select("incident_key", "admitted_pos"), "incident_key")
            .where(F.struct("t", "seq", "ord") >= c("admitted_pos")))
    u = told.select(c("timestamp").alias("ts"), kind.alias("type"), F.lit("incidents").alias("category"),
                    F.concat(name, "incident_type").alias("title"))
    e = told.select(c("timestamp").alias("ts"), F.lit("info").alias("type"), F.lit("evidence").alias("category"),
                    F.lit("Evidence Collected").alias("title"))
    out = a.unionByName(u).unionByName(e)
    if promoted is None:
        return out
    return out.unionByName(promoted.select("ts", F.lit("success").alias("type"), F.lit("detection").alias("category"),
                                           F.lit("Observation Promoted").alias("title")))


def notification_rollup(notices: DataFrame, gap_s: int = 3) -> DataFrame:
    """Equal notices less than gap_s apart become one with a count.

    A title may hold most rows, so a session is found by running totals, not by sorting a title on one task. Equal times
    are combined first.
    """
    key = ["type", "category", "title"]
    per_time = notices.groupBy(*key, "ts").agg(F.count("*").alias("n")).withColumn("t", F.unix_micros("ts"))
    near = with_totals(per_time.withColumn("seq", F.lit(0).cast("bigint")), key,
                       {"near": Sliding(F.lit(1), gap_s * SECOND, open=True)})
    starts = near.withColumn("start", (c("near") == 1).cast("int"))
    numbered = with_totals(starts, key, {"session": Running(c("start"))})
    return (numbered.groupBy(*key, "session")
            .agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.sum("n").alias("count")).drop("session"))


def notification_center(rolled: DataFrame, newest: int = 200) -> DataFrame:
    """The newest notices, summed by category and title."""
    kept = rolled.orderBy(c("first").desc(), "type", "category", "title").limit(newest)
    return kept.groupBy("category", "title").agg(F.sum("count").alias("count"), F.count("*").alias("groups"))
