"""One named query per operator. Every query reads the log lines derived from the whole events table, or whole texts.

The stage tables of an Engine are built on first use and shared by the queries of the same session and folder, as they
would be in a deployment. Results are flattened: times and lists as text, counts as bigint.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contract.rule_names import RULE_QUERIES
from sparkwarden.config import Config
from sparkwarden.functions import parsing as P
from sparkwarden.operators import actions as A
from sparkwarden.operators import behaviour as B
from sparkwarden.operators import chains as CH
from sparkwarden.operators import correlate as C
from sparkwarden.operators import detect as D
from sparkwarden.operators import evidence as E
from sparkwarden.operators import graph as G
from sparkwarden.operators import iocs as I
from sparkwarden.operators import merge as M
from sparkwarden.operators import parse
from sparkwarden.operators import search as Q
from sparkwarden.operators import stats as S
from sparkwarden.plans.engine import Engine
from sparkwarden.plans.store import listed
from sparkwarden.sources import follow as W
from sparkwarden.sources import lines as L
from sparkwarden.sources import sinks as K
from sparkwarden.streaming import batch_end as BE
from sparkwarden.streaming import jobs as J

c = F.col
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
_ENGINES: dict[tuple[str, str], tuple[str, Engine]] = {}
_LOCK = threading.Lock()


def engine(spark: SparkSession, sf_dir: str) -> Engine:
    """The folder's engine; a new one if its events table has changed or a stage table is gone."""
    key, events = (spark.sparkContext.applicationId, sf_dir), listed(spark, f"{sf_dir}/events.parquet")
    with _LOCK:
        was, e = _ENGINES.get(key, (None, None))
        if e is None or was != events or not e.store.whole():
            _ENGINES[key] = events, Engine(spark, L.event_lines(spark, sf_dir), Config(year=2024))
        return _ENGINES[key][1]


def flat(d: DataFrame) -> DataFrame:
    """Times and lists as text, integers as bigint, so that results compare across engines."""
    out = []
    for f in d.schema.fields:
        x = c(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            x = F.date_format(x, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            x = x.cast("bigint")
        elif isinstance(f.dataType, T.ArrayType):
            x = F.array_join(x, "|")
        out.append(x.alias(f.name))
    return d.select(*out)


def query(name: str):
    """Registers f(engine) -> DataFrame."""
    def add(f: Callable[[Engine], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: flat(f(engine(spark, sf_dir)))
        return f
    return add


def raw_query(name: str):
    """Registers f(spark, sf_dir, engine) -> DataFrame."""
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: flat(f(spark, sf_dir, engine(spark, sf_dir)))
        return f
    return add


# Sources and sinks.

@raw_query("scan_lines")
def _(spark, sf_dir, e):
    """Writes the derived lines as text files and reads them back."""
    path = f"{e.store.folder}/text_lines"
    e.lines.select("value").write.mode("overwrite").text(path)
    return L.read_lines(spark, path, glob="part-*").select("value")


@query("ingest_batch")
def _(e):
    return S.session_stats(e.entries, e.alerts, e.updates, e.incidents)


@query("export_csv")
def _(e):
    """Columns of the CSV export; writing them is one call more."""
    return K.csv_rows(e.entries)


REPORT_ALERT = ["alert_id", "rule_id", "rule_name", "severity", "source_ip", "username", "description", "matched_event_id", "timestamp", "status",
                "mitre", "event_count"]
REPORT_INCIDENT = ["incident_key", "incident_type", "severity", "status", "target_user", "first_seen", "last_seen", "total_events", "alert_count", "ip_count",
                   "triggered_rules", "mitre_techniques", "correlation_explanation", "confidence", "risk", "threat_score"]


@query("export_json")
def _(e):
    """The whole report, as the texts of its objects."""
    alerts = e.alerts.select(*REPORT_ALERT, "seq", "rule_ord")
    parts = K.report_parts(S.dashboard_stats(e.entries, e.alerts, e.incidents, e.every_after_merge), e.entries, e.all_incidents.select(*REPORT_INCIDENT), alerts)
    return K.report_rows(parts | {"alerts": parts["alerts"].drop("seq", "rule_ord")})


#: Names of files that hold the lines, by seq modulo their number.
FILES = ["auth.log", "syslog", "messages", "app.log", "notes", "old.txt", "kern.log.1", "data"]


def _named_files(e: Engine) -> str:
    folder = f"{e.store.folder}/named-files"
    if "_named_files" not in e.__dict__:
        name = F.get(F.array(*[F.lit(x) for x in FILES]), F.pmod("seq", F.lit(len(FILES))).cast("int"))
        K.named_texts(e.lines.select(name.alias("file"), "seq", "value"), folder)
        e.__dict__["_named_files"] = e.store.keep(folder)
    return folder


@query("discover_files")
def _(e):
    return L.discover_files(e.spark, _named_files(e)).select("name", "size_bytes")


@query("list_log_files")
def _(e):
    return L.list_log_files(e.spark, [_named_files(e)]).select("name", "size_bytes")


@query("latest_updates")
def _(e):
    return K.latest_update(e.updates).select("incident_key", "event_id", "n")


@query("newest_entries")
def _(e):
    return K.newest_entries(e.entries).select("seq", "event_id")


# Steps at the end of each micro-batch; the lines arrive in two.

@query("upsert_incidents")
def _(e):
    """The incident table after both batches: base and changes merged."""
    d = J.run_batch_ends(e).merged("incidents", "incident_key")
    return d.select("incident_key", "batch_id", "event_id", "n", "total_events", "alert_count", "first_seen", "last_seen", "target_user", "ip_count")


@query("publish_updates")
def _(e):
    return BE.published(J.run_batch_ends(e))


@query("stream_promotions")
def _(e):
    d = J.run_batch_ends(e).merged("observations", "evidence_key")
    return d.select("evidence_key", "event_count", "alert_count", "promoted_in")


@query("stream_merges")
def _(e):
    return J.run_batch_ends(e).log("merges").select("batch_id", "incident_key", "primary_key", "merge_ord")


@query("stream_priorities")
def _(e):
    return J.run_batch_ends(e).log("queue").select("batch_id", "incident_key", "priority")


# Parsing.

@query("detect_format")
def _(e):
    return parse.detect_format(e.lines)


ENTRY = ["seq", "event_id", "timestamp", "hostname", "source_ip", "username", "service", "process", "event_type", "message",
         "severity", "log_format"]


@query("parse_lines")
def _(e):
    return e.entries.select(*ENTRY)


@query("parse_syslog")
def _(e):
    return parse.parse_lines(e.lines, e.config, "syslog").where("log_format = 'syslog'").select(*ENTRY)


@query("parse_apache_access")
def _(e):
    return parse.parse_lines(e.lines, e.config, "apache_access").where("log_format = 'apache_access'").select(*ENTRY)


@query("parse_apache_error")
def _(e):
    """The access lines rewritten as error lines, then parsed."""
    source = e.entries.where("log_format = 'apache_access'")
    level = F.element_at(F.array(*map(F.lit, ["error", "warn", "notice", "crit", "debug"])), (c("seq") % 5 + 1).cast("int"))
    line = F.concat(F.lit("["), F.lit("Mon "), F.date_format("timestamp", "MMM dd HH:mm:ss"), F.lit(".250000 2024] [core:"), level,
                    F.lit("] [pid 12] [client "), c("source_ip"), F.lit(":99] "), c("message"))
    made = source.select("seq", line.alias("value"), "source_file", c("timestamp").alias("modified"))
    return parse.parse_lines(made, e.config).select(*ENTRY)


def _document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "value"))
    return rows.select((c("doc_id") * (1 << 32) + c("i")).alias("seq"), "value", F.lit("documents").alias("source_file"),
                       F.lit("2024-01-01 00:00:00").cast("timestamp").alias("modified"))


@raw_query("parse_fallback")
def _(spark, sf_dir, e):
    """Document text is in no log format, so every line takes the fallback."""
    d = parse.parse_lines(_document_lines(spark, sf_dir), e.config)
    return d.where("log_format = 'unknown'").select("seq", "message", "source_ip", "event_type", "severity", "timestamp")


@query("parse_bsd_ts")
def _(e):
    return (parse.split_fields(e.lines).where("log_format = 'auth'")
            .select("seq", P.bsd_time(F.get("f", F.lit(1)), e.config.year).alias("ts")))


@query("parse_apache_ts")
def _(e):
    return (parse.split_fields(e.lines).where("log_format = 'apache_access'")
            .select("seq", P.access_time(F.get("f", F.lit(3))).alias("ts")))


@query("extract_first_ip")
def _(e):
    return e.lines.select("seq", P.first_ip(c("value")).alias("ip"))


@query("extract_username")
def _(e):
    return e.lines.select("seq", P.username_of(c("value")).alias("username"))


@query("classify_event")
def _(e):
    return (e.entries.where("log_format = 'auth'").select("service", "message")
            .groupBy("service", P.event_type_of(F.lower("service"), F.lower("message")).alias("event_type")).agg(F.count("*").alias("n")))


@query("syslog_severity")
def _(e):
    return e.entries.where("log_format = 'auth'").groupBy(P.message_severity(F.lower("message")).alias("severity")).agg(
        F.count("*").alias("n"))


@query("http_severity")
def _(e):
    return e.entries.where("log_format = 'apache_access'").groupBy("severity", "message").agg(F.count("*").alias("n"))


# Filters.

ROW = ["seq", "event_id", "timestamp", "source_ip", "username", "service", "severity"]


@query("search_entries")
def _(e):
    return Q.page(Q.search_entries(e.entries, search="FAILED password", severity="medium", username="acct1"), 200, 50).select(*ROW)


@query("search_entries_total")
def _(e):
    return Q.search_entries(e.entries, search="10.0.0.3", event_type="Web Server", service="APACHE").agg(F.count("*").alias("total"))


@query("filter_alerts")
def _(e):
    return Q.filter_alerts(e.alerts, "active").select("alert_id", "rule_id", "timestamp")


@query("active_alerts")
def _(e):
    return Q.active_alerts(e.alerts).groupBy("rule_id").agg(F.count("*").alias("n"))


@query("active_incidents")
def _(e):
    return Q.active_incidents(e.all_incidents).select("incident_key", "incident_type")


@query("search_evidence")
def _(e):
    return E.search_evidence(e.evidence, e.evidence_context, e.evidence_iocs, severity="high", source_ip="10.0.0.2",
                             service="sshd", ioc="acct1", keyword="10.0.0").select("evidence_id", "rule_id", "event_count")


@query("search_evidence_keyword")
def _(e):
    """A keyword that spans the rule name and the first source."""
    return E.search_evidence(e.evidence, e.evidence_context, e.evidence_iocs, keyword="failures 10.0.0").select("evidence_id")


@query("evidence_by_incident")
def _(e):
    return e.evidence.where("incident_key = 'brute_force:10.0.0.1'").select("evidence_id", "rule_id", "rule_name", "event_count")


@query("list_observations")
def _(e):
    return e.observations.select("observation_id", "rule_id", "rule_name", "severity", "event_count", "alert_count", "first_seen",
                                 "last_seen", "unique_source_count", "collection_confidence")


def _incident_scalars(d: DataFrame) -> DataFrame:
    return d.select("incident_key", "incident_type", "severity", "confidence", "risk", "status", "target_user", "first_seen",
                    "last_seen", "total_events", "alert_count", "ip_count", "triggered_rules", "mitre_techniques")


@query("incident_list_view")
def _(e):
    d = Q.incident_list_view(e.incidents, e.timeline)
    return d.select("incident_key", "total_events", F.transform("timeline", lambda x: x["description"]).alias("timeline"))


@query("fp_filter")
def _(e):
    return e.all_incidents.select("incident_key", c("admitted_pos").isNotNull().alias("listed"),
                                  c("admitted_pos.seq").alias("admitted_seq"))


@query("recent_incident_view")
def _(e):
    return S.recent_incidents(e.incidents).select("incident_key")


# Detection.

ALERT = ["alert_id", "seq", "rule_id", "severity", "source_ip", "username", "description", "timestamp", "mitre", "event_count"]


def _rule_query(rules: list[str]):
    return lambda e: e.alerts.where(c("rule_id").isin(rules)).select(*ALERT)


for _name, _rules in RULE_QUERIES.items():
    query(_name)(_rule_query(_rules))


@query("rule_port_scan")
def _(e):
    d = D.port_scan_hits(e.scanned, e.config)
    return d.select(F.concat_ws("-", "event_id", "rule_id").alias("alert_id"), "seq", "source_ip", "event_count")


@query("alerts")
def _(e):
    return e.alerts.select("alert_id", "rule_id", "rule_name", "severity", "source_ip", "username", "description",
                           "matched_event_id", "timestamp", "status", "mitre", "event_count")


# Correlation.

UPDATE = ["incident_key", "seq", "event_id", "n"]
SCENARIO_QUERIES = {"incident_brute_force": "brute_force", "incident_account_compromise": "account_compromise",
                    "incident_web_recon": "web_recon", "incident_priv_esc": "priv_esc", "incident_service_failure": "service_fail"}


def _scenario_query(name: str):
    return lambda e: e.updates.where(c("incident_key").startswith(f"{name}:")).select(*UPDATE)


for _name, _scenario in SCENARIO_QUERIES.items():
    query(_name)(_scenario_query(_scenario))


@query("incident_updates")
def _(e):
    return e.updates.select("incident_key", "incident_type", "severity", "seq", C.update_text(e.config).alias("description"),
                            F.transform("hits", lambda h: h["rule_id"]).alias("rules"))


@query("build_incidents")
def _(e):
    return e.all_incidents.select("incident_key", "incident_type", "severity", "target_user", "first_seen", "last_seen",
                                  "total_events", "alert_count", "ip_count", "triggered_rules", "mitre_techniques",
                                  "correlation_explanation")


@query("incident_timeline")
def _(e):
    return e.timeline.select("incident_key", "seq", "sub", "timestamp", "event_type", "description", "severity")


@query("rank_priority")
def _(e):
    return e.ranked.select("incident_key", "threat_score", "priority")


@query("auth_gap")
def _(e):
    return B.auth_gap(e.detected)


@query("timeline_gaps")
def _(e):
    return Q.timeline_gaps(e.timeline).select("incident_key", "seq", "sub", "gap")


@query("notification_rollup")
def _(e):
    return S.notification_rollup(e.notices)


@query("notification_center")
def _(e):
    return S.notification_center(S.notification_rollup(e.notices))


# Joins.

@query("alerts_with_rules")
def _(e):
    return e.alerts.join(F.broadcast(e.rules.select("rule_id", "recommendation")), "rule_id").select(
        "alert_id", "rule_name", "recommendation")


@query("entry_detail")
def _(e):
    """Details of all entries that named root."""
    asked = e.entries.where("username = 'root'").select("seq")
    return Q.entry_detail(e.entries, e.alerts, e.rules, asked).select(
        "event_id", "message", "alert_id", "rule_name", "event_count", "recommendation")


@query("incident_related_logs")
def _(e):
    asked = e.all_incidents.where("incident_type = 'Account Compromise'")
    return Q.related_logs(e.entries, e.updates, asked).select("incident_key", "seq", "message")


@query("alerts_without_incident")
def _(e):
    return Q.alerts_without_incident(e.detected, e.updates).select(
        "seq", "event_id", F.transform("hits", lambda h: h["rule_id"]).alias("rules"))


def _asked_ioc(e: Engine) -> DataFrame:
    return e.spark.createDataFrame([("username", "acct3"), ("ipv4", "10.0.0.4")], "ioc_type string, value string")


@query("related_iocs")
def _(e):
    return I.related_iocs(e.ioc_links, _asked_ioc(e))


@query("merge_candidates")
def _(e):
    return M.merge_candidates(e.incidents, e.sources, e.config)


@query("merge_incidents")
def _(e):
    return e.listed.select("incident_key", "primary_key", "is_merged", "status", "severity", "total_events", "first_seen",
                           "last_seen", "target_user", "triggered_rules", "mitre_techniques", "first_sources", "merged_count",
                           "alert_count")


@query("incident_sources")
def _(e):
    """Every source of every incident: the whole list, a row each."""
    return e.sources.select("incident_key", "source_ip")


@query("merged_timeline")
def _(e):
    """Timelines of listed incidents after merging, as text rows in order."""
    return e.listed_timeline.select("incident_key", "merged_from", "seq", "sub", "event_type", "description").orderBy(
        "incident_key", "seq", "sub", "merged_from")


@query("merged_alerts")
def _(e):
    return e.listed_alerts


@query("merged_events")
def _(e):
    return e.listed_events


@query("merged_sources")
def _(e):
    """Every source of every listed incident after merging."""
    return e.listed_sources.select("incident_key", "source_ip")


@query("merge_map")
def _(e):
    return e.absorbed


@query("insights")
def _(e):
    return e.insights.drop("smart_recommendations", "threat_score_breakdown")


@query("evidence_for_incident")
def _(e):
    return e.incidents.join(e.evidence.select("incident_key", "evidence_id", "rule_name"), "incident_key").select(
        "incident_key", "evidence_id", "rule_name", "risk")


# Aggregations.

@query("dashboard_stats")
def _(e):
    return S.dashboard_stats(e.entries, e.alerts, e.incidents, e.every_after_merge)


@query("top_source_ips")
def _(e):
    return S.top_values(e.entries, "source_ip", "ip", ["timestamp", "seq"])


@query("top_event_types")
def _(e):
    return S.top_values(e.entries, "event_type", "type", ["timestamp", "seq"])


@query("severity_distribution")
def _(e):
    return S.severity_distribution(e.spark, e.entries).drop("ord")


@query("logs_over_time")
def _(e):
    return S.per_minute_of_day(e.entries)


@query("logs_per_minute")
def _(e):
    return S.per_minute(e.entries)


@query("rule_frequency")
def _(e):
    return S.rule_frequency(e.alerts, e.rules)


@query("threat_trend")
def _(e):
    return S.per_minute_of_day(e.alerts)


@query("threat_summary")
def _(e):
    return S.threat_summary(e.listed, e.listed_sources, e.alerts)


@query("most_dangerous")
def _(e):
    return S.most_dangerous(e.listed)


@query("most_active_attacker")
def _(e):
    return S.most_active_attacker(e.listed, e.listed_sources)


@query("most_targeted_user")
def _(e):
    return S.most_targeted_user(e.listed)


@query("most_targeted_service")
def _(e):
    return S.most_targeted_service(e.alerts)


@query("soc_queue")
def _(e):
    return S.soc_queue(e.ranked)


@query("merged_count")
def _(e):
    return S.merged_count(e.listed)


@query("behaviour_counters")
def _(e):
    return B.source_counters(e.scanned, e.detected)


@query("behaviour_user_counters")
def _(e):
    return B.user_counters(e.scanned)


@query("behaviour_service_counters")
def _(e):
    return B.service_counters(e.detected)


@query("behaviour_global")
def _(e):
    return B.global_findings(e.scanned, e.detected)


@query("ioc_relationships")
def _(e):
    return e.relationships


@query("ioc_confidence")
def _(e):
    return e.relationships.select("ioc_type", "value", "confidence")


@query("ioc_links")
def _(e):
    return e.ioc_links.select("ioc_type", "value", "link_type", "linked")


@query("incident_iocs")
def _(e):
    return I.incident_iocs(e.ioc_links, e.relationships, "web_recon:10.0.0.2").select("ioc_type", "value", "occurrences")


@query("evidence")
def _(e):
    met = F.size(F.filter("matched_conditions", lambda x: x["matched"]))
    return e.evidence.select("evidence_id", "incident_key", "rule_id", "rule_name", "severity", "first_seen", "last_seen",
                             "event_count", "alert_count", "unique_source_count", "collection_confidence", met.alias("met"))


@query("evidence_context")
def _(e):
    return e.evidence_context.select("evidence_key", "kind", "value", c("first_pos.seq").alias("first_seq"))


@query("evidence_iocs")
def _(e):
    return e.evidence_iocs.select("evidence_key", "ioc_type", "value", "source_event_id")


@query("evidence_raw_refs")
def _(e):
    return E.raw_refs(e.evidence_rows, e.scanned, e.config.raw_refs).select(
        "evidence_key", "rn", "event_id", "raw_log", "severity", "detection_rule_ids")


@query("observations")
def _(e):
    return e.observations.select("observation_id", "status", "event_count", "collection_confidence")


@query("observation_iocs")
def _(e):
    return E.evidence_iocs(e.observation_rows, e.facts).select("evidence_key", "ioc_type", "value", "source_event_id")


@query("collection_confidence")
def _(e):
    return e.evidence.select("incident_key", "collection_confidence")


@query("promote_observations")
def _(e):
    """Automatic promotion, and one by hand for every crash observation."""
    manual = e.observations.where("rule_id = 'R013'").select("observation_id", F.lit("by-hand").alias("incident_id"))
    return E.promote(e.observations, manual).select("observation_id", "status", "promoted", "promoted_to_incident_id")


@query("ioc_panel")
def _(e):
    return S.ioc_panel(e.evidence_iocs, "brute_force:10.0.0.1")


@query("investigation_queue")
def _(e):
    return S.investigation_queue(e.evidence, E.promote(e.observations))


@query("session_stats")
def _(e):
    """Lines of each format as one ingested file."""
    by_format = e.entries.withColumn("source_file", c("log_format"))
    formats = e.entries.select("seq", c("log_format").alias("source_file"))
    return S.session_stats(by_format, e.alerts.drop("source_file").join(formats, "seq"),
                           e.updates.drop("source_file").join(formats, "seq"), e.incidents)


@query("pipeline_health")
def _(e):
    return S.pipeline_health(e.entries, e.alerts, e.listed)


@query("latest_critical")
def _(e):
    return S.latest_critical(e.listed)


# Scores and texts.

@query("confidence")
def _(e):
    return e.all_incidents.select("incident_key", "confidence")


@query("risk")
def _(e):
    return e.all_incidents.select("incident_key", "risk")


@query("threat_score")
def _(e):
    b = "threat_score_breakdown"
    return e.all_incidents.select("incident_key", "threat_score", f"{b}.*")


@query("attack_chain")
def _(e):
    return e.all_incidents.select(
        "incident_key", "attack_chain_id", "attack_chain_stage", "attack_chain_progress", "attack_chain_stages_completed",
        "attack_chain_stages_missing", "estimated_objective")


@query("chain_list")
def _(e):
    return CH.chain_list(e.chain_stages, e.chains).drop("stages", "pos")


@query("behaviour_findings")
def _(e):
    return e.findings.select("incident_key", "part", "finding")


def _text_query(name: str):
    @query(name)
    def _(e):
        return e.with_texts(e.all_incidents).select("incident_key", name)


for _name in ("reasoning", "recommendations", "root_cause", "executive_summary", "technical_summary", "mitre_summary"):
    _text_query(_name)


@query("smart_recommendations")
def _(e):
    d = e.with_texts(e.all_incidents).select("incident_key", F.posexplode("smart_recommendations").alias("i", "r"))
    return d.select("incident_key", "i", "r.*")


@query("attack_narrative")
def _(e):
    return e.narratives


@query("affected_assets")
def _(e):
    return e.assets.select("incident_key", "part", "asset")


@query("matched_conditions")
def _(e):
    both = e.evidence.select("evidence_id", F.posexplode("matched_conditions").alias("i", "m")).unionByName(
        e.observations.select(c("observation_id").alias("evidence_id"), F.posexplode("matched_conditions").alias("i", "m")))
    return both.select("evidence_id", "i", "m.*")


# Indicators, sorts, graph.

@query("extract_iocs")
def _(e):
    return I.extract_iocs(e.entries).select("seq", "i", "ioc_type", "value")


@raw_query("extract_iocs_documents")
def _(spark, sf_dir, e):
    return I.extract_text_iocs(e.spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), "doc_id", "text")


@raw_query("extract_iocs_pages")
def _(spark, sf_dir, e):
    return I.extract_text_iocs(e.spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")), "page_id", "html")


@query("top_iocs")
def _(e):
    return I.top_iocs(e.relationships).select("ioc_type", "value", "confidence", "occurrences")


@query("ioc_lookup")
def _(e):
    return I.ioc_lookup(e.relationships, "ipv4", "10.0.0.3")


@query("incidents_sorted")
def _(e):
    return Q.sort_incidents(e.incidents).select("incident_key", "severity", "last_seen")


@query("latest_n")
def _(e):
    return Q.latest_n(e.entries, 1000).select("seq", "event_id")


@query("session_history")
def _(e):
    """Upload sessions and one monitoring session in one list."""
    first = e.entries.agg(F.min("timestamp").alias("start_time"), F.count("*").alias("events_processed"))
    monitor = first.select(F.lit("monitor").alias("session_id"), F.lit("live_folder").alias("source_type"), "start_time",
                           "events_processed")
    upload = (e.entries.groupBy("log_format").agg(F.min("timestamp").alias("start_time"), F.count("*").alias("events"))
              .select(F.concat(F.lit("upload-"), "log_format").alias("session_id"), F.lit("upload").alias("source_type"),
                      "start_time", "events"))
    return S.session_history(monitor, upload)


@query("graph_nodes_edges")
def _(e):
    return e.graph_edges


@query("graph_nodes")
def _(e):
    return e.graph_nodes


@query("graph_neighbors")
def _(e):
    return G.neighbors(e.graph_edges, e.detected.agg(F.min_by("event_id", "seq").alias("id")))


@query("graph_subgraph_nodes")
def _(e):
    return _subgraph(e)[0]


@query("graph_subgraph_edges")
def _(e):
    return _subgraph(e)[1]


def _subgraph(e: Engine):
    start = e.updates.agg(F.min_by("event_id", "seq").alias("id"))
    return G.subgraph_from(e.graph_nodes, e.graph_edges, start, 2)


@query("graph_counts")
def _(e):
    n = e.graph_nodes.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), "type", "n")
    return n.unionByName(e.graph_edges.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), "type", "n"))


# Actions.

def _alert_actions(e: Engine) -> DataFrame:
    """Acknowledge all root logins, resolve the earlier ones later, and try an unknown action on traversals."""
    a = e.alerts
    ack = a.where("rule_id = 'R004'").select("alert_id", F.lit("acknowledge").alias("action"), c("timestamp").alias("ts"))
    res = a.where("rule_id = 'R004' and seq % 2 = 0").select(
        "alert_id", F.lit("resolve").alias("action"), (c("timestamp") + F.expr("interval 1 hour")).alias("ts"))
    bad = a.where("rule_id = 'R007'").select("alert_id", F.lit("hide").alias("action"), c("timestamp").alias("ts"))
    gone = a.where("rule_id = 'R008'").select(F.concat("alert_id", F.lit("-x")).alias("alert_id"), F.lit("resolve").alias("action"),
                                              c("timestamp").alias("ts"))
    return ack.unionByName(res).unionByName(bad).unionByName(gone).withColumn("note", F.lit(""))


@query("apply_alert_actions")
def _(e):
    return A.apply_alert_actions(e.alerts, _alert_actions(e))[0].select("alert_id", "status")


@query("rejected_alert_actions")
def _(e):
    return A.apply_alert_actions(e.alerts, _alert_actions(e))[1].select("alert_id", "action", "reason")


def _incident_actions(e: Engine) -> DataFrame:
    """A whole life for compromises, a step too far for brute force, a reopened web incident."""
    plan = {"Account Compromise": ["investigate", "resolve", "close"], "Brute Force Attack": ["investigate", "close"],
            "Web Reconnaissance": ["investigate", "resolve", "reopen"], "Repeated Service Failure": ["dismiss"]}
    steps = e.spark.createDataFrame([(k, i, a) for k, v in plan.items() for i, a in enumerate(v)],
                                    "incident_type string, i int, action string")
    return e.all_incidents.join(F.broadcast(steps), "incident_type").select(
        c("incident_key").alias("incident_id"), "action", (c("last_seen") + F.make_dt_interval(mins=c("i"))).alias("ts"),
        F.lit("").alias("note"))


@query("apply_incident_actions")
def _(e):
    return A.apply_incident_actions(e.all_incidents, _incident_actions(e))[0].select("incident_key", "status")


@query("rejected_incident_actions")
def _(e):
    return A.apply_incident_actions(e.all_incidents, _incident_actions(e))[1].select("incident_id", "action", "reason")


# Streams: each runs to completion over the same lines, landed as files.

def _text_files(e) -> str:
    """The engine's lines as text files, written once per engine."""
    folder = f"{e.store.folder}/text-lines"
    if "_text_lines" not in e.__dict__:
        e.lines.select("value").repartition(3).write.mode("overwrite").text(folder)
        e.__dict__["_text_lines"] = e.store.keep(folder)
    return folder


@query("read_lines")
def _(e):
    """Lines read back from files."""
    return L.read_lines(e.spark, _text_files(e), glob="*.txt").select("value")


@query("start_from")
def _(e):
    """Files changed since a time: all since the first, none since a far one."""
    def since(t: str):
        return L.read_lines(e.spark, _text_files(e), modified_after=t, glob="*.txt").agg(F.count("*").alias("n")).select(F.lit(t[:4]).alias("since"), "n")
    return since("2000-01-01T00:00:00").unionByName(since("2999-01-01T00:00:00"))


FILE_LINES = 1 << 14


@raw_query("stream_lines")
def _(spark, sf_dir, e):
    """Log files that grow are followed: each has half of its lines at first, and all of them when the stream goes on."""
    folder = f"{e.store.folder}/growing"
    low = e.lines.agg(F.min("seq")).first()[0] or 0
    at = c("seq") - low
    rows = e.lines.select(F.format_string("lines-%06d.log", F.floor(at / FILE_LINES)).alias("file"), "seq", "value")
    for part in (rows.where(at % FILE_LINES < FILE_LINES // 2), rows):
        K.named_texts(part, folder)
        J.to_table(W.follow_lines(spark, folder, f"{folder}-register.json"), "followed", f"{folder}-stream")
    return spark.read.parquet(f"{folder}-stream/followed").groupBy("seq").agg(F.first("value").alias("value"), F.count("*").alias("n")).select("value", "n")


@raw_query("stream_detect")
def _(spark, sf_dir, e):
    return J.run_detect(e).select("seq", "rule_id", "event_count")


@raw_query("stream_correlate")
def _(spark, sf_dir, e):
    return J.run_correlate(e).select("incident_key", "seq", "n")


@raw_query("stream_counts")
def _(spark, sf_dir, e):
    return J.run_counts(e)


@raw_query("stream_rate")
def _(spark, sf_dir, e):
    return J.run_rate(e)
