"""Indicators linked by shared context: one row per indicator, one row per link."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.functions.iocs import entry_iocs, text_iocs
from sparkwarden.functions.rounding import round_exact

c = F.col
KEY = ["ioc_type", "value"]
# Indicator type and the entry column it comes from.
FIELDS = [("ipv4", "source_ip"), ("username", "username"), ("hostname", "hostname"), ("service", "service")]


def extract_iocs(entries: DataFrame) -> DataFrame:
    """Distinct indicators of each entry, in order."""
    return (entries.select("seq", "event_id", F.posexplode(entry_iocs()).alias("i", "x"))
            .select("seq", "event_id", "i", "x.*"))


def extract_text_iocs(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.explode(text_iocs(c(text))).alias("x")).select(key, "x.*")


def _keys() -> Column:
    pairs = F.array(*[F.struct(F.lit(k).alias("ioc_type"), c(f).alias("value")) for k, f in FIELDS])
    return F.explode(F.filter(pairs, lambda p: p["value"] != "")).alias("k")


def _ticks(scanned: DataFrame, updates: DataFrame) -> DataFrame:
    """An indicator is counted once per entry that names it, and again for each incident update of that entry."""
    fields = [f for _, f in FIELDS]
    entry = scanned.select("timestamp", "t", "seq", F.lit(0).alias("ord"), *fields)
    return (entry.unionByName(updates.select("timestamp", "t", "seq", "ord", *fields))
            .select("timestamp", F.struct("t", "seq", "ord").alias("pos"), _keys()).select("k.*", "timestamp", "pos"))


def ioc_links(scanned: DataFrame, detected: DataFrame, updates: DataFrame) -> DataFrame:
    """Distinct (indicator, link_type, linked) with the position of the first link. All sides combine before the shuffle."""
    context = F.array(*[F.struct(F.lit(k).alias("link_type"), c(f).alias("linked")) for k, f in FIELDS])
    fields = [f for _, f in FIELDS]
    base = (scanned.select("t", "seq", *fields).select("t", "seq", _keys(), context.alias("links"))
            .select("k.*", "t", "seq", F.explode("links").alias("l"))
            .where((c("l.link_type") != c("ioc_type")) & (c("l.linked") != ""))
            .select(*KEY, "l.link_type", "l.linked", F.struct("t", "seq", F.lit(0).alias("ord")).alias("pos")))
    rules = (detected.select("t", "seq", _keys(), F.explode("hits").alias("h"))
             .select("k.*", F.lit("rule").alias("link_type"), c("h.rule_id").alias("linked"),
                     F.struct("t", "seq", F.lit(0).alias("ord")).alias("pos")))
    incidents = (updates.select("t", "seq", "ord", "incident_key", _keys())
                 .select("k.*", F.lit("incident").alias("link_type"), c("incident_key").alias("linked"),
                         F.struct("t", "seq", "ord").alias("pos")))
    return (base.unionByName(rules).unionByName(incidents).groupBy(*KEY, "link_type", "linked")
            .agg(F.min("pos").alias("first_pos")))


def relationships(scanned: DataFrame, detected: DataFrame, updates: DataFrame, links: DataFrame) -> DataFrame:
    """One row per indicator. Confidence lags one tick: it is set before the last tick's own links are added."""
    seen = _ticks(scanned, updates).groupBy(*KEY).agg(
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.count("*").alias("occurrences"),
        F.max("pos").alias("last_pos"))
    hits = detected.select("t", "seq", F.size("hits").alias("n"), _keys()).select("k.*", "n", F.struct("t", "seq").alias("at"))
    alerts = hits.groupBy(*KEY).agg(F.sum("n").alias("related_alerts"), F.max("at").alias("alert_at"),
                                    F.max_by("n", "at").alias("alert_last"))

    def count(kind: str) -> Column:
        return F.count_if(c("link_type") == kind)
    # An indicator may have very many links, so they are counted without a join. Each tick adds one incident at most, so
    # the incidents known before the last tick are all, or all but one.
    linked = links.groupBy(*KEY).agg(
        count("incident").alias("related_incidents"), count("rule").alias("related_rules"),
        count("username").alias("related_users"), count("service").alias("related_services"),
        count("hostname").alias("related_hosts"), count("ipv4").alias("related_ips"),
        F.max(F.when(c("link_type") == "incident", c("first_pos"))).alias("incident_at"))
    # Rules per indicator are as few as the rules table.
    rules = (links.where("link_type = 'rule'").join(seen.select(*KEY, "last_pos"), KEY).groupBy(*KEY)
             .agg(F.count_if(c("first_pos") < c("last_pos")).alias("_rules")))
    d = seen.join(alerts, KEY, "left").join(linked, KEY, "left").join(rules, KEY, "left").na.fill(0)
    d = d.withColumn("_incidents", c("related_incidents") - F.when(c("incident_at") == c("last_pos"), 1).otherwise(0))
    on_last = ((c("last_pos.ord") == 0) & (c("alert_at.t") == c("last_pos.t")) & (c("alert_at.seq") == c("last_pos.seq")))
    earlier = c("related_alerts") - F.when(on_last, c("alert_last")).otherwise(0)

    def capped(x: Column, n: int) -> Column:
        return F.least(x, F.lit(n))
    score = (capped(c("occurrences") * 3, 30) + capped(c("_incidents") * 15, 30) + capped(c("_rules") * 10, 20)
             + capped(earlier * 2, 10) + 10)
    return d.select(*KEY, "first_seen", "last_seen", "occurrences", "related_alerts", "related_incidents", "related_users",
                    "related_services", "related_hosts", "related_rules", "related_ips",
                    round_exact(capped(score, 100).cast("double"), 1).alias("confidence"))


def top_iocs(relationships: DataFrame, limit: int = 20) -> DataFrame:
    if not 1 <= limit <= 100:
        raise ValueError("limit must be 1 to 100")
    return relationships.orderBy(c("confidence").desc(), c("occurrences").desc(), *KEY).limit(limit)


def ioc_lookup(relationships: DataFrame, ioc_type: str, value: str) -> DataFrame:
    return relationships.where((c("ioc_type") == ioc_type) & (c("value") == value))


def related_iocs(links: DataFrame, asked: DataFrame) -> DataFrame:
    """For each asked (ioc_type, value): the other indicators that share an incident, a rule or a source with it.

    One lookup per asked indicator; pairs of all indicators are never formed.
    """
    shared = links.where(c("link_type").isin("incident", "rule", "ipv4"))
    mine = (shared.join(asked.select(*KEY).distinct(), KEY)
            .select(c("ioc_type").alias("asked_type"), c("value").alias("asked_value"), "link_type", "linked"))
    other = shared.join(mine, ["link_type", "linked"])
    return (other.where((c("ioc_type") != c("asked_type")) | (c("value") != c("asked_value")))
            .select("asked_type", "asked_value", *KEY).distinct())


def incident_iocs(links: DataFrame, relationships: DataFrame, incident_key: str) -> DataFrame:
    linked = links.where((c("link_type") == "incident") & (c("linked") == incident_key))
    return relationships.join(linked.select(*KEY), KEY, "left_semi")
