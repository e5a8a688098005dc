"""Behaviour counters of sources, users and services, and the findings of each incident as of its last update."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.functions.rounding import fixed
from sparkwarden.functions.texts import speed_finding, text
from sparkwarden.operators.detect import has_rule
from sparkwarden.operators.ordered import SECOND, Running, first_rows, with_totals

c = F.col
AUTH_RULES = ("R001", "R002", "R003", "R004", "R014")
FAST_GAP_US = SECOND // 2
POS = ["t", "seq"]


def first_uses(rows: DataFrame, key: str, member: str) -> DataFrame:
    """Distinct (key, member) with the position of its first row."""
    return (rows.where((c(key) != "") & (c(member) != "")).groupBy(c(key).alias("key"), c(member).alias("member"))
            .agg(F.min(F.struct("t", "seq")).alias("p")).select("key", "member", "p.t", "p.seq"))


def auth_times(detected: DataFrame) -> DataFrame:
    """Authentication alerts of each source with the time since the one before it (null for the first).

    Neighbours are found by number, with an equi-join, so a busy source is not walked on one task.
    """
    d = (detected.where((c("source_ip") != "") & has_rule(*AUTH_RULES))
         .select(c("source_ip").alias("key"), "t", "seq"))
    d = with_totals(d, ["key"], {"n": Running(F.lit(1))})
    before = d.select("key", (c("n") + 1).alias("n"), c("t").alias("before"))
    return d.join(before, ["key", "n"], "left").select("key", "t", "seq", "n", (c("t") - c("before")).alias("gap"))


def auth_gap(detected: DataFrame) -> DataFrame:
    """Smallest gap between authentication alerts of each source that has two or more."""
    return (auth_times(detected).groupBy(c("key").alias("source_ip"))
            .agg(F.count("*").alias("auth_alerts"), (F.min("gap") / SECOND).alias("min_gap_s"))
            .where("min_gap_s is not null"))


def source_counters(scanned: DataFrame, detected: DataFrame) -> DataFrame:
    """Per source: events, distinct users, authentication alerts, firewall blocks. Aggregates combine before the shuffle."""
    rows = scanned.where(c("source_ip") != "")
    events = rows.groupBy("source_ip").agg(F.count("*").alias("events"))
    users = (rows.where(c("username") != "").select("source_ip", "username").distinct()
             .groupBy("source_ip").agg(F.count("*").alias("users")))
    hits = detected.where(c("source_ip") != "").groupBy("source_ip").agg(
        F.count_if(has_rule(*AUTH_RULES)).alias("auth_alerts"), F.count_if(has_rule("R010")).alias("firewall_blocks"))
    return events.join(users, "source_ip", "left").join(hits, "source_ip", "left").na.fill(0)


def user_counters(scanned: DataFrame) -> DataFrame:
    rows = scanned.where((c("source_ip") != "") & (c("username") != "")).select("username", "source_ip").distinct()
    return rows.groupBy("username").agg(F.count("*").alias("sources"))


def service_counters(detected: DataFrame) -> DataFrame:
    return detected.where(has_rule("R013")).groupBy("service").agg(F.count("*").alias("crashes"))


def global_findings(scanned: DataFrame, detected: DataFrame) -> DataFrame:
    """The five busiest sources with 10 events or more, and the five users with most sources, two or more."""
    first_ip = scanned.where(c("source_ip") != "").groupBy("source_ip").agg(F.min(F.struct(*POS)).alias("p"))
    ips = (source_counters(scanned, detected).join(first_ip, "source_ip")
           .orderBy(c("events").desc(), "p").limit(5).where("events >= 10")
           .select(F.lit("active_attacker").alias("type"), c("source_ip").alias("subject"), c("events").alias("event_count"),
                   c("users").alias("related"),
                   text("IP ", c("source_ip"), ": ", c("events"), " events targeting ", c("users"), " users").alias("description")))
    first_user = first_uses(scanned, "username", "source_ip").groupBy("key").agg(F.min(F.struct(*POS)).alias("p"))
    users = (user_counters(scanned).join(first_user, c("username") == c("key")).orderBy(c("sources").desc(), "p").limit(5)
             .where("sources >= 2")
             .select(F.lit("targeted_user").alias("type"), c("username").alias("subject"), F.lit(0).cast("bigint").alias("event_count"),
                     c("sources").alias("related"),
                     text("User '", c("username"), "': targeted from ", c("sources"), " IPs").alias("description")))
    return ips.unionByName(users)


BITS = 4
LEVELS = 10


def smallest_members(members: DataFrame, points: DataFrame, k: int = 5) -> DataFrame:
    """For each point (id, key, upto): the k smallest members of the key among those numbered 1..upto, as a sorted array.

    members(key, member, n). Numbers are grouped in cells of 16^level; every cell keeps its k smallest members, and a
    point reads the few cells that make up 1..upto. No point reads, and no task holds, all members of a key.
    """
    cells = members.select("key", "member", F.explode(F.array(*[F.lit(i) for i in range(LEVELS)])).alias("level"), "n")
    cells = cells.withColumn("cell", F.expr(f"shiftright(n - 1, level * {BITS})"))
    cells = first_rows(cells, ["key", "level", "cell"], ["member"], k).select("key", "level", "cell", "member")
    # Level i holds the cells from the start of the enclosing level i+1 cell up to the point's own cell, exclusive.
    whole = F.array(*[F.struct(F.lit(i).alias("level"), F.expr(f"shiftright(upto, {BITS * (i + 1)})").alias("outer"),
                               F.expr(f"shiftright(upto, {BITS * i})").alias("own")) for i in range(LEVELS)])
    need = points.select("id", "key", F.explode(whole).alias("w")).where(c("w.own") > c("w.outer") * 2 ** BITS)
    need = need.select("id", "key", c("w.level").alias("level"),
                       F.explode(F.sequence(c("w.outer") * 2 ** BITS, c("w.own") - 1)).alias("cell"))
    found = need.join(cells, ["key", "level", "cell"])
    return (first_rows(found, ["id"], ["member"], k).groupBy("id")
            .agg(F.sort_array(F.collect_list("member")).alias("members")))


def source_findings(scanned: DataFrame, detected: DataFrame, updates: DataFrame, incidents: DataFrame,
                    sources: DataFrame) -> DataFrame:
    """Findings per incident and source, as of the incident's last update."""
    rows = scanned.where(c("source_ip") != "")
    key = c("source_ip").alias("key")
    events = rows.select(key, *POS, F.lit(1).alias("ev"))
    users = first_uses(rows, "source_ip", "username").withColumn("nu", F.lit(1))
    auth = auth_times(detected).select("key", *POS, F.lit(1).alias("auth"), F.when(c("gap") < FAST_GAP_US, c("gap")).alias("gap"))
    blocks = detected.where((c("source_ip") != "") & has_rule("R010")).select(key, *POS, F.lit(1).alias("fw"))
    points = (sources.join(incidents.select("incident_key", "last_pos"), "incident_key")
              .select(c("source_ip").alias("key"), "last_pos.t", "last_pos.seq", F.struct("incident_key", c("first_pos").alias("at"))
                      .alias("id")))
    steps = events
    for more in (users, auth, blocks, points):
        steps = steps.unionByName(more, allowMissingColumns=True)

    def count(name: str) -> Running:
        return Running(F.coalesce(name, F.lit(0)))
    d = with_totals(steps, ["key"], {
        "events": count("ev"), "users": count("nu"), "auths": count("auth"), "blocks": count("fw"),
        "min_gap": Running(c("gap"), "min")})
    asked = d.where("id is not null").select("id", "key", "events", "users", "auths", "blocks", "min_gap")
    members = d.where("member is not null").select("key", "member", c("users").alias("n"))
    wanted = asked.where("users >= 3").select("id", "key", c("users").alias("upto"))
    names = smallest_members(members, wanted)
    asked = asked.join(names, "id", "left")
    ip = c("key")
    found = F.array_compact(F.array(
        F.when(c("users") >= 3, text("IP ", ip, " targeted ", c("users"), " different users (", F.array_join("members", ", "),
                                     "), indicating automated credential scanning.")),
        F.when(c("events") >= 20, text("IP ", ip, " generated ", c("events"), " events total, indicating sustained malicious "
                                       "activity.")),
        F.when((c("auths") >= 3) & c("min_gap").isNotNull(),
               text("IP ", ip, " made authentication attempts with ", fixed(c("min_gap") / SECOND, 2),
                    "s intervals, impossible for human interaction — confirms automated tooling.")),
        F.when(c("blocks") >= 5, text("IP ", ip, " was blocked by the firewall ", c("blocks"),
                                      " times, indicating persistent probing despite being blocked."))))
    return asked.select(c("id.incident_key").alias("incident_key"), F.lit(1).alias("part"), c("id.at").alias("at"),
                        F.posexplode(found).alias("i", "finding"))


def user_findings(scanned: DataFrame, incidents: DataFrame) -> DataFrame:
    uses = first_uses(scanned, "username", "source_ip").withColumn("new", F.lit(1))
    points = incidents.where(c("target_user") != "").select(
        c("target_user").alias("key"), "last_pos.t", "last_pos.seq", c("incident_key").alias("id"), F.lit(0).alias("new"))
    d = with_totals(uses.unionByName(points, allowMissingColumns=True), ["key"], {"n": Running(c("new"))})
    asked = d.where("id is not null and n >= 3").select("id", "key", "n")
    names = smallest_members(d.where("id is null").select("key", "member", "n"), asked.select("id", "key", c("n").alias("upto")))
    return asked.join(names, "id").select(
        c("id").alias("incident_key"), F.lit(2).alias("part"), F.lit(None).cast("struct<t:bigint,seq:bigint>").alias("at"),
        F.lit(0).alias("i"),
        text("User '", c("key"), "' was targeted from ", c("n"), " different IPs (", F.array_join("members", ", "),
             "), suggesting a coordinated or distributed attack.").alias("finding"))


SALTS = 64


def service_findings(detected: DataFrame, incidents: DataFrame) -> DataFrame:
    """Every incident with a crash names every service with five crashes by then: the result is that product.

    Only aggregates meet (one row per service, one per incident). They are joined by rule and a salt, so the rows are
    spread over SALTS groups, and the counts are read off running totals.
    """
    crashes = detected.where(has_rule("R013")).select("service", *POS)
    fifth = first_rows(crashes, ["service"], POS, 5)
    services = (fifth.groupBy("service").agg(F.min(F.struct(*POS)).alias("at"), F.max(F.struct(*POS)).alias("fifth"),
                                             F.count("*").alias("n")).where("n = 5")
                .select("service", "at", "fifth", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    asking = (incidents.where(F.array_contains("triggered_rules", "R013")).select("incident_key", "last_pos")
              .withColumn("salt", F.pmod(F.hash("incident_key"), F.lit(SALTS))))
    points = (asking.join(services, "salt").where(c("fifth") <= c("last_pos"))
              .select("service", "last_pos.t", "last_pos.seq", F.struct("incident_key", "at").alias("id"), F.lit(0).alias("one")))
    steps = crashes.withColumn("one", F.lit(1)).unionByName(points, allowMissingColumns=True)
    d = with_totals(steps, ["service"], {"n": Running(c("one"))}).where("id is not null")
    return d.select(
        c("id.incident_key").alias("incident_key"), F.lit(3).alias("part"), c("id.at").alias("at"), F.lit(0).alias("i"),
        text("Service '", c("service"), "' restarted ", c("n"), " times, abnormal frequency indicating possible DoS or "
             "instability.").alias("finding"))


def findings(scanned: DataFrame, detected: DataFrame, updates: DataFrame, incidents: DataFrame, sources: DataFrame) -> DataFrame:
    """(incident_key, part, at, i, finding), ordered by (part, at, i) within an incident."""
    speed = incidents.select(
        "incident_key", F.lit(4).alias("part"), F.lit(None).cast("struct<t:bigint,seq:bigint>").alias("at"), F.lit(0).alias("i"),
        speed_finding().alias("finding")).where("finding is not null")
    return (source_findings(scanned, detected, updates, incidents, sources)
            .unionByName(user_findings(scanned, incidents)).unionByName(service_findings(detected, incidents))
            .unionByName(speed))
