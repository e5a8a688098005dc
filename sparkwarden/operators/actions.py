"""Analysts' actions applied to alerts and incidents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.operators.ordered import Running, with_totals

c = F.col


def apply_alert_actions(alerts: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alerts with their new status, rejected actions). actions(alert_id, action, ts, note); the last one wins."""
    status = F.when(c("action") == "acknowledge", "ACKNOWLEDGED").when(c("action") == "resolve", "RESOLVED")
    known = alerts.select("alert_id")
    valid = actions.where(status.isNotNull())
    last = valid.groupBy("alert_id").agg(F.max_by(status, F.struct("ts", "action")).alias("_status"))
    changed = alerts.join(last, "alert_id", "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")
    unknown_action = actions.where(status.isNull()).withColumn("reason", F.lit("unknown action"))
    unknown_alert = valid.join(known, "alert_id", "left_anti").withColumn("reason", F.lit("unknown alert"))
    return changed, unknown_action.unionByName(unknown_alert)


# The step each action takes, from and to. Reopening is allowed in every status.
STEPS = [("investigate", "ACTIVE", "INVESTIGATING"), ("resolve", "INVESTIGATING", "RESOLVED"), ("close", "RESOLVED", "CLOSED")]


def apply_incident_actions(incidents: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(incidents with their new status, rejected actions). actions(incident_id, action, ts, note), applied in time order.

    Each status allows exactly one step forward, so between two reopenings the accepted actions are the first
    investigate, the first resolve after it and the first close after that: minima, with no list per incident.
    """
    known = [name for name, _, _ in STEPS] + ["reopen"]
    a = actions.withColumn("action", F.lower("action")).withColumnRenamed("incident_id", "incident_key")
    usable = a.where(c("action").isin(known)).join(incidents.select("incident_key", c("status").alias("start")), "incident_key")
    order = with_totals(
        usable.withColumn("t", F.unix_micros("ts")).withColumn("tie", F.xxhash64("action", "note")), ["incident_key"],
        {"part": Running((c("action") == "reopen").cast("int")), "n": Running(F.lit(1))}, seq="tie")
    key = ["incident_key", "part"]
    # Where a part starts: reopened, or in the incident's own status.
    begun = F.when(c("part") > 0, "ACTIVE").otherwise(c("start"))
    parts = order.groupBy(*key).agg(F.first(begun).alias("status")).withColumn("at", F.lit(0).cast("bigint"))
    accepted = order.where("action = 'reopen'").select("incident_key", "part", "n")
    for name, from_, to in STEPS:
        here = parts.where(c("status") == from_).select(*key, "at")
        taken = (order.where(c("action") == name).join(here, key).where(c("n") > c("at"))
                 .groupBy(*key).agg(F.min("n").alias("n")))
        accepted = accepted.unionByName(taken)
        moved = taken.withColumnRenamed("n", "_n")
        parts = parts.join(moved, key, "left").select(
            *key, F.when(c("_n").isNotNull(), to).otherwise(c("status")).alias("status"), F.coalesce("_n", "at").alias("at"))
    last = parts.groupBy("incident_key").agg(F.max_by("status", "part").alias("_status"))
    changed = (incidents.join(last, "incident_key", "left").withColumn("status", F.coalesce("_status", "status")).drop("_status"))

    # A refused action reports the status at its time: the last step accepted before it, or where its part began.
    to_status = F.when(c("action") == "reopen", "ACTIVE")
    for name, _, to in STEPS:
        to_status = to_status.when(c("action") == name, to)
    ok = accepted.select("incident_key", "n", F.lit(True).alias("ok"))
    marked = order.join(ok, ["incident_key", "n"], "left")
    steps = (marked.where("ok").select("incident_key", "n", F.struct("n", to_status.alias("status")).alias("step")))
    seen = marked.join(steps, ["incident_key", "n"], "left")
    seen = with_totals(seen, ["incident_key"], {"now": Running(c("step"), "max")}, t="n", seq="n", slice_width=4096)
    refused = seen.where("ok is null").select(
        c("incident_key").alias("incident_id"), "action", "ts", "note",
        F.concat(F.lit("not allowed in status "), F.coalesce("now.status", "start")).alias("reason"))
    unknown_action = a.where(~c("action").isin(known)).select(
        c("incident_key").alias("incident_id"), "action", "ts", "note", F.lit("unknown action").alias("reason"))
    unknown_incident = (a.where(c("action").isin(known)).join(incidents.select("incident_key"), "incident_key", "left_anti")
                        .select(c("incident_key").alias("incident_id"), "action", "ts", "note", F.lit("unknown incident").alias("reason")))
    return changed, refused.unionByName(unknown_action).unionByName(unknown_incident)
