"""What happens at the end of each micro-batch: incidents are brought up to date, observations promoted, incidents merged and
ranked, and slices published for those who watch.

One stream takes the entries, rule hits and incident updates that the other streams appended. A batch touches tables of
incidents and observations only: new updates join the log, incidents that they name are built again from their own
updates, and observations add up counts. Merging and ranking then run over incidents, never over lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden import dims
from sparkwarden.config import Config
from sparkwarden.operators import correlate, detect, evidence
from sparkwarden.plans.engine import Engine
from sparkwarden.schema import SLIM_COLUMNS
from sparkwarden.sources.sinks import newest_entries
from sparkwarden.streaming.tables import BatchTables

c = F.col
KEYS = {"incidents": "incident_key", "observations": "evidence_key"}
SLICES = ("new_logs", "new_alert", "new_incident", "evidence_created", "observation_promoted", "stats_update")
HIT = "array<struct<ord:int,rule_id:string,event_count:int,fail_no:bigint>>"


def together(scanned: DataFrame, hits: DataFrame, updates: DataFrame) -> DataFrame:
    """Streams of entries, hits and updates as one, so that a micro-batch has what belongs to the same lines."""
    return (scanned.select(F.lit("entry").alias("row_kind"), *SLIM_COLUMNS)
            .unionByName(hits.select(F.lit("hit").alias("row_kind"), *SLIM_COLUMNS, "rule_id", "event_count"), allowMissingColumns=True)
            .unionByName(updates.select(F.lit("update").alias("row_kind"), "incident_key", "seq", "t", "n"), allowMissingColumns=True))


def detected_of(hits: DataFrame) -> DataFrame:
    """Hits as the batch tables have them: a row per entry."""
    order = F.create_map(*[F.lit(x) for pair in dims.RULE_ORD.items() for x in pair])
    hit = F.struct(F.coalesce(order[c("rule_id")], F.lit(99)).alias("ord"), "rule_id", c("event_count").cast("int").alias("event_count"),
                   F.lit(None).cast("bigint").alias("fail_no"))
    return (hits.groupBy("seq").agg(F.first(F.struct(*[x for x in SLIM_COLUMNS if x != "seq"])).alias("e"), F.sort_array(F.collect_list(hit)).alias("hits"))
            .select("seq", "e.*", c("hits").cast(HIT).alias("hits")))


def updates_of(updates: DataFrame, entries: DataFrame, detected: DataFrame) -> DataFrame:
    """Updates with what they keep of their entry, as correlate.incident_updates gives them."""
    scenario = F.substring_index("incident_key", ":", 1)

    def of(i: int):
        return F.create_map(*[F.lit(x) for s in dims.SCENARIOS for x in (s[0], s[i])])[scenario]

    subject = F.expr("substring(incident_key, locate(':', incident_key) + 1)")
    entry = [c("severity").alias("entry_severity") if x == "severity" else c(x) for x in SLIM_COLUMNS if x not in ("web_flag", "path", "seq", "t")]
    d = updates.select("incident_key", "seq", "t", "n").join(entries.select("seq", *entry, F.lit(True).alias("there")), "seq", "left")
    # A batch has an entry with its hits and updates, since steps run one after the other; one that has not must not be taken.
    d = d.withColumn("n", F.when(c("there"), c("n")).otherwise(F.raise_error(F.lit("an update came without its entry")).cast("bigint"))).drop("there")
    d = d.join(detected.select("seq", "hits"), "seq", "left")
    return d.select("incident_key", of(2).alias("incident_type"), of(3).alias("severity"), of(1).alias("ord"), subject.alias("subject"), "n", "seq", "t",
                    *[x for x in d.columns if x not in ("incident_key", "seq", "t", "n", "hits")], F.coalesce("hits", F.array().cast(HIT)).alias("hits"))


class AsOf(Engine):
    """The engine's views over an updates log instead of lines."""

    def __init__(self, spark: SparkSession, updates: DataFrame, config: Config, folder: str):
        super().__init__(spark, None, config, folder)
        self._updates = updates

    @property
    def updates(self) -> DataFrame:
        return self._updates


def observed(detected: DataFrame, updates: DataFrame) -> DataFrame:
    """Counts of a batch's alerting entries that belong to no incident, by observation."""
    rows = evidence.observation_rows(detected, updates)
    return rows.groupBy("evidence_key").agg(F.count(F.lit(1)).alias("event_count"), F.sum(F.size("hits")).cast("bigint").alias("alert_count"))


def batch_end(tables: BatchTables, config: Config):
    """The function for foreachBatch. A batch that runs again finds its record and does nothing, or writes the same again."""
    def run(batch: DataFrame, batch_id: int) -> None:
        if batch_id in tables.records():
            return
        spark = tables.spark
        work = f"{tables.folder}/_work/{batch_id}"

        def cut(name: str, d: DataFrame) -> DataFrame:
            d.write.mode("overwrite").parquet(f"{work}/{name}")
            return spark.read.schema(d.schema).parquet(f"{work}/{name}")

        rows = cut("rows", batch)
        entries = rows.where("row_kind = 'entry'").select(*SLIM_COLUMNS)
        detected = cut("detected", detected_of(rows.where("row_kind = 'hit'")))
        new = cut("updates", updates_of(rows.where("row_kind = 'update'"), entries, detected))
        earlier = tables.log("updates")
        everything = new if earlier is None else earlier.drop("batch_id").unionByName(new)
        # Observations: counts add up; one is promoted in the batch in which it grows enough.
        seen = observed(detected, new)
        before = tables.merged("observations", "evidence_key")
        if before is not None:
            old = before.select("evidence_key", c("event_count").alias("e"), c("alert_count").alias("a"), c("promoted_in").alias("p"))
            seen = seen.join(old, "evidence_key", "left")
        else:
            seen = seen.select("*", F.lit(0).alias("e"), F.lit(0).alias("a"), F.lit(None).cast("bigint").alias("p"))
        seen = seen.select("evidence_key", (c("event_count") + F.coalesce("e", F.lit(0))).alias("event_count"),
                           (c("alert_count") + F.coalesce("a", F.lit(0))).alias("alert_count"), "p")
        grown = (c("event_count") >= 3) | (c("alert_count") >= 2)
        observations = cut("observations", seen.select("evidence_key", "event_count", "alert_count",
                                                       F.coalesce("p", F.when(grown, F.lit(batch_id).cast("bigint"))).alias("promoted_in")))
        # Incidents: those touched are built again; merging and ranking see the whole list.
        state = AsOf(spark, cut("all_updates", everything), config, f"{work}/engine")
        incidents = state.ranked.select("incident_key", "incident_type", "severity", "status", "target_user", "total_events", "first_seen", "last_seen",
                                        "threat_score", "merged_count", "priority")
        merges = state.absorbed
        touched = new.groupBy("incident_key").agg(F.count(F.lit(1)).alias("new_events"), F.max_by("event_id", F.struct("t", "seq")).alias("event_id"),
                                                  F.max_by("n", F.struct("t", "seq")).alias("n"))
        # Shown are incidents that the false-positive filter has let in.
        shown = touched.join(state.incidents.select("incident_key"), "incident_key", "left_semi")
        dim = detect.rules_table(spark)
        alerts = detect.alerts_of(detected, dim)
        totals = rows.agg(F.count_if(c("row_kind") == "entry").alias("lines"), F.count_if(c("row_kind") == "hit").alias("alerts"),
                          F.count_if(c("row_kind") == "update").alias("updates"))
        tables.write(batch_id, {
            "updates": new, "observations": observations, "merges": merges, "queue": incidents.select("incident_key", "priority"),
            "incidents": touched.join(correlate.build_incidents(state.updates.join(touched.select("incident_key"), "incident_key", "left_semi"), config)
                                      .select("incident_key", "incident_type", "total_events", "alert_count", "first_seen", "last_seen", "target_user", "ip_count"),
                                      "incident_key"),
            "new_logs": newest_entries(entries).select("seq", "event_id"),
            "new_alert": alerts.select("alert_id", "rule_id", "severity"),
            "new_incident": shown.select("incident_key", "event_id", "n"),
            "evidence_created": shown.select(F.concat(F.lit("EV-"), "incident_key").alias("evidence_id")),
            "observation_promoted": observations.where(c("promoted_in") == batch_id).select(F.concat(F.lit("OBS-"), "evidence_key").alias("observation_id")),
            "stats_update": totals,
        }, KEYS)
    return run


def published(tables: BatchTables) -> DataFrame:
    """(batch_id, slice, id) of everything that was published."""
    out = None
    for name in SLICES:
        d = tables.log(name)
        if d is None:
            continue
        told = (F.to_json(F.struct("lines", "alerts", "updates")) if name == "stats_update" else c(d.columns[1] if name == "new_logs" else d.columns[0]))
        d = d.select("batch_id", F.lit(name).alias("slice"), told.cast("string").alias("id"))
        out = d if out is None else out.unionByName(d)
    return out
