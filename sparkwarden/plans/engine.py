"""The chain from lines to incidents, as stage tables and views over them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.config import Config
from sparkwarden.functions import scoring as S
from sparkwarden.functions import texts as T
from sparkwarden.operators import behaviour, chains, correlate, detect, evidence, graph, iocs, merge, search, stats
from sparkwarden.operators.parse import parse_lines
from sparkwarden.plans.store import Store
from sparkwarden.schema import ENTRY_COLUMNS

c = F.col


class Engine:
    """Stages are written once; everything else is a lazy view over them.

    lines(seq, value, source_file, modified) is any DataFrame of log lines, one per row. Tables whose size per incident
    has no bound (sources, timeline, events, findings, indicators) are tables of their own, keyed by incident_key.
    """

    def __init__(self, spark: SparkSession, lines: DataFrame, config: Config | None = None, folder: str | None = None):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        # The JVM does not compile methods above 8000 bytes, which one generated method of the whole parse step would be.
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
        self.spark = spark
        self.lines = lines
        self.config = config or Config()
        self.store = Store(spark, folder)

    def _cut(self, name: str, df: DataFrame) -> DataFrame:
        return self.store.table(name, lambda: df)

    # Dimensions.

    @cached_property
    def rules(self) -> DataFrame:
        return detect.rules_table(self.spark)

    @cached_property
    def chains(self) -> DataFrame:
        return chains.chains_table(self.spark)

    # Lines to alerts.

    @property
    def scanned(self) -> DataFrame:
        """Entries with what each line alone decides."""
        return self.store.table("scanned", lambda: detect.with_line_rules(parse_lines(self.spread(self.lines), self.config)))

    def spread(self, lines: DataFrame) -> DataFrame:
        """Input in fewer splits than there are cores is spread before parsing; large input comes in enough splits."""
        cores = self.spark.sparkContext.defaultParallelism
        return lines.repartition(cores) if lines.rdd.getNumPartitions() < cores else lines

    @property
    def entries(self) -> DataFrame:
        return self.scanned.select(*ENTRY_COLUMNS)

    @property
    def detected(self) -> DataFrame:
        """Entries with rule hits."""
        return self.store.table("detected", lambda: detect.detected_entries(
            self.scanned, self.config, self._cut))

    @property
    def alerts(self) -> DataFrame:
        return detect.alerts_of(self.detected, self.rules)

    # Alerts to incidents.

    @property
    def updates(self) -> DataFrame:
        return self.store.table("updates", lambda: correlate.incident_updates(
            self.scanned, self.detected, self.config))

    @property
    def sources(self) -> DataFrame:
        return self.store.table("incident_sources", lambda: correlate.incident_ips(self.updates))

    @property
    def timeline(self) -> DataFrame:
        return correlate.timeline(self.updates, self.config)

    @property
    def _base(self) -> DataFrame:
        return self.store.table("incident_base", lambda: correlate.build_incidents(self.updates, self.config))

    @property
    def chain_spans(self) -> DataFrame:
        return self.store.table("chain_spans", lambda: chains.periods(self._base, correlate.incident_rules(self.updates)))

    @property
    def chain_stages(self) -> DataFrame:
        return self.store.table("chain_stages", lambda: chains.chain_stages(self.updates, self._base, self.chain_spans))

    @property
    def all_incidents(self) -> DataFrame:
        """Every incident with its scores, also those the false-positive filter keeps out of the lists."""
        def build() -> DataFrame:
            chained = chains.with_chains(self._base, self.chain_stages, self.chains, self.chain_spans)
            return (chained.withColumn("confidence", S.confidence()).withColumn("risk", S.risk())
                    .withColumn("threat_score_breakdown", S.threat_breakdown()).withColumn("threat_score", S.threat_score())
                    .join(correlate.admissions(self.updates), "incident_key", "left"))
        return self.store.table("incidents", build)

    @property
    def incidents(self) -> DataFrame:
        return self.all_incidents.where(c("admitted_pos").isNotNull())

    # Merging, once at the end of a batch.

    @property
    def absorbed(self) -> DataFrame:
        return self.store.table("absorbed", lambda: merge.merge_map(self.incidents, self.sources, self.config, self._cut))

    @property
    def listed(self) -> DataFrame:
        """Listed incidents after merging, with is_merged."""
        listed, sources = merge.merged_incidents(self.incidents, self._listed_sources, self.absorbed, self.updates)
        self.store.table("listed_sources", lambda: sources)
        return self.store.table("listed", lambda: listed)

    @property
    def _listed_sources(self) -> DataFrame:
        return self.sources.join(self.incidents.select("incident_key"), "incident_key", "left_semi")

    def of_owner(self, d: DataFrame) -> DataFrame:
        """Rows of listed incidents, under the incident that they were merged into."""
        owner = self.listed.select("incident_key", F.coalesce("primary_key", "incident_key").alias("_owner"))
        return d.join(owner, "incident_key").withColumn("merged_from", F.when(c("_owner") != c("incident_key"), c("incident_key"))).withColumn(
            "incident_key", c("_owner")).drop("_owner")

    @property
    def listed_timeline(self) -> DataFrame:
        """Timelines after merging: those of the united incidents as one, in order of time."""
        return self.of_owner(self.timeline)

    @property
    def listed_alerts(self) -> DataFrame:
        """(incident_key, seq, rule_id): the distinct alerts of each listed incident after merging."""
        own = self.updates.select("incident_key", "seq", F.explode("hits.rule_id").alias("rule_id"))
        return self.of_owner(own).select("incident_key", "seq", "rule_id").distinct()

    @property
    def listed_events(self) -> DataFrame:
        """(incident_key, seq): the distinct entries of each listed incident after merging."""
        return self.of_owner(self.updates.select("incident_key", "seq")).select("incident_key", "seq").distinct()

    @property
    def listed_findings(self) -> DataFrame:
        return self.of_owner(self.findings)

    @property
    def listed_sources(self) -> DataFrame:
        _ = self.listed
        return self.store.table("listed_sources", None)

    @property
    def ranked(self) -> DataFrame:
        return merge.rank_priority(self.listed)

    @property
    def every_after_merge(self) -> DataFrame:
        """All incidents with the status they have after merging."""
        closed = self.absorbed.select("incident_key", F.lit("CLOSED").alias("_s"))
        return self.all_incidents.join(closed, "incident_key", "left").withColumn("status", F.coalesce("_s", "status")).drop("_s")

    # Texts and findings.

    def with_texts(self, incidents: DataFrame) -> DataFrame:
        """Adds the text columns that one incident row decides."""
        return (incidents.withColumn("reasoning", T.reasoning()).withColumn("recommendations", T.recommendations())
                .withColumn("smart_recommendations", T.smart_recommendations()).withColumn("root_cause", T.root_cause())
                .withColumn("executive_summary", T.executive_summary()).withColumn("technical_summary", T.technical_summary())
                .withColumn("mitre_summary", T.mitre_summary()))

    @property
    def findings(self) -> DataFrame:
        return self.store.table("findings", lambda: behaviour.findings(
            self.scanned, self.detected, self.updates, self.all_incidents, self.sources))

    @property
    def narratives(self) -> DataFrame:
        return search.attack_narrative(self.all_incidents, self.timeline)

    @property
    def assets(self) -> DataFrame:
        return search.affected_assets(self.all_incidents, self.sources, correlate.update_text(self.config))

    @property
    def insights(self) -> DataFrame:
        """One row per incident with everything an investigation page shows that has a bound."""
        d = self.with_texts(self.all_incidents).join(self.narratives, "incident_key", "left")
        return d.join(self.ranked.select("incident_key", "priority"), "incident_key", "left").select(
            "incident_key", "executive_summary", "technical_summary", "attack_narrative", "root_cause", "mitre_summary",
            "smart_recommendations", "attack_chain_id", "attack_chain_stage", "attack_chain_progress",
            "attack_chain_stages_completed", "attack_chain_stages_missing", "estimated_objective", "threat_score",
            "threat_score_breakdown", "priority")

    # Evidence, indicators, graph.

    @property
    def evidence_rows(self) -> DataFrame:
        return evidence.incident_rows(self.updates)

    @property
    def observation_rows(self) -> DataFrame:
        return evidence.observation_rows(self.detected, self.updates)

    @property
    def facts(self) -> DataFrame:
        return self.store.table("line_facts", lambda: evidence.line_facts(self.scanned))

    @property
    def evidence(self) -> DataFrame:
        return self.store.table("evidence", lambda: evidence.evidence(
            self.updates, self.facts, self.all_incidents, self.rules))

    @property
    def observations(self) -> DataFrame:
        return self.store.table("observations", lambda: evidence.observations(
            self.detected, self.updates, self.facts, self.rules))

    @property
    def notices(self) -> DataFrame:
        """What a user is told. Observations are promoted once, at the end of the batch: at the time of its last line."""
        end = self.entries.agg(F.max("timestamp").alias("ts")).select("ts", F.lit(True).alias("promoted"))
        promoted = evidence.promote(self.observations).where("promoted").select("promoted").join(F.broadcast(end), "promoted")
        return stats.notifications(self.alerts, self.updates, self.incidents, promoted)

    @property
    def evidence_context(self) -> DataFrame:
        return self.store.table("evidence_context", lambda: evidence.context_values(self.evidence_rows, self.facts))

    @property
    def evidence_iocs(self) -> DataFrame:
        return self.store.table("evidence_iocs", lambda: evidence.evidence_iocs(self.evidence_rows, self.facts))

    @property
    def ioc_links(self) -> DataFrame:
        return self.store.table("ioc_links", lambda: iocs.ioc_links(self.scanned, self.detected, self.updates))

    @property
    def relationships(self) -> DataFrame:
        return self.store.table("ioc_relationships", lambda: iocs.relationships(
            self.scanned, self.detected, self.updates, self.ioc_links))

    @property
    def graph_nodes(self) -> DataFrame:
        return graph.nodes(self.detected, self.updates)

    @property
    def graph_edges(self) -> DataFrame:
        return self.store.table("graph_edges", lambda: graph.edges(self.detected, self.updates))
