"""Attack chains: stages reached per chain and attacker, as of each incident's last update."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwarden import dims


def chains_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(dims.CHAINS, "chain_type string, chain_name string, stages array<string>, objective string")


def _order() -> Column:
    return F.create_map(*[F.lit(x) for n, chain in enumerate(dims.CHAINS) for x in (chain[0], n)])


def _of(mapping: dict[str, tuple[str, str]], key: Column) -> Column:
    """The chain and stage that a fixed map names for a type or a rule; null for others."""
    return F.create_map(*[x for k, (chain, stage) in mapping.items() for x in (F.lit(k), F.struct(
        F.lit(chain).alias("chain_type"), F.lit(stage).alias("stage")))])[key]


def periods(incidents: DataFrame, rules: DataFrame) -> DataFrame:
    """(incident_key, from, to, chain_type, stage, ip): the spans over which an incident stays in one chain and stage.

    The first chain, in the order of the chains table, that knows the incident's type or a rule triggered so far takes it.
    Rules only add up, so an incident can only move to an earlier chain: it has at most one span per chain. In a chain that
    does not know the type, the rule triggered first gives the stage. A span also ends where the first source appears.
    `to` is null for the last one; `rules` has every rule of an incident with its first position.
    """
    c = F.col
    known = incidents.select("incident_key", "incident_type", "first_pos", "first_ip", "first_ip_pos")
    by_type = known.select("incident_key", c("first_pos").alias("from"), _of(dims.CHAIN_OF_TYPE, c("incident_type")).alias("x"), F.lit(0).alias("by_rule"))
    at = F.struct(c("first_pos.t").alias("t"), c("first_pos.seq").alias("seq"))
    by_rule = (rules.withColumn("x", _of(dims.CHAIN_OF_RULE, c("rule_id"))).where("x is not null")
               .groupBy("incident_key", c("x.chain_type").alias("chain_type"))
               .agg(F.min_by(F.struct(at.alias("from"), "x"), "first_pos").alias("y"))
               .select("incident_key", "y.from", "y.x", F.lit(1).alias("by_rule")))
    # At most one row per chain, by type before by rule; then in order of time, those that win over all before.
    hits = (by_type.where("x is not null").unionByName(by_rule)
            .withColumn("n", _order()[c("x.chain_type")])
            .groupBy("incident_key", "n").agg(F.min(F.struct("by_rule", "from", "x")).alias("h")))
    so_far = Window.partitionBy("incident_key").orderBy("h.from", "n").rowsBetween(Window.unboundedPreceding, -1)
    starts = (hits.withColumn("least", F.min("n").over(so_far)).where("least is null or n < least")
              .select("incident_key", "h.from", "h.x", "n"))
    # Where two begin at one update, the earlier chain has it.
    starts = starts.groupBy("incident_key", "from").agg(F.min_by("x", "n").alias("x"))
    cuts = known.where("first_ip_pos > first_pos").select("incident_key", c("first_ip_pos").alias("from"), F.lit(None).cast(starts.schema["x"].dataType).alias("x"))
    ahead = Window.partitionBy("incident_key").orderBy("from")
    rows = (starts.unionByName(cuts).groupBy("incident_key", "from").agg(F.first("x", ignorenulls=True).alias("x"))
            .withColumns({"x": F.last("x", ignorenulls=True).over(ahead), "to": F.lead("from").over(ahead)}))
    return (rows.where("x is not null").join(known.select("incident_key", "first_ip", "first_ip_pos"), "incident_key")
            .select("incident_key", "from", "to", "x.chain_type", "x.stage", F.when(c("from") >= c("first_ip_pos"), c("first_ip")).alias("ip")))


def attacker(ip: Column, user: Column) -> Column:
    return F.concat_ws(":", F.when(ip != "", ip), F.when(user != "", user))


def chain_points(updates: DataFrame, incidents: DataFrame, spans: DataFrame) -> DataFrame:
    """(incident_key, chain_type, stage, attacker, pos): every attacker key an incident had in a span, and when it first had it there.

    The key is first source : last user so far. Within a span it can only be new at its first update and at one that names a
    user, so a partial aggregate by user is enough, with no window over an incident.
    """
    c = F.col
    own = ["incident_key", "chain_type", "stage", "ip"]
    named = updates.where("username <> ''").select("incident_key", "username", F.struct("t", "seq").alias("pos")).join(spans, "incident_key")
    within = (named.where("pos >= `from` and (`to` is null or pos < `to`)").groupBy(*own, "username").agg(F.min("pos").alias("pos"))
              .select(*own[:3], attacker(c("ip"), c("username")).alias("attacker"), "pos"))
    # The first span begins with the first update; the user of a later one is the last named up to its begin.
    begins = spans.join(incidents.select("incident_key", "first_pos", "first_row_user"), "incident_key")
    first = begins.where("`from` = first_pos").select(*own[:3], attacker(c("ip"), c("first_row_user")).alias("attacker"), c("from").alias("pos"))
    before = named.where("pos <= `from`").groupBy(*own, "from").agg(F.max_by("username", "pos").alias("user"))
    later = (begins.where("`from` > first_pos").drop("first_pos", "first_row_user")
             .join(before.select("incident_key", "from", "user"), ["incident_key", "from"], "left")
             .select(*own[:3], attacker(c("ip"), c("user")).alias("attacker"), c("from").alias("pos")))
    return within.unionByName(first).unionByName(later).where("attacker <> ''")


def chain_stages(updates: DataFrame, incidents: DataFrame, spans: DataFrame) -> DataFrame:
    """One row per chain, attacker and stage, with the position it was first seen: at most one per stage of the chain."""
    c = F.col
    points = (chain_points(updates, incidents, spans)
              .join(incidents.select("incident_key", "ord", "first_seen"), "incident_key")
              .withColumn("pos", F.struct(c("pos.t").alias("t"), c("pos.seq").alias("seq"), c("ord").alias("ord"))))
    return (points.groupBy("chain_type", "attacker", "stage")
            .agg(F.min("pos").alias("pos"), F.min_by("first_seen", "pos").alias("first_seen"),
                 F.count_distinct("incident_key").alias("incidents")))


def with_chains(incidents: DataFrame, stages: DataFrame, chains: DataFrame, spans: DataFrame) -> DataFrame:
    """Incidents with chain columns: the stages their attacker had reached at their last update, in their last chain."""
    c = F.col
    last = spans.where("`to` is null").select("incident_key", "chain_type", "stage")
    own = (incidents.withColumn("attacker", attacker(c("first_ip"), c("target_user"))).join(last, "incident_key", "left")
           .withColumn("last_update", F.struct(c("last_pos.t").alias("t"), c("last_pos.seq").alias("seq"), c("ord").alias("ord"))))
    reached = (own.where("attacker <> ''").select("incident_key", "chain_type", "attacker", "last_update")
               .join(stages.select("chain_type", "attacker", c("stage").alias("seen"), "pos"), ["chain_type", "attacker"])
               .where(c("pos") <= c("last_update")).groupBy("incident_key").agg(F.collect_set("seen").alias("seen")))
    d = own.join(reached, "incident_key", "left").join(chains, "chain_type", "left")
    on = c("seen").isNotNull()
    nothing = F.array().cast("array<string>")
    completed = F.when(on, F.filter("stages", lambda s: F.array_contains("seen", s))).otherwise(nothing)
    missing = F.when(on, F.filter("stages", lambda s: ~F.array_contains("seen", s))).otherwise(nothing)
    return d.select(
        *incidents.columns,
        F.when(on, chain_id(c("chain_type"), c("attacker"))).alias("attack_chain_id"),
        F.when(on, c("stage")).otherwise("").alias("attack_chain_stage"),
        F.when(on, F.bround(F.size(completed) / F.size("stages") * 100, 1)).otherwise(0.0).alias("attack_chain_progress"),
        completed.alias("attack_chain_stages_completed"), missing.alias("attack_chain_stages_missing"),
        F.when(on, c("objective")).otherwise("").alias("estimated_objective"))


def chain_id(chain: Column, who: Column) -> Column:
    return F.concat(F.lit("CHAIN-"), chain, F.lit(":"), who)


def chain_list(stages: DataFrame, chains: DataFrame) -> DataFrame:
    """One row per chain and attacker, by progress. An incident has one stage in a chain, so incident counts add up."""
    c = F.col
    d = (stages.groupBy("chain_type", "attacker")
         .agg(F.collect_set("stage").alias("seen"), F.min("pos").alias("pos"), F.sum("incidents").alias("incident_count"),
              F.min_by("first_seen", "pos").alias("first_seen")).join(chains, "chain_type"))
    completed = F.filter("stages", lambda s: F.array_contains("seen", s))
    return d.select(
        chain_id(c("chain_type"), c("attacker")).alias("chain_id"), "chain_name", "chain_type", "stages",
        completed.alias("stages_completed"), F.filter("stages", lambda s: ~F.array_contains("seen", s)).alias("stages_missing"),
        F.bround(F.size(completed) / F.size("stages") * 100, 1).alias("progress"), "objective", "incident_count", "first_seen",
        "pos").orderBy(c("progress").desc(), "pos")
