"""Evidence graph as a node table and an edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col
# Node type, id prefix, entry column, and type of the edge from an event to it.
CONTEXT = [("host", "host:", "hostname", "originated"), ("ip", "ip:", "source_ip", "originated"),
           ("user", "user:", "username", "targeted"), ("service", "svc:", "service", "related")]
_FIELDS = ["event_id", "hostname", "source_ip", "username", "service", "hits"]


def _registrations(detected: DataFrame, updates: DataFrame) -> DataFrame:
    """An entry is registered once per incident update, or once if it only raised alerts."""
    alone = detected.join(updates.select("seq"), "seq", "left_anti").select(*_FIELDS).withColumn("incident_key", F.lit(None))
    return updates.select(*_FIELDS, "incident_key").unionByName(alone.withColumn("incident_key", c("incident_key").cast("string")))


def _alert_ids() -> Column:
    return F.transform("hits", lambda h: F.concat_ws("-", c("event_id"), h["rule_id"]))


def edges(detected: DataFrame, updates: DataFrame) -> DataFrame:
    """Directed edges, repeated as often as they were registered. Narrow over the registrations."""
    def edge(source, target, kind: str) -> Column:
        return F.struct(source.alias("source"), target.alias("target"), F.lit(kind).alias("type"))
    event, incident = c("event_id"), c("incident_key")
    context = F.array_compact(F.array(*[
        F.when(c(f) != "", edge(event, F.concat(F.lit(prefix), c(f)), kind)) for _, prefix, f, kind in CONTEXT]))
    alerts = F.transform(_alert_ids(), lambda a: edge(event, a, "generated"))
    triggered = F.transform(_alert_ids(), lambda a: edge(a, incident, "triggered"))
    member = F.array(edge(event, incident, "related"))
    every = F.when(incident.isNotNull(), F.concat(context, alerts, triggered, member)).otherwise(F.concat(context, alerts))
    return _registrations(detected, updates).select(F.explode(every).alias("e")).select("e.*")


def nodes(detected: DataFrame, updates: DataFrame) -> DataFrame:
    def node(ident, kind: str, label) -> Column:
        return F.struct(ident.alias("id"), F.lit(kind).alias("type"), label.alias("label"))
    event, incident = c("event_id"), c("incident_key")
    context = [F.when(c(f) != "", node(F.concat(F.lit(prefix), c(f)), kind, c(f))) for kind, prefix, f, _ in CONTEXT]
    fixed = F.array_compact(F.array(node(event, "event", event), *context,
                                    F.when(incident.isNotNull(), node(incident, "incident", incident))))
    every = F.concat(fixed, F.transform(_alert_ids(), lambda a: node(a, "alert", a)))
    return _registrations(detected, updates).select(F.explode(every).alias("n")).select("n.*").distinct()


def neighbors(edges: DataFrame, start: DataFrame, edge_type: str | None = None) -> DataFrame:
    """The out-edges (of a type) of the nodes start(id)."""
    d = edges.join(start.select(c("id").alias("source")), "source", "left_semi").select("source", "target", "type")
    return d if edge_type is None else d.where(c("type") == edge_type)


def subgraph_from(nodes: DataFrame, edges: DataFrame, start: DataFrame, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) within depth hops of start(id) along edge direction; edges are all out-edges of the nodes reached.

    A round follows the edges of the nodes that the round before it found, not of all found so far.
    """
    reached = new = start.select("id").distinct()
    links = edges.select(c("source").alias("id"), "target")
    for _ in range(depth):
        new = links.join(new, "id", "left_semi").select(c("target").alias("id")).distinct().join(reached, "id", "left_anti")
        reached = reached.unionByName(new)
    return nodes.join(reached, "id", "left_semi"), neighbors(edges, reached)


def subgraph(spark: SparkSession, nodes: DataFrame, edges: DataFrame, node_id: str, depth: int = 2) -> tuple[DataFrame, DataFrame]:
    return subgraph_from(nodes, edges, spark.createDataFrame([(node_id,)], "id string"), depth)
