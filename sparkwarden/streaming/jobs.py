"""Streaming jobs: the same rules over lines as they arrive.

Each job is a query with its own checkpoint. Steps that append are chained through file sinks: the sink's log names the
files of each batch, and the next step's file source follows that log, so a batch that runs again is read once. Results that
are updated are written per batch id, where a repeated batch replaces its own output, and only read in batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwarden.config import Config
from sparkwarden.operators import detect
from sparkwarden.operators.parse import parse_lines
from sparkwarden.schema import LINES, SLIM_COLUMNS
from sparkwarden.streaming import state as ST
from sparkwarden.streaming.batch_end import batch_end, together
from sparkwarden.streaming.tables import BatchTables

c = F.col
WATERMARK = "2 minutes"
OUTPUT_MODE, TIMEOUT = "append", "NoTimeout"
FILES_PER_BATCH = 1000


def land(lines: DataFrame, folder: str) -> None:
    """Appends a closed segment of lines for the streams to pick up."""
    lines.select("seq", "value", "source_file", "modified").write.mode("append").parquet(folder)


def landed_lines(spark: SparkSession, folder: str) -> DataFrame:
    """seq comes with the lines, as an offset does on a message bus."""
    return spark.readStream.schema(LINES).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(folder)


def scan(lines: DataFrame, config: Config) -> DataFrame:
    return detect.with_line_rules(parse_lines(lines, config))


def detect_stream(scanned: DataFrame, config: Config) -> DataFrame:
    """Rule hits: line rules pass straight through, counted rules keep state per source."""
    columns = [*SLIM_COLUMNS]
    line = detect.line_hits(scanned).select(*columns, "rule_id", c("event_count").cast("bigint").alias("event_count"))
    rows = (scanned.where("is_failure or is_login or is_404")
            .select(*columns, F.coalesce("source_ip", F.lit(detect.UNKNOWN)).alias("ip"), "is_failure", "is_login", "is_404"))
    counted = rows.groupBy("ip").applyInPandasWithState(
        ST.auth_and_404(config, columns), line.schema, ST.AUTH_STATE, OUTPUT_MODE, TIMEOUT)
    return line.unionByName(counted)


def path_stream(scanned: DataFrame, hits: DataFrame) -> DataFrame:
    """Web rows with the first use of each path marked."""
    cols = [F.coalesce("source_ip", F.lit(detect.UNKNOWN)).alias("ip"), F.coalesce("path", F.lit("")).alias("path"), "t", "seq"]
    rows = scanned.where("web_flag").select(*cols).unionByName(
        hits.where("rule_id = 'R015' and not web_flag").select(*cols))
    return rows.groupBy("ip", "path").applyInPandasWithState(
        ST.first_of_path, "ip string, t bigint, seq bigint, is_new bigint", "seen boolean", OUTPUT_MODE, TIMEOUT)


def correlate_stream(hits: DataFrame, paths: DataFrame, config: Config) -> DataFrame:
    """Incident updates (incident_key, seq, t, n) from hits and marked web rows."""
    ip = F.coalesce("source_ip", F.lit(detect.UNKNOWN))
    service = F.when(c("service") != "", c("service")).otherwise(detect.UNKNOWN)
    user = F.when(c("username") != "", c("username")).otherwise(detect.UNKNOWN)

    def keyed(kind: str, rows: DataFrame, subject, rule, is_new) -> DataFrame:
        return rows.select(F.lit(kind).alias("kind"), subject.alias("subject"), "t", "seq", rule.alias("rule_id"),
                           is_new.cast("bigint").alias("is_new"))
    none, rule = F.lit(None).cast("string"), c("rule_id")
    rows = (keyed("failure", hits.where("rule_id in ('R001', 'R014', 'R002')"), ip, rule, F.lit(0))
            .unionByName(keyed("crash", hits.where("rule_id = 'R013'"), service, rule, F.lit(0)))
            .unionByName(keyed("path", paths, c("ip"), none, c("is_new"))))
    counted = rows.groupBy("kind", "subject").applyInPandasWithState(
        ST.incident_windows(config), ST.UPDATE, ST.UPDATE_STATE, OUTPUT_MODE, TIMEOUT)
    escalations = hits.where("rule_id = 'R005'").select(
        F.concat(F.lit("priv_esc:"), user).alias("incident_key"), "seq", "t", F.lit(1).cast("bigint").alias("n"))
    return counted.unionByName(escalations)


def minute_counts(scanned: DataFrame) -> DataFrame:
    """Lines per minute, and per five minutes sliding by one, with a watermark that bounds the state."""
    marked = scanned.select("timestamp").withWatermark("timestamp", WATERMARK)
    sizes = F.array(F.lit("1 minute"), F.lit("5 minutes"))
    one = marked.select("timestamp", F.explode(sizes).alias("size"))
    spans = F.when(c("size") == "1 minute", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(4)))
    # A line belongs to one tumbling minute and to five sliding windows, which start on minutes.
    placed = one.select("timestamp", "size", F.explode(spans).alias("back"))
    return placed.groupBy(F.window("timestamp", "1 minute").alias("w"), "size", "back").agg(F.count("*").alias("n"))


def to_table(stream: DataFrame, name: str, folder: str, mode: str = "append", each=None):
    """Starts a run over everything that has arrived, and waits for it.

    Appended rows go to a file sink; updated ones to one folder per batch id, or where `each` (batch, batch_id) puts them."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{name}/batch_id={batch_id}")
    if each is not None:
        write, mode = each, "each"
    writer = stream.writeStream.queryName(name).outputMode("append" if mode == "each" else mode).option("checkpointLocation", f"{folder}/_state/{name}").trigger(availableNow=True)
    query = (writer.format("parquet").option("path", f"{folder}/{name}").start() if mode == "append" else writer.foreachBatch(write).start())
    query.awaitTermination()
    return query


VOLUME = "volume"


def measured(scanned: DataFrame) -> DataFrame:
    """The stream with metrics that Spark takes while a batch runs: its lines and the time of its last event."""
    return scanned.observe(VOLUME, F.count(F.lit(1)).alias("lines"), F.max("timestamp").alias("last_event_time"))


def rate(query) -> list[tuple]:
    """(batch_id, lines, last_event_time, seconds, per_second) of a query's recent batches that had lines."""
    out = []
    for p in query.recentProgress:
        seen = (p.observedMetrics or {}).get(VOLUME)
        if seen is not None and seen["lines"]:
            seconds = p.durationMs.get("triggerExecution", 0) / 1000
            out.append((p.batchId, seen["lines"], str(seen["last_event_time"]), seconds, round(seen["lines"] / seconds, 1) if seconds > 0 else 0.0))
    return out


RATE = "batch_id bigint, lines bigint, last_event_time string, seconds double, per_second double"


SEGMENTS = 2


class Replay:
    """Runs streams over an engine's lines, landed in closed segments one after the other; each run resumes its checkpoint."""

    def __init__(self, engine, name: str):
        self.engine, self.spark, self.config = engine, engine.spark, engine.config
        self.folder = f"{engine.store.folder}/streams/{name}"
        self.landing = f"{self.folder}/landing"
        self.tables = BatchTables(self.spark, f"{self.folder}/tables")

    def run(self, step) -> Replay:
        low, high = self.engine.lines.agg(F.min("seq"), F.max("seq")).first()
        size = (high - low) // SEGMENTS + 1
        for i in range(SEGMENTS):
            land(self.engine.lines.where(c("seq").between(low + i * size, low + (i + 1) * size - 1)), self.landing)
            # Lines are parsed once, by a stream of their own; the others read its table.
            scanned = scan(landed_lines(self.spark, self.landing), self.config)
            query = to_table(measured(scanned), "scanned", self.folder)
            # One row a batch: what a monitor shows as events per second.
            self.spark.createDataFrame(rate(query), RATE).withColumn("last_event_time", c("last_event_time").cast("timestamp")).write.mode("overwrite").parquet(f"{self.folder}/rate/segment={i}")
            step(self, self.stored("scanned", scanned.schema))
        return self

    def stored(self, name: str, schema) -> DataFrame:
        return self.spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(f"{self.folder}/{name}")

    def result(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")


def _incident_chain(r: Replay, scanned: DataFrame) -> None:
    hits = detect_stream(scanned, r.config)
    to_table(hits, "hits", r.folder)
    stored = r.stored("hits", hits.schema)
    to_table(path_stream(scanned, stored), "paths", r.folder)
    paths = r.stored("paths", "ip string, t bigint, seq bigint, is_new bigint")
    updates = correlate_stream(stored, paths, r.config)
    to_table(updates, "updates", r.folder)
    # No limit of files: a batch takes what the steps before it have written.
    all_of = lambda name, schema: r.spark.readStream.schema(schema).parquet(f"{r.folder}/{name}")
    ends = together(all_of("scanned", scanned.schema), all_of("hits", hits.schema), all_of("updates", updates.schema))
    to_table(ends, "batch-ends", r.folder, each=batch_end(r.tables, r.config))


def _volumes(r: Replay, scanned: DataFrame) -> None:
    to_table(minute_counts(scanned), "counts", r.folder, mode="update")


def _once(engine, name: str, step) -> Replay:
    done = engine.__dict__.setdefault("_replays", {})
    if name not in done:
        done[name] = Replay(engine, name).run(step)
        engine.store.keep(done[name].folder)
    return done[name]


def run_detect(engine) -> DataFrame:
    return _once(engine, "incidents", _incident_chain).result("hits")


def run_correlate(engine) -> DataFrame:
    return _once(engine, "incidents", _incident_chain).result("updates")


def run_counts(engine) -> DataFrame:
    """Counts per minute and per sliding five minutes: the last output of each window wins."""
    d = _once(engine, "volumes", _volumes).result("counts")
    last = d.groupBy("w", "size", "back").agg(F.max_by("n", "batch_id").alias("n"))
    start = c("w.start") - F.make_dt_interval(mins=c("back"))
    return last.groupBy(start.alias("window_start"), "size").agg(F.sum("n").alias("n"))


def run_rate(engine) -> DataFrame:
    """Lines up to each batch, its last event time, and whether lines per second were measured."""
    d = _once(engine, "volumes", _volumes).result("rate")
    so_far = Window.orderBy("batch_id")  # a row for each batch
    return d.select("batch_id", F.sum("lines").over(so_far).alias("lines"), F.max("last_event_time").over(so_far).alias("last_event_time"),
                    (c("per_second") > 0).alias("measured"))


def run_batch_ends(engine) -> BatchTables:
    """The tables that the steps at the end of each micro-batch have written."""
    return _once(engine, "incidents", _incident_chain).tables
