"""Exports and published slices. Every writer is a distributed write; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col


def named_texts(rows: DataFrame, folder: str) -> None:
    """Writes rows (file, seq, value) as one text file for each `file`, under that very name, in order of seq.

    Each file is written by one task beside the folder and then moved, which replaces a file of that name."""
    spark = rows.sparkSession
    spare = f"{folder}-spare"
    (rows.repartition("file").sortWithinPartitions("file", "seq").select("file", "value").write.partitionBy("file").mode("overwrite").text(spare))
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(folder))
    for f in fs.globStatus(path(f"{spare}/file=*/part-*")):
        to = path(f"{folder}/{f.getPath().getParent().getName().removeprefix('file=')}")
        fs.delete(to, False)
        if not fs.rename(f.getPath(), to):
            raise OSError(f"{to} could not be written")


def csv_rows(entries: DataFrame) -> DataFrame:
    """Columns of the CSV export: no nulls, ISO times, messages cut to 300 characters."""
    iso = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    whole = F.unix_micros("timestamp") % 1_000_000 == 0
    return entries.select(
        "event_id", F.when(whole, iso).otherwise(micros).alias("timestamp"), "hostname", F.coalesce("source_ip", F.lit("")).alias("source_ip"),
        F.coalesce("username", F.lit("")).alias("username"), "service", "event_type", "severity",
        F.substring("message", 1, 300).alias("message"), "log_format")


def write_csv(entries: DataFrame, path: str) -> None:
    csv_rows(entries).write.mode("overwrite").option("header", True).option("emptyValue", "").option("escape", '"').csv(path)


def report_alerts(alerts: DataFrame, n: int = 500) -> DataFrame:
    """The last n alerts, oldest first."""
    last = alerts.orderBy(c("seq").desc(), c("rule_ord").desc()).limit(n)
    return last.orderBy("seq", "rule_ord")


#: Times in JSON, as ISO text.
ISO = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss"}


def report_parts(stats: DataFrame, entries: DataFrame, incidents: DataFrame, alerts: DataFrame) -> dict[str, DataFrame]:
    """The four parts of the report: metadata, statistics, incidents (all columns given) and the last alerts."""
    meta = entries.agg(F.count("*").alias("total_entries_analyzed"))
    return {"report_metadata": meta, "statistics": stats, "incidents": incidents, "alerts": report_alerts(alerts)}


def write_json_report(path: str, stats: DataFrame, entries: DataFrame, incidents: DataFrame, alerts: DataFrame) -> None:
    """The report as four JSON tables; the metadata tell when it was written."""
    for name, d in report_parts(stats, entries, incidents, alerts).items():
        d = d.withColumn("generated_at", F.current_timestamp()) if name == "report_metadata" else d
        d.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/{name}")


def json_rows(d: DataFrame) -> DataFrame:
    """Nested rows as one JSON text each, nulls included."""
    return d.select(F.to_json(F.struct("*"), ISO).alias("json"))


def report_rows(parts: dict[str, DataFrame]) -> DataFrame:
    """(part, json): the whole report, a text for each of its objects."""
    out = None
    for name, d in parts.items():
        rows = json_rows(d).select(F.lit(name).alias("part"), "json")
        out = rows if out is None else out.unionByName(rows)
    return out


def newest_entries(entries: DataFrame, n: int = 50) -> DataFrame:
    return entries.orderBy(c("seq").desc()).limit(n)


def latest_update(updates: DataFrame) -> DataFrame:
    """The last update of each incident: what an upsert by incident leaves."""
    rest = [x for x in updates.columns if x != "incident_key"]
    return (updates.groupBy("incident_key").agg(F.max_by(F.struct(*rest), F.struct("t", "seq")).alias("u"))
            .select("incident_key", "u.*"))
