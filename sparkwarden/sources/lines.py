"""Where raw lines come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwarden.dims import LOG_NAMES
from sparkwarden.functions.parsing import INNER_LINE_ENDS, trimmed

LOG_GLOB = "{*.log,syslog,messages}"


def _to_lines(raw: DataFrame) -> DataFrame:
    """value, _metadata to non-blank trimmed lines; rows holding other line ends are split."""
    split = F.when(F.col("value").rlike(INNER_LINE_ENDS), F.split("value", INNER_LINE_ENDS)).otherwise(F.array("value"))
    return (raw.select(F.explode(split).alias("value"),
                       F.col("_metadata.file_path").alias("source_file"),
                       F.col("_metadata.file_modification_time").alias("modified"))
            .withColumn("value", trimmed(F.col("value"))).where(F.col("value") != ""))


def read_lines(spark: SparkSession, path, modified_after: str | None = None, glob: str = LOG_GLOB) -> DataFrame:
    """Batch read of a log file, a folder or several. seq follows the order of lines within each file.

    seq depends on how the files are split, so it is fixed by writing the entries table once and reading it after that.
    """
    reader = spark.read.format("text").option("pathGlobFilter", glob)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    lines = _to_lines(reader.load(path))
    return lines.select(F.monotonically_increasing_id().alias("seq"), "value", "source_file", "modified")


LINE_BITS = 24


def stream_lines(spark: SparkSession, folder: str, start_from: str | None = None, files_per_batch: int = 1000,
                 glob: str = LOG_GLOB) -> DataFrame:
    """Every new closed file of a folder. The file source does not follow appended bytes: land rolled segments.

    A segment is read whole, so a line's number within it is known and equal lines stay apart: seq is made of a hash of the
    file and of that number. A segment may have 2^24 lines; a longer one is refused.
    """
    raw = (spark.readStream.format("text").option("pathGlobFilter", glob).option("wholetext", True)
           .option("maxFilesPerTrigger", files_per_batch).load(folder))
    cut = F.split(F.regexp_replace("value", "\r\n?", "\n"), INNER_LINE_ENDS + "|\n")
    lines = raw.select(F.posexplode(cut).alias("n", "value"), F.col("_metadata.file_path").alias("source_file"),
                       F.col("_metadata.file_modification_time").alias("modified"))
    number = F.when(F.col("n") < 1 << LINE_BITS, F.col("n")).otherwise(F.raise_error(F.lit("more than 2^24 lines in one segment")).cast("int"))
    seq = F.shiftleft(F.shiftrightunsigned(F.xxhash64("source_file"), LINE_BITS + 1), LINE_BITS).bitwiseOR(number.cast("bigint"))
    lines = (lines.withColumn("value", trimmed(F.col("value"))).where(F.col("value") != "")
             .select(seq.alias("seq"), "value", "source_file", "modified"))
    return lines if start_from is None else lines.where(F.col("modified") >= F.lit(start_from).cast("timestamp"))


def discover_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files a folder watch would take, by name."""
    name = F.col("name")
    return (_files(spark, folder).where(name.endswith(".log") | name.isin(LOG_NAMES)).orderBy("name"))


def list_log_files(spark: SparkSession, folders: list[str]) -> DataFrame:
    """Name, path and size; also takes names without any suffix."""
    name = F.col("name")
    keep = name.endswith(".log") | ~F.contains(F.regexp_replace(name, r"^\.+", ""), F.lit(".")) | name.isin(LOG_NAMES)
    return _files(spark, folders).where(keep).orderBy("name", "path")


def _files(spark: SparkSession, path) -> DataFrame:
    """Content is not selected, so it is not read."""
    return (spark.read.format("binaryFile").load(path)
            .select(F.element_at(F.split("path", "/"), -1).alias("name"), "path", F.col("length").alias("size_bytes")))


#: The last whole second that a timestamp, which counts microseconds in 64 bits, can hold.
LAST_SECOND = ((1 << 63) - 1) // 1_000_000


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines as a projection of the events table: the stand-in for traffic where only tables are given.

    Five addresses act all the time; in every fourth stretch of 200 seconds two others take their place, aim at one account
    and are not seen again. Some lines name no address, some are of rare kinds, and some scan ports.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type")
    i, u, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")

    def num(x: Column) -> Column:
        return x.cast("string")

    stretch = F.floor(i / 1000)
    second = F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp")) + F.floor(i / 5)
    # An id may be any bigint: seconds that no timestamp holds are taken modulo 2^32.
    t = F.timestamp_seconds(F.when(second.between(-LAST_SECOND, LAST_SECOND), second).otherwise(F.pmod(second, F.lit(1 << 32))))
    ip = (F.when(stretch % 4 == 3, F.concat(F.lit("10.1."), num(stretch % 250), F.lit("."), num(u % 2 + 1)))
          .otherwise(F.concat(F.lit("10.0.0."), num(u % 5 + 1))))
    scanner = F.when(i % 2000 < 200, "10.2.0.9").otherwise(ip)
    origin = F.when(i % 7 == 3, "gateway").otherwise(ip)
    pid = num(1000 + i % 9000)
    acct = F.concat(F.lit("acct"), num(F.when(stretch % 4 == 3, stretch % 20).otherwise(u % 20)))
    bsd = F.date_format(t, "MMM dd HH:mm:ss")
    who = F.when(i % 11 == 0, "root").when(u % 7 == 0, F.concat(F.lit("invalid user "), acct)).otherwise(acct)
    path = (F.when(i % 17 == 0, "/../../etc/passwd").when(i % 19 == 0, "/login?x=admin'--")
            .otherwise(F.concat(F.lit("/p"), num(i % 40))))
    agent = F.when(i % 13 == 0, "sqlmap/1.7.10").otherwise("Mozilla/5.0")
    line = (
        F.when(i % 997 == 0, F.concat(bsd, F.lit(" prod-01 kernel: [452.1] Kernel panic - not syncing")))
        .when(i % 991 == 0, F.concat(bsd, F.lit(" prod-01 app[9]: write failed: No space left on device")))
        .when(kind == "error", F.concat(bsd, F.lit(" prod-01 sshd["), pid, F.lit("]: Failed password for "), who,
                                         F.lit(" from "), origin, F.lit(" port 22 ssh2")))
        .when(kind == "purchase", F.concat(bsd, F.lit(" prod-01 sshd["), pid, F.lit("]: Accepted password for "), acct,
                                           F.lit(" from "), ip, F.lit(" port 22 ssh2")))
        .when(kind == "view", F.concat(ip, F.lit(" - - ["), F.date_format(t, "dd/MMM/yyyy:HH:mm:ss"),
                                       F.lit(' +0000] "GET '), path, F.lit(' HTTP/1.1" 404 200 "-" "'), agent, F.lit('"')))
        .when(kind == "click", F.concat(bsd, F.lit(" prod-01 kernel: [UFW BLOCK] IN=eth0 OUT= SRC="), scanner,
                                        F.lit(" DST=192.168.1.10 PROTO=TCP SPT=40000 DPT="), num(20 + i % 60)))
        .when(i % 2 == 0, F.concat(bsd, F.lit(" prod-01 su["), pid,
                                   F.lit("]: pam_unix(su:session): session opened for user root by "), acct))
        .otherwise(F.concat(bsd, F.lit(" prod-01 svc"), num(u % 3), F.lit("[77]: worker segfault at 0")))
    )
    return e.select(i.alias("seq"), line.alias("value"), F.lit("events").alias("source_file"), t.alias("modified"))
