"""What the operators share: staged tables, running sums that spread hot keys, and A-Z lower-casing."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwarden.plans.store import shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """The table, written to the shared folder and read again: cuts lineage and survives lost executors."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Shuffle files go once the table is written, not when the driver collects garbage; texts go to Python workers in small batches,
#: since the executor and the worker of each of its tasks hold a whole one.
STEP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def step(df: DataFrame, name: str) -> DataFrame:
    """staged(), for jobs with much to shuffle or with many texts, under the settings of STEP."""
    conf = df.sparkSession.conf
    before = {key: conf.get(key, None) for key in STEP}
    try:
        for key, value in STEP.items():
            conf.set(key, value)
        return staged(df.select("*"), name)
    finally:
        for key, value in before.items():
            if value is None:
                conf.unset(key)
            else:
                conf.set(key, value)


def removed(*tables: DataFrame) -> None:
    """Removes the files of staged tables that nothing will read any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def placed(rows: DataFrame, key: str, cell: str, order: list[Column], size: Column, before: str) -> DataFrame:
    """Adds the sum of `size` over the rows of the same key that come earlier in (cell, order).

    A key may hold any share of the rows: each (key, cell) is ordered on its own, and only the cells' sums are put in
    order per key. `key` must not be null.
    """
    rows = rows.withColumn("_size", size.cast("bigint"))
    cells = rows.groupBy(key, cell).agg(F.sum("_size").alias("_sum"))
    earlier = Window.partitionBy(key).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(key, cell, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    local = Window.partitionBy(key, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.withColumn("_local", F.coalesce(F.sum("_size").over(local), F.lit(0)))
    return (inner.join(offsets, [key, cell]).withColumn(before, F.col("_offset") + F.col("_local"))
            .drop("_size", "_offset", "_local"))
