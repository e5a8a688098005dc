"""URL filters: allow and block rules on (host, path prefix), judged by a sorted sweep.

Hosts are keyed by their reversed labels (`com.example.www`), so that a host and its subdomains share prefixes. A page is
entered once under each reversed host prefix that some rule names; there, a rule's path is an interval of paths, and
intervals nest. Rules and pages are merged in path order; the last rule passed carries the stack of rules it lies in,
and the first of the stack that the page's path starts with is the longest fitting one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwarden.llm.common import lower_ascii

c = F.col
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\.", -1))


def stacks(rules: DataFrame) -> DataFrame:
    """Per rule (host_key, path): itself and the rules of its host that it lies in, longest path first.

    Enclosing rules are looked up by equality on the prefixes of those lengths that the host's rules have."""
    one = rules.groupBy(c("host_key"), c("path")).agg(F.max("verdict").alias("verdict"), F.first("rule").alias("rule"))
    lengths = one.groupBy("host_key").agg(F.collect_set(F.length("path")).alias("lengths"))
    prefixes = (one.select("host_key", "path").join(lengths, "host_key")
                .withColumn("n", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))))
                .select("host_key", "path", c("path").substr(F.lit(1), c("n")).alias("outer")))
    found = prefixes.join(one.withColumnRenamed("path", "outer"), ["host_key", "outer"])
    entry = F.struct(F.length("outer").alias("n"), c("outer").alias("path"), "rule", "verdict")
    return found.groupBy("host_key", "path").agg(F.sort_array(F.collect_list(entry), asc=False).alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of `pages` (page_id, url); `rules` has host, path, verdict.

    The host is what stands between the first `://` and `/`, `?`, `#` or the end, A-Z lower-cased; the path follows up to
    `?`, `#` or the end. A rule fits its host and all subdomains if the path starts with its path. The rule with the
    longest host wins, then the longest path; of two equal rules, block. Without one the verdict is `default`.

    A url that is null, empty or has no `://` has an empty host and path and gets the default. Rows are kept as they are:
    repeated rows and null page_ids give a row each. No pages give no rows, no rules the default for all. A null host,
    path or verdict makes a rule void. Other columns are not read. Hosts of any number of labels: only as many as the
    longest rule host has are looked at.

    One host may hold any share of the pages: it is split into cells in proportion, each with a copy of its rules.
    """
    spark = pages.sparkSession
    wide = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rules = (rules.where("host is not null and path is not null and verdict is not null")
             .select(lower_ascii(c("host")).alias("host"), "path", "verdict")
             .select(F.array_join(reversed_labels(c("host")), ".").alias("host_key"), "path", "verdict",
                     F.concat("host", "path").alias("rule"), F.size(F.split("host", r"\.", -1)).alias("labels")))
    known = rules.groupBy("host_key").agg(F.max("labels").alias("labels"))
    # Row numbers come from the scan, before any shuffle, so a repeated task gives the same ones.
    rows = pages.select("page_id", host_of(c("url")).alias("host"), path_of(c("url")).alias("path")).withColumn(
        "row", F.monotonically_increasing_id())
    deepest = known.agg(F.coalesce(F.max("labels"), F.lit(0))).first()[0]
    labels = reversed_labels(c("host"))
    keys = (rows.select("row", "path", F.explode(F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(deepest))) if deepest else F.array().cast("array<int>"),
        lambda n: F.array_join(F.slice(labels, F.lit(1), n), "."))).alias("host_key"))
        .join(known, "host_key", "left_semi"))
    counts = keys.groupBy("host_key").agg(F.count(F.lit(1)).alias("n"))
    cells = counts.select("host_key", F.ceil(c("n") * wide / F.sum("n").over(Window.partitionBy())).cast("int").alias("cells"))
    stack_type = "array<struct<n:int,path:string,rule:string,verdict:string>>"
    marked = keys.join(cells, "host_key").select(
        "host_key", F.pmod(F.xxhash64("row"), c("cells")).cast("int").alias("cell"), "path", "row",
        F.lit(None).cast(stack_type).alias("stack"))
    signs = stacks(rules).join(cells, "host_key").select(
        "host_key", F.explode(F.sequence(F.lit(0), c("cells") - 1)).alias("cell"), "path", F.lit(None).cast("bigint").alias("row"), "stack")
    sweep = (Window.partitionBy("host_key", "cell").orderBy("path", c("row").asc_nulls_first())
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # Dealt by both: the joins before leave rows dealt by host alone, which would do for the window but not spread a hot host.
    dealt = marked.unionByName(signs).repartition("host_key", "cell")
    hits = (dealt.withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).where("row is not null")
            .withColumn("hit", F.get(F.filter("stack", lambda r: F.startswith(c("path"), r["path"])), F.lit(0))).where("hit is not null"))
    best = F.max(F.struct(F.length("host_key").alias("host"), c("hit.n"), c("hit.rule"), c("hit.verdict")))
    nothing = F.lit(None).cast("string")
    found = (rows.withColumns({"host_key": nothing, "hit": F.lit(None).cast("struct<n:int,path:string,rule:string,verdict:string>")})
             .unionByName(hits.select("row", "host_key", "hit"), allowMissingColumns=True))
    return (found.groupBy("row").agg(F.max("page_id").alias("page_id"), F.max("host").alias("host"), F.max("path").alias("path"), best.alias("best"))
            .select("page_id", "host", "path", c("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")))
