"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents are shuffled and laid end to end, once per allowed pass, and cut into blocks of equal numbers of
words. The schedule maps golden-ratio points through the sources' cumulative weights; the n-th slot of a source takes its
n-th block. What the points leave a source short of (a few slots, by their discrepancy) is appended at the end, and its
last block is cut at the target, so each source gives its target to the word.
"""

from __future__ import annotations

from decimal import Decimal, localcontext

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkwarden.llm.common import n_words, placed, staged

c = F.col
WEIGHTS = (3, 1, 2)
SHARE, PASSES, BLOCK, GRID, SEED = 1.5, 2, 1024, 4096, "mix:"
LEAST_CHUNK = 256


def golden() -> tuple[float, float]:
    """The golden ratio's fraction, and that of 2^20 times it: slots up to 2^40 keep an exact fraction."""
    with localcontext() as ctx:
        ctx.prec = 60
        g = (Decimal(5).sqrt() - 1) / 2
        return float(g), float(g * (1 << 20) % 1)


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """source_no, source, source_size, target from (source, size): one row per source, numbered by code point, null last.

    Sources share `share` of all words by weight (repeating); a target stops at `passes` times its source's size and the
    excess is shared again by weight. In order of size over weight the stopped sources come first, so one pass over running
    sums finds them all."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("source_no", F.row_number().over(Window.orderBy(c("source").asc_nulls_last())))
    s = s.withColumns({"weight": F.get(F.array(*[F.lit(float(w)) for w in weights]), (c("source_no") - 1) % len(weights)),
                       "most": c("source_size") * passes, "total": F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))})
    order = Window.orderBy(c("most") / c("weight"), "source_no")
    s = s.withColumns({"given": F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
                       "open": F.sum("weight").over(Window.partitionBy()) - F.coalesce(
                           F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))})
    s = s.withColumn("stopped", c("most") * c("open") <= c("weight") * (c("total") - c("given")))
    every = Window.partitionBy()
    s = s.withColumns({"left": c("total") - F.sum(F.when(c("stopped"), c("most")).otherwise(0)).over(every),
                       "sharing": F.sum(F.when(c("stopped"), 0.0).otherwise(c("weight"))).over(every)})
    return s.select("source_no", "source", "source_size", F.when(c("stopped"), c("most").cast("double"))
                    .otherwise(c("left") * c("weight") / c("sharing")).alias("target"))


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """source_no, rank, slot, upto: which source each slot of the mix takes from, that slot's number within its source, and
    the word of the source's sequence at which its block ends. slot is null for those appended at the end."""
    spark = sources.sparkSession
    every = Window.partitionBy()
    s = (sources.select("source_no", F.round("target").cast("bigint").alias("quota")).where("quota > 0")
         .withColumn("to", F.sum("quota").over(Window.orderBy("source_no")) / F.sum("quota").over(every))
         .withColumn("from", F.coalesce(F.lag("to").over(Window.orderBy("source_no")), F.lit(0.0))))
    # Slots are numbered within a source by stretches, as many as keep a hot source spread over the cluster.
    stretches = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    slots = s.agg(F.coalesce(F.ceil(F.sum("quota") / block), F.lit(0))).first()[0]
    # Cumulative weights are looked up by equality on a grid: a cell holds the few sources whose interval meets it.
    grid = s.withColumn("cell", F.explode(F.sequence(F.floor(c("from") * GRID), F.least(F.floor(c("to") * GRID), F.lit(GRID - 1)))))
    step, far = golden()
    point = (c("slot") % (1 << 20) * F.lit(step) + F.floor(c("slot") / (1 << 20)) * F.lit(far)) % 1
    taken = (spark.range(0, slots).select(c("id").alias("slot")).withColumn("point", point)
             .withColumn("cell", F.floor(c("point") * GRID)).join(grid, "cell").where("point >= `from` and point < `to`")
             .withColumn("chunk", F.floor(c("slot") / max(LEAST_CHUNK, -(-slots // stretches)))))
    ranked = placed(taken.select("source_no", "chunk", "slot"), "source_no", "chunk", [c("slot")], F.lit(1), "rank")
    need = F.ceil(c("quota") / block)
    missing = (s.join(taken.groupBy("source_no").agg(F.count(F.lit(1)).alias("have")), "source_no", "left")
               .withColumn("have", F.coalesce("have", F.lit(0))).where(c("have") < need)
               .select("source_no", F.explode(F.sequence(c("have"), need - 1)).alias("rank"), F.lit(None).cast("bigint").alias("slot")))
    return (ranked.select("source_no", "rank", "slot").unionByName(missing).join(s.select("source_no", "quota"), "source_no")
            .select("source_no", "rank", "slot", F.least((c("rank") + 1) * block, "quota").alias("upto"))
            .where(c("upto") > c("rank") * block))


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, passes: int = PASSES, block: int = BLOCK,
          carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, slot (and the columns `carried`) of every row of `docs` (doc_id, text, source).

    size counts the words `[^\\x20\\x09-\\x0D]+` of the whole text. taken counts the words of the row that the mix takes;
    it is never above `passes` times size. A document at the edge of a target is taken in part. slot is the first place of the
    schedule that takes from the row: rows in its order are the interleaved mix. It is null where none does.

    Null or empty texts have size 0 and nothing taken. A null source is a source, the last one. Equal and null doc_ids are
    told apart by their place in the shuffle; equal rows are taken one after the other, in either order. No documents, or
    none with words, give targets of 0. Other columns are not read. A source may hold any share of the rows: it is ordered
    in 4096 cells, and blocks are joined by (source, block).
    """
    key = F.md5(F.concat(F.lit(SEED), F.coalesce(c("doc_id").cast("string"), F.lit(""))))
    slim = staged(docs.select("doc_id", "source", n_words(c("text")).alias("size"), key.alias("key"), *carried), "mix-sizes")
    sources = staged(targets(slim, weights, share, passes), "mix-sources")
    rows = slim.join(sources.withColumnRenamed("source", "of"), c("source").eqNullSafe(c("of"))).drop("of")
    rows = rows.withColumn("cell", F.substring("key", 1, 3))
    order = [c("key"), c("doc_id"), c("size")]
    rows = placed(rows, "source_no", "cell", order, c("size"), "start")
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("source_no", "cell").orderBy(*order)))
    rows = staged(rows, "mix-rows")
    begin = c("start") + c("pass") * c("source_size")
    pieces = (rows.where("size > 0").select("source_no", "cell", "nth", "size", "start", "source_size",
                                            F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass"))
              .select("source_no", "cell", "nth", begin.alias("begin"), (begin + c("size")).alias("end"))
              .withColumn("rank", F.explode(F.sequence(F.floor(c("begin") / block), F.floor((c("end") - 1) / block)))))
    met = F.least("end", "upto") - F.greatest("begin", c("rank") * block)
    used = (pieces.join(schedule(sources, block), ["source_no", "rank"]).groupBy("source_no", "cell", "nth")
            .agg(F.sum(F.greatest(F.lit(0), met)).alias("taken"), F.min(F.when(met > 0, c("slot"))).alias("slot")))
    return (rows.join(used, ["source_no", "cell", "nth"], "left")
            .select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), "slot", *carried))


def remixed(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, passes: int = PASSES, block: int = BLOCK) -> DataFrame:
    """The mix itself: the rows of `docs` (doc_id, text, source), each as often as the mix takes it, all columns as they are.

    A row of which the mix takes at least half once more appears once more; only the row at the edge of a source's target is
    taken in part. Rows without words are not taken. Cases as for mixed(); equal rows are repeated together.
    """
    # The caller's columns travel as one, so none of their names can meet one used here.
    keyed = docs.select(F.struct(*[c(f"`{n}`") for n in docs.columns]).alias("row"), "doc_id", "text", "source",
                        F.xxhash64(*[c(f"`{n}`") for n in docs.columns]).alias("mark"))
    times = F.floor(c("taken") / c("size") + 0.5)
    plan = (mixed(keyed, weights, share, passes, block, ("mark",)).where("size > 0").groupBy(c("doc_id").alias("id"), "mark")
            .agg(F.sum(times).cast("int").alias("times"), F.count(F.lit(1)).alias("n")).where("times > 0"))
    plan = staged(plan, "mix-plan")
    rows = keyed.select("row", c("doc_id").alias("of_id"), c("mark").alias("of_mark"))
    same = c("of_id").eqNullSafe(c("id")) & (c("of_mark") == c("mark"))
    out = rows.join(plan.where("n = 1"), same)
    equal = plan.where("n > 1")
    if equal.take(1):
        out = out.unionByName(rows.join(equal, same).dropDuplicates(["id", "mark"]))
    return out.withColumn("time", F.explode(F.sequence(F.lit(1), "times"))).select(*[c(f"row.`{n}`") for n in docs.columns])


ORACLE = f"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
         md5('{SEED}' || coalesce(doc_id::varchar, '')) as key from documents),
totals as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as no from sized group by source),
weighed as (
  select *, [3.0, 1.0, 2.0][((no - 1) % 3 + 1)::bigint]::double as weight, source_size * 2 as most, sum(source_size) over () * 1.5::double as total from totals),
filled as (
  select *, coalesce(sum(most) over (order by most / weight, no rows between unbounded preceding and 1 preceding), 0) as given,
         sum(weight) over (order by most / weight, no rows between current row and unbounded following) as open from weighed),
split as (select *, most * open <= weight * (total - given) as stopped from filled),
aimed as (
  select no, source, source_size, case when stopped then most::double else
           (total - sum(case when stopped then most else 0 end) over ()) * weight
           / sum(case when stopped then 0.0::double else weight end) over () end as target from split),
laid as (
  select a.no, s.doc_id, s.size, a.source_size, a.target, round(a.target) as quota,
         row_number() over () as row, coalesce(sum(s.size) over (partition by a.no order by s.key, s.doc_id, s.size rows between unbounded preceding and 1 preceding), 0) as start
  from sized s join aimed a on s.source is not distinct from a.source),
shares as (
  select no, quota, sum(quota) over (order by no) / sum(quota) over () as upto from (select no, round(target)::bigint as quota from aimed) where quota > 0),
spans as (select *, coalesce(lag(upto) over (order by no), 0) as since from shares),
points as (
  select slot, (slot % 1048576 * {golden()[0]!r}::double + (slot // 1048576) * {golden()[1]!r}::double) % 1 as point
  from (select unnest(range((select coalesce(ceil(sum(quota) / {BLOCK}), 0)::bigint from spans))) as slot)),
slots as (
  select s.no, p.slot, s.quota, row_number() over (partition by s.no order by p.slot) - 1 as rank
  from points p join spans s on p.point >= s.since and p.point < s.upto),
passed as (select row, no, size, start + pass * source_size as since from laid, (select unnest([0, 1]) as pass) where size > 0),
met as (
  select p.row, min(s.slot) as slot from passed p join slots s on s.no = p.no and s.rank * {BLOCK} < p.since + p.size and (s.rank + 1) * {BLOCK} > p.since
   and least(p.since + p.size, (s.rank + 1) * {BLOCK}, s.quota) > greatest(p.since, s.rank * {BLOCK}) group by p.row)
select doc_id, size, source_size, target,
       (greatest(0, least(start + size, quota) - start) + greatest(0, least(start + source_size + size, quota) - start - source_size))::bigint as taken, slot
from laid left join met using (row)
"""
