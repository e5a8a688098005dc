"""Failure lists that a successful login clears, without walking a source's history on one task.

Number a source's failures 1, 2, 3, ... A login after failure p raises the alert and clears the list exactly when at
least three uncleared failures lie in the window ending at failure p. With the windowed count w(p), that means
w(p) >= 3 and p >= r + 3, where r is the failure number at the last clearing. So the clearings are the greedy choice
of numbers p at least 3 apart among the candidates {p : w(p) >= 3, a login follows failure p}.

The choice inside a chunk of numbers depends on earlier chunks only through how many of its first numbers are barred
(0, 1 or 2). Chunks are therefore summed up as maps from 3 entry states to 3 exit states, maps are composed over a tree whose
nodes have FAN children, and the entry states are handed back down. A row of any level holds at most FAN numbers or maps,
so the work is linear in the candidates, and a level has a 32nd of the rows of the one below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.operators.ordered import Running, with_totals

CHUNK, FAN = 4096, 32


def _choose(candidates: Column, start: Column, gap: int) -> Column:
    """struct(next free number, chosen numbers) of the greedy choice from start on."""
    zero = F.struct(start.alias("free"), F.array().cast("array<bigint>").alias("chosen"))

    def step(s: Column, p: Column) -> Column:
        taken = F.struct((p + gap).alias("free"), F.concat(s["chosen"], F.array(p)).alias("chosen"))
        return F.when(p >= s["free"], taken).otherwise(s)
    return F.aggregate(candidates, zero, step)


def _follow(maps: Column, first: Column, entry: Column, last: Column) -> Column:
    """The state behind `last` of sorted (i, exits) maps, entered before `first`. A missing i frees all."""
    def step(s: Column, m: Column) -> Column:
        state = F.when(s["i"] == m["i"], s["state"]).otherwise(0)
        return F.struct((m["i"] + 1).alias("i"), F.element_at(m["exits"], state + 1).alias("state"))
    end = F.aggregate(maps, F.struct(first.alias("i"), entry.cast("int").alias("state")), step)
    return F.when(end["i"] == last, end["state"]).otherwise(0)


def _entries(maps: Column, first: Column, entry: Column) -> Column:
    """(i, entry state) of each of at most FAN maps."""
    zero = F.struct(first.alias("i"), entry.cast("int").alias("state"),
                    F.array().cast("array<struct<i:bigint,state:int>>").alias("seen"))

    def step(s: Column, m: Column) -> Column:
        state = F.when(s["i"] == m["i"], s["state"]).otherwise(0)
        return F.struct((m["i"] + 1).alias("i"), F.element_at(m["exits"], state + 1).alias("state"),
                        F.concat(s["seen"], F.array(F.struct(m["i"].alias("i"), state.alias("state")))).alias("seen"))
    return F.aggregate(maps, zero, step)["seen"]


def clearings(candidates: DataFrame, key: str, number: str, gap: int, chunk: int = FAN,
              cut=lambda name, df: df) -> DataFrame:
    """candidates(key, number), one row each, to the chosen (key, number). cut(name, df) writes a level of the tree as a table."""
    c = F.col
    chunks = candidates.groupBy(key, F.floor(c(number) / chunk).alias("i")).agg(F.sort_array(F.collect_list(number)).alias("numbers"))
    exits = F.array(*[F.greatest(F.lit(0), (_choose(c("numbers"), c("i") * chunk + d, gap)["free"] - (c("i") + 1) * chunk)).cast("int")
                      for d in range(gap)])
    levels = [cut("clearing_chunks", chunks.withColumn("exits", exits))]
    top = levels[0].agg(F.max("i")).first()[0] or 0
    while top:
        top //= chunk
        maps = (levels[-1].groupBy(key, F.floor(c("i") / chunk).alias("up"))
                .agg(F.sort_array(F.collect_list(F.struct("i", "exits"))).alias("maps")).withColumnRenamed("up", "i"))
        first, last = c("i") * chunk, (c("i") + 1) * chunk
        levels.append(cut(f"clearing_level_{len(levels)}", maps.withColumn(
            "exits", F.array(*[_follow(c("maps"), first, F.lit(d), last) for d in range(gap)]))))
    entries = levels[-1].select(key, "i", F.lit(0).alias("entry"))
    for level in reversed(levels[1:]):
        seen = level.join(entries, [key, "i"]).select(key, F.explode(_entries(c("maps"), c("i") * chunk, c("entry"))).alias("x"))
        entries = seen.select(key, c("x.i").alias("i"), c("x.state").alias("entry"))
    return (levels[0].join(entries, [key, "i"])
            .select(key, F.explode(_choose(c("numbers"), c("i") * chunk + c("entry"), gap)["chosen"]).alias(number)))


def last_cleared(rows: DataFrame, cleared: DataFrame, key: str, number: str, out: str) -> DataFrame:
    """Adds to rows(key, number, ...) the largest cleared number below or equal to theirs, null if none."""
    both = (rows.withColumn("_cleared", F.lit(None).cast("bigint"))
            .unionByName(cleared.select(key, number, F.col(number).alias("_cleared")), allowMissingColumns=True)
            .withColumn("_row", F.col("_cleared").isNull()))
    both = with_totals(both, [key], {out: Running(F.col("_cleared"), "max")}, t=number, seq=number, slice_width=CHUNK)
    return both.where("_row").drop("_cleared", "_row")
