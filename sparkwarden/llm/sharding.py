"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has `points` places on a ring of 65536 cells. A row hashes to a cell and belongs to the next place clockwise;
what is between two places is an arc. A shard takes rows from its own arcs until it is full; the rest goes on clockwise to
the next shard with room. Loads are bounded at the even share, rounded down or up, so counts are at most one apart.

Rows of an arc are alike but for their rank, so the walk around the ring is done on the arcs' counts (shards x points
numbers) and gives ranges of ranks.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkwarden.llm.common import placed

c = F.col
CELLS, POINTS, SEED = 1 << 16, 128, 7


def cell_of(hashed: Column) -> Column:
    return F.pmod(hashed, F.lit(CELLS)).cast("int")


def ring(spark, shards: int, points: int = POINTS) -> DataFrame:
    """arc, owner, cell: the places of all shards, numbered clockwise."""
    places = spark.range(shards * points).select(
        "id", (c("id") % shards).cast("int").alias("owner"), F.floor(c("id") / shards).alias("point")).withColumn(
        "cell", cell_of(F.xxhash64(F.lit(SEED), "owner", "point")))  # a shard's places do not depend on the others
    return places.select(F.row_number().over(Window.orderBy("cell", "id")).alias("arc"), "owner", "cell")


def arcs(spark, shards: int, points: int = POINTS) -> DataFrame:
    """cell, arc, owner: the first place at or after each cell, around the ring."""
    places = ring(spark, shards, points).groupBy("cell").agg(F.min_by(F.struct("arc", "owner"), "arc").alias("place"))
    cells = spark.range(CELLS).select(c("id").cast("int").alias("cell")).join(places, "cell", "left")
    # Counted back from the last cell, as a frame that only grows is summed in one go.
    ahead = Window.orderBy(c("cell").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    place = F.coalesce(F.last("place", ignorenulls=True).over(ahead), F.min("place").over(Window.partitionBy()))
    return cells.withColumn("place", place).select("cell", "place.arc", "place.owner")


def walk(counts: list[tuple[int, int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """From (arc, owner, rows) clockwise: (arc, from rank, to rank, shard, first slot). Sums of counts only, no rows."""
    rows = sum(n for _, _, n in counts)
    room = [rows // shards + (s < rows % shards) for s in range(shards)]
    full = list(room)
    out, stay = [], {}

    def give(arc, lo, n, shard):
        out.append((arc, lo, lo + n, shard, full[shard] - room[shard]))
        room[shard] -= n

    for arc, owner, n in counts:
        stay[arc] = min(n, room[owner])
        if stay[arc]:
            give(arc, 0, stay[arc], owner)
    waiting: deque[list[int]] = deque()
    for lap in range(2):
        for arc, owner, n in counts:
            if not lap and n > stay[arc]:
                waiting.append([arc, stay[arc], n - stay[arc]])
            while waiting and room[owner]:
                first = waiting[0]
                n_here = min(first[2], room[owner])
                give(first[0], first[1], n_here, owner)
                first[1] += n_here
                first[2] -= n_here
                if not first[2]:
                    waiting.popleft()
    return out


def sharded(docs: DataFrame, shards: int, points: int = POINTS) -> DataFrame:
    """All rows and columns of `docs` (doc_id, text), with shard (int) and slot (bigint, gapless from 0 within a shard).

    Rows are placed by doc_id; ties within a cell are ordered by hash, doc_id and the text's crc32, so reruns agree. Null
    doc_ids share a cell; null and empty texts are rows like any other; repeated rows are counted each, in either order.
    No rows give none. Columns named shard or slot are replaced; other columns pass through unchanged.

    The ring's cells spread any hot source or group of copies, as only doc_id decides. The first pass reads doc_id alone.
    """
    spark = docs.sparkSession
    hashed = F.xxhash64(F.lit(SEED), c("doc_id"))
    around = arcs(spark, shards, points)
    counts = (docs.select(cell_of(hashed).alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
              .join(F.broadcast(around), "cell").groupBy("arc").agg(F.sum("n").alias("n")))
    # All places, those without rows too: shards x points numbers.
    counts = ring(spark, shards, points).join(counts, "arc", "left").select("arc", "owner", F.coalesce("n", F.lit(0)).alias("n"))
    ranges = walk(sorted((r.arc, r.owner, r.n) for r in counts.collect()), shards)
    values = ", ".join(str(r) for r in ranges) or "(0, 0, 0, 0, 0)"
    parts = spark.sql(f"select int(a) as arc, bigint(l) as low, bigint(h) as high, int(s) as shard, bigint(b) as first "
                      f"from values {values} as t(a, l, h, s, b)")
    kept = [n for n in docs.columns if n.lower() not in ("shard", "slot")]
    # The caller's columns travel as one, so none of their names can meet one used here.
    crc = F.crc32(F.coalesce(c("text").cast("string"), F.lit("")).cast("binary"))
    inner = (docs.select(F.struct(*[c(f"`{n}`") for n in kept]).alias("row"), hashed.alias("hash"), cell_of(hashed).alias("cell"), "doc_id", crc.alias("crc"))
             .join(F.broadcast(around.select("cell", "arc")), "cell"))
    ranked = placed(inner, "arc", "cell", [c("hash"), c("doc_id"), c("crc")], F.lit(1), "rank")
    return (ranked.join(F.broadcast(parts), "arc").where("rank >= low and rank < high")
            .select(*[c(f"row.`{n}`") for n in kept], "shard", (c("first") + c("rank") - c("low")).alias("slot")))
