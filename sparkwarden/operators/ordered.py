"""Order-dependent totals that do not put a whole hot key on one task.

A plain window by key sends every row of a key to one task, and fails when one source holds a third of the rows. So rows
are grouped in three steps, each fixed by the data alone (a lost executor recomputes the same groups):

  cell   one key, one timestamp, one block of 2^20 seq values   -> window over at most 2^20 rows
  slice  the cells of one key in one span of time               -> window over one row per cell
  key    the slices of one key                                  -> window over one row per slice

Rows are shuffled once, by cell. Only the cells (partially aggregated before their shuffle) go further. There is one plan
at every size, and none of it runs while a plan is built. plan="keys" names the plain window instead, for keys known to be small.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BITS = 20
SECOND = 1_000_000
SLICE_US = 60 * SECOND


@dataclass(frozen=True)
class Running:
    """Total of value over all earlier rows of the key and this one. how: sum, min or max."""
    value: Column
    how: str = "sum"


@dataclass(frozen=True)
class Sliding:
    """Sum of value over rows of the key within window_us before this row, and this one.

    open leaves out rows exactly window_us ago.
    """
    value: Column
    window_us: int
    open: bool


def _fold(how: str):
    return {"sum": F.sum, "min": F.min, "max": F.max}[how]


def _join(how: str, a: Column, b: Column) -> Column:
    if how == "sum":
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return F.least(a, b) if how == "min" else F.greatest(a, b)


def with_totals(df: DataFrame, keys: list[str], totals: dict[str, Running | Sliding], t: str = "t", seq: str = "seq",
                slice_width: int = SLICE_US, plan: str = "cells") -> DataFrame:
    """Adds one column per total, in (t, seq) order within the keys. Keys must not be null.

    Rows with equal (t, seq) count as one step, so all of them see each other. Both plans, cells and keys, give the same.
    """
    if plan == "keys":
        return _by_key(df, keys, totals, t, seq)
    return _by_cell(df, keys, totals, t, seq, slice_width)


def _by_key(df: DataFrame, keys: list[str], totals: dict[str, Running | Sliding], t: str, seq: str) -> DataFrame:
    so_far = Window.partitionBy(*keys).orderBy(t, seq).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same_t = Window.partitionBy(*keys, t).orderBy(seq).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    by_t = Window.partitionBy(*keys).orderBy(t)
    out = df
    for n, x in totals.items():
        if isinstance(x, Running):
            out = out.withColumn(n, _fold(x.how)(x.value).over(so_far))
            if x.how == "sum":
                out = out.withColumn(n, F.coalesce(n, F.lit(0)))
        else:
            earlier = by_t.rangeBetween(-(x.window_us - 1) if x.open else -x.window_us, -1)
            out = out.withColumn(n, _join("sum", F.sum(x.value).over(earlier), F.sum(x.value).over(same_t)))
    return out


def _by_cell(df: DataFrame, keys: list[str], totals: dict[str, Running | Sliding], t: str, seq: str, slice_width: int) -> DataFrame:
    running = {n: x for n, x in totals.items() if isinstance(x, Running)}
    sliding = {n: x for n, x in totals.items() if isinstance(x, Sliding)}
    how = {n: (x.how if isinstance(x, Running) else "sum") for n, x in totals.items()}

    d = df.withColumn("_block", F.shiftright(F.col(seq), BLOCK_BITS))
    for n, x in totals.items():
        d = d.withColumn(f"_v_{n}", x.value)
    cell = [*keys, t, "_block"]
    in_cell = Window.partitionBy(*cell).orderBy(seq).rangeBetween(Window.unboundedPreceding, 0)
    rows = d
    for n in totals:
        rows = rows.withColumn(f"_r_{n}", _fold(how[n])(f"_v_{n}").over(in_cell))

    cells = d.groupBy(*cell).agg(*[_fold(how[n])(f"_v_{n}").alias(f"_c_{n}") for n in totals])
    carry = None
    if running:
        s = cells.withColumn("_slice", F.floor(F.col(t) / slice_width))
        in_slice = Window.partitionBy(*keys, "_slice").orderBy(t, "_block").rowsBetween(Window.unboundedPreceding, -1)
        in_key = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        slices = s.groupBy(*keys, "_slice").agg(*[_fold(how[n])(f"_c_{n}").alias(f"_s_{n}") for n in running])
        slices = slices.select(*keys, "_slice", *[_fold(how[n])(f"_s_{n}").over(in_key).alias(f"_k_{n}") for n in running])
        inner = s.select(*cell, "_slice", *[_fold(how[n])(f"_c_{n}").over(in_slice).alias(f"_i_{n}") for n in running])
        carry = inner.join(slices, [*keys, "_slice"]).select(
            *cell, *[_join(how[n], F.col(f"_i_{n}"), F.col(f"_k_{n}")).alias(f"_b_{n}") for n in running])
    # One pass per window width: each cell goes to its own slot and the next one, so a slot sees a full window back.
    for width in sorted({x.window_us for x in sliding.values()}):
        named = {n: x for n, x in sliding.items() if x.window_us == width}
        slot = F.floor(F.col(t) / width)
        spread = cells.withColumn("_own", slot).withColumn("_slot", F.explode(F.array(slot, slot + 1)))
        by_slot = Window.partitionBy(*keys, "_slot").orderBy(t)
        same_t = Window.partitionBy(*keys, "_slot", t).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        cols = []
        for n, x in named.items():
            earlier = by_slot.rangeBetween(-(width - 1) if x.open else -width, -1)
            cols.append(_join("sum", F.sum(f"_c_{n}").over(earlier), F.sum(f"_c_{n}").over(same_t)).alias(f"_b_{n}"))
        part = spread.select(*cell, "_own", "_slot", *cols).where(F.col("_own") == F.col("_slot")).drop("_own", "_slot")
        carry = part if carry is None else carry.join(part, cell)
    out = rows.join(carry, cell)
    for n in totals:
        out = out.withColumn(n, _join(how[n], F.col(f"_r_{n}"), F.col(f"_b_{n}")))
    return out.select(*df.columns, *totals)


def first_rows(df: DataFrame, keys: list[str], order: list[str], n: int, rank: str = "rn") -> DataFrame:
    """The first n rows per key. Spark cuts every map-side group to n rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)
