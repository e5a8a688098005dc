"""Chat formatting: role sequences are repaired at least cost and rendered.

A legal chat is an optional system turn, then user and assistant in turn, ending with an assistant. Per input turn the
repair keeps it, relabels it, or merges it into the turn before (if they have the same role after relabelling), each after
inserting as many empty turns as the automaton needs; the end may need an empty assistant turn. Dynamic programming over
the automaton's states finds the cheapest way; of equally cheap ones the first in the documented order of moves.

A conversation may be of any length: the turns are range-partitioned by (conversation, turn), so a long one lies over
several partitions. For those, each partition gives a small matrix of least costs from state to state; the matrices (one per
partition border) are chained, which fixes the state at each border, and every partition then repairs its own piece.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import lower_ascii, staged

c = F.col
#: States: what the last turn was. "start" is before any turn; only start and assistant may end a chat.
STATES = ("start", "system", "user", "assistant")
ROLES = ("system", "user", "assistant")
LEGAL = {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
#: Costs of a merge, of an empty turn, and of another role for a turn of a known or an unknown role.
MERGE, INSERT, RELABEL, UNKNOWN = 1, 3, 4, 2
OPEN, CLOSE, JOIN = "<|{}|>\n", "\n<|end|>\n", "\n\n"


def fillers(state: str, role: str) -> tuple[str, ...] | None:
    """The fewest empty turns between a state and a turn of that role; None if none will do."""
    if role in LEGAL[state]:
        return ()
    paths = [(x,) for x in LEGAL[state]]
    while paths and len(paths[0]) < len(STATES):
        if fit := [p for p in paths if role in LEGAL[p[-1]]]:
            return min(fit)
        paths = [(*p, x) for p in paths for x in LEGAL[p[-1]]]
    return None


def moves_of(role: str | None) -> list[tuple[int, int, int, str, str, tuple[str, ...]]]:
    """(state before, state after, cost, action, new role, inserted) for a turn of that role, in order of preference."""
    out = []
    for s, state in enumerate(STATES):
        for new in sorted(ROLES, key=lambda x: x != role):
            change = 0 if new == role else RELABEL if role in ROLES else UNKNOWN
            label = "" if new == role else "relabel"
            gap = fillers(state, new)
            if state == new:
                out.append((s, s, change + MERGE, f"{label} merge".strip(), new, ()))
            if gap is not None:
                out.append((s, STATES.index(new), change + INSERT * len(gap), label or "keep", new, gap))
    return out


MOVES = {role: moves_of(role) for role in (*ROLES, None)}
END = [0 if s in ("start", "assistant") else INSERT if s == "user" else 2 * INSERT for s in STATES]


def known(role: str | None) -> str | None:
    return role if role in ROLES else None


def forward(roles: list[str | None], cost: list[float]) -> tuple[list[float], list[list[tuple | None]]]:
    """Least costs per state after the turns, from those before; and per turn and state the move that reached it."""
    back = []
    for role in roles:
        after, by = [math.inf] * len(STATES), [None] * len(STATES)
        for move in MOVES[known(role)]:
            if (x := cost[move[0]] + move[2]) < after[move[1]]:
                after[move[1]], by[move[1]] = x, move
        cost = after
        back.append(by)
    return cost, back


def path(back: list[list[tuple | None]], state: int) -> list[tuple]:
    out = []
    for by in reversed(back):
        out.append(by[state])
        state = by[state][0]
    return out[::-1]


def matrix(roles: list[str | None]) -> list[list[float]]:
    return [forward(roles, [0.0 if s == t else math.inf for t in range(len(STATES))])[0] for s in range(len(STATES))]


def chained(matrices: list[list[list[float]]]) -> list[tuple[int, int]]:
    """(state before, state after) of each piece of a conversation, on a cheapest way from start to a legal end."""
    costs = [[0.0] + [math.inf] * (len(STATES) - 1)]
    for m in matrices:
        costs.append([min(costs[-1][s] + m[s][t] for s in range(len(STATES))) for t in range(len(STATES))])
    state = min(range(len(STATES)), key=lambda t: costs[-1][t] + END[t])
    out = []
    for m, before in zip(reversed(matrices), reversed(costs[:-1]), strict=True):
        out.append((min(range(len(STATES)), key=lambda s: before[s] + m[s][state]), state))
        state = out[-1][0]
    return out[::-1]


def repaired(turns: list[tuple[str | None, str | None]], first: int = 0, last: int | None = None) -> list[tuple[str, str, list[str], int, str]]:
    """(action, role, inserted roles, cost, rendered piece) per turn, from a state to a state (None: to the end of the chat).

    The pieces of a whole conversation, one after the other, are the chat. The last one also holds what the end needs."""
    roles = [r for r, _ in turns]
    cost, back = forward(roles, [0.0 if s == first else math.inf for s in range(len(STATES))])
    end = min(range(len(STATES)), key=lambda t: cost[t] + END[t]) if last is None else last
    out = []
    for (before, _, price, action, role, gap), (_, text) in zip(path(back, end), turns, strict=True):
        if action.endswith("merge"):
            piece = JOIN + (text or "")
        else:
            empty = "".join(OPEN.format(g) + CLOSE for g in gap)
            piece = (CLOSE if before else "") + empty + OPEN.format(role) + (text or "")
        out.append((action, role, list(gap), price, piece))
    if last is None and out:
        action, role, gap, price, piece = out[-1]
        tail = [] if STATES[end] == "assistant" else ["assistant"] if STATES[end] == "user" else ["user", "assistant"]
        out[-1] = (action, role, gap + tail, price + END[end], piece + CLOSE + "".join(OPEN.format(g) + CLOSE for g in tail))
    return out


def _conversations(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple]:
    """((part, conv_id), rows) of rows sorted by (part, conv_id, turn)."""
    def rows() -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(b[k].to_pylist() for k in names), strict=True)

    yield from groupby(rows(), key=lambda r: r[:2])


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (part, conv), rows in _conversations(batches, ("part", "conv_id", "role")):
        m = matrix([r[2] for r in rows])
        yield pa.RecordBatch.from_pylist([{"part": part, "conv_id": conv, "costs": [x for row in m for x in row]}],
                                         pa.schema([("part", pa.int32()), ("conv_id", pa.int64()), ("costs", pa.list_(pa.float64()))]))


OUT = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("action", pa.string()), ("new_role", pa.string()),
                 ("inserted", pa.list_(pa.string())), ("cost", pa.int64()), ("piece", pa.string())])


def _repaired(borders: object) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (part, conv), rows in _conversations(batches, ("part", "conv_id", "turn", "role", "text", "given")):
            got = list(rows)
            first, last = borders.value.get((part, conv), (0, None))
            done = repaired([(r[3], r[4]) for r in got], first, last)
            out += [(conv, r[2], r[5], action, role, gap, cost, piece) for r, (action, role, gap, cost, piece) in zip(got, done, strict=True)]
            if len(out) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out, strict=True), OUT, strict=True)], schema=OUT)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out, strict=True), OUT, strict=True)], schema=OUT)

    return run


def formatted(turns: DataFrame, partitions: int | None = None) -> DataFrame:
    """conv_id, turn, role, action, new_role, inserted, cost, piece of every row of `turns` (conv_id, turn, role, text).

    action is keep, relabel, merge or relabel merge; inserted lists the empty turns before it (for the last turn also those
    after it); piece is what the turn adds to the rendered chat: the pieces of a conversation in the order of the turns are
    the chat. Roles are compared A-Z lower-cased; null and unknown ones are relabelled. Turns are ordered by turn, nulls
    first, ties by role and text, so repeated rows stand side by side. Rows without a conv_id are one conversation. A null
    text is empty. No turns give no rows. Other columns are not read.
    """
    spark = turns.sparkSession
    order = ["conv_id", "turn", "role", "text", "row"]
    # Equal rows are told apart by their place in the scan, so that even many of them can lie in several partitions.
    rows = turns.withColumn("row", F.monotonically_increasing_id()).select(c("conv_id").cast("bigint"), c("turn").cast("bigint"), lower_ascii(c("role")).alias("role"), "text", c("role").alias("given"), "row")
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = staged(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "turns")
    # Conversations over several partitions: at most one per border.
    spread = placed.groupBy("conv_id").agg(F.min("part").alias("_from"), F.max("part").alias("_to")).where("_from < _to").select("conv_id").collect()
    borders: dict[tuple, tuple[int, int | None]] = {}
    if spread:
        named = [r.conv_id for r in spread if r.conv_id is not None]
        some = c("conv_id").isin(named) | (c("conv_id").isNull() if len(named) < len(spread) else F.lit(False))
        found = (placed.where(some).select("part", *order).repartition("part").sortWithinPartitions("part", *order)
                 .mapInArrow(_matrices, "part int, conv_id bigint, costs array<double>").collect())
        for conv, pieces in groupby(sorted(found, key=lambda r: (r.conv_id is not None, r.conv_id, r.part)), key=lambda r: r.conv_id):
            got = list(pieces)
            states = chained([np.array(r.costs).reshape(len(STATES), -1).tolist() for r in got])
            for n, (r, (before, after)) in enumerate(zip(got, states, strict=True)):
                borders[(r.part, conv)] = (before, after if n + 1 < len(got) else None)
    return placed.repartition("part").sortWithinPartitions("part", *order).select("part", *order, "given").mapInArrow(
        _repaired(spark.sparkContext.broadcast(borders)),
        "conv_id bigint, turn bigint, role string, action string, new_role string, inserted array<string>, cost bigint, piece string")
