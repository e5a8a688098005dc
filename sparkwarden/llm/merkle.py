"""Merkle manifest of a dataset: a tree per source over leaves in doc_id order, and a tree over the sources.

Leaf positions come from bitmaps, not from sorting. Tasks turn their doc_ids into containers (per source and 8192 ids: a
sorted list while there are few, else a bitmap), equal containers are merged, and a directory of popcounts is laid out beside
each bitmap. A leaf's position is the number of rows in the containers before its own plus a rank query in its container.
Doc_ids that occur several times keep how often; only then are leaves grouped, and ties are placed by leaf.

Levels are reduced WIDTH = 3^6 nodes at a time: rows are keyed by position div WIDTH into arrays of WIDTH slots, each array
folds six levels, and the array's root is a node of the next round. A round has a 729th of the rows of the one before. On the
way back each array gets the path above it, so proofs need one join of arrays a round and none of leaves.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import placed, removed, step

c = F.col
FAN, LEVELS = 3, 6
WIDTH = FAN**LEVELS
BITS = 13
SPAN, LISTED = 1 << BITS, 1 << 9
#: Rows without a doc_id come first: their container lies below all others.
NO_ID = -(1 << 52)
#: A container's rows beyond this (only repeated doc_ids get there) are dealt over several tasks.
TASK_ROWS = 1 << 14
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(fields: list[Column]) -> Column:
    """The digest (binary) of the fields: `-` for null, else the number of bytes, a colon and the value."""
    said = [x.cast("string") for x in fields]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in said]).cast("binary"), 256))


def source_key(source: Column) -> Column:
    """A key without nulls, in the order of sources: null first, then bytewise."""
    return F.coalesce(F.concat(F.lit(":"), source.cast("string")), F.lit(""))


class Container:
    """Which of SPAN ids are there, and how many rows each repeated one has beyond its first."""

    def __init__(self, ids: np.ndarray, more: np.ndarray):
        self.ids, self.more = ids, more  # ids: sorted and distinct; more: rows (id, count)

    @classmethod
    def of(cls, low: np.ndarray) -> Container:
        ids, n = np.unique(low, return_counts=True)
        several = n > 1
        return cls(ids, np.stack([ids[several], n[several] - 1]))

    @property
    def rows(self) -> int:
        return len(self.ids) + int(self.more[1].sum())

    def packed(self) -> tuple[bytes, bytes]:
        """The ids (2 bytes each, or from LISTED on a bitmap behind its popcount directory), and the repeats."""
        more = self.more.astype("<i8").tobytes()
        if len(self.ids) < LISTED:
            return b"L" + self.ids.astype("<u2").tobytes(), more
        bits = np.zeros(SPAN, dtype=bool)
        bits[self.ids] = True
        words = np.packbits(bits, bitorder="little").view("<u8")
        before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.uint32)[:-1])).astype("<u4")
        return b"B" + before.tobytes() + words.tobytes(), more

    @classmethod
    def merged(cls, packed: list[tuple[bytes, bytes]]) -> Container:
        if len(packed) == 1:
            return cls(ids_of(packed[0][0]), repeats_of(packed[0][1]))
        bits, times = np.zeros(SPAN, dtype=bool), np.zeros(SPAN, dtype=np.int64)
        for ids, more in packed:
            got, extra = ids_of(ids), repeats_of(more)
            times[got[bits[got]]] += 1
            bits[got] = True
            times[extra[0]] += extra[1]
        several = np.flatnonzero(times)
        return cls(np.flatnonzero(bits), np.stack([several, times[several]]))


def ids_of(packed: bytes) -> np.ndarray:
    if packed[:1] == b"L":
        return np.frombuffer(packed, "<u2", offset=1).astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8, offset=1 + SPAN // 16), bitorder="little"))


def repeats_of(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<i8").reshape(2, -1)


def ranks(packed: bytes, more: bytes, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per id (all of them in the container): the rows before it, and its own number of rows."""
    if packed[:1] == b"L":
        rank = np.searchsorted(np.frombuffer(packed, "<u2", offset=1), low).astype(np.int64)
    else:
        before = np.frombuffer(packed, "<u4", SPAN // 64, 1)
        words = np.frombuffer(packed, np.uint8, offset=1 + SPAN // 16).view("<u8")
        at = low >> 6
        inner = words[at] & ((np.uint64(1) << (low & 63).astype(np.uint64)) - np.uint64(1))
        rank = before[at] + np.bitwise_count(inner).astype(np.int64)
    ids, extra = repeats_of(more)
    if not len(ids):
        return rank, np.ones(len(low), dtype=np.int64)
    sums = np.concatenate(([0], np.cumsum(extra)))
    at = np.searchsorted(ids, low)
    own = np.where(ids[np.minimum(at, len(ids) - 1)] == low, extra[np.minimum(at, len(ids) - 1)], 0)
    return rank + sums[at], own + 1


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin, and the end."""
    n = len(columns[0])
    new = np.zeros(n - 1, dtype=bool)
    for x in columns:
        new |= x[1:] != x[:-1]
    return np.concatenate(([0], np.flatnonzero(new) + 1, [n]))


def _containers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch's rows (source, high, low) as containers, one for each source and high part."""
    for b in batches:
        if not b.num_rows:
            continue
        names = b["source"].dictionary_encode()
        code, high, low = names.indices.to_numpy(), b["high"].to_numpy(), b["low"].to_numpy()
        order = np.lexsort((high, code))
        code, high, low = code[order], high[order], low[order]
        at = _runs(code, high)
        found = [Container.of(low[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
        yield _packed([names.dictionary[int(k)].as_py() for k in code[at[:-1]]], high[at[:-1]].tolist(), found)


def _packed(sources: list[str], highs: list[int], found: list[Container]) -> pa.RecordBatch:
    packed = [x.packed() for x in found]
    return pa.RecordBatch.from_arrays(
        [pa.array(sources, pa.string()), pa.array(highs, pa.int64()), pa.array([x.rows for x in found], pa.int64()),
         pa.array([x[0] for x in packed], pa.binary()), pa.array([x[1] for x in packed], pa.binary())],
        ["source", "high", "n", "ids", "more"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Containers sorted by (source, high) with equal ones merged; two of a kind are held at most, the merged and the next."""
    held: tuple[str, int] | None = None
    parts: list[tuple[bytes, bytes]] = []
    for b in batches:
        done: list[tuple[str, int, Container]] = []
        for key in zip(b["source"].to_pylist(), b["high"].to_pylist(), b["ids"].to_pylist(), b["more"].to_pylist(), strict=True):
            if held is not None and key[:2] != held:
                done.append((*held, Container.merged(parts)))
                parts = []
            held = key[:2]
            parts.append(key[2:])
            if len(parts) >= 256:
                parts = [Container.merged(parts).packed()]
        if done:
            yield _packed(*[list(x) for x in zip(*done, strict=True)])
    if held is not None:
        yield _packed([held[0]], [held[1]], [Container.merged(parts)])


CONTAINER = "source string, high bigint, n bigint, ids binary, more binary"


def index(rows: DataFrame) -> DataFrame:
    """The merged containers of `rows` (source, high, low) with `base`, the rows of the same source in containers before."""
    parts = rows.select("source", "high", "low").mapInArrow(_containers, CONTAINER)
    merged = step(parts.repartition("source", "high").sortWithinPartitions("source", "high").mapInArrow(_merged, CONTAINER), "containers")
    slim = merged.select("source", "high", "n", F.shiftright("high", 10).alias("cell"))
    return step(merged.join(placed(slim, "source", "cell", [c("high")], c("n"), "base").drop("cell", "n"), ["source", "high"]), "index")


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted so that each container comes before the leaves it ranks."""
    base, ids, more = 0, b"", b""
    for b in batches:
        is_leaf = b["ids"].is_null().to_numpy(zero_copy_only=False)
        low = b["low"].to_numpy()
        first, many = np.zeros(len(low), dtype=np.int64), np.zeros(len(low), dtype=np.int64)
        cuts = [0, *np.flatnonzero(~is_leaf).tolist(), len(low)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if i < j and not is_leaf[i]:
                base, ids, more = b["base"][i].as_py(), b["ids"][i].as_py(), b["more"][i].as_py()
                i += 1
            if i < j:
                rank, many[i:j] = ranks(ids, more, low[i:j])
                first[i:j] = base + rank
        out = pa.RecordBatch.from_arrays([b["source"], b["doc_id"], b["leaf"], b["claim"], b["n"], pa.array(first), pa.array(many)],
                                         ["source", "doc_id", "leaf", "claim", "n", "first", "many"])
        yield out.filter(pa.array(is_leaf))


def positions(leaves: DataFrame) -> DataFrame:
    """source, doc_id, leaf, claim of every row of `leaves`, and `at`, its position from 0 among those of its source.

    Order is doc_id (without one first), then leaf, then claim. Rows equal in all of these get one position each."""
    rows = leaves.select("*", F.lit(1).cast("bigint").alias("n"), F.coalesce(F.shiftright("doc_id", BITS), F.lit(NO_ID)).alias("high"),
                         F.coalesce(c("doc_id").bitwiseAND(F.lit(SPAN - 1)), F.lit(0)).cast("bigint").alias("low"))
    found = index(rows)
    repeats = bool(found.where("octet_length(more) > 0").take(1))
    if repeats:  # equal leaves of one doc_id are one row with a number, combined before the shuffle
        rows = rows.groupBy("source", "doc_id", "leaf", "claim", "high", "low").agg(F.sum("n").alias("n"))
        tasks = found.where(c("n") > TASK_ROWS).select("source", "high", F.ceil(c("n") / TASK_ROWS).alias("tasks"))
        rows = rows.join(tasks, ["source", "high"], "left").withColumn("task", F.coalesce(F.pmod(F.xxhash64("leaf"), "tasks"), F.lit(0))).drop("tasks")
        tables = found.join(tasks, ["source", "high"], "left").withColumn(
            "task", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("tasks", F.lit(1)) - 1))).drop("tasks")
    else:
        rows, tables = (x.withColumn("task", F.lit(0).cast("bigint")) for x in (rows, found))
    nothing = {"doc_id": "bigint", "leaf": "binary", "claim": "binary", "low": "bigint", "base": "bigint", "ids": "binary", "more": "binary"}
    order = ["source", "high", "task", "kind", "low", "doc_id", "leaf", "claim", "n", "base", "ids", "more"]

    def shaped(df: DataFrame, kind: int) -> DataFrame:
        missing = {k: F.lit(0).cast(t) if t == "bigint" and k != "doc_id" else F.lit(None).cast(t) for k, t in nothing.items() if k not in df.columns}
        return df.withColumns({**missing, "kind": F.lit(kind)}).select(order)

    both = shaped(tables, 0).unionByName(shaped(rows, 1)).repartition("source", "high", "task").sortWithinPartitions("source", "high", "task", "kind")
    ranked = both.mapInArrow(_ranked, "source string, doc_id bigint, leaf binary, claim binary, n bigint, first bigint, many bigint")
    if not repeats:
        return ranked.select("source", "doc_id", "leaf", "claim", c("first").alias("at"))
    ranked = step(ranked, "ranked")
    ties = ranked.where("many > 1").withColumns({"tie": F.concat_ws(" ", "first", "source"), "cell": F.substring(F.hex("leaf"), 1, 4)})
    tied = placed(ties, "tie", "cell", [c("leaf"), c("claim")], c("n"), "before")
    last = F.floor((c("n") - 1) / SPAN)
    tied = tied.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).repartition("tie", "cell", "leaf", "block")
    inner = F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.lit(SPAN - 1), c("n") - 1 - c("block") * SPAN)))
    tied = tied.withColumn("inner", inner).withColumn("at", c("first") + c("before") + c("block") * SPAN + c("inner"))
    return ranked.where("many = 1").withColumn("at", c("first")).unionByName(tied, allowMissingColumns=True).select("source", "doc_id", "leaf", "claim", "at")


def fold(nodes: list[bytes], levels: int | None) -> list[list[bytes]]:
    """The nodes and what they become, level by level: `levels` times, or until one is left."""
    out = [nodes]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        now = [x.hex().encode() for x in out[-1]]
        out.append([sha256(b"".join(now[i : i + FAN])).digest() for i in range(0, len(now), FAN)])
    return out


def paths(folded: list[list[bytes]]) -> list[bytes]:
    """Per node, for each level: the numbers of its run's nodes before and behind it (a byte each), and these nodes."""
    out = []
    for i in range(len(folded[0])):
        path = []
        for level in folded[:-1]:
            lo = i - i % FAN
            run = level[lo : lo + FAN]
            path += [struct.pack("BB", i - lo, len(run) - 1 - (i - lo)), *run[: i - lo], *run[i - lo + 1 :]]
            i //= FAN
        out.append(b"".join(path))
    return out


def siblings(path: bytes) -> list[tuple[bytes, bytes]]:
    """A path's levels as hex text: what stands before the node, what behind."""
    out, at = [], 0
    while at < len(path):
        mid = at + 2 + 32 * path[at]
        end = mid + 32 * path[at + 1]
        out.append((path[at + 2 : mid].hex().encode(), path[mid:end].hex().encode()))
        at = end
    return out


def folded_up(node: bytes, levels: list[tuple[bytes, bytes]]) -> bytes:
    for before, behind in levels:
        node = sha256(before + node.hex().encode() + behind).digest()
    return node


def _levels(total: int) -> int | None:
    return None if total <= WIDTH else LEVELS


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        nodes = [slots(x) for x in b["slots"].to_pylist()]
        roots = [fold([x["node"] for x in s], _levels(n))[-1][0] for s, n in zip(nodes, b["total"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b["tree"], b["block"], pa.array(roots, pa.binary()), b["total"]], ["tree", "at", "node", "total"])


def slots(rows: list[dict]) -> list[dict]:
    """The array's rows, each put into its slot."""
    out: list[dict] = [{}] * len(rows)
    for x in rows:
        out[x["slot"]] = x
    return out


def arrays(nodes: DataFrame, totals: DataFrame, carried: list[str]) -> DataFrame:
    """tree, block, slots, total: the nodes (tree, at, node, ...) of every tree in arrays of WIDTH slots."""
    slot = F.struct(F.pmod("at", F.lit(WIDTH)).cast("int").alias("slot"), "node", *carried)
    keyed = nodes.groupBy("tree", F.floor(c("at") / WIDTH).alias("block")).agg(F.collect_list(slot).alias("slots"))
    return keyed.join(totals, "tree")


def grown(nodes: DataFrame, totals: DataFrame, carried: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """The rounds' arrays, lowest first, and (tree, root). totals: tree, total."""
    rounds, most = [], totals.agg(F.max("total")).first()[0] or 0
    done = None
    while most:
        rounds.append(step(arrays(nodes, totals, carried), "arrays"))
        carried = []
        roots = step(rounds[-1].select("tree", "block", F.transform("slots", lambda x: F.struct(x.slot.alias("slot"), x.node.alias("node"))).alias("slots"), "total")
                     .mapInArrow(_roots, "tree string, at bigint, node binary, total bigint"), "nodes")
        finished = roots.where(c("total") <= WIDTH).select("tree", c("node").alias("root"))
        done = finished if done is None else done.unionByName(finished)
        nodes = roots.where(c("total") > WIDTH).select("tree", "at", "node")
        totals = totals.where(c("total") > WIDTH).select("tree", F.ceil(c("total") / WIDTH).alias("total"))
        most = -(-most // WIDTH) if most > WIDTH else 0
    return rounds, done


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrays with the path above them, to a row for each slot with its whole path."""
    for b in batches:
        kept = [k for k in b.schema.names if k not in ("block", "slots", "total", "above")]
        for r in b.to_pylist():
            s = slots(r["slots"])
            found = paths(fold([x["node"] for x in s], _levels(r["total"])))
            rows = [{**{k: r[k] for k in kept}, "at": r["block"] * WIDTH + i, "path": p + r["above"], **x} for i, (x, p) in enumerate(zip(s, found, strict=True))]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([*[b.schema.field(k) for k in kept], ("at", pa.int64()), ("path", pa.binary()), *b.schema.field("slots").type.value_type]))


def traced(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """A row for each node of the lowest round, with the path to the top. above: tree, above (the path over its root), and what to carry."""
    kind = {f.name: f.dataType.simpleString() for f in above.schema.fields if f.name not in ("above", "at")}
    now = above.withColumn("block", F.lit(0).cast("bigint"))
    for k, r in enumerate(reversed(rounds)):
        slot = r.schema["slots"].dataType.elementType
        schema = ", ".join([*(f"`{n}` {t}" for n, t in kind.items()), "at bigint", "path binary", *(f"{f.name} {f.dataType.simpleString()}" for f in slot.fields)])
        # Trees that end in this round meet their own path; the others meet those of the arrays' nodes in the round above.
        out = r.join(now, ["tree", "block"]).mapInArrow(_paths, schema)
        if k < len(rounds) - 1:
            lower = out.select(*kind, c("path").alias("above"), c("at").alias("block"))
            low = above.withColumn("block", F.lit(0).cast("bigint")).join(r.select("tree").distinct(), "tree", "left_anti")
            now = step(lower.unionByName(low), "above")
    return out


def leaves(docs: DataFrame) -> DataFrame:
    """source (a key), doc_id, leaf of every row; `claim` is null."""
    return docs.select(source_key(c("source")).alias("source"), c("doc_id").cast("bigint").alias("doc_id"),
                       leaf([c(k) for k in FIELDS]).alias("leaf"), F.lit(None).cast("binary").alias("claim"))


def manifest(rows: DataFrame) -> DataFrame:
    """doc_id, leaf, claim, subroot, root, path (binary) of every leaf of `rows` (source, doc_id, leaf, claim), as leaves() gives them.

    Per source, leaves ascend by doc_id, those without one first, equal doc_ids by leaf and then by claim. Every three
    nodes in a row become one until one is left, the subroot; subroots in the order of sources likewise give the root. path
    has the siblings up to the root, see siblings(). claim is carried along, for an audit of another version of the row.
    Rows equal in all columns are leaves each. A null or empty field is told apart in the leaf. No rows give no rows;
    other columns are not read. The list of sources is ordered by windows over their first letters.
    """
    slim = step(rows, "leaves")
    totals = step(slim.groupBy(c("source").alias("tree")).agg(F.count(F.lit(1)).alias("total")), "totals")
    placed_rows = positions(slim).select(c("source").alias("tree"), "at", c("leaf").alias("node"), "doc_id", "claim")
    rounds, subroots = grown(placed_rows, totals, ["doc_id", "claim"])
    if subroots is None:
        return rows.select("doc_id", "leaf", "claim", F.lit("").cast("binary").alias("subroot"), F.lit("").cast("binary").alias("root"), F.lit("").cast("binary").alias("path"))
    named = subroots.select(F.lit("").alias("all"), F.substring("tree", 1, 3).alias("cell"), "tree", c("root").alias("subroot"))
    order = step(placed(named, "all", "cell", [c("tree")], F.lit(1), "at"), "subroots")
    top_nodes = order.select(F.lit("").alias("tree"), "at", c("subroot").alias("node"), c("tree").alias("source"))
    top_rounds, top = grown(top_nodes, order.groupBy(F.lit("").alias("tree")).agg(F.count(F.lit(1)).alias("total")), ["source"])
    whole = top.select("tree", "root", F.lit("").cast("binary").alias("above"))
    over = step(traced(top_rounds, whole).select(c("source").alias("tree"), c("node").alias("subroot"), "root", c("path").alias("above")), "sources")
    removed(slim)
    return traced(rounds, over).select("doc_id", c("node").alias("leaf"), "claim", "subroot", "root", "path")


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the paths prove: the digest of the siblings, and the root that the claimed leaf (else the leaf itself) folds to."""
    for b in batches:
        rows = []
        for leaf_, claim, root, path in zip(b["leaf"].to_pylist(), b["claim"].to_pylist(), b["root"].to_pylist(), b["path"].to_pylist(), strict=True):
            levels = siblings(path)
            got = folded_up(leaf_ if claim is None else claim, levels)
            rows.append((sha256(b"".join(x + y for x, y in levels)).hexdigest(), got.hex(), got == root))
        proof, folded, ok = zip(*rows, strict=True) if rows else ((), (), ())
        hexed = [pa.array([x.hex() for x in b[k].to_pylist()], pa.string()) for k in ("leaf", "subroot", "root")]
        yield pa.RecordBatch.from_arrays([b["doc_id"], *hexed, pa.array(proof, pa.string()), pa.array(folded, pa.string()), pa.array(ok, pa.bool_())],
                                         ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def audited(found: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified (digests as hex text) of every row of manifest()."""
    return found.mapInArrow(_audit, "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def tampered(docs: DataFrame) -> DataFrame:
    """leaves(), with the leaf that a row has after tampering as its claim: the \\n of the text go where crc32(doc_id) is even."""
    text = F.translate(c("text").cast("string"), "\n", "")
    other = leaf([text if k == "text" else c(k) for k in FIELDS])
    hit = (F.crc32(c("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains(c("text").cast("string"), F.lit("\n"))
    return docs.select(source_key(c("source")).alias("source"), c("doc_id").cast("bigint").alias("doc_id"),
                       leaf([c(k) for k in FIELDS]).alias("leaf"), F.when(hit, other).alias("claim"))


def plain(docs: list[tuple]) -> list[tuple]:
    """The audited rows of tampered() documents (doc_id, source, lang, n_chars, text), by the definition; for tests."""
    import zlib

    def digest(*parts: str) -> str:
        return sha256("".join(parts).encode()).hexdigest()

    def of(fields: tuple) -> str:
        return digest(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields])

    def tree(nodes: list[str]) -> tuple[str, list[list[tuple[list[str], list[str]]]]]:
        proofs: list[list[tuple[list[str], list[str]]]] = [[] for _ in nodes]
        where = list(range(len(nodes)))
        while len(nodes) > 1:
            for i, at in enumerate(where):
                lo = at // 3 * 3
                proofs[i].append((nodes[lo:at], nodes[at + 1 : lo + 3]))
                where[i] = at // 3
            nodes = [digest(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)]
        return nodes[0], proofs

    groups: dict[bytes, list[tuple]] = {}
    for d in docs:
        hit = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 2 == 0 and d[4] is not None and "\n" in d[4]
        other = of((*d[:4], d[4].replace("\n", ""))) if hit else None
        groups.setdefault(b"" if d[1] is None else b":" + d[1].encode(), []).append((d[0] is not None, d[0] or 0, of(d), other or "", d[0]))
    names = sorted(groups)
    trees = {}
    for k in names:
        groups[k].sort()
        trees[k] = tree([x[2] for x in groups[k]])
    if not names:
        return []
    root, upper = tree([trees[k][0] for k in names])
    out = []
    for k, up in zip(names, upper, strict=True):
        subroot, proofs = trees[k]
        for (_, _, leaf_, other, doc_id), proof in zip(groups[k], proofs, strict=True):
            node = other or leaf_
            for before, behind in proof + up:
                node = digest(*before, node, *behind)
            out.append((doc_id, leaf_, subroot, root, digest(*[x for a, z in proof + up for x in a + z]), node, node == root))
    return out
