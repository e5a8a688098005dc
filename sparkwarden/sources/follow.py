"""A stream of lines from growing log files: follows appended bytes and starts over where a file was rotated.

Offsets are bytes: per file, how far its complete lines reach. Files are numbered in a register in the shared folder, by path
and by a hash of their first line, so a rotated file (its first line is another one, or it has shrunk) is a new number that
is read from its start. seq is the file's number and the line's place in the file: unique, and the same however often a batch
runs. Only the driver keeps the register; it grows with the number of files, as the offsets in the checkpoint do.

A batch is cut into ranges of PART bytes, which tasks read from the shared file system on their own. Ranges begin and end at
lines. A line counts once it has its line feed.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator, Sequence
from datetime import UTC, datetime
from urllib.parse import urlparse
from uuid import uuid4

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from sparkwarden.dims import LOG_NAMES
from sparkwarden.functions.parsing import trimmed

NAME = "followed_logs"
PART, CHUNK, HEAD = 64 << 20, 1 << 16, 1 << 20
#: A file may have 2^40 bytes, and there may be 2^23 files.
PLACE_BITS = 40
BATCH_ROWS = 10_000


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path and the path in it. A path without a scheme is local."""
    if urlparse(path).scheme:
        return pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.fs.LocalFileSystem(), path


def is_log(name: str) -> bool:
    return name.endswith(".log") or name in LOG_NAMES


def first_line(f, size: int) -> int | None:
    """A hash of the first line (of its first MB, if longer); None while it has no end."""
    f.seek(0)
    start = f.read(min(size, HEAD))
    if b"\n" in start:
        return zlib.crc32(start[: start.index(b"\n") + 1])
    return zlib.crc32(start) if len(start) == HEAD else None


def whole_lines(f, size: int, least: int) -> int:
    """Up to where the file's first `size` bytes are complete lines; `least` if no line feed follows that."""
    hi = size
    while hi > least:
        lo = max(least, hi - CHUNK)
        f.seek(lo)
        found = f.read(hi - lo).rfind(b"\n")
        if found >= 0:
            return lo + found + 1
        hi = lo
    return least


class Register:
    """Numbers of files: by path the number, the first line's hash, and the end last told."""

    def __init__(self, path: str):
        self.fs, self.path = opened(path)
        kind = self.fs.get_file_info(self.path).type
        self.files: dict[str, dict] = {}
        self.given = -1
        if kind == pyarrow.fs.FileType.File:
            with self.fs.open_input_stream(self.path) as f:
                self.given, self.files = json.loads(f.read())

    def number(self, path: str, head: int, size: int) -> dict:
        known = self.files.get(path)
        if known is None or known["head"] != head or size < known["end"]:
            self.given += 1
            known = self.files[path] = {"number": self.given, "head": head, "end": 0}
        return known

    def save(self) -> None:
        """Written beside and renamed, before any offset of it is told."""
        spare = f"{self.path}.{uuid4().hex}"
        parent = self.path.rsplit("/", 1)[0]
        self.fs.create_dir(parent, recursive=True)
        with self.fs.open_output_stream(spare) as f:
            f.write(json.dumps([self.given, self.files]).encode())
        self.fs.move(spare, self.path)


class Range(InputPartition):
    def __init__(self, number: int, path: str, lo: int, hi: int):
        self.number, self.path, self.lo, self.hi = number, path, lo, hi


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.register = options["path"], options["register"]
        self.part = int(options.get("partBytes", PART))

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        """Per file number: its path and how far its complete lines reach."""
        fs, root = opened(self.folder)
        register, ends = Register(self.register), {}
        for info in fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True)):
            if info.type != pyarrow.fs.FileType.File or not is_log(info.base_name) or not info.size:
                continue
            with fs.open_input_file(info.path) as f:
                head = first_line(f, info.size)
                if head is None:
                    continue
                known = register.number(info.path, head, info.size)
                known["end"] = whole_lines(f, info.size, known["end"])
            if known["end"]:
                ends[str(known["number"])] = [info.path, known["end"]]
        register.save()
        return ends

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        ranges = []
        for number, (path, hi) in end.items():
            lo = start.get(number, [path, 0])[1]
            ranges += [Range(int(number), path, at, min(at + self.part, hi)) for at in range(lo, hi, self.part)]
        return ranges

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(self.folder)
        info = fs.get_file_info(partition.path)
        if info.type != pyarrow.fs.FileType.File:
            return  # removed meanwhile, as a watch would find it
        modified = datetime.fromtimestamp((info.mtime_ns or 0) / 1e9, UTC)
        seqs, values = [], []
        with fs.open_input_file(partition.path) as f:
            for at, line in lines_from(f, partition.lo, partition.hi):
                for piece in line.decode("utf-8", "surrogateescape").splitlines(keepends=True):
                    raw = piece.encode("utf-8", "surrogateescape")
                    seqs.append(partition.number << PLACE_BITS | at)
                    values.append(raw.decode("utf-8", "replace"))
                    at += len(raw)
                if len(seqs) >= BATCH_ROWS:
                    yield batch(seqs, values, partition.path, modified)
                    seqs, values = [], []
        if seqs:
            yield batch(seqs, values, partition.path, modified)


def lines_from(f, lo: int, hi: int) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin in the range; the last of them may end behind it."""
    at, rest = lo, b""
    if lo:  # a line that begins before the range belongs to the range before
        f.seek(lo - 1)
        while (more := f.read(CHUNK)) and b"\n" not in more:
            at += len(more)
        if not more:
            return
        skip = more.index(b"\n") + 1
        at, rest = at - 1 + skip, more[skip:]
    else:
        f.seek(0)
    while at < hi:
        while b"\n" not in rest:
            more = f.read(CHUNK)
            if not more:
                return
            rest += more
        lines = rest.split(b"\n")
        for line in lines[:-1]:
            if at >= hi:
                return
            yield at, line + b"\n"
            at += len(line) + 1
        rest = lines[-1]


def batch(seqs: list[int], values: list[str], path: str, modified: datetime) -> pa.RecordBatch:
    n = len(seqs)
    return pa.RecordBatch.from_arrays([pa.array(seqs, pa.int64()), pa.array(values, pa.string()), pa.array([path] * n, pa.string()),
                                       pa.array([modified] * n, pa.timestamp("us", "UTC"))], ["seq", "value", "source_file", "modified"])


class FollowedLogs(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "seq bigint, value string, source_file string, modified timestamp"

    def streamReader(self, schema) -> Reader:  # noqa: N802
        return Reader(self.options)


def follow_lines(spark: SparkSession, folder: str, register: str, part_bytes: int = PART) -> DataFrame:
    """Lines appended to the log files of a folder (and those below it), trimmed, without blank ones.

    register: a file in the shared folder that holds the files' numbers; a stream that is started again needs the same."""
    spark.dataSource.register(FollowedLogs)
    raw = spark.readStream.format(NAME).option("register", register).option("partBytes", part_bytes).load(folder)
    return raw.withColumn("value", trimmed(F.col("value"))).where(F.col("value") != "")
