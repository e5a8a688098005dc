"""Token files: one array of ids for many documents, with document boundaries and ids in Elias-Fano form.

A file holds, in order: the header (magic, bytes per id, numbers of documents, of ids and of documents without a doc_id, the
least doc_id), the boundaries (where each document ends), the doc_ids less the least one, and the ids of all documents, 2
bytes each where the vocabulary fits, else 4. Files are written in ascending doc_id order, without a doc_id first.

Texts are encoded where they are read; only ids are shuffled, to the range of doc_ids that a file covers. A file is written
under a name of its own and then renamed, so a task that runs twice leaves the same file. Encoding goes by words: the
tokenizer never joins what a blank separates, so each word's ids are computed once per worker and kept in a bounded memory.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.llm.common import placed, step
from sparkwarden.llm.elias_fano import EliasFano

c = F.col
MAGIC, END = b"TOKF0001", 1
HEAD = struct.Struct("<8sBQQQq")
FILE_ROWS, FILE_BYTES, WORDS, RUNS = 8192, 32 << 20, 100_000, 400_000
#: Latin letters, then ASCII signs without the apostrophe (which begins contractions).
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
_TOKENIZERS: dict[str, Encoder] = {}


def tokenizer(path: str) -> Encoder:
    """The tokenizer and its memory of words, one of each per worker process."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Encoder(path)
    return _TOKENIZERS[path]


class Encoder:
    """Encodes texts word by word, with memories of words and of their letter runs.

    Words of Latin letters with ASCII signs behind them are cut here as the tokenizer would cut them, and only new letter runs
    go through its model; all other new words go through the whole tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.kind = np.uint16 if self.t.get_vocab_size(with_added_tokens=True) <= 1 << 16 else np.uint32
        self.words: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {"": b""}
        self.model, self.code = self.t.model, "H" if self.kind is np.uint16 else "I"
        # What the tokenizer makes of a letter beyond ASCII before its model sees it.
        self.marks = {x: "".join(y for y, _ in self.t.pre_tokenizer.pre_tokenize_str(chr(x))) for x in range(0xC0, 0x100)}
        # Cutting is done here only for a tokenizer seen to cut so.
        probe = ["Word", "Été,", "naïve...", "x!?", "ÀÖØöøÿß%-"]
        self.plain = all(self._cut(w) == self._whole([w])[0] for w in probe)

    def _whole(self, words: list[str]) -> list[bytes]:
        e = self.t.encode(words, is_pretokenized=True, add_special_tokens=False)
        data, size = np.array(e.ids, dtype=self.kind).tobytes(), np.dtype(self.kind).itemsize
        ends = (np.searchsorted(np.array(e.word_ids, dtype=np.int64), np.arange(len(words)), side="right") * size).tolist()
        return [data[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]

    def _run(self, run: str) -> bytes:
        """A run of letters or of signs, lower case, through the tokenizer's model."""
        if (ids := self.runs.get(run)) is None:
            piece = run if run.isascii() else run.translate(self.marks)
            ids = self.runs[run] = array(self.code, [x.id for x in self.model.tokenize(piece)]).tobytes()
        return ids

    def _cut(self, word: str) -> bytes | None:
        m = PLAIN.fullmatch(word)
        return self._run(m[1].lower()) + self._run(m[2]) if m else None

    def learn(self, words: list[str]) -> None:
        other, known, runs, cut = [], self.words, self.runs, PLAIN.fullmatch
        for w in words:
            if not self.plain or (m := cut(w)) is None:
                other.append(w)
                continue
            letters, signs = m.groups()
            letters = letters.lower()
            ids = runs[letters] if letters in runs else self._run(letters)
            known[w] = ids + (runs[signs] if signs in runs else self._run(signs)) if signs else ids
        for at in range(0, len(other), 4096):
            self.words.update(zip(other[at : at + 4096], self._whole(other[at : at + 4096]), strict=True))

    def encode(self, texts: list[str | None], end: int = END) -> list[bytes]:
        """The ids of each text, with the end id, as little-endian numbers."""
        cut = [(x or "").replace("\n", " ").split(" ") for x in texts]
        known = self.words
        seen = set().union(*cut)
        new = seen.difference(known)
        if len(known) + len(new) > WORDS:
            known = self.words = {w: known[w] for w in seen.intersection(known)}
        if len(self.runs) > RUNS:
            self.runs = {"": b""}
        self.learn(list(new))
        tail = np.array([end], dtype=self.kind).tobytes()
        return [b"".join(map(known.__getitem__, words)) + tail for words in cut]


def _encoded(path: str, bounds: list[int]) -> Callable:
    """Each document's ids, and the part of the doc_ids that it falls into (0 without a doc_id)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upto = np.array(bounds, dtype=np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                rows = b.slice(at, 256)
                part = np.searchsorted(upto, rows["doc_id"].fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), rows["doc_id"], pa.array(tokenizer(path).encode(rows["text"].to_pylist()), pa.binary())],
                                                 ["part", "doc_id", "ids"])

    return run


def packed_file(doc_ids: list[int | None], ids: list[bytes], size: int) -> bytes:
    named = np.array([x for x in doc_ids if x is not None], dtype=np.int64)
    least = int(named[0]) if len(named) else 0
    ends = np.cumsum([len(x) // size for x in ids])
    head = HEAD.pack(MAGIC, size, len(ids), int(ends[-1]), len(ids) - len(named), least)
    apart = named.view(np.uint64) - np.array(least, dtype=np.int64).view(np.uint64)
    return head + EliasFano.of(ends).packed() + EliasFano.of(apart).packed() + b"".join(ids)


class TokenFile:
    """A file's content: numbers of documents and ids, boundaries by index, and the ids of a document."""

    def __init__(self, data: bytes | pa.Buffer):
        view = memoryview(data)
        magic, self.size, self.n_docs, self.n_ids, self.bare, self.least = HEAD.unpack_from(view)
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.ends, at = EliasFano.unpacked(view, HEAD.size)
        self.named, at = EliasFano.unpacked(view, at)
        self.ids = np.frombuffer(view, np.uint16 if self.size == 2 else np.uint32, self.n_ids, at)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]

    def doc_ids(self) -> list[int | None]:
        return [None] * self.bare + (self.named.all() + self.least).tolist()


def open_folder(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if urlparse(folder).scheme:
        return pyarrow.fs.FileSystem.from_uri(folder)
    return pyarrow.fs.LocalFileSystem(), folder


def _written(folder: str, size: int, file_bytes: int) -> Callable:
    """Rows come sorted by (part, doc_id). A part of more than `file_bytes` is cut into several files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from uuid import uuid4

        fs, root = open_folder(folder)
        fs.create_dir(root, recursive=True)
        part, piece, held_ids, held, bytes_held = None, 0, [], [], 0

        def close() -> pa.RecordBatch:
            name, spare = f"{root}/{part:010d}-{piece:06d}.ids", f"{root}/.{uuid4().hex}"
            with fs.open_output_stream(spare) as f:
                f.write(packed_file(held_ids, held, size))
            fs.move(spare, name)
            return pa.RecordBatch.from_pylist([{"part": part, "piece": piece, "n_docs": len(held), "n_ids": sum(map(len, held)) // size}])

        for b in batches:
            for doc_id, p, ids in zip(b["doc_id"].to_pylist(), b["part"].to_pylist(), b["ids"].to_pylist(), strict=True):
                if held and (p != part or bytes_held >= file_bytes):
                    yield close()
                    piece, held_ids, held, bytes_held = (piece + 1 if p == part else 0), [], [], 0
                part = p
                held_ids.append(doc_id)
                held.append(ids)
                bytes_held += len(ids)
        if held:
            yield close()

    return run


def write(docs: DataFrame, folder: str, path: str, file_rows: int = FILE_ROWS, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes `docs` (doc_id bigint, text) as token files with the tokenizer of `path`; returns the files' (part, piece, n_docs, n_ids).

    Files hold whole documents in ascending doc_id order, those without a doc_id first; equal doc_ids are ordered by their
    ids. A null text is empty, and every document ends with id 1. Repeated rows are documents each. No rows write no files.
    Other columns are not read. A part has about `file_rows` rows, and a file is closed at `file_bytes`.
    """
    size = np.dtype(tokenizer(path).kind).itemsize
    parts = -(-docs.count() // file_rows)
    # Bounds between parts, from the doc_ids alone; equal doc_ids fall into one part.
    bounds = docs.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 100 * parts)).first()[0] if parts > 1 else []
    ids = docs.select("doc_id", c("text").cast("string")).mapInArrow(_encoded(path, sorted(set(bounds or []))), "part bigint, doc_id bigint, ids binary")
    return step(ids.repartition(max(1, parts), "part").sortWithinPartitions("part", "doc_id", "ids").mapInArrow(
        _written(folder, size, file_bytes), "part bigint, piece bigint, n_docs bigint, n_ids bigint"), "token-files")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for name, content in zip(b["path"], b["content"], strict=True):
            f = TokenFile(content.as_buffer())
            part, piece = (int(x) for x in name.as_py().rsplit("/", 1)[1].removesuffix(".ids").split("-"))
            ends = f.ends.all()
            starts = np.concatenate(([0], ends[:-1]))
            crc = [zlib.crc32(f.ids[i:j].astype("<u4").tobytes()) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([part] * f.n_docs, pa.int64()), pa.array([piece] * f.n_docs, pa.int64()),
                                              pa.array(f.doc_ids(), pa.int64()), pa.array(starts), pa.array(ends - starts), pa.array(crc, pa.int64())],
                                             ["part", "piece", "doc_id", "inner", "n_tokens", "ids_crc32"])


def read(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files of `folder`; `files` is what write() returned."""
    spark = files.sparkSession
    starts = placed(files.withColumn("all", F.lit(0)), "all", "part", [c("piece")], c("n_ids"), "before").select("part", "piece", "before")
    if not files.take(1):
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(folder).select("path", "content")
    docs = content.mapInArrow(_read, "part bigint, piece bigint, doc_id bigint, inner bigint, n_tokens bigint, ids_crc32 bigint")
    return docs.join(starts, ["part", "piece"]).select("doc_id", (c("before") + c("inner")).alias("start"), "n_tokens", "ids_crc32")
