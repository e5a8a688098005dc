import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkwarden.llm import token_files as T
from sparkwarden.llm.elias_fano import EliasFano

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "\n\n", "a b", "x y\x1cz\x85w", "don't we'll I'M  it's", "ΑΣ ΣΑΣ. ς", "é ́e", "İstanbul ǅ ﬁ", "日本 語。12 345", "<|endoftext|> <|startoftext|>x",
       "é" * 3000, "word " * 30000, "﻿a​b", "a\x00b", "co-op A.B. (x) x's <|endoftext|>, a<|endoftext|> ÷× x÷ ªº aª µ", "ÀÉ ÿß ẞ ſ K Å Œuvre œ"]


def want(texts):
    t = Tokenizer.from_file(PATH)
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes() for x in texts]


def test_words_are_encoded_as_whole_texts(sample):
    texts = ODD + [r.text for r in sample.collect()]
    got = [np.frombuffer(x, np.uint16).astype("<u4").tobytes() for x in T.tokenizer(PATH).encode(texts)]
    assert got == want(texts)


def test_memory_of_words_is_bounded():
    """An executor has a worker or more for each core, and each has a memory of its own."""
    e = T.Encoder(PATH)
    for k in range(0, 440_000, 20_000):
        texts = [" ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}" for i in range(k, k + 20_000))]
        got = e.encode(texts)
        assert len(e.words) <= 100_000 and len(e.runs) <= 420_001
    assert np.frombuffer(got[0], np.uint16).astype("<u4").tobytes() == want(texts)[0]


def test_memory_keeps_the_words_in_use(monkeypatch):
    """A full memory forgets what the present texts don't hold, and learns no word twice that it has kept."""
    monkeypatch.setattr(T, "WORDS", 40)
    e, learned = T.Encoder(PATH), []
    learn = e.learn
    monkeypatch.setattr(e, "learn", lambda words: (learned.extend(words), learn(words)))
    texts = [" ".join(["Été,", "often", "naïve..."] + [f"{chr(97 + i)}{chr(97 + j)}ÿ" for i in range(15)]) for j in range(26)]
    got = [e.encode([x])[0] for x in texts]
    assert [np.frombuffer(x, np.uint16).astype("<u4").tobytes() for x in got] == want(texts)
    assert len(e.words) <= 40 and learned.count("often") == learned.count("Été,") == 1


def test_every_letter_is_cut_as_the_tokenizer_cuts_it():
    letters = [chr(x) for x in range(0xC0, 0x100)]
    texts = [*letters, "".join(letters), *("a" + x + "b" + y for x in letters for y in letters[::7])]
    assert [np.frombuffer(x, np.uint16).astype("<u4").tobytes() for x in T.Encoder(PATH).encode(texts)] == want(texts)


@pytest.mark.parametrize("rows,size", [(8192, 32 << 20), (7, 32 << 20), (50, 400)])
def test_files_give_back_every_document(spark, docs, sample, tmp_path, rows, size):
    given = [(r.doc_id, r.text) for r in sample.collect()] + [(10_000 + i, x) for i, x in enumerate(ODD)]
    given += [(None, "no id"), (None, None), (-5, "negative"), (3, None), given[7], given[7], (1 << 60, "far")]
    files = T.write(docs([(a, b, None) for a, b in given]), f"file://{tmp_path}/out", PATH, rows, size)
    got = T.read(files, f"file://{tmp_path}/out").orderBy("start").collect()
    ids = want([x for _, x in given])
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == sorted(((d, len(x) // 4, zlib.crc32(x)) for (d, _), x in zip(given, ids, strict=True)), key=str)
    keys = [-(1 << 63) if r.doc_id is None else r.doc_id for r in got]
    assert keys == sorted(keys) and [r.start for r in got] == [sum(r.n_tokens for r in got[:i]) for i in range(len(got))]
    assert (files.count() > 10) == (rows < 8192)


def test_empty(docs, tmp_path):
    files = T.write(docs([]), str(tmp_path / "none"), PATH)
    assert T.read(files, str(tmp_path / "none")).count() == 0


def test_document_access_and_space():
    r = random.Random(2)
    ids = [np.array([r.randrange(40000) for _ in range(r.choice([1, 3, 700]))], np.uint16) for _ in range(3000)]
    data = T.packed_file(list(range(5, 3005)), [x.tobytes() for x in ids], 2)
    f = T.TokenFile(data)
    for i in [0, 1, 255, 256, 257, 1999, 2999]:
        assert (f.document(i) == ids[i]).all()
    assert f.doc_ids() == list(range(5, 3005))
    assert len(f.ends.packed()) < 3000 * 2  # of 8 bytes each in a plain table


@pytest.mark.parametrize("values", [[0], [0, 0, 0], [5, 5, 9, 1 << 50], list(range(0, 9000, 9)), [0] * 600 + [1 << 20] * 600])
def test_elias_fano(values):
    e, at = EliasFano.unpacked(memoryview(EliasFano.of(np.array(values)).packed() + b"x"), 0)
    assert e.all().tolist() == values and [e.select(i) for i in range(len(values))] == values
    assert EliasFano.of(np.zeros(0, np.int64)).all().tolist() == []
