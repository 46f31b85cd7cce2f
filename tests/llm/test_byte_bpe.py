"""Byte-level BPE by prefixes: against the tiktoken library."""

from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from verbatia.llm.byte_bpe import Coder, Prefixes, Vocabulary, decode_bytes, edit_texts, encode_bytes
from verbatia.llm.queries import QUERIES

PIECES = ["the ", "and", "  ", "\n", "é", "12", "'s", "ing", " ", ".", "don't", "世", " ", " ", "\t", "😀", "\r\n", "aaa", "'"]


def library(name: str) -> tuple[str, tiktoken.Encoding]:
    path = public_tokenizers.path(name)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    path, lib = library("byte_bpe_50k.tiktoken")
    return Coder(path, public_tokenizers.PATTERN), lib


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_ids_equal_the_librarys(name):
    path, lib = library(name)
    code, r = Coder(path, public_tokenizers.PATTERN), random.Random(4)
    texts = ["".join(r.choice(PIECES) for _ in range(r.randint(0, 40))) for _ in range(1500)] + ["a" * 3000, "ab" * 2000, " " * 300, "\n", "", "x \n", "<|endoftext|>"]
    raw = [t.encode() for t in texts]
    got = code(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    assert [x.tolist() for x in got] == [lib.encode_ordinary(t) for t in texts]
    assert all(code.vocabulary.decode(x).tobytes() == t for x, t in zip(got, raw))


def test_neighbours_bear_each_other_as_merging_says(coder):
    code, lib = coder
    r, words = random.Random(5), code.vocabulary
    x, y = (np.array([r.randrange(len(words.text)) if r.random() < 0.5 else r.randrange(400) for _ in range(4000)]) for _ in range(2))
    want = [lib._core_bpe.encode_single_piece(words.text[a] + words.text[b]) == [a, b] for a, b in zip(x, y)]
    assert words.bear(x, y).tolist() == want == [words.bears(int(a), int(b)) for a, b in zip(x, y)]


def test_prefixes_grow_and_shrink(coder):
    code, lib = coder
    r = random.Random(6)
    data = ("quickest" * 20 + "".join(r.choice("abcdefgh") for _ in range(300))).encode()
    piece = Prefixes(code.vocabulary)
    for i in range(0, len(data), 11):
        assert piece.append(data[i : i + 11]).ids().tolist() == lib._core_bpe.encode_single_piece(piece.data)
    for n in (300, 33, 32, 1):
        assert piece.cut(n).ids().tolist() == lib._core_bpe.encode_single_piece(data[:n])
    assert piece.cut(0).ids().tolist() == []


def test_edits_find_the_ids_of_the_new_text(coder):
    code, lib = coder
    r = random.Random(7)
    for _ in range(3000):
        text = "".join(r.choice(PIECES) for _ in range(r.randint(0, 30)))
        a = r.randint(0, len(text))
        b, put = r.randint(a, min(len(text), a + 4)), "".join(r.choice(PIECES) for _ in range(r.randint(0, 3)))
        new, ids = code.edit_text(text, np.array(lib.encode_ordinary(text), np.uint32), a, b, put)
        assert new == text[:a] + put + text[b:] and ids.tolist() == lib.encode_ordinary(new), (text, a, b, put)


def test_vocabularies_that_break_the_conditions_are_refused():
    every = {bytes([b]): b for b in range(256)}
    with pytest.raises(ValueError):
        Vocabulary({b"a": 0})
    with pytest.raises(ValueError):
        Vocabulary(every | {b"abc": 256, b"bc": 257})
    assert [x.tolist() for x in Vocabulary(every | {b"ab": 256, b"ba": 257}).encode([b"aba", b"bab", b""])] == [[256, 97], [98, 256], []]


def test_texts_of_documents(spark, docs, texts, empty):
    path, lib = library("byte_bpe_50k.tiktoken")
    rows = encode_bytes(docs, path, public_tokenizers.PATTERN)
    got = sorted((r.doc_id, r.ids, bytes(r.decoded)) for r in rows.collect())
    assert got == sorted((i, lib.encode_ordinary(t or ""), (t or "").encode()) for i, t in texts)
    again = decode_bytes(rows.drop("decoded"), path, public_tokenizers.PATTERN)
    assert sorted((r.doc_id, bytes(r.decoded)) for r in again.collect()) == sorted((i, d) for i, _, d in got)
    assert encode_bytes(empty, path, public_tokenizers.PATTERN).count() == 0


def test_edited_texts(spark, docs, texts):
    path, lib = library("byte_bpe_50k.tiktoken")
    once = {i: t for i, t in texts}
    coded = spark.createDataFrame([(i, t, None if t is None else lib.encode_ordinary(t)) for i, t in once.items()], "doc_id long, text string, ids array<int>")
    edits = [(i, len(t), len(t), " more of it") for i, t in once.items() if t and i % 2] + [(i, 2, 5, "X's") for i, t in once.items() if t and len(t) > 9 and i % 3 == 0] + [(-1, 0, 0, "lost"), (0, 0, 1, None)]
    rows = {r.doc_id: r for r in edit_texts(coded, spark.createDataFrame(edits, "doc_id long, start int, stop int, put string"), path, public_tokenizers.PATTERN).collect()}
    assert set(rows) == set(once)
    for i, t in once.items():
        new = t
        for _, a, b, put in sorted((e for e in edits if e[0] == i), key=lambda e: e[1:3], reverse=True):
            new = new and new[:a] + (put or "") + new[b:]
        assert rows[i].text == new and rows[i].ids == (None if new is None else lib.encode_ordinary(new))


def test_registered_query(spark, texts, tmp_path):
    _, lib = library("byte_bpe_50k.tiktoken")
    spark.createDataFrame([(i, t, 1.0) for i, t in [*texts, (None, "no id")]], "doc_id long, text string, ids double").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = [(i, len(ids := lib.encode_ordinary(t or "")), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())) for i, t in [*texts, (None, "no id")]]
    got = QUERIES["op12_byte_bpe"](spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
