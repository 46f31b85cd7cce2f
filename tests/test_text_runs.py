"""Runs, offsets and ranges made within the rows of texts: the same as from tokens, and no words are shuffled."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from verbatia.operators import approximate, cues, findings, intervals, phrases
from verbatia.operators.corpus import build_corpus
from verbatia.operators.tokens import running_sums, tokenize, tokenize_with_offsets


def test_text_runs_equal_runs_of_tokens_with_offsets(spark):
    r = random.Random(5)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)]
    works = [(i, " ".join(r.choices(words, k=30)) + ".") for i in range(8)]
    texts = [(i, " ".join(r.choices(words, k=20)) + ", é" + works[i % 8][1][3 * i : 3 * i + 60] + "… " + works[(i + 3) % 8][1][:40]) for i in range(12)]
    docs = spark.createDataFrame([*texts, (90, ""), (91, None), (92, "12 3")], "doc_id long, text string")
    corpus = build_corpus(spark.createDataFrame(works, "item_id long, text string"))
    tokens = tokenize(docs, ["doc_id"])
    cols = ["doc_id", "work", "d0", "d1", "b0", "b1", "words", "mass", "rarest"]
    want = sorted(tuple(x) for x in phrases.exact_runs(tokens, corpus).select(*cols).collect())
    found = phrases.text_runs(docs, corpus)
    got = found.collect()
    assert want and sorted(tuple(x[c] for c in cols) for x in got) == want
    text = dict(texts)
    off = {(x.doc_id, x.tok): x for x in tokenize_with_offsets(docs, ["doc_id"]).collect()}
    for x in got:
        assert (x.s, x.e) == (off[x.doc_id, x.d0].start, off[x.doc_id, x.d1 - 1].end)
        assert x.before == off[x.doc_id, x.d0].gap and x.after == (off[x.doc_id, x.d1].gap if (x.doc_id, x.d1) in off else None)
    assert all(text[k[0]][x.start : x.end] == x.raw for k, x in off.items())


def test_offsets_shuffle_nothing(spark):
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    plan = tokenize_with_offsets(docs, ["doc_id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_running_sums(spark):
    rows = spark.createDataFrame([(i, [j % 5 for j in range(i)] if i != 3 else None) for i in range(12)], "i int, a array<int>").coalesce(1)
    for x in rows.select("i", "a", running_sums(F.col("a")).alias("s")).filter("i <> 3 and i % 4 <> 1").collect():
        assert x.s == [sum(x.a[: k + 1]) for k in range(x.i)]


def test_with_overlaps(spark):
    a = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (2, 0, 5), (3, 1, 2)], "k int, s long, e long")
    b = spark.createDataFrame([(1, 4, 5), (2, 5, 6), (1, 4, 5)], "k int, s long, e long")
    got = {(x.k, x.s): x.marked for x in intervals.with_overlaps(a, b, "k", "marked").collect()}
    assert got == {(1, 0): True, (1, 5): False, (2, 0): False, (3, 1): False}


def _texts(spark, seed: int):
    r = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    works = [(i, " ".join(r.choices(words, k=30)) + ".") for i in range(6)]
    texts = [(i, "".join(w + r.choice([" ", " ", ", ", ". "]) for w in r.choices(words, k=25)) + works[i % 6][1][3 * i : 3 * i + 50].replace("wa", "wb", 1)) for i in range(20)]
    docs = spark.createDataFrame([*texts, (90, ""), (91, None)], "doc_id long, text string")
    return docs, build_corpus(spark.createDataFrame(works, "item_id long, text string"))


def test_text_windows_equal_windows_of_tokens(spark):
    docs, _ = _texts(spark, 3)
    named = {"waa": "lead_in", "wba": "article", "wca": "article", "wda": "lead_in"}
    off = tokenize_with_offsets(docs, ["doc_id"])
    want = sorted(tuple(x) for x in cues.cue_windows(off, named, most=6).collect())
    got = cues.text_windows(docs, named, most=6).collect()
    assert want and sorted((x.doc_id, x.w0, x.w1, x.kind) for x in got) == want
    at = {(x.doc_id, x.tok): x for x in off.collect()}
    assert all((x.s, x.e) == (at[x.doc_id, x.w0].start, at[x.doc_id, x.w1 - 1].end) for x in got)


def test_shared_diagonals_equal_a_plain_loop(spark):
    docs, corpus = _texts(spark, 4)
    rows = approximate.document_rows(docs)
    rare = {x.fold for x in corpus.vocab.filter("df <= 3").collect()}
    places = [(x.work, x.pos, x.fold) for x in corpus.tokens.collect() if x.fold in rare]
    want = {}
    for x in rows.collect():
        for tok, word in enumerate(x.words):
            for work, pos, fold in places:
                if fold == word:
                    want.setdefault((x.doc_id, work, tok - pos), set()).add(tok)
    count = lambda toks: [sum(1 for t in toks if t - 1 not in toks), max(next(n for n in range(1, 99) if t + n not in toks) for t in toks)]
    assert want and {(x.doc_id, x.work, x.diag): [x.blocks, x.longest] for x in approximate.shared_diagonals(rows, corpus, 3).collect()} == {k: count(v) for k, v in want.items()}


def test_seeds_left_out_give_no_alignment(spark, monkeypatch):
    docs, corpus = _texts(spark, 6)
    rows = approximate.document_rows(docs)
    (works,) = approximate._blocks(corpus, phrases.Thresholds())
    monkeypatch.setattr(approximate, "SEEDS", 7)
    some = 0
    for x in rows.collect():
        segment = [sum(s <= t for s in x.starts) for t in range(len(x.words))]
        toks, places = approximate.promising(pa.array(x.words), np.array(segment), works)
        seeds = [(int(t), works.names[works.work_of[p]], int(works.pos_of[p])) for t, p in zip(toks, places)]
        every = [*approximate.align(x.words, x.starts, works, anchor=0.5)]
        some += len(every)
        assert len(seeds) < sum(len(works.places.get(w, ())) for w in x.words)
        assert [*approximate.align(x.words, x.starts, works, anchor=0.5, seeds=seeds)] == every
    assert some


def test_marked_pairs_by_letters(spark):
    words = spark.createDataFrame([(w,) for w in ("cafe", "café", "café", "caf", "́", "a1", "ab")], "fold string")
    got = {(x.fold, x.other) for x in findings.marked_pairs(words).collect()}
    assert got == {("cafe", "café"), ("cafe", "café"), ("café", "café")}
