"""Exact values on small fixtures, seeded invariants, and differential tests of the Python helpers."""

from __future__ import annotations

import io
import random
import zipfile
from collections import deque

import pytest
from pyspark.sql import functions as F

from verbatia.functions.normalize import ARABIC, GENERIC, clean_text, scrub
from verbatia.operators import citations, corpus, edits, evaluate, extract, fuzzy, intervals, phrases, verify
from verbatia.operators.tokens import tokenize, tokenize_with_offsets
from verbatia.plans import audit
from verbatia.sources import files
from verbatia.streaming import state


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_levels_of_the_arabic_profile(spark):
    word = F.lit("قَالَ ـ  أَحْمَدُ‏")
    assert value(spark, ARABIC.literal(word)) == "قَالَ أَحْمَدُ"
    assert value(spark, ARABIC.letters(word)) == "قال أحمد"
    assert value(spark, ARABIC.folded(word)) == "قال احمد"
    assert value(spark, ARABIC.has_diacritics(word))
    assert value(spark, ARABIC.folded(F.lit("الصلاة على موسى"))) == "الصلاه علي موسي"


def test_generic_profile_and_cleaning(spark):
    assert value(spark, GENERIC.literal(F.lit("é ­ x"))) == "é x"
    assert value(spark, clean_text(F.lit("﻿a\r\nb\x07 "))) == "a\nb"
    assert value(spark, scrub(F.lit("a" * 21 + " b"))) == "[removed] b"


def test_offsets_point_at_the_tokens(spark):
    r = random.Random(3)
    rows = [(i, "".join(r.choice("ab é😀.,\ń") for _ in range(r.randint(0, 40)))) for i in range(60)]
    texts = dict(rows)
    got = tokenize_with_offsets(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()
    assert all(texts[t.doc_id][t.start : t.end] == t.raw for t in got)
    plain = tokenize(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()
    assert {(t.doc_id, t.tok, t.raw) for t in got} == {(t.doc_id, t.tok, t.raw) for t in plain}


def test_runs_are_maximal_and_found_without_seeding(spark):
    r = random.Random(5)
    vocab = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    works = [(i, " ".join(r.choice(vocab) for _ in range(40))) for i in range(6)]
    docs = []
    for d in range(30):
        words = [r.choice(vocab) for _ in range(30)]
        src = r.choice(works)[1].split()
        a, n = r.randint(0, 30), r.randint(3, 9)
        docs.append((d, " ".join(words[:10] + src[a : a + n] + words[10:])))
    c = corpus.build_corpus(spark.createDataFrame(works, "item_id long, text string"))
    df = {x.fold: x.df for x in c.vocab.collect()}
    got = {(x.doc_id, x.work, x.d0, x.d1, x.b0) for x in phrases.exact_runs(tokenize(spark.createDataFrame(docs, "doc_id long, text string"), ["doc_id"]), c).collect()}
    want = set()
    for d, text in docs:
        a = text.split()
        for w, other in works:
            b = other.split()
            for i in range(len(a)):
                for j in range(len(b)):
                    if a[i] == b[j] and (not i or not j or a[i - 1] != b[j - 1]):
                        n = 0
                        while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                            n += 1
                        if n >= 3 and min(df[x] for x in a[i : i + n]) <= 4:
                            want.add((d, w, i, i + n, j))
    assert got == want


def test_greedy_choice_is_disjoint_and_keeps_the_first(spark):
    rows = [(1, 0, 5, 1.0), (1, 4, 8, 9.0), (1, 8, 9, 2.0), (2, 0, 1, 1.0)]
    kept = intervals.greedy_disjoint(spark.createDataFrame(rows, "k long, s long, e long, mass double"), "k", [-F.col("mass"), F.col("s")])
    assert sorted((x.k, x.s) for x in kept.collect()) == [(1, 4), (1, 8), (2, 0)]


def test_interval_joins(spark):
    a = spark.createDataFrame([(1, 0, 3), (1, 5, 6)], "k long, s long, e long")
    b = spark.createDataFrame([(1, 2, 5, "x"), (2, 0, 9, "y")], "k long, s2 long, e2 long, v string")
    assert [(x.s, x.v) for x in intervals.overlap_join(a, b, ["k"]).collect()] == [(0, "x")]
    assert [x.s for x in intervals.overlap_join(a, b, ["k"], "left_anti").collect()] == [5]
    p = spark.createDataFrame([(1, 4, "p"), (1, 7, "q")], "k long, at long, ref string")
    assert sorted((x.s, x.ref) for x in intervals.asof_forward(a, p, "k", 2).collect()) == [(0, "p"), (5, "q")]
    assert sorted((x.s, x.ref) for x in intervals.asof_backward(a, p, "k", 2).collect() if x.ref) == [(5, "p")]
    merged = intervals.merge_ranges(spark.createDataFrame([(1, 0, 3), (1, 2, 5), (1, 6, 7)], "k long, s long, e long"), "k")
    assert sorted((x.s, x.e) for x in merged.collect()) == [(0, 5), (6, 7)]


def test_changes_apply_in_order_and_conflicts_go(spark):
    texts = spark.createDataFrame([(1, "a b c"), (2, "x")], "doc_id long, text string")
    changes = spark.createDataFrame([(1, 0, 1, "A"), (1, 0, 3, "no"), (1, 4, 5, "C")], "doc_id long, s long, e long, replacement string")
    kept = edits.without_conflicts(changes)
    assert {(x.doc_id, x.text) for x in edits.apply_changes(texts, kept).collect()} == {(1, "A b C"), (2, "x")}


def test_citations(spark):
    docs = spark.createDataFrame([(1, "see 2:255-256, 3:9-4 and «two words» \"one\"")], "doc_id long, text string")
    refs = sorted((x.s, x.chapter, x.verse, x.last, x.problem) for x in extract.numeric_references(docs).collect())
    assert refs == [(4, 2, 255, 256, "none"), (15, 3, 9, 4, "reversed")]
    assert [x.found for x in extract.marked_spans(docs).collect()] == ["«two words»"]


@pytest.mark.parametrize(
    "span",
    ["“two words”", "”two words“", "((two words))", "﴿two words﴾", "﴾two words﴿", "﴿﴿two words﴾﴾", "«two\nwords»", "{two\nwords}", "((two\nwords))", "﴿two\nwords﴾", '"two words"', "{" + "a " * 750 + "}", "«" + "b\n" * 750 + "»"],
)
def test_marked_spans_of_every_kind(spark, span):
    text = f"😀 one {span} and {span} end"
    got = extract.marked_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert sorted((x.s, x.e, x.found) for x in got) == [(i, i + len(span), span) for i in (6, 11 + len(span))]


@pytest.mark.parametrize("text", ["“two\nwords”", "﴿two\n\nwords﴾", "((one))", "{" + "a " * 751 + "}", "(two words)", "“two words", "«one two {three"])
def test_what_is_not_marked(spark, text):
    assert extract.marked_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).count() == 0


def naive_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_edit_scripts_are_least():
    r = random.Random(2)
    for _ in range(300):
        a, b = ([r.choice("abc") for _ in range(r.randint(0, 8))] for _ in range(2))
        equal, sub, dele, ins = evaluate.edit_counts(a, b)
        assert sub + dele + ins == naive_distance(a, b)
        assert (equal + sub + dele, equal + sub + ins) == (len(a), len(b))


def test_edit_scripts_prefer_diagonal_steps_then_deletions():
    def back(a, b):
        i, j, out = len(a), len(b), [0, 0, 0, 0]
        while i or j:
            here = naive_distance(a[:i], b[:j])
            steps = [(i - 1, j - 1, int(a[i - 1] != b[j - 1]))] if i and j else []
            steps += [(i - 1, j, 2)] if i else []
            steps += [(i, j - 1, 3)] if j else []
            i, j, kind = next(s for s in steps if naive_distance(a[: s[0]], b[: s[1]]) + (s[2] > 0) == here)
            out[kind] += 1
        return tuple(out)

    r = random.Random(12)
    for _ in range(200):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 9))] for _ in range(2))
        assert evaluate.edit_counts(a, b) == back(a, b)
    long = [str(i % 97) for i in range(700)]
    assert evaluate.edit_counts(long, long[:300] + ["x"] + long[301:]) == (699, 1, 0, 0)


def test_near_words():
    assert fuzzy.near_word("reading", "readings") and not fuzzy.near_word("ab", "ab") and not fuzzy.near_word("stone", "water")


def test_near_words_are_all_found(spark):
    r = random.Random(6)
    words = {"".join(r.choice("abcde") for _ in range(r.randint(1, 9))) for _ in range(250)} | {"recieve", "receive", "mississippi", "missisippi", "ab" * 12, "ab" * 11 + "c", "été", "étés", "aaaa", "aaaaaa"}
    want = {(a, b) for a in words for b in words if a < b and fuzzy.near_word(a, b)}
    df = spark.createDataFrame([(w,) for w in words], "fold string")
    got = [tuple(x) for x in fuzzy.near_words(fuzzy.near_candidates(df)).collect()]
    assert {("receive", "recieve"), ("missisippi", "mississippi")} < want and len(got) == len(set(got)) and set(got) == want
    pairs = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string").filter("a < b")
    assert {tuple(x) for x in fuzzy.near_words(pairs).collect()} == want


def test_the_limiter_counts_accepted_requests_only():
    assert state.admit([0, 1, 2, 60, 60.5, 61.5], deque(), 2, 60) == [True, True, False, False, True, True]
    assert state.admit([0, 60, 60.1], deque(), 1, 60) == [True, False, True]


def test_folds_hold_no_whole_key(spark):
    r = random.Random(8)
    rows = [(i, r.choice((1, 1, 1, 2, 3, None)), None if i % 97 == 0 else 1e9 + r.randint(0, 900), r.random() < 0.6) for i in range(600)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, s double, ok boolean").withColumn("ts", F.timestamp_seconds("s"))
    order = sorted(rows, key=lambda x: (x[2] is None, x[2] or 0, x[0]))
    limited, skipped = set(), set()
    for k in (1, 2, 3, None):
        mine = [(i, float("nan") if t is None else t, ok) for i, u, t, ok in order if u == k]
        limited |= {(k, i, a) for (i, *_), a in zip(mine, state.admit([t for _, t, _ in mine], deque(), 4, 20))}
        until = float("-inf")
        for i, t, ok in mine:
            skipped.add((k, i, t < until))
            if not t < until:
                until = float("-inf") if ok else t + 20
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for df, want in ((state.rate_limit(events, 4, 20), limited), (state.cooldown(events, "ok", 20), skipped)):
            assert "InPandas" not in df._jdf.queryExecution().toString()
            got = [tuple(x) for x in df.collect()]
            assert len(got) == 600 and set(got) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_limiter_stream_equals_batch(spark, tmp_path):
    rows = [(i, i % 3, 1e9 + i * 7 % 50) for i in range(60)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, s double").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = state.rate_limit_stream(stream, 4, 20).writeStream.format("memory").queryName("limited").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    want = {tuple(r) for r in state.rate_limit(events, 4, 20).collect()}
    assert {tuple(r) for r in spark.table("limited").collect()} == want


def test_freshness(spark):
    df = spark.createDataFrame([(10, None), (90_000, None), (90_000, 170_000 - 30), (700_000, 1_000_000 - 30)], "age long, fail long")
    now = F.when(F.col("age") == 700_000, 1_000_000).otherwise(170_000)
    got = [r.x for r in df.select(state.freshness(now, now - F.col("age"), F.col("fail")).alias("x")).collect()]
    assert got == ["use", "refresh", "use_stale", "unavailable"]


def docx(xml: str, **more: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in {"word/document.xml": xml, **more}.items():
            z.writestr(name, body)
    return out.getvalue()


@pytest.fixture
def body():
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    return f"<w:document {ns}><w:p><w:r><w:t>one</w:t></w:r><w:del><w:r><w:delText>gone</w:delText></w:r></w:del></w:p><w:p><w:ins><w:r><w:t>two</w:t></w:r></w:ins></w:p></w:document>"


def test_files_give_text_or_a_reason(spark, tmp_path, body):
    cases = {"a.docx": docx(body), "b.txt": "hé\r\nx".encode(), "c.txt": "x".encode("utf-16"), "d.pdf": b"%PDF-1.4", "e.txt": b"\xff\xfe\xff", "f.docx": b"PK\x03\x04junk", "g.txt": b"a" * 30_000, "h.bin": b"a\0\1"}
    for name, raw in cases.items():
        (tmp_path / name).write_bytes(raw)
    got = {r.path.rsplit("/", 1)[1]: (r.text, r.code) for r in files.read_files(spark, str(tmp_path)).collect()}
    assert got["a.docx"] == ("one\ntwo", None) and got["b.txt"] == ("hé\nx", None) and got["c.txt"] == ("x", None)
    assert {n: got[n][1] for n in "d.pdf f.docx g.txt h.bin".split()} == {"d.pdf": "unsupported_pdf", "f.docx": "damaged", "g.txt": "too_long", "h.bin": "binary"}
    assert got["g.txt"][0] is None


def test_proposals(spark):
    rows = [("a", "failed", None), ("a", "ok", '{"quotes": [{"quote": "q", "reference_text": "r"}]}'), ("b", "ok", "not json")]
    got = files.provider_proposals(spark.createDataFrame(rows, "id string, outcome string, answer string")).collect()
    assert [(r.id, r.quote, r.reference_text) for r in got] == [("a", "q", "r")]


def test_quotations_and_citations(spark):
    works = spark.createDataFrame([(1, "alpha beta gamma delta. one two three four"), (2, "one two three five")], "item_id long, text string")
    c = corpus.build_corpus(works)
    quotes = [(1, "alpha beta gamma", None, None), (2, "one two three", None, None), (3, "one two three", 2, 0), (4, "beta gamma", None, None), (5, "no such words", None, None), (6, "beta gamma", 1, 0)]
    df = spark.createDataFrame([(i, q.split(), w, u, u) for i, q, w, u in quotes], "quote_id long, words array<string>, ref_work long, ref_unit0 long, ref_unit1 long")
    places = verify.covered_units(verify.exact_occurrences(df, c), c)
    got = {r.quote_id: (r.status, r.work) for r in verify.verify(df, places.select("quote_id", "work", "p0", "p1", "unit0", "unit1")).collect()}
    assert got == {1: ("matched", 1), 2: ("uncertain", None), 3: ("matched", 2), 4: ("uncertain", 1), 5: ("difference", None), 6: ("matched", 1)}
    coverage = {r.quote_id: r.coverage for r in places.filter("work = 1").collect()}
    assert coverage[1] == "partial"


def test_an_audit_of_a_clean_and_a_copying_text(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    source = [word() for _ in range(30)]
    docs = [(1, " ".join(word() for _ in range(40))), (2, "intro words. " + " ".join(source[5:15]) + ". (7:0)")]
    works = spark.createDataFrame([(7, " ".join(source)), (8, " ".join(word() for _ in range(30)))], "item_id long, text string")
    found = audit.audit(spark.createDataFrame(docs, "doc_id long, text string"), corpus.build_corpus(works), phrases.Thresholds(mass_floor=0.0, mass_candidate=2.0)).collect()
    assert [(f.doc_id, f.quote, f.work, f.p0, f.p1, f.start_status) for f in found] == [(2, " ".join(source[5:15]), 7, 5, 15, "punctuation")]
    assert found[0].reference == "7:0" and found[0].reference_status == "incorrect"


def test_named_citations_and_their_quotations(spark):
    text = "He said one two three (Book Of 3) and, as Letters 2-1 says, four five six. Numbers 9"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    works = spark.createDataFrame([(10, "Book Of", 5), (11, "Letters", 4), (12, "Numbers", 4)], "work long, name string, n_units int")
    refs = citations.named_references(docs, works)
    got = sorted((r.s, r.work, r.unit0, r.unit1, r.problem) for r in refs.collect())
    assert [g[1:] for g in got] == [(10, 3, 3, "none"), (11, 2, 1, "reversed"), (12, 9, 9, "out_of_range")]
    spans = [(1, text.index(q), text.index(q) + len(q)) for q in ("one two three", "four five six")]
    attached = citations.attach_references(spark.createDataFrame(spans, "doc_id long, s long, e long"), refs.filter("problem <> 'out_of_range'"))
    assert [text[r.ref_s : r.ref_e][-3:] for r in attached.orderBy("s").collect()] == ["f 3", "2-1"]


def test_the_limiter_takes_keys_of_any_type(spark):
    rows = [("audit|10.0.0.1", f"e{i}", i * 10) for i in range(8)] + [("audit|10.0.0.2", "x", 5), (None, "y", 5)]
    events = spark.createDataFrame(rows, "client string, id string, at long").selectExpr("client", "id", "timestamp_seconds(at) as ts")
    got = state.rate_limit(events, limit=3, key="client", event_id="id")
    assert got.dtypes == [("client", "string"), ("id", "string"), ("accepted", "boolean")]
    assert {(r.client, r.id): r.accepted for r in got.collect()} == {(c, i): c != "audit|10.0.0.1" or i not in ("e3", "e4", "e5", "e6") for c, i, _ in rows}
