"""Operators on findings, cues and static tables on small fixtures."""

from __future__ import annotations

import io
import random
import zipfile
from collections import Counter
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from verbatia.operators import cues, findings, fuzzy
from verbatia.sources import files, tables


def test_near_words_equal_their_definition(spark):
    r = random.Random(2)
    words = ["".join(r.choice("abc") for _ in range(r.randint(1, 9))) for _ in range(120)] + ["mississippi", "missisippi", "receive", "recieve", "abcdefgh", "abcdefxy"]
    df = spark.createDataFrame([(w,) for w in words], "fold string")
    got = {(x.a, x.b) for x in fuzzy.near_words(fuzzy.near_candidates(df)).collect()}

    def near(a, b):
        short = min(len(a), len(b))
        return short >= 3 and abs(len(a) - len(b)) <= 3 and sum((Counter(a) & Counter(b)).values()) >= short - 1 and SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.75

    assert got == {(a, b) for a in set(words) for b in set(words) if a < b and near(a, b)}
    assert ("abcdefgh", "abcdefxy") not in got and ("receive", "recieve") in got


def test_place_in_a_stream_equals_brute_force():
    r = random.Random(5)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
        return row[-1]

    for _ in range(200):
        quote, stream = [r.choice("abcd") for _ in range(r.randint(1, 5))], [r.choice("abcd") for _ in range(r.randint(0, 9))]
        j0, j1, equal = fuzzy.place_in(quote, stream)
        least = min(distance(quote, stream[i:j]) for i in range(len(stream) + 1) for j in range(i, len(stream) + 1))
        assert distance(quote, stream[j0:j1]) == least and 0 <= equal <= min(len(quote), j1 - j0)


def test_lines_marks_and_folds(spark):
    df = spark.createDataFrame([("a\nbc (d {e} f", 5), ("", 0), ("Äb­c", 2), (") x", 1)], "text string, at int")
    got = df.select(findings.line_column(F.col("text"), F.col("at")).alias("p"), findings.open_mark(F.col("text"), {"(": ")", "{": "}"}).alias("o"), findings.fold_map(F.col("text")).alias("m")).collect()
    assert [tuple(x.p) for x in got] == [(2, 4), (1, 1), (1, 3), (1, 2)]
    assert [x.o for x in got] == ["(", "", "", ""]
    assert [(y.x, y.at) for y in got[2].m] == [("ä", 0), ("b", 1), ("c", 3)] and got[1].m == []


def test_edits_move_or_spoil_spans(spark):
    spans = spark.createDataFrame([(1, 5, 9), (1, 20, 24), (2, 0, 3)], "doc_id long, s long, e long")
    changes = spark.createDataFrame([(1, 0, 2, 3), (1, 21, 22, -1)], "doc_id long, s long, e long, added int")
    got = {(x.doc_id, x.s, x.e): x.stale for x in findings.shift_spans(spans, changes).collect()}
    assert got == {(1, 8, 12): False, (1, 23, 27): True, (2, 0, 3): False}


def test_gold_takes_the_first_finding_that_covers_half(spark):
    gold = spark.createDataFrame([(1, 0, 10, 7), (1, 50, 60, 8)], "doc_id long, g0 long, g1 long, gold_work long")
    found = spark.createDataFrame([(1, 6, 12, 7), (1, 2, 9, 9), (1, 4, 10, 7), (1, 58, 70, 8)], "doc_id long, d0 long, d1 long, work long")
    got = sorted((x.g0, x.d0, x.work) for x in findings.match_gold(gold, found).fillna(-1).collect())
    assert got == [(0, 2, 9), (50, -1, -1)]


def test_cue_windows_end_with_the_sentence(spark):
    rows = [(1, i, w, g) for i, (w, g) in enumerate([("that", ""), ("a", " "), ("that", " "), ("b", " "), ("c", " "), ("d", ". "), ("that", " "), ("e", " ")])]
    t = spark.createDataFrame(rows, "doc_id long, tok long, fold string, gap string")
    assert [tuple(x) for x in cues.cue_windows(t, {"that": "lead_in"}).collect()] == [(1, 3, 5, "lead_in")]


def test_static_tables_and_the_cached_corpus(spark, tmp_path):
    (tmp_path / "z.tsv").write_text("# made\nword\t3.5\nother\t1.0\n")
    (tmp_path / "c.json").write_text('[{"a": 1},\n {"a": 2}]')
    (tmp_path / "t.txt").write_text("one\ntwo")
    assert {tuple(x) for x in tables.frequency_table(spark, f"{tmp_path}/z.tsv").collect()} == {("word", 3.5), ("other", 1.0)}
    assert [x.a for x in tables.cases(spark, f"{tmp_path}/c.json", "a int").collect()] == [1, 2]
    assert tables.articles(spark, f"{tmp_path}/t.txt").first().text == "one\ntwo"
    root = f"file://{tmp_path}/cache"
    assert tables.load_corpus(spark, root) is None
    for at in (1.0, 2.0):
        tables.save_corpus(spark.createDataFrame([(int(at), "x")], "work int, text string"), root, at)
    units, at = tables.load_corpus(spark, root)
    assert at == 2.0 and [x.work for x in units.collect()] == [2]


def test_a_damaged_archive_is_refused():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", "<x>" + "ab" * 500 + "</x>")
    raw = bytearray(out.getvalue())
    at = raw.index(b"word/document.xml") + 17
    raw[at : at + 4] = b"\xff\xff\xff\xff"
    assert files.docx_text(bytes(raw)) == (None, "damaged")


def test_marks_conflict_letter_by_letter(spark):
    pairs = [("été", "ete", True, False), ("ete", "été", False, True), ("côte", "coté", True, True), ("šő", "so", True, False), ("a", "b", False, False), ("كِتَابًا", "كتاب", False, False), ("كِتَابً", "كِتَاب", True, False), ("كِتَابًا", "كِتَاباً", False, False)]
    rows = spark.createDataFrame([(n, *p) for n, p in enumerate(pairs)], "n int, a string, b string, one boolean, two boolean")
    a, b = findings.mark_profile(F.col("a")), findings.mark_profile(F.col("b"))
    got = rows.select("n", "one", "two", findings.marks_conflict(a, b).alias("x"), findings.marks_conflict(b, a).alias("y")).collect()
    assert [(r.x, r.y) for r in sorted(got)] == [p[2:] for p in pairs]
    assert [r.m for r in spark.createDataFrame([("őš1",)], "w string").select(findings.letter_marks(F.col("w")).alias("m")).collect()] == [["o:\u030b", "s:\u030c"]]
