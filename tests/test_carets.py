"""Carets of texts: the rows of their SQL on odd texts, a long text, and what is written for those that match nothing."""

from __future__ import annotations

import random
import time

import duckdb
import pytest

from verbatia.operators import continuations
from verbatia.operators.corpus import build_corpus
from verbatia.plans import rules

NAMES = ["caret_verdicts", "caret_choices", "caret_accuracy"]


def _word(r: random.Random) -> str:
    return "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=7))


def _tables(spark, at, texts: list[tuple], works: list[str]) -> str:
    spark.createDataFrame(texts, "doc_id long, text string, lang string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([*enumerate(works)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r = random.Random(4)
    works = [" ".join(_word(r) for _ in range(30)) + ". " + " ".join(_word(r) for _ in range(20)) + "." for _ in range(6)]
    works.append(works[0])
    texts = []
    for i in range(60):
        w = r.choice(works).replace(".", "").split()
        cut = r.randint(0, 30)
        said = w[cut : cut + r.randint(8, 16)]
        if i % 3 == 0:
            said[-5] = _word(r)
        texts.append((i, f"{' '.join(_word(r) for _ in range(12))}. that {' '.join(said)}! «{' '.join(w[3:14])}» {' '.join(_word(r) for _ in range(5))}", r.choice(["en", "de", None])))
    marks = ["« that", "“, that", "«\n \t", "{\x0c", '" " ', "«»", "«𝄞", "“«"]
    texts += [(200 + i, f"x, y; {m} {' '.join(works[i % 6].split()[2:12])} 's {' '.join(works[i % 5].split()[4:15])}{m}", "fr") for i, m in enumerate(marks)]
    odd = ["", None, "...", "one", " ".join(works), "\n".join(works[1].split()), "12 " + works[2].upper(), " ".join([works[3].split()[0]] * 12), "é́ " + works[4]]
    return _tables(spark, tmp_path_factory.mktemp("carets"), [*texts, *((1000 + i, x, ["en", None][i % 2]) for i, x in enumerate(odd))], works)


@pytest.mark.parametrize("name", NAMES)
def test_rows_of_odd_texts_equal_sql(spark, tables, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"create view {table} as select * from '{tables}/{table}.parquet/*.parquet'")
    asked = con.execute(rules.ORACLE[name])
    columns = [d[0] for d in asked.description]
    want = sorted(map(repr, asked.fetchall()))
    df = rules.QUERIES[name](spark, tables)
    assert len(want) > 30 or name == "caret_accuracy" and len(want) == 4
    assert sorted(df.columns) == sorted(columns) and sorted(repr(tuple(x[c] for c in columns)) for x in df.collect()) == want


def test_a_long_text_takes_time_in_proportion(spark, tmp_path):
    # Its gaps were once made anew for every one of its words, and its words copied to every one of its segments.
    r = random.Random(9)
    words = [_word(r) for _ in range(500)]
    text = " ".join(w + ("." if i % 20 == 19 else "") for i, w in enumerate(r.choices(words, k=60_000)))
    at = _tables(spark, tmp_path, [(1, text, "en")], words[:2])
    began = time.perf_counter()
    hidden = [x.hidden for x in rules._carets(spark, at).select("seg", "hidden").orderBy("seg").collect()]
    assert hidden == [w.rstrip(".") for w in text.split()[16::20]] and time.perf_counter() - began < 40


def test_carets_that_match_nothing_are_not_written(spark, monkeypatch):
    corpus = build_corpus(spark.createDataFrame([(1, "the old harbour wakes before the early bells")], "item_id long, text string"))
    said = [["the", "old"], ["old", "the"], ["old", "harbour", "x"], ["harbour"], [], ["x", "y", "z"], ["bells", "wakes", "before"]]
    carets = spark.createDataFrame([*enumerate(said)], "id int, words array<string>").selectExpr("*", "cast(null as int) as since")
    sizes, kept = {}, continuations.written

    def written(df):
        out = kept(df)
        if "run1" in out.columns:
            sizes["rows"] = out.count()
        return out

    monkeypatch.setattr(continuations, "written", written)
    rows = {x.id: x for x in continuations.judged(carets, corpus)[0].collect()}
    assert sizes["rows"] == 3 and sorted(rows) == [*range(len(said))]
    assert [(rows[i].matched, rows[i].matched1, rows[i].blocked, rows[i].mends) for i in rows if rows[i].matched < 2 > rows[i].matched1] == [(0, 0, "no_match", False)] * 4
    assert (rows[0].matched, rows[2].matched1, rows[6].matched) == (2, 2, 2)
