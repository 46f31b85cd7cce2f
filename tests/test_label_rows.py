"""Openings of works in texts and the checks of their labels: the rows of their SQL on odd texts, and no words are shuffled."""

from __future__ import annotations

import random

import duckdb
import pytest

from verbatia.plans import findings, findings_sql


def _word(r: random.Random) -> str:
    return "".join(r.choices("abcdefghijklmnopqrstuvwxyzé", k=7))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Texts of words of their own that quote openings; two works have one opening, one has four words, one opening repeats a word."""
    r = random.Random(6)
    works = [[_word(r) for _ in range(12)] for _ in range(5)]
    works += [works[0][:5] + [_word(r) for _ in range(4)], works[1][:4], ["la"] * 5 + ["le"]]
    texts = []
    for i in range(150):
        own = [_word(r) for _ in range(300)]
        texts.append(" ".join([*own[:100], *works[i % 8][: r.randint(3, 8)], *own[100:], *works[i % 3][:5]]))
    texts += ["", None, "...", " ".join(works[0][:5]).upper(), "; ".join(works[2]), " ".join(["la"] * 9), "\n".join(works[3][:5]) + "\U0001f600" + "-".join(works[4][:5]), " ".join(works[1][:4])]
    at = tmp_path_factory.mktemp("labels")
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, " ".join(w) + ".") for i, w in enumerate(works)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), sum(len((x or "").encode()) for x in texts)


@pytest.mark.parametrize("name, least", [("label_checks", 2), ("located_quotes", 200)])
def test_rows_of_odd_texts_equal_sql(spark, tables, name, least):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"create view {table} as select * from '{tables[0]}/{table}.parquet/*.parquet'")
    asked = con.execute(findings_sql.ORACLE[name])
    columns = [d[0] for d in asked.description]
    want = sorted(map(repr, asked.fetchall()))
    df = findings.QUERIES[name](spark, tables[0])
    assert len(want) >= least and sorted(df.columns) == sorted(columns) and sorted(repr(tuple(x[c] for c in columns)) for x in df.collect()) == want


def test_checks_without_places(spark, tmp_path):
    spark.createDataFrame([(1, "nothing of it")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(map(tuple, findings.label_checks(spark, str(tmp_path)).collect())) == [("contained", 0, 0), ("unambiguous", 0, 0)]


def _shuffled(spark) -> int:
    """Bytes written to shuffles by the stages so far."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_no_words_are_shuffled(spark, tables):
    before = _shuffled(spark)
    findings.label_checks(spark, tables[0]).write.format("noop").mode("overwrite").save()
    assert _shuffled(spark) - before < tables[1] / 4
