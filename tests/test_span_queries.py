"""Queries on the spans of runs: the rows of their SQL on odd texts, and texts are shuffled once, words never."""

from __future__ import annotations

import random

import duckdb
import pytest

from verbatia.plans import findings, findings_sql, rules

QUERIES, ORACLE = findings.QUERIES | rules.QUERIES, findings_sql.ORACLE | rules.ORACLE
NAMES = ["attached_references", "edited_findings", "edits_in_order", "neighbour_limits", "selected_findings"]


def _word(r: random.Random) -> str:
    return "".join(r.choices("abcdefghijklmnopqrstuvwxyzé", k=7))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Texts of words of their own, of which most quote works; works that share passages; citations before, behind, between and inside quotations."""
    r = random.Random(15)
    works = [[_word(r) for _ in range(40)] for _ in range(8)]
    works[1][5:15] = works[0][20:30]
    texts = []
    for i in range(80):
        own, w = [_word(r) for _ in range(300)], works[i % 8]
        parts = [" ".join(own[:100]), "x 3:4 ", " ".join(w[5:17]), r.choice([" 12:7-9", "\n(5.1)", "", "𝄞 1:1, 1:2"]), " ".join(own[100:200]), "\U0001f600 ", " ".join(w[20:29]).title(), " 2:2 ", " ".join(works[(i + 1) % 8][:8])]
        texts.append((i, " ".join(parts) + r.choice(["", "\n9:9\n", ". " + " ".join(own[200:])])))
    whole = " ".join(works[0])
    odd = ["", None, "12 3:4", "\n" + whole, whole, "7:7" + whole + "8:8", " 1:2 ".join([whole] * 4), "\r\n".join(works[1]), "é " + " ".join(works[2][:6]) + "́", " ".join(works[3][:3]) + "4:5" + " ".join(works[3][3:6])]
    rows = [*texts, *((1000 + i, x) for i, x in enumerate(odd))]
    at = tmp_path_factory.mktemp("spans")
    spark.createDataFrame([(i, x, "en") for i, x in rows], "doc_id long, text string, lang string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, " ".join(w) + ".") for i, w in enumerate(works)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), sum(len((x or "").encode()) for _, x in rows)


@pytest.mark.parametrize("name", NAMES)
def test_rows_of_odd_texts_equal_sql(spark, tables, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"create view {table} as select * from '{tables[0]}/{table}.parquet/*.parquet'")
    asked = con.execute(ORACLE[name])
    columns = [d[0] for d in asked.description]
    want = sorted(map(repr, asked.fetchall()))
    df = QUERIES[name](spark, tables[0])
    assert len(want) > 150 or name == "selected_findings" and len(want) > 70
    assert sorted(df.columns) == sorted(columns) and sorted(repr(tuple(x[c] for c in columns)) for x in df.collect()) == want


def _shuffled(spark) -> int:
    """Bytes written to shuffles by the stages so far."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.mark.parametrize("name", NAMES)
def test_no_words_are_shuffled(spark, tables, name):
    # Large tables are not broadcast.
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = _shuffled(spark)
        QUERIES[name](spark, tables[0]).write.format("noop").mode("overwrite").save()
        assert _shuffled(spark) - before < 2 * tables[1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
