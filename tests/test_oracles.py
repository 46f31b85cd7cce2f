"""Every query with SQL gives the rows of that SQL in DuckDB, over the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from verbatia.plans import findings, findings_sql, queries, rules, sql

QUERIES, ORACLE = queries.QUERIES | findings.QUERIES | rules.QUERIES, sql.ORACLE | findings_sql.ORACLE | rules.ORACLE
DATA = Path("/root/testdata/sf0.001")
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return (0, "")
    return (1, f"{value:.5f}") if isinstance(value, float) else (2, str(value))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    want = duck.execute(ORACLE[name])
    columns = [d[0] for d in want.description]
    assert {c: TYPES[t] for c, t in df.dtypes} == {d[0]: str(d[1]) for d in want.description}
    rows = want.fetchall()
    got = sorted(tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect())
    assert got == sorted(tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in rows)


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES) and set(findings.QUERIES) == set(findings_sql.ORACLE)
