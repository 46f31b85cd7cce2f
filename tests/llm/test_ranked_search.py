"""Ranked search: every item's best documents against scoring all of them, and the registered query against its SQL."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from verbatia.llm import ranked_search
from verbatia.llm.queries import ORACLE_SQL, QUERIES
from verbatia.llm.ranked_search import Heap, Shard, search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text: str | None) -> list[str]:
    return TERM.findall("".join(x.lower() if x.isascii() else x for x in text or ""))


def best(docs: list, items: list, k: int) -> list[tuple]:
    """(item, rank, doc, score) of documents scored one by one."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    count, total = len(held), sum(c.total() for _, c in held)
    df = Counter(x for _, c in held for x in c)
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in asked.items():
        scores = []
        for i, c in held:
            m = 50 + (50 * c.total() * count) // total
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[x] + 1))) * ((1000000000 * c[x]) // (1000 * c[x] + 20 * m)) for x in own if c[x])
            if score > 0:
                scores.append((-score, i is not None, i or 0))
        out += [(item, n, i if known else None, -s) for n, (s, known, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def items(texts):
    r = random.Random(2)
    long = [t for _, t in texts if len(terms(t)) >= 12]
    out = [(i, " ".join(r.sample(terms(r.choice(long)), 12))) for i in range(25)]
    return out + [(25, None), (26, ""), (27, "the of and to"), (28, "absent wordings"), (None, "the one"), (3, "two words"), (3, "two words"), (29, " ".join(t for t in long[:3]))]


@pytest.mark.parametrize("k, block, shard, window", [(50, 200_000, 2_000_000, 2048), (3, 150, 60, 4), (1, 200_000, 500, 16)])
def test_best_documents(spark, docs, texts, items, monkeypatch, k, block, shard, window):
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", block)
    monkeypatch.setattr(ranked_search, "SHARD_POSTINGS", shard)
    monkeypatch.setattr(ranked_search, "WINDOW", window)
    asked = spark.createDataFrame([(i, t, "clash", 1) for i, t in items], "item_id long, text string, term string, rank int")
    rows = search(docs, asked, k).collect()
    assert sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in rows), key=repr) == best(texts, items, k)


def test_only_pivots_are_scored(monkeypatch):
    r = np.random.default_rng(1)
    doc = np.concatenate([np.sort(r.choice(5000, n, replace=False)) for n in (40, 400, 3000)])
    term = np.repeat([0, 1, 2], (40, 400, 3000))
    impact = np.concatenate([r.integers(900, 1000, 40), r.integers(90, 100, 400), r.integers(1, 10, 3000)])
    shard, heap, scored = Shard(term, doc, impact, 5000), Heap(10), []
    whole = Shard._pass

    def watched(docs, *a):
        if not a[-1]:
            scored.extend(docs.tolist())
        return whole(docs, *a)

    monkeypatch.setattr(Shard, "_pass", staticmethod(watched))
    monkeypatch.setattr(ranked_search, "WINDOW", 100)
    shard.search(np.array([0, 1, 2, 9]), heap)
    heap.close([(i, 0) for i in range(5000)])
    total = np.bincount(doc, impact, 5000).astype(int)
    assert [(-s, d) for s, d, _ in heap.names] == [(total[d], d) for d in sorted(range(5000), key=lambda d: (-total[d], d))[:10]]
    assert len(scored) < 3000 // 4


def test_empty_tables(spark, docs, empty, items):
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert search(empty, asked).count() == 0
    assert search(docs, asked.filter("false")).columns == ["item_id", "rank", "doc_id", "text_key", "score"]
    assert search(docs, asked.filter("false")).count() == search(docs, asked.filter("text is null")).count() == 0


def test_registered_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    want = con.execute(ORACLE_SQL["op13_ranked_search"])
    columns = [d[0] for d in want.description]
    got = QUERIES["op13_ranked_search"](spark, folder)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(want.fetchall())
