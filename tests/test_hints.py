"""Citations found by a hint of their words: against a plain loop, and as the second pass of attaching."""

from __future__ import annotations

import random

from verbatia.operators.citations import attach_references, hinted_references


def plain(spans: list[tuple], refs: list[tuple]) -> set[tuple]:
    """Every span of a document tries every citation in order."""
    used, out = set(), set()
    for doc, s, e, hint in sorted({x for x in spans if x[3] and x[3].strip()}, key=lambda x: x[:3]):
        if any(o[:3] == (doc, s, e) for o in out):
            continue
        want = " ".join(hint.lower().split())
        for d, rs, re_, found in sorted({x for x in refs if x[3]}, key=lambda x: x[:3]):
            said = " ".join(found.lower().split())
            if d == doc and (d, rs, re_) not in used and abs(rs - e) <= 150 and said and (want in said or said in want):
                used.add((d, rs, re_))
                out.add((doc, s, e, rs, re_))
                break
    return out


def test_equals_a_plain_loop(spark):
    r = random.Random(11)
    names = ["Acts 2:3", "acts  2", "Kings 4", "kings", "2:3", "Genesis 1:1", "", None]
    spans = [(d, s, s + r.randint(3, 40), r.choice(names)) for d in range(30) for s in r.sample(range(900), r.randint(0, 8))]
    refs = [(d, s, s + r.randint(3, 9), r.choice(names)) for d in range(30) for s in r.sample(range(1000), r.randint(0, 12))]
    got = hinted_references(spark.createDataFrame(spans, "doc_id long, s long, e long, hint string"), spark.createDataFrame(refs, "doc_id long, s long, e long, found string"))
    rows = {tuple(x) for x in got.select("doc_id", "s", "e", "ref_s", "ref_e").collect()}
    assert rows == plain(spans, refs) and len(rows) > 15


def test_hints_are_the_second_pass(spark):
    spans = spark.createDataFrame([(1, 0, 10, "kings"), (1, 200, 220, "acts 2"), (1, 400, 410, None)], "doc_id long, s long, e long, hint string")
    refs = spark.createDataFrame([(1, 12, 20, "Genesis 1"), (1, 300, 306, "Acts 2"), (1, 370, 377, "Kings 4")], "doc_id long, s long, e long, found string")
    rows = {x.s: x.ref_s for x in attach_references(spans, refs).collect()}
    assert rows == {0: 12, 200: 300, 400: 370}
    assert {x.s: x.ref_s for x in attach_references(spans.drop("hint"), refs).collect()} == {0: 12, 200: None, 400: 370}
