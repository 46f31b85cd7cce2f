"""Candidates of all kinds merged, and the audit over them."""

from __future__ import annotations

import random

from verbatia.operators.corpus import build_corpus
from verbatia.operators.phrases import prose_zipf
from verbatia.operators.reconcile import merge
from verbatia.operators.tokens import tokenize
from verbatia.plans.full_audit import audit_all

ROW = "doc_id string, rank int, d0 long, d1 long, source string, announced boolean, hints array<struct<work:long,p0:long,p1:long>>"


def plain(rows: list[tuple]) -> dict:
    out = {}
    for doc in {r[0] for r in rows}:
        kept = []
        for _, rank, a, b, source, said, hints in sorted((r for r in rows if r[0] == doc and r[2] < r[3]), key=lambda r: (r[1], r[2], -r[3], r[4], r[6])):
            met = [k for k in kept if a < k[1] and k[0] < b]
            if not met:
                kept.append([a, b, {source}, said, hints, []])
            else:
                met[0][2].add(source)
                met[0][3] |= said
                met[0][4] = met[0][4] or hints
                met[0][5].append((source, a, b))
        out[doc] = sorted((a, b, tuple(sorted(s)), said, tuple(h), tuple(o)) for a, b, s, said, h, o in kept)
    return {d: k for d, k in out.items() if k}


def test_merge_equals_a_plain_loop(spark):
    r = random.Random(5)
    rows = []
    for d in range(25):
        for _ in range(r.randint(0, 30)):
            a, rank = r.randint(0, 80), r.randint(0, 2)
            rows.append((f"d|{d}", rank, a, a + r.randint(0, 12), ["marked", "run", "pair"][rank], r.random() < 0.2, [(r.randint(1, 3), a, a + 3)] if r.random() < 0.5 else []))
    got = {}
    for x in merge(spark.createDataFrame(rows, ROW)).collect():
        got.setdefault(x.doc_id, []).append((x.d0, x.d1, tuple(x.sources), x.announced, tuple(tuple(h) for h in x.hints), tuple((o.source, o.d0, o.d1) for o in x.others)))
    assert {d: sorted(k) for d, k in got.items()} == plain(rows)


def test_merge_of_nothing(spark):
    assert merge(spark.createDataFrame([], ROW)).collect() == []


WORKS = [
    (1, "the amber lantern swings above a frozen courtyard gate.\nseven patient herons watched the silver river turn backwards."),
    (2, "under copper domes the clockmaker counts forgotten winters.\nevery marble stair remembers one careful footstep going down."),
    (3, "a velvet orchard hums beyond the granite quarry wall tonight."),
]
TEXTS = [
    (1, "He wrote «seven patient herons watched the silver river turn backwards» (1:1) and left."),
    (2, "We heard that under copper domes the clockmaker counts forgotten winters while nothing else happened (2:1)."),
    (3, "Somebody said every marble stair remembers one gentle footstep going down, then slept."),
    (4, "Nothing of interest stands here at all, not one word."),
    (5, ""),
    (6, None),
    (7, "A title “made of other words entirely” is marked only."),
]


def test_audit_over_all_kinds(spark):
    corpus = build_corpus(spark.createDataFrame(WORKS, "item_id long, text string"))
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").selectExpr("*", "1 as work", "'x' as quote_id", "2 as s")
    zipf = prose_zipf(tokenize(docs.select("doc_id", "text"), ["doc_id"]))
    rows = {}
    for x in audit_all(docs, corpus, {"that": "lead_in"}, zipf).collect():
        rows.setdefault(x.doc_id, []).append(x)
    for doc, found in rows.items():
        found.sort(key=lambda x: x.finding)
        text = dict(TEXTS)[doc]
        assert [x.finding for x in found] == list(range(1, len(found) + 1)) and all(text[x.s : x.e] == x.quote for x in found)
        assert all(a.e <= b.s for a, b in zip(found, found[1:]))
    assert not {4, 5, 6} & set(rows)
    (one,) = rows[1]
    assert one.quote == "seven patient herons watched the silver river turn backwards" and {"marked", "run"} <= set(one.sources)
    assert (one.status, one.reason, one.work, one.coverage, one.reference, one.reference_status) == ("none_needed", "equal", 1, "full", "1:1", "matched")
    (two,) = rows[2]
    assert two.announced and two.quote == "under copper domes the clockmaker counts forgotten winters" and (two.work, two.coverage, two.status) == (2, "full", "none_needed")
    (three,) = rows[3]
    assert three.quote.startswith("every marble stair") and three.status in ("proposed", "review_only") and three.work == 2 and three.similarity < 1.0
    (seven,) = rows[7]
    assert seven.sources == ["marked"] and seven.occurrences == 0 and seven.status == "review_only" and seven.reference_status == "missing"
