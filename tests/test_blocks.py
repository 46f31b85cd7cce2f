"""Joins by blocks equal plain loops at the borders of blocks, and cue windows those of a forward pass."""

from __future__ import annotations

import random

from verbatia.operators.cues import BLOCK, cue_hits, cue_windows
from verbatia.operators.intervals import asof_backward, asof_forward


def test_asof_joins_equal_plain_loops(spark):
    r = random.Random(3)
    spans = [(d, s, s + r.randint(1, 9)) for d in range(12) for s in r.sample(range(0, 200), r.randint(0, 12))] + [(99, 5, 6), (98, None, None)]
    points = [(d, at, f"{d}/{at}") for d in range(12) for at in r.sample(range(0, 220), r.randint(0, 20))]
    a, b = spark.createDataFrame(spans, "doc_id int, s long, e long"), spark.createDataFrame(points, "doc_id int, at long, ref string")
    for within in (0, 1, 7, 40, 500):
        ahead = {x[:3]: min((p[1] for p in points if x[1] is not None and p[0] == x[0] and x[2] <= p[1] <= x[2] + within), default=None) for x in spans}
        behind = {x[:3]: max((p[1] for p in points if x[1] is not None and p[0] == x[0] and x[1] - within <= p[1] <= x[1]), default=None) for x in spans}
        for found, want in ((asof_forward(a, b, "doc_id", within), ahead), (asof_backward(a, b, "doc_id", within), behind)):
            rows = found.collect()
            assert {(x.doc_id, x.s, x.e): x.at for x in rows} == want and len(rows) == len(want)
            assert all(x.ref == (None if x.at is None else f"{x.doc_id}/{x.at}") for x in rows)


def test_cue_windows_and_hits_equal_plain_loops(spark):
    r = random.Random(8)
    docs = {d: [(r.choice(["say", "call", *"abcdef"]), ". " if r.random() < 0.08 else " ") for _ in range(r.choice([1, 3, 3 * BLOCK, 7 * BLOCK]))] for d in range(8)}
    tokens = [(d, i, w, gap) for d, words in docs.items() for i, (w, gap) in enumerate(words)]
    got = cue_windows(spark.createDataFrame(tokens, "doc_id int, tok long, fold string, gap string"), {"say": "x", "call": "y"}, most=90)
    want = {}
    for d, words in docs.items():
        for i, (w, _) in enumerate(words):
            stop = next((j for j in range(i + 1, len(words)) if "." in words[j][1]), len(words))
            end = min(stop, i + 91)
            if w in ("say", "call") and end - i - 1 >= 2:
                want[d, end] = (d, i + 1, end, "x" if w == "say" else "y")
    assert {tuple(x) for x in got.collect()} == set(want.values())
    shared = [(d, i, r.randint(1, 3), r.randint(-2, 2), float(r.randint(1, 4))) for d, words in docs.items() for i in range(len(words)) if r.random() < 0.4]
    best = {}
    for d, w0, w1, kind in want.values():
        votes = {}
        for d2, i, work, diag, idf in shared:
            if d == d2 and w0 <= i < w1:
                n, mass = votes.get((work, diag), (0, 0.0))
                votes[work, diag] = n + 1, mass + idf
        if votes:
            (work, diag), (n, mass) = min(votes.items(), key=lambda v: (-v[1][0], -v[1][1], v[0]))
            if n >= 2:
                best[d, w0, w1] = (kind, work, diag, n, mass)
    rows = cue_hits(got, spark.createDataFrame(shared, "doc_id int, tok long, work int, diag int, idf double")).collect()
    assert {(x.doc_id, x.w0, x.w1): (x.kind, x.work, x.diag, x.matched, x.mass) for x in rows} == best and len(rows) == len(best) > 5
