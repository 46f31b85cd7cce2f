"""Runs and announced spans brought together, against a plain loop over lists."""

from __future__ import annotations

import random

import pytest

from verbatia.operators.reconcile import reconcile

RUN = "doc_id long, d0 int, d1 int, work int, b0 int, b1 int"
SAID = "doc_id long, d0 int, d1 int, w0 int, w1 int, work int, b0 int, b1 int"


def plain(runs: list[tuple], said: list[tuple]) -> list[tuple]:
    """(d0, d1, source, announced, hints) of one document: every span compared with every candidate."""
    out = []
    for d0, d1 in sorted({r[:2] for r in runs}):
        out.append([d0, d1, "run", False, sorted({r[2:] for r in runs if r[:2] == (d0, d1)})])
    for d0, d1, w0, w1, *place in sorted(said, key=lambda s: (s[0], s[1], s[2], s[3], s[4:])):
        over = [c for c in out if c[0] < d1 and d0 < c[1]]
        low, high = min([d0, *(c[0] for c in over)]), max([d1, *(c[1] for c in over)])
        if not over:
            out.append([d0, d1, "cue", True, [tuple(place)]])
        elif any((c[0], c[1]) == (low, high) for c in over) or low < w0 or high > w1 or any(c[3] or c[2] == "cue" for c in over):
            for c in over:
                if c[0] <= d0 and d1 <= c[1]:
                    c[3] = True
        else:
            hints = [(w, max(0, a - (c[0] - low)), b + high - c[1]) for c in sorted(over) for w, a, b in c[4]]
            out = [c for c in out if c not in over] + [[low, high, "cue", True, hints]]
    return sorted(map(tuple, (([*c[:4], tuple(c[4])]) for c in out)))


@pytest.mark.parametrize("seed", range(3))
def test_equals_a_plain_loop(spark, seed):
    r = random.Random(seed)
    runs, said = [], []
    for doc in [*range(40), None]:
        at = 0
        while at < 60 and r.random() < 0.9:
            at += r.randint(0, 8)
            end = at + r.randint(2, 7)
            runs += [(doc, at, end, r.randint(1, 3), p, p + end - at) for p in r.sample(range(50), r.randint(1, 2))]
            at = end
        for _ in range(r.randint(0, 7)):
            d0 = r.randint(0, 60)
            d1 = d0 + r.randint(2, 9)
            w0 = max(0, d0 - r.randint(0, 5))
            said.append((doc, d0, d1, w0, d1 + r.randint(0, 5), r.randint(1, 3), 5, 5 + d1 - d0))
    said += said[:3]
    got = reconcile(spark.createDataFrame(runs, RUN).repartition(3), spark.createDataFrame(said, SAID).repartition(3)).collect()
    for doc in {x[0] for x in runs + said}:
        mine = sorted((x.d0, x.d1, x.source, x.announced, tuple(map(tuple, x.hints))) for x in got if x.doc_id == doc)
        assert mine == plain([x[1:] for x in runs if x[0] == doc], [x[1:] for x in said if x[0] == doc]), doc


def test_each_case(spark):
    runs = [(1, 10, 14, 7, 3, 7), (2, 10, 14, 7, 3, 7), (3, 10, 14, 7, 3, 7), (4, 10, 14, 7, 3, 7), (4, 15, 18, 8, 0, 3), (5, 10, 20, 7, 3, 13)]
    said = [(1, 10, 14, 9, 20, 7, 3, 7), (2, 9, 16, 9, 20, 7, 2, 9), (3, 12, 16, 12, 20, 7, 5, 9), (4, 9, 17, 8, 20, 7, 2, 10), (5, 12, 15, 11, 30, 7, 5, 8), (6, 1, 3, 0, 9, 2, 0, 2)]
    rows = {x.doc_id: [] for x in []}
    for x in reconcile(spark.createDataFrame(runs, RUN), spark.createDataFrame(said, SAID)).collect():
        rows.setdefault(x.doc_id, []).append((x.d0, x.d1, x.source, x.announced, [tuple(h) for h in x.hints]))
    assert rows == {
        1: [(10, 14, "run", True, [(7, 3, 7)])],
        2: [(9, 16, "cue", True, [(7, 2, 9)])],
        3: [(10, 14, "run", False, [(7, 3, 7)])],
        4: [(9, 18, "cue", True, [(7, 2, 11), (8, 0, 3)])],
        5: [(10, 20, "run", True, [(7, 3, 13)])],
        6: [(1, 3, "cue", True, [(2, 0, 2)])],
    }
    assert reconcile(spark.createDataFrame([], RUN), spark.createDataFrame([], SAID)).count() == 0
