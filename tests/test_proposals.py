"""Corrections of quotations: what is offered, what is left to review, and that exact text is never corrected."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from verbatia.operators.corpus import build_corpus
from verbatia.operators.proposals import Bars, corrected, lay, passages, propose

WORKS = [
    (1, "The quiet river carries silver leaves past seven sleeping villages. Every winter brings another heavy silence to those distant hills"),
    (2, "My neighbour keeps eleven copper kettles under his narrow staircase. Someone painted the garden wall with yellow birds"),
    (3, "The quiet river carries golden leaves past seven sleeping villages. Nobody remembers which captain sailed there first"),
]
SCHEMA = "quote_id long, words array<string>, folds array<string>, bounded boolean, ref_work long, ref_unit0 long, ref_unit1 long"


@pytest.fixture(scope="module")
def corpus(spark):
    return build_corpus(spark.createDataFrame(WORKS, "item_id long, text string"))


def asked(spark, rows):
    return spark.createDataFrame([(i, t.split(), t.lower().split(), bounded, *ref) for i, t, bounded, ref in rows], SCHEMA)


NO = (None, None, None)
CASES = [
    # Equal text, one place or several.
    ("eleven copper kettles under", False, NO, "none_needed", "equal"),
    ("past seven sleeping villages", False, NO, "review_only", "several_places"),
    ("past seven sleeping villages", False, (3, 0, 0), "none_needed", "equal"),
    ("copper kettles", False, NO, "review_only", "too_short"),
    # One word of six replaced, none closer elsewhere.
    ("keeps eleven copper buckets under his narrow staircase", False, NO, "proposed", "proposed"),
    ("keeps eleven copper kettles under narrow staircase", False, NO, "proposed", "proposed"),
    # As like another place; a citation of a unit tells them apart, one of a work that names neither does not.
    ("the quiet river carries copper leaves past seven sleeping villages", True, NO, "review_only", "rival"),
    ("the quiet river carries copper leaves past seven sleeping villages", True, (3, 0, 0), "proposed", "proposed"),
    ("the quiet river carries copper leaves past seven sleeping villages", True, (3, None, None), "review_only", "rival"),
    # A citation of another place, too little in common, a short quotation, nothing found.
    ("keeps eleven copper buckets under his narrow staircase", False, (1, 0, 0), "review_only", "other_place"),
    ("keeps twelve copper buckets under the narrow staircase", False, NO, "review_only", "too_different"),
    ("wholly different words that stand nowhere", False, NO, "review_only", "not_found"),
    # One word of three: only between the writer's own marks and with a citation of the unit.
    ("someone painted yellow", False, NO, "review_only", "too_different"),
    ("eleven brazen kettles", True, (2, 0, 0), "proposed", "proposed"),
    ("eleven brazen kettles", False, (2, 0, 0), "review_only", "too_different"),
    ("eleven brazen kettles", True, (2, None, None), "review_only", "too_different"),
    # A word too many at the edge may be the writer's own.
    ("painted the garden wall with yellow birds today", False, NO, "review_only", "open_edge"),
    ("painted the garden wall with yellow birds today", True, NO, "proposed", "proposed"),
]


def test_what_is_offered(spark, corpus):
    quotes = asked(spark, [(n, t, b, ref) for n, (t, b, ref, *_) in enumerate(CASES)] + [(99, "", False, NO)])
    rows = {r.quote_id: r for r in propose(quotes, corpus).collect()}
    assert len(rows) == len(CASES) + 1 and rows[99].reason == "not_found"
    for n, (text, bounded, ref, status, reason) in enumerate(CASES):
        assert (rows[n].status, rows[n].reason) == (status, reason), (text, bounded, ref, rows[n])
        assert bool(rows[n].edits) == (status == "proposed")


def test_edits_give_the_words_of_the_corpus(spark, corpus):
    r = random.Random(4)
    streams = {w: t.replace(".", "").split() for w, t in WORKS}
    rows, exact = [], set()
    for n in range(60):
        work = r.choice((1, 2))
        at = r.randrange(len(streams[work]) - 8)
        words = streams[work][at : at + 8]
        if n % 3:
            k = r.randrange(1, 7)
            words[k : k + 1] = r.choice((["zebra"], [words[k], "zebra"], []))
        else:
            exact.add(n)
        rows.append((n, " ".join(words), True, NO))
    quotes = asked(spark, rows)
    got = propose(quotes, corpus).join(quotes.select("quote_id", "words"), "quote_id").withColumn("after", corrected(F.col("words"), F.col("edits"))).collect()
    offered = 0
    for x in got:
        if x.quote_id in exact:
            assert x.edits == [] and x.after == x.words
        elif x.status == "proposed":
            offered += 1
            assert x.after == streams[x.work][x.p0 : x.p1]
    assert offered >= 15


def test_passages_equal_a_plain_search(spark, corpus):
    """Every window of a work is laid out; voting must find what is closest."""
    quotes = [(n, t.lower().split()) for n, (t, *_) in enumerate(CASES) if len(t.split()) > 5]
    got = {}
    for x in passages(spark.createDataFrame(quotes, "quote_id long, folds array<string>"), corpus, bars=Bars(passages=1)).collect():
        got[x.quote_id] = (x.similarity, x.equal)
    for n, words in quotes:
        laid = [lay(words, w[max(0, at) : at + len(words) + 8]) for _, t in WORKS for w in [t.lower().replace(".", "").split()] for at in range(-4, len(w))]
        best = max(((f[2], f[3]) for f in laid if f), default=(0, 0))
        if best[1] >= 2:
            assert abs(got[n][0] - best[0]) < 1e-6


def test_laying_out_a_quotation():
    assert lay(["x"], ["a"]) is None
    start, end, similarity, equal, near, steps = lay("a colour b".split(), "z a color b q".split())
    assert (start, end, equal, near) == (1, 4, 2, 1) and similarity == 2 * 2 / 6 and [s[0] for s in steps] == ["equal", "replace", "equal"]
    # Words replaced at the edges belong to the passage.
    assert lay("x b c y".split(), "p a b c d q".split())[:2] == (1, 5)
    assert SequenceMatcher(None, "colour", "color").ratio() >= 0.75
