"""Suggestions from the sorted suffix table: against plain loops, and the rules case by case."""

from __future__ import annotations

import random

import pytest

from verbatia.operators.continuations import Gates, backwards, longest_matches, suggest
from verbatia.operators.corpus import build_corpus
from pyspark.sql import functions as F

LOW = Gates(mass=((None, 0.0),), distinct_mass=0.0, correction_mass=0.0)


def plain(run: list[str], works: dict[str, list[str]]) -> tuple[int, set]:
    """The most last words of the run that end at any place, and those places."""
    found = {}
    for work, words in works.items():
        for p in range(len(words)):
            n = 0
            while n < len(run) and n <= p and run[-1 - n] == words[p - n]:
                n += 1
            found[work, p] = n
    best = max(found.values(), default=0)
    return best, {at for at, n in found.items() if n == best}


@pytest.mark.parametrize("letters, seed", [("ab", 1), ("abcd", 2), ("abcdefghijklmnop", 3)])
def test_equals_a_plain_loop(spark, letters, seed):
    r = random.Random(seed)
    words = [x * n for x in letters for n in (1, 2)]
    works = {f"w{i:02}": [r.choice(words) for _ in range(r.randint(1, 60))] for i in range(12)}
    works["copy"], works["again"] = works["w03"], works["w03"] * 3
    runs = [[r.choice(words) for _ in range(r.randint(1, 9))] for _ in range(120)]
    for _ in range(120):
        at = r.choice(list(works.values()))
        cut = r.randint(1, len(at))
        runs.append([r.choice(words), *at[max(0, cut - r.randint(1, 50)) : cut]][-40:])
    corpus = build_corpus(spark.createDataFrame([(k, " ".join(v)) for k, v in works.items()], "item_id string, text string"))
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(runs)], "id int, words array<string>").withColumn("run", backwards(F.col("words")))
    met, numbers = longest_matches(rows, corpus)
    place = {x.number: (x.work, x.pos) for x in numbers.collect()}
    assert sorted(place) == list(range(sum(map(len, works.values()))))
    got = {x.id: (x.matched, {place[i] for i in range(x.lo, x.hi)}) for x in rows.join(met, "run").collect()}
    want = {i: plain(x, works) for i, x in enumerate(runs)}
    assert got == {i: x for i, x in want.items() if x[0] >= 2} and len(got) > 50


UNITS = "the old harbour wakes before the early bells ring out. a grey ship waits behind the long stone wall today.\nnobody saw the grey ship leave at dawn. the old harbour sleeps."


def choices(spark, typed: str, since=None, **more):
    corpus = build_corpus(spark.createDataFrame([("h", UNITS)], "item_id string, text string"))
    carets = spark.createDataFrame([(1, typed.split(), since)], "id int, words array<string>, since int")
    return [(x.kind, x.to_text, x.typed, x.places, x.ambiguous) for x in suggest(carets, ["id"], corpus, **{"gates": LOW} | more).orderBy("rank").collect()]


def test_next_words_stop_at_the_end_of_the_unit(spark):
    assert choices(spark, "so the old harbour wakes before") == [("continue", "the early bells ring out", 5, 1, False)]
    assert choices(spark, "nobody saw the grey ship") == [("continue", "leave at dawn", 5, 1, False)]
    assert choices(spark, "grey ship leave at dawn") == []


def test_two_words_need_an_open_mark_or_an_announcing_word(spark):
    assert choices(spark, "said the old harbour") == []
    many = choices(spark, "the old harbour", since=3)
    assert [(x[0], x[1]) for x in many] == [("continue", "wakes before the early"), ("continue", "sleeps")] and all(x[3] == 2 and x[4] for x in many)
    assert choices(spark, "said the old harbour", since=4) == many and choices(spark, "he said so the old harbour", since=6) == []
    assert choices(spark, "quoting the old harbour", cues=["quoting"], distinct=False) == many


def test_a_wrong_last_word_is_replaced_and_left_out_words_inserted(spark):
    assert choices(spark, "the old harbour wakes after") == [("replace", "before", 4, 1, False)]
    assert choices(spark, "the old harbour wakes early") == [("insert", "before the", 4, 1, False)]
    assert choices(spark, "harbour wakes after", since=3) == []
    assert choices(spark, "saw the grey ship waits") == []  # three words of another place match to the end, one less than the quotation has
    assert choices(spark, "nobody saw the grey ship waits") == [("replace", "leave", 5, 1, False)]


def test_bars_of_places_and_mass(spark):
    assert choices(spark, "the old harbour", since=3, gates=Gates(mass=((None, 0.0),), places=((None, 1),))) == []
    assert choices(spark, "so the old harbour wakes before", gates=Gates()) == []


def test_empty_runs_repeats_and_corpora(spark):
    assert choices(spark, "") == [] and choices(spark, "harbour") == []
    empty = build_corpus(spark.createDataFrame([], "item_id string, text string"))
    carets = spark.createDataFrame([(1, ["a", "b", "c"], None), (1, ["a", "b", "c"], None)], "id int, words array<string>, since int")
    assert suggest(carets, ["id"], empty, gates=LOW).collect() == []
