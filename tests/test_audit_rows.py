"""What the full audit reads of long texts: citations only about numbers and chapters' words, and candidates cut from the row of their text."""

from __future__ import annotations

import random

import pytest

from pyspark.sql import functions as F

from verbatia.operators.citation_grammar import ARABIC_FORMS, ENGLISH_FORMS, Parser, folding
from verbatia.plans.full_audit import quoted

ENGLISH = {("amber",): 1, ("amber", "lantern"): 2, ("velvet", "orchard", "hums"): 3}
ARABIC = {("البقره",): 2, ("ال", "عمران"): 3}


class Whole(Parser):
    def windows(self, folded):
        yield 0, len(folded)


def _text(r: random.Random, grammar, names: dict) -> str:
    words = [" ".join(n) for n in [*names, *grammar.ordinals]] + [*sorted(grammar.unit | grammar.chapter | grammar.of | grammar.sign), "stone", "İb", "a‍b", "٣:٤", "é"]
    few = sorted(grammar.unit | grammar.chapter | grammar.of)
    parts = (r.choice([r.choice(words), r.choice(few), str(r.randint(0, 1200)), r.choice(":،,-–()[]/._"), r.choice(words).title()]) + r.choice([" ", "", "\n", " "]) for _ in range(r.choice([3, 30, 150])))
    return "".join(parts) + " ".join(["filler"] * r.choice([0, 12, 30, 100]))


@pytest.mark.parametrize("grammar, names", [(ENGLISH_FORMS, ENGLISH), (ARABIC_FORMS, ARABIC), (ENGLISH_FORMS, {})])
def test_windows_hold_all_citations(grammar, names):
    r, own, whole, found = random.Random(11), Parser(grammar, names), Whole(grammar, names), 0
    for _ in range(300):
        text = "".join(_text(r, grammar, names) for _ in range(3))
        got = own.read(text)
        assert got == whole.read(text), text
        found += len(got)
    assert found > 100


def test_words_far_from_numbers_and_chapters_are_not_read():
    parser = Parser(ENGLISH_FORMS, ENGLISH)
    far = "plain words of a long text, " * 2000
    assert parser.read(far) == [] and parser.tokens == []
    (c,) = parser.read(far + "Amber Lantern 5 " + far)
    assert (c.work, c.unit0) == (2, 5) and len(parser.tokens) < 100


def test_folded_places_are_those_of_the_text():
    fold = folding(ENGLISH_FORMS.profile)
    for text in ["", "plain Text", "İstanbul ﬁn", "a‍b 𝄞 é", "é x", "٣:٤"]:
        folded, places = fold(text)
        assert len(places) == len(folded) and [*places] == sorted(places) and all(0 <= p < len(text) for p in places)


def test_candidates_are_cut_from_their_text(spark):
    texts = {1: "𝄞 One, «two» three\nfour.", 2: "é́ X-y z", 3: None, 4: "", 5: "unused words"}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    asked = [(1, 0, 1), (1, 1, 3), (1, 3, 4), (2, 0, 4), (2, 1, 2)]
    rows = {(x.doc_id, x.d0, x.d1): x for x in quoted(spark.createDataFrame(asked, "doc_id long, d0 long, d1 long"), docs).collect()}
    words = {1: ["One", "two", "three", "four"], 2: ["é́", "X", "y", "z"]}
    assert sorted(rows) == asked
    for (doc, d0, d1), x in rows.items():
        assert x.words == words[doc][d0:d1] and x.folds == [w.lower() for w in x.words] and x.quote_id == f"{doc}:{d0}:{d1}"
        assert x.quote == texts[doc][x.s : x.e] and x.quote.startswith(x.words[0]) and x.quote.endswith(x.words[-1])


def test_words_are_counted_once(spark):
    from verbatia.operators.phrases import prose_zipf
    from verbatia.operators.tokens import tokenize

    reads = spark.sparkContext.accumulator(0)

    def read(text: str) -> str:
        reads.add(1)
        return text

    docs = spark.createDataFrame([(i, f"one two w{i}") for i in range(20)], "doc_id long, text string").repartition(2)
    docs = docs.select("doc_id", F.udf(read)("text").alias("text"))
    zipf = prose_zipf(tokenize(docs, ["doc_id"]))
    made = reads.value
    both = zipf.join(zipf.select(F.col("fold").alias("other"), F.col("n").alias("m")), F.col("n") == F.col("m")).filter("fold = 'one'").collect()
    assert {x.other for x in both} == {"one", "two", "w"} and reads.value == made >= 20
