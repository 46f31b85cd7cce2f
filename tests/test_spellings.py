"""The rasm's conventions word by word, and words that meet by any of their forms."""

from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from verbatia.functions.normalize import ARABIC
from verbatia.operators.corpus import build_corpus
from verbatia.operators.spellings import explained, latin_forms, met_words, occurrences_by_forms, rasm_forms, same_skeleton, split_vocatives

# A word of the rasm, its ordinary spelling, and a convention that explains it.
SAME = [
    ("ٱلزَّكَوٰةَ", "الزَّكَاةَ", "wasla"), ("ٱلْحَيَوٰةُ", "الْحَيَاةُ", "dagger_alef"), ("بِٱلْغَدَوٰةِ", "بِالْغَدَاةِ", "dagger_alef"),
    ("ءَامَنَ", "آمَنَ", "hamza_seat"), ("ءَايَٰتٍ", "آيَاتٍ", "hamza_seat"), ("قُرْءَانًا", "قُرْآنًا", "hamza_seat"), ("ٱلْكِتَٰبِ", "الْكِتَابِ", "wasla"), ("صَٰلِحًا", "صَالِحًا", "dagger_alef"),
    ("ٱلَّيْلَ", "اللَّيْلَ", "wasla"), ("وَٱلَّٰتِى", "وَاللَّاتِي", "wasla"), ("ٱسْتَوَىٰهُ", "اسْتَوَاهُ", "wasla"), ("سَيِّـَٔاتٍ", "سَيِّئَاتٍ", "hamza_seat"),
    ("هَيْـًٔا", "هَيْئًا", "hamza_seat"), ("مَآ", "مَا", "madd_sign"), ("وَلَآ", "وَلَا", "madd_sign"), ("جَآءَ", "جَاءَ", "madd_sign"), ("لِّلَّذِينَ", "لِلَّذِينَ", "idgham_shadda"), ("وَجَدتُّمْ", "وَجَدْتُمْ", "idgham_shadda"),
    ("يَتْلُوا۟", "يَتْلُو", "small_marks"), ("قَالُوا۟", "قَالُوا", "small_marks"), ("هَٰذِهِۦ", "هَٰذِهِ", "dagger_alef"), ("عَلِيمُۢ", "عَلِيمٌ", "small_marks"), ("دَاوُۥدَ", "دَاوُودَ", "small_marks"),
    ("فَسْـَٔلْ", "فَاسْأَلْ", "hamza_seat"), ("جَآءُو", "جَاءُوا", "madd_sign"), ("إِلَٰهَ", "إِلَٰهَ", "dagger_alef"), ("ٱلنَّبِيِّـۧنَ", "النَّبِيِّينَ", "wasla"),
]
DIFFERENT = [("ٱلزَّكَوٰةَ", "الصَّلَاةَ"), ("ءَامَنُوا۟", "أَمَنُوا"), ("ٱلْكِتَٰبَ", "الْكُتُبَ"), ("قَالُوا۟", "قُولُوا"), ("ٱلَّيْلِ", "النَّهَارِ"), ("مَآ", "مَنْ")]
ORDINARY = ["هَٰذَا", "رُءُوسِكُمْ", "سُوءَ", "شَيْءٌ", "السَّمَاءُ", "آتُوا", "مَآبًا", "سَأَلَ", "سُئِلَ", "مُؤْمِنٌ", "بِئْسَ", "الصلاة", "يا", "أيها", "الَّتِي", "امْرَأَةً", "إِنَّ", "لَآيَةً"]


@pytest.fixture(scope="module")
def forms(spark):
    words = [(w,) for w in {*(q for q, *_ in [*SAME, *DIFFERENT]), *ORDINARY}] + [(None,), ("",)]
    return rasm_forms(spark.createDataFrame(words, "raw string")).persist()


def test_spellings_of_the_rasm_are_explained(spark, forms):
    pairs = spark.createDataFrame([(q, s) for q, s, _ in SAME if s] + DIFFERENT, "quote string, source string")
    got = {(r.quote, r.source): r.features for r in explained(pairs, forms).collect()}
    for quote, source, code in SAME:
        if source:
            assert got[quote, source] is not None and (code is None or code in got[quote, source]), (quote, source)
    assert all(got[p] is None for p in DIFFERENT)


def test_ordinary_words_are_folded_as_ever(forms):
    rows = {r.raw: r for r in forms.withColumn("plain", ARABIC.folded(F.col("raw"))).collect()}
    for word in [*ORDINARY, ""]:
        assert rows[word].fold == rows[word].plain, word
    for word in ("الصلاة", "يا", "أيها", "شَيْءٌ"):
        assert rows[word].features == rows[word].exact == rows[word].alternatives == []


def test_alternatives_name_what_the_rasm_cannot_tell_apart(forms):
    rows = {r.raw: r for r in forms.collect()}
    assert (rows["يَتْلُوا۟"].fold, rows["يَتْلُوا۟"].alternatives) == ("يتلوا", ["يتلو"])
    assert (rows["جَآءُو"].fold, rows["جَآءُو"].alternatives) == ("جاءو", ["جاءوا"])
    assert set(rows["مَآ"].exact) == {"ما", "مآ"}


def test_skeletons(spark):
    rows = spark.createDataFrame([("سَلَٰم", "سَلَامٌ"), ("كِتَاب", "كُتُب"), ("قال", "مال"), ("ها", "هو")], "a string, b string")
    assert [r.same for r in rows.select(same_skeleton(F.col("a"), F.col("b")).alias("same")).collect()] == [True, True, False, False]


def test_vocatives_are_two_words(spark):
    text = "قال وَيَـٰقَوْمِ يَٰٓأَيُّهَا هَٰٓأَنتُمْ هَٰٓؤُلَآءِ يَوْم"
    at, rows = 0, []
    for n, word in enumerate(text.split()):
        at = text.index(word, at)
        rows.append((7, n, at, at + len(word), word))
    got = split_vocatives(spark.createDataFrame(rows, "doc_id long, tok long, start long, end long, raw string"), ["doc_id"]).orderBy("tok").collect()
    assert [r.raw for r in got] == ["قال", "وَيَـٰ", "قَوْمِ", "يَٰٓ", "أَيُّهَا", "هَٰٓ", "أَنتُمْ", "هَٰٓؤُلَآءِ", "يَوْم"]
    assert all(text[r.start : r.end] == r.raw for r in got) and [r.tok for r in got] == list(range(9))


def test_quotations_of_the_rasm_are_found(spark):
    works = [(1, "وَالَّذِينَ آمَنُوا وَعَمِلُوا الصَّالِحَاتِ. يَتْلُو عَلَيْهِمْ آيَاتِهِ"), (2, "آمَنُوا وَعَمِلُوا السَّيِّئَاتِ")]
    corpus = build_corpus(spark.createDataFrame(works, "item_id long, text string"), profile=ARABIC)
    said = {1: "ءَامَنُوا۟ وَعَمِلُوا۟ ٱلصَّٰلِحَٰتِ", 2: "يَتْلُوا۟ عَلَيْهِمْ ءَايَٰتِهِۦ", 3: "ءَامَنُوا۟ وَعَمِلُوا۟", 4: "ٱلزَّكَوٰةَ"}
    each = spark.createDataFrame([(i, n, w) for i, t in said.items() for n, w in enumerate(t.split())], "quote_id long, n int, raw string")
    with_forms = each.join(rasm_forms(each), "raw").groupBy("quote_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", F.concat(F.array("fold"), "alternatives").alias("f")))), lambda x: x["f"]).alias("forms"))
    got = sorted(tuple(r) for r in occurrences_by_forms(with_forms, corpus).collect())
    assert got == [(1, 1, 1, 4), (2, 1, 4, 7), (3, 1, 1, 3), (3, 2, 0, 2)]


def test_latin_words_meet_by_any_form(spark):
    words = ["straße", "strasse", "über", "ueber", "uber", "garçon", "garcon", "plain", None]
    df = spark.createDataFrame([(w,) for w in words], "fold string")
    forms = {w: {r.form for r in latin_forms(df).filter(F.col("fold") == w).collect()} for w in words if w}
    assert forms["über"] == {"über", "ueber", "uber"} and forms["plain"] == {"plain"}
    want = {(a, b) for a, b in itertools.product(forms, forms) if forms[a] & forms[b]}
    assert {(r.fold, r.other) for r in met_words(df, df).collect()} == want
