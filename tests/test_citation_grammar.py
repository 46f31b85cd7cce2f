"""Citations in all forms: what is read, where it stands, and what is wrong with it."""

from __future__ import annotations

import random

import pytest

from verbatia.operators.citation_grammar import ARABIC_FORMS, ENGLISH_FORMS, Parser, arabic_ordinals, citations, english_ordinals
from verbatia.operators.citations import attach_references

ARABIC = {("البقره",): 2, ("ال", "عمران"): 3, ("المايده",): 5, ("براءه",): 9, ("النور",): 24, ("لقمان",): 31, ("محمد",): 47}
ENGLISH = {("genesis",): 1, ("first", "kings"): 11, ("kings",): 12, ("acts",): 44}

READ = [
    ("[البقرة: 255]", "name", 2, 255, None), ("(البقرة: ٢٥٥)", "name", 2, 255, None), ("البَقَرَة/255", "name", 2, 255, None), ("سورة آل عمران، الآية 103", "chapter", 3, 103, None),
    ("سورة البقرة آية 255-257", "chapter", 2, 255, 257), ("الآية 5 من سورة المائدة", "unit_first", 5, 5, None), ("الآية رقم (5) في سورة المائدة", "unit_first", 5, 5, None), ("2:255", "numeric", 2, 255, None),
    ("[2 : 255–257]", "numeric", 2, 255, 257), ("سورة براءة: 40", "chapter", 9, 40, None), ("وفي سورة لقمان", "chapter", 31, None, None), ("الآية الخامسة عشرة من سورة النور.", "ordinal_first", 24, 15, None),
    ("الآية الحادية والعشرون من سورة البقرة", "ordinal_first", 2, 21, None), ("محمد 7", "name", 47, 7, None), ("البقرة آية: 12", "name", 2, 12, None), ("سورة البقرة (الآية 3)", "chapter", 2, None, None),
]
NOT_READ = ["اهتدى بالنور وجاء محمد إلى البيت", "الحالة الخامسة عشرة من سورة حياته", "الآية الخامسة من كتاب الأدب", "12:30:45", "1.2:3", "البقرة 2555", "", "سورة"]


@pytest.mark.parametrize("text, form, work, unit0, unit1", READ)
def test_forms(text, form, work, unit0, unit1):
    (c,) = Parser(ARABIC_FORMS, ARABIC).read("قال (" + text + ")")
    assert (c.form, c.work, c.unit0, c.unit1) == (form, work, unit0, unit1)
    said = ("قال (" + text + ")")[c.start : c.end]
    assert said in text and said[0] not in "[( " and said[-1] not in "]) ."


@pytest.mark.parametrize("text", NOT_READ)
def test_other_text_is_no_citation(text):
    assert Parser(ARABIC_FORMS, ARABIC).read(text) == []


def test_ordinals_are_complete():
    for table in (arabic_ordinals(), english_ordinals()):
        assert set(table.values()) == set(range(1, 100))
    assert english_ordinals()[("twenty", "first")] == 21 and english_ordinals()[("fortieth",)] == 40 and english_ordinals()[("eightieth",)] == 80


def test_overlaps_leave_the_longest():
    read = Parser(ENGLISH_FORMS, ENGLISH).read
    assert [(c.work, c.unit0) for c in read("First Kings 3")] == [(11, 3)]
    assert [(c.work, c.unit0, c.unit1) for c in read("verse 2 of chapter Genesis 4-5; Acts: 7")] == [(1, 2, None), (44, 7, None)]
    assert [(c.form, c.unit0) for c in read("the Twenty verse twenty first of book Acts")] == [("ordinal_first", 21)]


def test_offsets_of_random_texts_are_exact():
    r, read = random.Random(5), Parser(ARABIC_FORMS, ARABIC).read
    for _ in range(400):
        parts = [r.choice([*(x[0] for x in READ), "كلمة", "😀", "َ", "\n", ".", "ﷺ", "12"]) for _ in range(r.randint(1, 7))]
        text = " ".join(parts)
        found = read(text)
        assert all(a.end <= b.start for a, b in zip(found, found[1:]))
        for c in found:
            (again,) = [x for x in read(text[c.start : c.end]) if x.end - x.start == c.end - c.start] or [c]
            assert again[2:] == c[2:] and text[c.start : c.end].strip() == text[c.start : c.end]


def test_citations_of_documents(spark):
    works = spark.createDataFrame([(1, "Genesis", 50), (11, "First Kings", 22), (12, "Kings", 25)], "work long, name string, n_units int")
    docs = [(1, "\"In the beginning\" (Genesis: 1) and \"so\" Genesis 51, then 99:1, Genesis 5-2"), (1, "Genesis 3"), (2, None), (3, ""), (None, "chapter first kings, verses 2 - 4")]
    rows = citations(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, found string"), works)
    got = sorted(((r.doc_id or 0, r.s, r.work, r.unit0, r.unit1, r.problem) for r in rows.collect()))
    assert [g[2:] for g in got] == [(11, 2, 4, "none"), (1, 3, 3, "none"), (1, 1, 1, "none"), (1, 51, 51, "out_of_range"), (99, 1, 1, "no_work"), (1, 5, 2, "reversed")]
    spans = spark.createDataFrame([(1, 0, 18)], "doc_id long, s long, e long")
    (x,) = attach_references(spans, rows.filter("problem = 'none' and s > 5")).collect()
    assert x.ref_s == docs[0][1].index("Genesis")
