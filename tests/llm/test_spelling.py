"""Spelling variants: automata, near words and forms against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from verbatia.llm import spelling
from verbatia.llm.queries import QUERIES
from verbatia.llm.spelling import Automaton, near_words, spelling_groups
from verbatia.llm.work import Workspace


def one_apart(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def groups(counts: dict[str, int]) -> list[tuple]:
    """(word, n, n_near, form, form_n, root) of every word, from all pairs."""
    near = {w: [v for v in counts if one_apart(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n, len(near[w]), form[w], form[w] and counts[form[w]], root))
    return sorted(out)


@pytest.fixture(scope="module")
def counts() -> dict[str, int]:
    r = random.Random(3)
    out: dict[str, int] = {}
    for _ in range(150):
        word = "".join(r.choice("abé😀" if r.random() < 0.1 else "abc") for _ in range(r.randint(2, 9)))
        out[word] = r.choice((5, 6, 30, 200, 900))
        for _ in range(3):
            at, x = r.randrange(len(word)), r.choice("abcé")
            out.setdefault(r.choice((word[:at] + x + word[at:], word[:at] + word[at + 1 :] or "a", word[:at] + x + word[at + 1 :])), r.choice((5, 5, 6, 31, 150)))
    return out


def test_automaton_numbers_words_and_is_minimal(counts):
    words = sorted(counts)
    a = Automaton(words)
    assert [a.number(w) for w in words] == list(range(len(words))) and a.number("zzz") is None and a.number("") is None
    # Minimal: as many states as there are distinct sets of continuations.
    rests = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for w in words for p in (w[:i] for i in range(len(w) + 1))}
    assert len(a.edges) == len(rests)
    for word in words[::7] + ["abcabc", "zz"]:
        for exact in range(len(word) + 1):
            want = {i for i, w in enumerate(words) if w[:exact] == word[:exact] and one_apart(w, word)}
            assert {i for i in a.near(word, exact)} == {i for i in want if one_apart(word[exact:], words[i][exact:])} == want


@pytest.mark.parametrize("limit", [20_000, 3])
def test_near_words_and_forms(spark, counts, monkeypatch, limit):
    monkeypatch.setattr(spelling, "GROUP_WORDS", limit)
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    pairs = near_words(words, Workspace(spark, "near"))
    got = [(r.word, r.n, r.other, r.other_n) for r in pairs.collect()]
    assert sorted(got) == sorted((a, counts[a], b, counts[b]) for a in counts for b in counts if one_apart(a, b))
    rows = spelling_groups(words, Workspace(spark, "groups"))
    assert sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in rows.collect()) == groups(counts)


def test_registered_query(spark, tmp_path):
    r = random.Random(8)
    base = ["wording", "Straßen", "éclatante", "lettering", "abcdefgh" * 40, "short", "COUNTED"]
    texts = [(i, " ".join(r.choice(base) for _ in range(r.randint(0, 120))) + "×tail÷tail 1word,wörd") for i in range(700)]
    rows = [*texts, (None, "wording wording"), (5, None), (6, ""), texts[3], (9, "lettering " * 20_000)]
    spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, word string, n long").write.parquet(f"{tmp_path}/documents.parquet")
    counts: Counter = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(x.lower() if x.isascii() else x for x in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    want = groups({w: n for w, n in counts.items() if len(w) >= 6 and n >= 5})
    got = QUERIES["op11_spelling"](spark, str(tmp_path))
    assert got.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    assert sorted((r.word, r.n, r.n_near, r.form, r.form_n, r.root) for r in got.collect()) == want
    assert any(w[3] for w in want)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert QUERIES["op11_spelling"](spark, f"{tmp_path}/none").count() == 0
