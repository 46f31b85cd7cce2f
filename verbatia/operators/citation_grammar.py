"""Written citations in all their forms, by a small parser over words, numbers and signs.

A grammar names the words of a language (unit, chapter, of, number sign) and how its ordinals are made; the works' names come from a table
of bounded size. Forms: "verse 5 of chapter Name", the same with an ordinal word (1 to 99), "chapter Name, verse 5-7" or without a
number, "Name: 5" and "Name verse 5", "2:5-7". Texts are folded before they are read, with the place of every character kept,
so that offsets are those of the text as written. Of citations that overlap the longest stays, then the first.

Cases: null and empty texts have no citation. Numbers have one to three digits. Works and units that do not exist and reversed ranges are
kept, with what is wrong. Repeated rows are read each. Names of several words are tried before shorter ones.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatia.functions.normalize import ARABIC, DIGITS, GENERIC, INVISIBLE, Profile

#: Names that a task may hold.
MOST_NAMES = 100_000
DASHES = "-–—"


def folding(profile: Profile) -> Callable[[str], tuple[str, Sequence[int]]]:
    """Folded text and the place of each of its characters, for a profile."""
    gone = {c for lo, hi in (*profile.dropped, *profile.diacritics, *INVISIBLE) for c in range(lo, hi + 1)}
    table = dict.fromkeys(gone, "") | {ord(a): b for a, b in profile.fold} | {ord(a): b for a, b in zip(*DIGITS)} | {ord(a): b for a, b in profile.ligatures}
    #: Characters met so far that become none or several.
    odd: set[str] = set()

    class Folded(dict):
        def __missing__(self, code: int) -> str:
            self[code] = y = table.get(code, chr(code).lower())
            if len(y) != 1:
                odd.add(chr(code))
            return y

    known = Folded()

    def fold(text: str) -> tuple[str, Sequence[int]]:
        folded = text.translate(known)
        if not any(x in text for x in odd):
            return folded, range(len(text))
        return folded, [i for i, x in enumerate(text) for _ in known[ord(x)]]

    return fold


def arabic_ordinals() -> dict[tuple[str, ...], int]:
    """Feminine ordinals from 1 to 99 as folded words."""
    # The numerals' words.
    ones = "الاولي الثانيه الثالثه الرابعه الخامسه السادسه السابعه الثامنه التاسعه العاشره".split()
    with_tens = ["الحاديه", *ones[1:9]]
    tens = "العشر الثلاث الاربع الخمس الست السبع الثمان التسع".split()
    out: dict[tuple[str, ...], int] = {(w,): n for n, w in enumerate(ones, 1)}
    out |= {(w, "عشره"): 10 + n for n, w in enumerate(with_tens, 1)}
    for t, stem in enumerate(tens, 2):
        for end in ("ون", "ين"):
            out[(stem + end,)] = 10 * t
            out |= {(w, "و" + stem + end): 10 * t + n for n, w in enumerate(with_tens, 1)}
    return out


def english_ordinals() -> dict[tuple[str, ...], int]:
    # The numerals' words.
    ones = "first second third fourth fifth sixth seventh eighth ninth".split()
    teens = "tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth".split()
    tens = "twent thirt fort fift sixt sevent eight ninet".split()
    out: dict[tuple[str, ...], int] = {(w,): n for n, w in enumerate([*ones, *teens], 1)}
    for t, stem in enumerate(tens, 2):
        out[(stem + "ieth",)] = 10 * t
        out |= {(stem + "y", w): 10 * t + n for n, w in enumerate(ones, 1)}
    return out


@dataclass(frozen=True)
class Grammar:
    """The words that citations are made of, folded."""

    profile: Profile
    unit: frozenset[str]
    chapter: frozenset[str]
    of: frozenset[str]
    sign: frozenset[str] = frozenset()
    ordinals: dict[tuple[str, ...], int] = field(default_factory=dict)


ENGLISH_FORMS = Grammar(GENERIC, frozenset("verse verses sentence sentences line lines no".split()), frozenset("chapter book work".split()), frozenset("of in from".split()), frozenset(["no"]), english_ordinals())
ARABIC_FORMS = Grammar(ARABIC, frozenset("الايه الايات ايه ايات رقم".split()), frozenset(["سوره"]), frozenset("من في".split()), frozenset(["رقم"]), arabic_ordinals())

CHUNK = re.compile(r"\S*")
WORD = re.compile(r"(?P<number>\d+)|(?P<word>[^\W\d_]+)|(?P<other>\S)")


class Token(NamedTuple):
    kind: str
    text: str
    start: int
    end: int


class Citation(NamedTuple):
    start: int
    end: int
    form: str
    work: int | None
    unit0: int | None
    unit1: int | None


class Parser:
    """Citations of a text whose works are named by ``names`` (folded words: work)."""

    def __init__(self, grammar: Grammar, names: dict[tuple[str, ...], int]):
        self.g, self.fold = grammar, folding(grammar.profile)
        self.names, self.ordinals = self._by_first(names), self._by_first(grammar.ordinals)
        self.tokens: list[Token] = []
        # Every form holds a number or a chapter's word: no more tokens than these stand ahead of the first of them, and behind it.
        longest = max(map(len, names), default=0)
        self.ahead = max(8, longest + 3, max(map(len, grammar.ordinals), default=0) + 2)
        words = "|".join(map(re.escape, sorted(grammar.chapter)))
        self.anchor = re.compile(rf"\d|(?<![^\W\d_])(?:{words})(?![^\W\d_])" if words else r"\d")
        self.behind = re.compile(rf"\S*(?:\s+\S+){{0,{longest + 8}}}")

    @staticmethod
    def _by_first(phrases: dict[tuple[str, ...], int]) -> dict[str, list[tuple[tuple[str, ...], int]]]:
        """Phrases by their first word, long ones first."""
        out: dict[str, list] = {}
        for words in sorted(phrases, key=len, reverse=True):
            out.setdefault(words[0], []).append((words, phrases[words]))
        return out

    # Each of the following reads at a place and gives the place behind what it has read, or none.
    def word(self, i: int, among: frozenset[str]) -> int | None:
        return i + 1 if i < len(self.tokens) and self.tokens[i].kind == "word" and self.tokens[i].text in among else None

    def mark(self, i: int, among: str) -> int:
        """Behind one of the signs, if it stands there."""
        return i + 1 if i < len(self.tokens) and self.tokens[i].kind == "other" and self.tokens[i].text in among else i

    def phrase(self, i: int, phrases: dict) -> tuple[int, int] | None:
        if i < len(self.tokens) and self.tokens[i].kind == "word":
            for words, value in phrases.get(self.tokens[i].text, ()):
                if tuple(t.text for t in self.tokens[i : i + len(words)]) == words:
                    return i + len(words), value
        return None

    def number(self, i: int) -> int | None:
        return int(self.tokens[i].text) if i < len(self.tokens) and self.tokens[i].kind == "number" and len(self.tokens[i].text) <= 3 else None

    def range(self, i: int) -> tuple[int, int, int | None] | None:
        """(place behind, first, last or none) of a number or a range."""
        first = self.number(i)
        if first is None:
            return None
        dash = self.mark(i + 1, DASHES)
        last = self.number(dash) if dash > i + 1 else None
        return (i + 1, first, None) if last is None else (dash + 1, first, last)

    def chapter_name(self, i: int) -> tuple[int, int] | None:
        j = self.word(i, self.g.chapter)
        return j and self.phrase(j, self.names)

    def unit_first(self, i: int) -> tuple | None:
        j = self.word(i, self.g.unit)
        if j is None:
            return None
        ordinal = self.phrase(j, self.ordinals)
        if ordinal:
            j, numbers = ordinal[0], (ordinal[1], None)
        else:
            j = self.mark(self.word(j, self.g.sign) or j, ":(")
            found = self.range(j)
            if found is None:
                return None
            j, numbers = self.mark(found[0], ")"), found[1:]
        j = self.word(j, self.g.of)
        named = j and self.chapter_name(j)
        return named and (named[0], "ordinal_first" if ordinal else "unit_first", named[1], *numbers)

    def chapter_first(self, i: int) -> tuple | None:
        named = self.chapter_name(i)
        if not named:
            return None
        j = self.mark(named[0], "،,:؛-–")
        j = self.mark(self.word(j, self.g.unit) or j, ":([")
        found = self.range(j)
        return (found[0], "chapter", named[1], *found[1:]) if found else (named[0], "chapter", named[1], None, None)

    def bare(self, i: int) -> tuple | None:
        named = self.phrase(i, self.names)
        if not named:
            return None
        j = self.mark(named[0], ":：/،,")
        j = self.word(j, self.g.unit) or j
        found = self.range(self.mark(j, ":") if j > named[0] else j)
        return found and (found[0], "name", named[1], *found[1:])

    def numeric(self, i: int) -> tuple | None:
        """Two numbers with a colon; not a part of a longer chain of numbers."""
        work, colon = self.number(i), self.mark(i + 1, ":")
        found = self.range(colon) if work is not None and colon > i + 1 else None
        if found is None:
            return None
        touches = lambda a, b: 0 <= a and b < len(self.tokens) and self.tokens[a].end == self.tokens[b].start
        if touches(i - 1, i) and self.tokens[i - 1].text in ":.":
            return None
        if touches(found[0] - 1, found[0]) and self.tokens[found[0]].text == ":":
            return None
        return found[0], "numeric", work, *found[1:]

    def windows(self, folded: str) -> Iterator[tuple[int, int]]:
        """Disjoint ranges that begin and end between words and hold all citations, and little else."""
        at = begin = end = 0
        while met := self.anchor.search(folded, at):
            if met.start() >= end:
                size = 16 * self.ahead
                while (low := max(end, met.start() - size)) > end and len(folded[low : met.start()].split()) < self.ahead + 2:
                    size *= 2
                # A word that the cut goes through is left out, but not one that begins where the last window ended.
                low += low > end and CHUNK.match(folded, low).end() - low
                if low > end:
                    if begin < end:
                        yield begin, end
                    begin = low
            at = CHUNK.match(folded, met.end()).end()
            end = max(end, self.behind.match(folded, met.end()).end())
        if begin < end:
            yield begin, end

    def read(self, text: str) -> list[Citation]:
        folded, places = self.fold(text)
        found = []
        for begin, end in self.windows(folded):
            self.tokens = [Token(m.lastgroup, m.group(), m.start(), m.end()) for m in WORD.finditer(folded, begin, end)]
            for i in range(len(self.tokens)):
                for form in (self.unit_first, self.chapter_first, self.bare, self.numeric):
                    if got := form(i):
                        s, e = self.tokens[i].start, self.tokens[got[0] - 1].end
                        found.append((s - e, s, Citation(places[s], places[e - 1] + 1, *got[1:])))
        kept: list[tuple[int, int, Citation]] = []
        for _, _, c in sorted(found, key=lambda x: x[:2]):
            at = bisect_left(kept, (c.start,))
            if (at == 0 or kept[at - 1][1] <= c.start) and (at == len(kept) or c.end <= kept[at][0]):
                kept.insert(at, (c.start, c.end, c))
        return [c for *_, c in kept]


def citations(docs: DataFrame, works: DataFrame, grammar: Grammar = ENGLISH_FORMS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, s, e, found, form, work, unit0, unit1, problem): the citations of texts; works(work, name, n_units) has a row for each name.

    unit1 is the last unit of a range, the unit itself without one, and null where no unit is named.
    """
    rows = works.select(F.col("work").cast("long").alias("work"), "name").filter("name is not null").limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names of works")
    fold = folding(grammar.profile)
    names = {words: r.work for r in sorted(rows, key=lambda r: -r.work) if (words := tuple(m.group() for m in WORD.finditer(fold(unicodedata.normalize("NFC", r.name))[0])))}
    shared = docs.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(grammar, shared.value)
        for batch in batches:
            out = []
            for name, said in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out += [(name, c.start, c.end, said[c.start : c.end], *c[2:5], c.unit0 if c.unit1 is None else c.unit1) for c in parser.read(said or "")]
            if out:
                kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], [key, "s", "e", "found", "form", "work", "unit0", "unit1"])

    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, s long, e long, found string, form string, work long, unit0 long, unit1 long")
    sizes = works.groupBy(F.col("work").cast("long").alias("work")).agg(F.max("n_units").alias("n_units"))
    met = found.join(F.broadcast(sizes), "work", "left")  # MOST_NAMES rows at most
    outside = (F.col("unit0") < 1) | (F.col("unit0") > F.col("n_units")) | (F.col("unit1") < 1) | (F.col("unit1") > F.col("n_units"))
    problem = F.when(F.col("n_units").isNull(), "no_work").when(F.coalesce(outside, F.lit(False)), "out_of_range").when(F.coalesce(F.col("unit1") < F.col("unit0"), F.lit(False)), "reversed").otherwise("none")
    return met.select(key, "s", "e", "found", "form", "work", "unit0", "unit1", problem.alias("problem"))
