"""Normalisation profiles: literal, letters and folded forms of a text, as columns.

``literal`` drops invisible characters and collapses white space after canonical composition; ``letters`` also drops
diacritics; ``folded`` also maps letter variants, so that each level equates more spellings than the one before.
Everything is built in but the composition, a Pandas UDF that is only evaluated for texts with a
combining mark.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranges of code points (inclusive) with a role in the Arabic script.
ARABIC_ANNOTATION = ((0x06D6, 0x06E4), (0x06E7, 0x06E9), (0x06EA, 0x06ED))
ARABIC_DIACRITICS = ((0x064B, 0x065F), (0x0670, 0x0670), (0x06E5, 0x06E6))
INVISIBLE = ((0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2060), (0x2066, 0x2069), (0xFEFF, 0xFEFF))
TATWEEL = 0x0640
# Letter variants and the letter they are folded to; ligatures and their words.
ARABIC_FOLD = {
    "أ": "ا", "إ": "ا", "آ": "ا", "ٱ": "ا", "ٲ": "ا", "ٳ": "ا",
    "ى": "ي", "ی": "ي", "ې": "ي", "ۍ": "ي", "ئ": "ي",
    "ة": "ه", "ۀ": "ه", "ە": "ه",
    "ؤ": "و", "ک": "ك", "ڪ": "ك",
}
ARABIC_LIGATURES = {"ﷲ": "الله", "ﷺ": "صلى الله عليه وسلم"}
DIGITS = ("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")
#: Combining marks of all scripts that a letter may be followed by.
MARKS = r"\p{M}"


def char_class(*ranges: tuple[int, int]) -> str:
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


def _composed(form: str, text: Column) -> Column:
    def compose(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize(form, t), na_action="ignore")

    return F.pandas_udf(compose, "string")(text)


def nfc(text: Column) -> Column:
    """Canonical composition; texts without combining marks are left as they are."""
    return F.when(text.rlike(MARKS), _composed("NFC", text)).otherwise(text)


def nfd(text: Column) -> Column:
    """Canonical decomposition: letters followed by their marks; ASCII texts are left as they are."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), _composed("NFD", text)).otherwise(text)


def presentation_forms(text: Column) -> Column:
    """Arabic presentation forms as their base letters; other characters are left as they are."""
    return F.when(text.rlike(r"[\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFE}]"), _composed("NFKC", text)).otherwise(text)


def ascii_digits(text: Column) -> Column:
    return F.translate(text, *DIGITS)


@dataclass(frozen=True)
class Profile:
    """How a script is normalised: what is dropped at each level, and what is folded."""

    name: str
    dropped: tuple[tuple[int, int], ...] = INVISIBLE
    diacritics: tuple[tuple[int, int], ...] = ()
    fold: tuple[tuple[str, str], ...] = ()
    ligatures: tuple[tuple[str, str], ...] = ()
    token: str = r"[\p{L}\p{M}]+"

    def literal(self, text: Column) -> Column:
        for ligature, words in self.ligatures:
            text = F.replace(text, F.lit(ligature), F.lit(words))
        text = F.regexp_replace(nfc(text), char_class(*self.dropped), "")
        return F.trim(F.regexp_replace(text, r"\s+", " "))

    def letters(self, text: Column) -> Column:
        literal = self.literal(text)
        return F.regexp_replace(literal, char_class(*self.diacritics), "") if self.diacritics else literal

    def folded(self, text: Column) -> Column:
        folded = F.lower(self.letters(text))
        if self.fold:
            folded = F.translate(folded, "".join(a for a, _ in self.fold), "".join(b for _, b in self.fold))
        return folded

    def has_diacritics(self, text: Column) -> Column:
        return text.rlike(char_class(*self.diacritics)) if self.diacritics else F.lit(False)


GENERIC = Profile("generic")
ARABIC = Profile(
    "arabic",
    dropped=(*ARABIC_ANNOTATION, *INVISIBLE, (TATWEEL, TATWEEL)),
    diacritics=ARABIC_DIACRITICS,
    fold=tuple(ARABIC_FOLD.items()),
    ligatures=tuple(ARABIC_LIGATURES.items()),
)


def clean_text(text: Column) -> Column:
    """Imported text: no byte-order mark, line feeds only, no control characters, trimmed."""
    text = F.regexp_replace(text, r"^\x{FEFF}+", "")
    text = F.regexp_replace(text, r"\r\n?", "\n")
    return F.trim(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]", ""))


def scrub(text: Column, longest: int = 20) -> Column:
    """Runs of more than ``longest`` letters are replaced, so that logs hold no running text."""
    return F.regexp_replace(text, rf"\p{{L}}{{{longest + 1},}}", "[removed]")


def line_of(text: Column, offset: Column) -> Column:
    """One-based line of a code-point offset."""
    return F.regexp_count(F.substring(text, F.lit(1), offset), F.lit("\n")) + 1
