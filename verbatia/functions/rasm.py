"""The rasm orthography of the canonical Arabic corpus, rewritten to ordinary spelling by an ordered cascade of patterns.

A word is first brought to cells: a letter, then its dagger alef, shadda, vowel and special marks, in that order. The rules
are then replaced one after the other in the JVM; each is a pattern over cells with what stands before and behind. Symbols of the private-use
area stand for what later rules must tell apart: a hamza on a stretch, a bare carrier of a dagger alef, hamzas whose
seat is decided, an alef with madda that was made of two letters, and one that may only be a sign of length.

Only words with a feature of the rasm are rewritten. Spellings that the rasm can't tell apart come out as alternatives.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verbatia.functions.normalize import ARABIC, ARABIC_FOLD, INVISIBLE, char_class

# Marks and letters by their Unicode names.
FATHATAN, DAMMATAN, KASRATAN, FATHA, DAMMA, KASRA, SHADDA, SUKUN = (chr(c) for c in range(0x064B, 0x0653))
MADDA, HAMZA_ABOVE, HAMZA_BELOW, DAGGER, TATWEEL = (chr(c) for c in (0x0653, 0x0654, 0x0655, 0x0670, 0x0640))
SMALL_SEEN, SMALL_ZERO, SMALL_MEEM, SMALL_LOW_MEEM, SMALL_WAW, SMALL_YEH, SMALL_HIGH_YEH = (chr(c) for c in (0x06DC, 0x06DF, 0x06E2, 0x06ED, 0x06E5, 0x06E6, 0x06E7))
ALEF, WASLA, ALEF_MADDA, HAMZA, YEH, ALEF_YEH, WAW, HEH = "ا", "ٱ", "آ", "ء", "ي", "ى", "و", "ه"
#: Small marks that only the rasm writes.
SMALL = "[\\u06DF-\\u06E8\\u06EA-\\u06ED]"
# Words that keep their dagger alef; letters of the rasm and of ordinary spelling, as folded stems.
KEPT = "ذلك هذا هذه هذان هذين هولاء اوليك لكن اله رحمن هكذا".split()
WAW_FOR_ALEF = dict(zip("صلوه زكوه حيوه مشكوه منوه غدوه نجوه ربو".split(), "صلاه زكاه حياه مشكاه مناه غداه نجاه ربا".split()))
ONE_LAM = "اليل الات الاتي الايي الذان التان".split()
WORDS = dict(zip("اولوا رباا يحي يستحي اقصا محي تحي نحي احي".split(), "أولو ربا يحيي يستحيي أقصى محيي تحيي نحيي أحيي".split()))
CLITICS = "و ف ب ل ك ا ول فل وب فب وك وا فا وس فس س".split()

# Symbols of this module.
STRETCHED, CARRIER, LINE, JOINED, WILD = (chr(c) for c in range(0xE001, 0xE006))
V, A, U, I = f"[{FATHATAN}-{KASRA}]", f"[{FATHA}{FATHATAN}]", f"[{DAMMA}{DAMMATAN}]", f"[{KASRA}{KASRATAN}]"
MARK = "[\\u064B-\\u065F\\u0670\\u06D6-\\u06DC\\u06DF-\\u06E8\\u06EA-\\u06ED]"
#: Marks of a cell in their order; a cell without them is quiet.
OWN = f"{DAGGER}?{SHADDA}?{V}?[{SMALL_ZERO}{SMALL_SEEN}{SMALL_WAW}{SMALL_YEH}]*"
QUIET = f"(?![{DAGGER}{SHADDA}]|{V})"
BOUND = f"{MARK}{{0,4}}"
#: Clitics and the article, behind which a word proper begins.
LEAD = f"(?:[وف]{OWN}(?=.{OWN}.))?(?:(?:[كل]{OWN}|ب{SHADDA}?{KASRA})(?=.{OWN}.))?(?:[{ALEF}{WASLA}]{OWN}ل{DAGGER}?(?!{SHADDA}){V}?(?=.))?"

CELLS = (
    # Marks of another edition, the small meem of assimilated nunation, marks written apart from their letter.
    ("ٖ", KASRATAN), ("ٗ", FATHATAN), ("ٞ", DAMMATAN),
    *((f"{a}(?={MARK}*[{SMALL_MEEM}{SMALL_LOW_MEEM}])|(?<=[{SMALL_MEEM}{SMALL_LOW_MEEM}]{BOUND}){a}", b) for a, b in ((FATHA, FATHATAN), (DAMMA, DAMMATAN), (KASRA, KASRATAN))),
    (f"{ALEF}({MARK}*?){HAMZA_ABOVE}", "أ$1"), (f"{ALEF}({MARK}*?){HAMZA_BELOW}", "إ$1"), (f"[{ALEF}أ]({MARK}*?){MADDA}", f"{ALEF_MADDA}$1"),
    (f"{WAW}({MARK}*?){HAMZA_ABOVE}", "ؤ$1"), (f"[{YEH}{ALEF_YEH}]({MARK}*?){HAMZA_ABOVE}", "ئ$1"),
    # A stretch carries a hamza, a small yeh or a dagger alef, or nothing.
    (f"{TATWEEL}(?={MARK}*{HAMZA_ABOVE})", STRETCHED), (f"{TATWEEL}{MARK}*{SMALL_HIGH_YEH}{MARK}*", YEH), (f"{TATWEEL}(?={MARK}*{DAGGER})", CARRIER), (f"{TATWEEL}{MARK}*", ""),
    # A sukun on an alef says that it is silent.
    (f"(?<={ALEF}{BOUND}){SUKUN}", SMALL_ZERO), (f"[^\\P{{M}}{DAGGER}{SHADDA}{FATHATAN}-{KASRA}{SMALL_ZERO}{SMALL_SEEN}{SMALL_WAW}{SMALL_YEH}]", ""),
    (f"([^{DAGGER}\\P{{M}}]+){DAGGER}", f"{DAGGER}$1"), (f"([^{DAGGER}{SHADDA}\\P{{M}}]+){SHADDA}", f"{SHADDA}$1"), (f"([{SMALL_ZERO}{SMALL_SEEN}{SMALL_WAW}{SMALL_YEH}]+)({V})", "$2$1"),
)

H = f"[{HAMZA}{STRETCHED}]"
JOINS = f"(?:{DAGGER}{SHADDA}?{FATHA}?|{SHADDA}?{FATHA}(?:[{ALEF}{ALEF_MADDA}]{DAGGER}?|{CARRIER}{DAGGER}))"
LETTERS = (
    # The verb "to see"; a hamza and the alef behind it, at the start of a word, behind a quiet letter, behind an a or after an i that is a clitic's.
    (f"^({LEAD}ر{OWN}){HAMZA}({OWN})[{ALEF}{ALEF_MADDA}]({OWN})$", f"$1أ$2{ALEF_YEH}$3"),
    (f"^({LEAD}){H}{JOINS}", f"$1{JOINED}"), (f"(?<=[^\\p{{M}}]){H}{JOINS}", JOINED), (f"(?<={A}[{SMALL_ZERO}{SMALL_WAW}{SMALL_YEH}]{{0,2}}){H}{JOINS}", JOINED), (f"^([^{SHADDA}]{I}){H}{JOINS}", f"$1{JOINED}"),
    # Silent letters, the small seen on sad, the alef that the imperative "ask" leaves out, small letters.
    (f"{ALEF}{V}?{SMALL_ZERO}(?={YEH}{QUIET})", ""), (f"(?<=م{BOUND}ل{BOUND})إ({OWN})[{YEH}{ALEF_YEH}]{SMALL_ZERO}", "ئ$1"), (f"[{YEH}{ALEF_YEH}]{V}?{SMALL_ZERO}", ""),
    (f"ص({OWN}?){SMALL_SEEN}", "س$1"), (f"^([وف]{OWN})(?=س{STRETCHED})", f"$1{ALEF}"),
    (f"{HEH}({SHADDA}?{V}?)[{SMALL_WAW}{SMALL_YEH}]$", f"{HEH}$1"), (SMALL_WAW, WAW), (SMALL_YEH, YEH),
)

FINAL = f"(?={OWN}(?:{ALEF}{OWN})?$)"
LONG = f"(?:(?<=[{ALEF}{ALEF_MADDA}{JOINED}]{BOUND})|(?<={DAGGER}{SHADDA}?{V}?))"


def _seats(before: str, hamza: str, behind: str = "", line: bool = False, vowels: str = "iu") -> list[tuple[str, str]]:
    """The seat by the hamza's own vowel: i on yeh, u on waw, a on alef; others on the line. ``line``: all on the line."""
    by = {"i": (I, "ئ"), "u": (U, "ؤ"), "a": (A, "أ")}
    seats = [] if line else [(f"{before}{hamza}(?={DAGGER}?{SHADDA}?{by[v][0]}){behind}", by[v][1]) for v in vowels]
    return [*seats, (f"{before}{hamza}{behind}", LINE)]


QUIET_YEH, QUIET_WAW = f"(?<={YEH})", f"(?<={WAW})"
BESIDE_WAW = f"(?={DAGGER}?{SHADDA}?{U}[{SMALL_ZERO}]*{WAW})"
LONG_U, LONG_I = f"(?<={U}{WAW})", f"(?<={I}{YEH})"
SEATS = (
    # At the start of the word proper, and behind the hamza of a question.
    (f"^({LEAD}){H}(?={DAGGER}?{SHADDA}?{I})", "$1إ"), (f"^({LEAD}){H}", "$1أ"),
    (f"^([أإؤئ{HAMZA}]{OWN}){H}(?={DAGGER}?{SHADDA}?{I})", "$1إ"), (f"^([أإؤئ{HAMZA}]{OWN}){H}", "$1أ"),
    (f"{QUIET_YEH}{H}(?={DAGGER}?{SHADDA}?{A}[{SMALL_ZERO}]*{ALEF})", "ئ"),
    (f"(?<=ر{BOUND}){H}{BESIDE_WAW}", LINE), (f"{LONG}{H}{BESIDE_WAW}", LINE),
    # Behind a long a, a long u or i, and a sukun.
    (f"{LONG}{H}(?={DAGGER}?{SHADDA}?{A})", LINE), (f"{LONG}{H}{FINAL}", LINE), *_seats(LONG, H),
    *((f"{long}{h}{behind}", LINE) for long in (LONG_U, LONG_I) for h, behind in ((HAMZA, ""), (STRETCHED, FINAL))), (f"{LONG_I}{STRETCHED}", "ئ"), *_seats(LONG_U, STRETCHED, vowels="iua"),
    (f"(?<=[^\\p{{M}}{CARRIER}]){HAMZA}|(?<=[^\\p{{M}}{CARRIER}]){STRETCHED}{FINAL}", LINE), (f"{QUIET_YEH}{STRETCHED}(?={OWN}س)", "أ"), (f"{QUIET_YEH}{STRETCHED}", "ئ"),
    (f"(?<=[^\\p{{M}}]){STRETCHED}{BESIDE_WAW}", "ئ"), *_seats("(?<=[^\\p{M}])", STRETCHED, vowels="iua"),
    # Behind a vowel: the stronger of the two, i before u before a.
    (f"(?<={WAW}{BOUND}){H}(?={DAGGER}?{SHADDA}?{A})", LINE),
    (f"(?<={A}){STRETCHED}{BESIDE_WAW}", "ئ"), (f"(?<={A}){HAMZA}{BESIDE_WAW}", LINE),
    (f"(?<={I}[{SMALL_ZERO}]?){H}|{H}(?={DAGGER}?{SHADDA}?{I})", "ئ"), (f"(?<={U}[{SMALL_ZERO}]?){H}|{H}(?={DAGGER}?{SHADDA}?{U})", "ؤ"), (f"(?<={A}[{SMALL_ZERO}]?){H}|{H}(?={DAGGER}?{SHADDA}?{A})", "أ"),
    (LINE, HAMZA), (STRETCHED, HAMZA),
    # An alef behind a seat that carries the ending itself.
    (f"أ({SHADDA}?{FATHATAN}){ALEF}{OWN}$", "أ$1"),
    (f"{LONG}ؤ({OWN}){ALEF}{OWN}$", f"{HAMZA}$1"), (f"(?<={U})ؤ({OWN}){ALEF}{OWN}$", "ؤ$1"), (f"ؤ({OWN}){ALEF}{OWN}$", "أ$1"),
    # An alef with madda behind an a may be no more than a sign of length.
    (f"(?<={A}[{SMALL_ZERO}]{{0,2}}){ALEF_MADDA}(?!{DAGGER})", WILD),
)
LENGTHS = ((f"{ALEF_YEH}{DAGGER}(?={OWN}$)", ALEF_YEH), (f"{ALEF_YEH}{DAGGER}{SHADDA}?{V}?", ALEF), (f"{CARRIER}?{DAGGER}({SHADDA}?{V}?)", f"$1{ALEF}"))
PREFIX = f"(?:[وفبلك{ALEF}]{{0,3}}(?:ال|لل)?)"


def _replaced(text: Column, rules) -> Column:
    for pattern, put in rules:
        text = F.regexp_replace(text, pattern, put)
    return text


def folded_cells(text: Column) -> Column:
    """Letters of cells, folded: no marks, no symbols."""
    bare = F.regexp_replace(F.translate(text, WILD + JOINED, ALEF + ALEF), f"{MARK}|{CARRIER}", "")
    return F.translate(bare, "".join(ARABIC_FOLD), "".join(ARABIC_FOLD.values()))


def _any(words, prefix: str, suffix: str = "") -> str:
    return f"^{prefix}(?:{'|'.join(sorted(words, key=len, reverse=True))}){suffix}"


def cells(raw: Column) -> Column:
    """The word as cells; invisible characters are gone."""
    return _replaced(F.regexp_replace(raw, char_class(*INVISIBLE), ""), CELLS)


def lettered(cells: Column) -> Column:
    """Hamzas joined and seated, silent letters gone; dagger alefs are still marks."""
    return _replaced(_replaced(cells, LETTERS), SEATS)


def lengthened(seated: Column) -> Column:
    """Dagger alefs written as ordinary spelling has them: kept off closed words, an alef elsewhere."""
    stem = folded_cells(seated)
    kept = stem.rlike(_any(KEPT, PREFIX, ".{0,3}$"))
    waw = F.regexp_replace(seated, f"{WAW}{DAGGER}{SHADDA}?(?!{V})", ALEF)
    out = F.when(stem.rlike("|".join(WAW_FOR_ALEF)), waw).otherwise(seated)
    return F.when(kept, F.regexp_replace(seated, f"{CARRIER}?{DAGGER}", "")).otherwise(_replaced(out, LENGTHS))


def worded(spelled: Column) -> Column:
    """Closed words: one lam for two behind a clitic, and words whose last letters differ."""
    clitic = f"(?:{'|'.join(sorted(CLITICS, key=len, reverse=True))})?"
    stem = folded_cells(spelled)
    lam = "|".join(w[2:] for w in ONE_LAM)
    two = F.regexp_replace(spelled, f"^((?:[وفبلكس]{OWN}){{0,2}}[{ALEF}{WASLA}]{OWN})ل", "$1لل")
    out = F.when(stem.rlike(f"^{clitic}ال(?:{lam}).{{0,3}}$"), two).otherwise(spelled)
    for wrong, right in WORDS.items():
        out = F.when(stem.rlike(f"^{clitic}(?:ال|لل)?{wrong}$"), F.concat(F.regexp_replace(stem, f"{wrong}$", ""), F.lit(right))).otherwise(out)
    return out


def features(raw: Column, seated: Column, as_cells: Column) -> Column:
    """Codes of the rasm's features in a word; none for ordinary spelling."""
    has = lambda code, test: F.when(test, F.lit(code))
    hamzas = f"[^{HAMZA}{STRETCHED}{JOINED}]"
    moved = F.regexp_replace(as_cells, hamzas, "") != F.regexp_replace(F.replace(seated, F.lit(WILD), F.lit("")), hamzas, "")
    joined = seated.contains(JOINED)
    found = [
        has("wasla", raw.contains(WASLA)),
        has("small_marks", raw.rlike(SMALL)),
        has("dagger_alef", F.regexp_replace(as_cells, f"{ALEF_YEH}{DAGGER}(?={OWN}$)", "").contains(DAGGER)),
        has("silent_alef", raw.rlike(f"{ALEF}{MARK}*{SUKUN}")),
        has("hamza_seat", moved | joined),
        has("madd_sign", raw.contains(MADDA) | as_cells.rlike(f"{A}[{SMALL_ZERO}]*{ALEF_MADDA}")),
        has("idgham_shadda", raw.rlike(f"^.{MARK}*{SHADDA}") | raw.rlike(f"[دطث]ت{MARK}*{SHADDA}")),
    ]
    codes = F.filter(F.array(*found), lambda x: x.isNotNull())
    stem = folded_cells(as_cells)
    clitic = f"(?:{'|'.join(sorted(CLITICS, key=len, reverse=True))})?"
    lexicon = stem.rlike(f"^{clitic}(?:ال|لل)?(?:{'|'.join(WORDS)})$") | stem.endswith("اءو")
    return F.when(F.size(codes) > 0, codes).when(raw.rlike(f".{TATWEEL}"), F.array(F.lit("tatweel"))).when(lexicon, F.array(F.lit("lexicon"))).otherwise(codes)


def seated_letters(text: Column) -> Column:
    """Letters without marks, compared with their hamza seats."""
    return F.translate(F.regexp_replace(text, MARK, ""), f"{WASLA}{ALEF_YEH}ی", f"{ALEF}{YEH}{YEH}")


def exact(raw: Column) -> Column:
    return seated_letters(ARABIC.letters(raw))


#: A vocative (or "ha" before a hamza on alef) that the rasm joins to the next word.
VOCATIVE = f"^((?:[وف]{MARK}*)?(?:{YEH}{MARK}*{DAGGER}{MARK}*(?=.{MARK}*.)|{YEH}{MARK}*{TATWEEL}{MARK}*{DAGGER}{MARK}*(?=.)|{HEH}{MARK}*{TATWEEL}?{MARK}*{DAGGER}{MARK}*(?=أ|{ALEF}{MARK}*{HAMZA_ABOVE})))"


def split_vocative(raw: Column) -> Column:
    """The word's parts: two for a joined vocative, else one."""
    return F.split(F.regexp_replace(raw, VOCATIVE, "$1\n"), "\n")
