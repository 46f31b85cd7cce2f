"""Spellings of one word: rewritten forms of a vocabulary, and words that meet through any of their forms.

Rules run once over the distinct words, never over the running text; the table of forms is joined back. A word's forms, the
first of which is its fold, are exploded into rows, so that "meets by any form" is one equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verbatia.functions import rasm
from verbatia.functions.normalize import ARABIC
from verbatia.operators.corpus import Corpus

#: Letters of Latin scripts that are written by two letters where they lack.
LATIN_PAIRS = {"ß": "ss", "æ": "ae", "œ": "oe", "ä": "ae", "ö": "oe", "ü": "ue"}


def rasm_forms(words: DataFrame, raw: str = "raw") -> DataFrame:
    """(raw, features, fold, alternatives, exact) of each distinct word of the canonical script.

    ``fold`` is the ordinary fold of a word without a feature. ``exact`` holds the ordinary spellings, with their hamza seats, that
    a word with a feature can stand for, and is empty for others.
    """
    rows = words.select(F.col(raw).alias("raw")).filter("raw is not null").distinct()
    rows = rows.withColumn("cells", rasm.cells(F.col("raw"))).withColumn("seated", rasm.lettered(F.col("cells")))
    rows = rows.withColumn("features", rasm.features(F.col("raw"), F.col("seated"), F.col("cells"))).withColumn("spelled", rasm.lengthened(F.col("seated")))
    rows = rows.withColumn("spelled", rasm.worded(F.col("spelled")))
    own = F.size("features") > 0
    rows = rows.withColumn("fold", F.when(own, rasm.folded_cells(F.col("spelled"))).otherwise(ARABIC.folded(F.col("raw"))))
    silent = F.col("cells").rlike(f"{rasm.ALEF}{rasm.V}?{rasm.SMALL_ZERO}$")
    shorter = F.when(silent & (F.length("fold") > 3) & F.col("fold").endswith(rasm.ALEF), F.expr("substring(fold, 1, length(fold) - 1)"))
    open_ = F.col("fold").endswith(rasm.ALEF + rasm.HAMZA + rasm.WAW)
    longer = F.when(open_, F.concat("fold", F.lit(rasm.ALEF)))
    others = F.filter(F.array(shorter, longer), lambda x: x.isNotNull())
    rows = rows.withColumn("alternatives", F.when(own, others).otherwise(F.expr("cast(array() as array<string>)")))
    plain = F.transform(F.array(F.lit(rasm.ALEF), F.lit(rasm.ALEF_MADDA)), lambda x: rasm.seated_letters(F.replace(F.translate("spelled", rasm.JOINED, rasm.ALEF_MADDA), F.lit(rasm.WILD), x)))
    short = F.transform(F.filter(plain, lambda x: silent & (F.length(x) > 3) & x.endswith(rasm.ALEF)), lambda x: F.substring(x, F.lit(1), F.length(x) - 1))
    long = F.transform(F.filter(plain, lambda x: open_), lambda x: F.concat(x, F.lit(rasm.ALEF)))
    exact = F.array_sort(F.array_distinct(F.concat(plain, short, long)))
    return rows.select("raw", "features", "fold", "alternatives", F.when(own, exact).otherwise(F.expr("cast(array() as array<string>)")).alias("exact"))


def explained(pairs: DataFrame, forms: DataFrame, quote: str = "quote", source: str = "source") -> DataFrame:
    """Pairs of words with ``features``: the conventions by which the quote is a rasm spelling of the source; null if none makes them equal."""
    said = forms.select(F.col("raw").alias(quote), "features", "exact")
    met = pairs.join(said, quote, "left")
    return met.withColumn("features", F.when(F.array_contains("exact", rasm.exact(F.col(source))), F.col("features"))).drop("exact")


def same_skeleton(a: Column, b: Column) -> Column:
    """Two words with the same consonants in the same order, two at least; no rule need make them equal."""
    bare = [F.regexp_replace(ARABIC.folded(x), f"[{rasm.ALEF}{rasm.WAW}{rasm.YEH}{rasm.HAMZA}]", "") for x in (a, b)]
    return (F.length(bare[0]) >= 2) & (bare[0] == bare[1])


def latin_forms(words: DataFrame, word: str = "fold") -> DataFrame:
    """(fold, form): distinct words of Latin scripts with all forms that stand for them.

    A form is the word itself, the word with letters written by two (ß as ss, ä as ae), and the word without diacritics.
    """
    w = F.col("fold")
    paired = w
    for letter, pair in LATIN_PAIRS.items():
        paired = F.replace(paired, F.lit(letter), F.lit(pair))
    bare = F.replace(F.translate(w, *PLAIN), F.lit("ß"), F.lit("ss"))
    rows = words.select(F.col(word).alias("fold")).filter("fold is not null").distinct()
    return rows.select("fold", F.explode(F.array_distinct(F.array(w, paired, bare))).alias("form"))


#: Small Latin letters with diacritics and their base letters.
PLAIN = ("àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ", "aaaaaaceeeeiiiinoooooouuuuyy")


def met_words(words: DataFrame, others: DataFrame, forms=latin_forms) -> DataFrame:
    """(fold, other): distinct words of two tables that share a form, equal ones included."""
    a, b = forms(words), forms(others).withColumnRenamed("fold", "other")
    return a.join(b, "form").select("fold", "other").distinct()


def occurrences_by_forms(quotes: DataFrame, corpus: Corpus, key: str = "quote_id") -> DataFrame:
    """(key, work, p0, p1): every place where the words of a quotation (array ``forms`` of arrays of folds) stand in a row, each in any form.

    Every form of every word meets the corpus by one equi-join; a place is where all words lie on one diagonal. The rarest word
    of a quotation opens its places, so that common words only confirm them.
    """
    each = quotes.select(key, F.size("forms").alias("n"), F.posexplode("forms").alias("i", "forms")).select(key, "n", "i", F.explode(F.array_distinct("forms")).alias("fold"))
    rarity = each.join(corpus.small(corpus.vocab.select("fold", "df")), "fold", "left").groupBy(key, "n", "i").agg(F.sum(F.coalesce("df", F.lit(0))).alias("df"))
    opener = rarity.groupBy(key, "n").agg(F.min_by("i", F.struct("df", "i")).alias("i"))
    places = corpus.tokens.select("work", "pos", "fold")
    # Two forms of a word may be one corpus word: distinct places.
    opened = each.join(opener, [key, "n", "i"]).join(corpus.small(places), "fold").select(key, "n", "work", (F.col("pos") - F.col("i")).alias("p0")).distinct()
    rest = opened.join(each, [key, "n"]).select(key, "n", "work", "p0", "i", "fold", (F.col("p0") + F.col("i")).alias("pos"))
    met = rest.join(corpus.small(places), ["work", "pos", "fold"]).select(key, "n", "work", "p0", "i").distinct()
    whole = met.groupBy(key, "n", "work", "p0").agg(F.count("*").alias("met")).filter(F.col("met") == F.col("n"))
    return whole.select(key, "work", "p0", (F.col("p0") + F.col("n")).alias("p1"))


def split_vocatives(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens (keys, tok, start, end, raw) with joined vocatives as two, offsets intact; tokens are numbered anew."""
    parts = tokens.select(*keys, "tok", "start", "end", F.posexplode(rasm.split_vocative(F.col("raw"))).alias("part", "raw"))
    n = F.length("raw")
    start = F.when(F.col("part") == 0, F.col("start")).otherwise(F.col("end") - n)
    parts = parts.select(*keys, "tok", "part", start.alias("start"), (start + n).alias("end"), "raw")
    order = W.partitionBy(*keys).orderBy("tok", "part")
    return parts.withColumn("tok", F.row_number().over(order).cast("long") - 1).drop("part")
