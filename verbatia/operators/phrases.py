"""Exact phrases of a corpus in documents: rare seeds, diagonals, runs, tiers, word pairs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verbatia.operators.corpus import Corpus
from verbatia.operators.tokens import with_ends, word_arrays
from verbatia.sources.tables import written


@dataclass(frozen=True)
class Thresholds:
    """Bars that depend on the corpus; the defaults suit small corpora, ``LARGE`` a corpus of thousands of units."""

    seed_df: int = 4
    min_words: int = 3
    mass_floor: float = 6.0
    mass_candidate: float = 12.0
    mass_common: float = 9.0
    approx_mass: float = 8.0
    approx_words: int = 4
    anchor_idf: float = 3.0
    max_edits: int = 2
    pair_units: int = 4
    pair_rare_zipf: float = 4.5
    pair_other_zipf: float = 6.0


LARGE = Thresholds(seed_df=300, mass_floor=12.0, mass_candidate=20.0, mass_common=16.0, approx_mass=16.0, anchor_idf=5.0, pair_rare_zipf=3.2)


def _width(bars: Thresholds) -> int:
    return max(2, min(3, bars.min_words))


def _seeds(corpus: Corpus, bars: Thresholds) -> DataFrame:
    """(work, pos, g0, g1, ...): neighbouring words of works of which one is rare."""
    n, work = _width(bars), W.partitionBy("work").orderBy("pos")
    ahead = [F.lead("fold", i).over(work).alias(f"g{i}") for i in range(n)]
    rare = corpus.vocab.filter(F.col("df") <= bars.seed_df).select("fold", F.lit(True).alias("rare"))
    known = corpus.tokens.join(rare, "fold", "left").select("work", "pos", *ahead, F.max("rare").over(work.rowsBetween(0, n - 1)).alias("rare"))
    return known.filter(F.col("rare") & F.col(f"g{n - 1}").isNotNull()).drop("rare")


def _islands(met: DataFrame, bars: Thresholds, *more: Column) -> DataFrame:
    """Runs of met words (doc_id, work, diag, tok, pos, df, idf) that stand side by side on a diagonal."""
    line = W.partitionBy("doc_id", "work", "diag").orderBy("tok")
    islands = met.withColumn("island", F.col("tok") - F.row_number().over(line))
    runs = islands.groupBy("doc_id", "work", "diag", "island").agg(
        F.min("tok").alias("d0"), (F.max("tok") + 1).alias("d1"), F.min("pos").alias("b0"), (F.max("pos") + 1).alias("b1"), F.count("*").alias("words"), F.round(F.sum("idf"), 6).alias("mass"), F.min("df").alias("rarest"), *more
    )
    runs = runs.filter((F.col("words") >= bars.min_words) & (F.col("rarest") <= bars.seed_df))
    return runs.drop("diag", "island")


def exact_runs(tokens: DataFrame, corpus: Corpus, bars: Thresholds = Thresholds()) -> DataFrame:
    """Maximal runs of equal words: (doc_id, work, d0, d1, b0, b1, words, mass, rarest).

    A run of n words or more that holds a rare word holds n neighbours with it, so the n-grams (n is three, or
    the least words of a run) with a rare word are the only seeds. A seed names a diagonal (place in the document less place in
    the work); the work's words are then laid on the diagonal and compared with the document's.
    """
    grams, doc = [f"g{i}" for i in range(_width(bars))], W.partitionBy("doc_id").orderBy("tok")
    said = tokens.select("doc_id", "tok", *[F.lead("fold", i).over(doc).alias(g) for i, g in enumerate(grams)]).filter(F.col(grams[-1]).isNotNull())
    keys = said.join(corpus.small(_seeds(corpus, bars)), grams).select("doc_id", "work", (F.col("tok") - F.col("pos")).alias("diag")).distinct()
    laid = keys.join(corpus.small(corpus.tokens.join(corpus.vocab, "fold")), "work").select("doc_id", "work", "diag", "pos", (F.col("pos") + F.col("diag")).alias("tok"), "fold", "df", "idf")
    return _islands(laid.join(tokens.select("doc_id", "tok", "fold"), ["doc_id", "tok", "fold"]), bars)


def text_runs(docs: DataFrame, corpus: Corpus, bars: Thresholds = Thresholds(), text: str = "text") -> DataFrame:
    """``exact_runs`` of whole texts (doc_id, text), with their offsets s and e and the text directly ``before`` and ``after`` them.

    A text's words stay in one row: seeds are met inside it, and the texts that have any are met by their diagonals once more, so
    that texts are shuffled once and words never. ``after`` is null at the end of a text.
    """
    docs = docs.select("doc_id", F.col(text).alias("text"))
    grams = [f"g{i}" for i in range(_width(bars))]
    words = word_arrays(docs, ["doc_id"]).select("doc_id", F.transform("raws", F.lower).alias("g0"))
    lines = words.select("doc_id", F.posexplode(F.arrays_zip(F.col("g0"), *[F.slice("g0", F.lit(i + 1), F.size("g0")).alias(g) for i, g in enumerate(grams) if i])).alias("tok", "g"))
    said = lines.select("doc_id", F.col("tok").cast("long").alias("tok"), *[f"g.{g}" for g in grams]).filter(F.col(grams[-1]).isNotNull())
    keys = said.join(corpus.small(_seeds(corpus, bars)), grams).select("doc_id", "work", (F.col("tok") - F.col("pos")).alias("diag")).distinct()
    asked = keys.groupBy("doc_id").agg(F.collect_list(F.struct("work", "diag")).alias("keys"))
    texts = with_ends(word_arrays(docs.join(asked, "doc_id"), ["doc_id", "keys"])).withColumn("folds", F.transform("raws", F.lower))
    each = texts.select("doc_id", "raws", "gaps", "ends", "folds", F.explode("keys").alias("k")).select("doc_id", "raws", "gaps", "ends", "folds", "k.work", "k.diag")
    laid = each.join(corpus.small(corpus.tokens.join(corpus.vocab, "fold").select("work", "pos", "fold", "df", "idf")), "work")
    tok = F.col("pos") + F.col("diag")
    at = tok.cast("int")
    met = laid.filter((tok >= 0) & (F.get("folds", at) == F.col("fold"))).select(
        "doc_id", "work", "diag", "pos", tok.alias("tok"), "df", "idf", (F.get("ends", at) - F.length(F.get("raws", at))).alias("s"), F.get("ends", at).alias("e"), F.get("gaps", at).alias("before"), F.get("gaps", at + 1).alias("after")
    )
    return _islands(met, bars, F.min("s").alias("s"), F.max("e").alias("e"), F.min_by("before", "tok").alias("before"), F.max_by("after", "tok").alias("after"))


def tier(bars: Thresholds = Thresholds(), words: str = "words", mass: str = "mass") -> Column:
    """hidden below the floor; candidate if long and rare enough; else possible."""
    words, mass = F.col(words), F.col(mass)
    rare = ((words >= 4) & (mass >= bars.mass_candidate)) | ((words >= 5) & (mass >= bars.mass_common))
    return F.when(mass < bars.mass_floor, "hidden").when(rare, "candidate").otherwise("possible")


def prose_zipf(tokens: DataFrame) -> DataFrame:
    """Frequency of every word in ordinary text: log10 of occurrences per thousand million words, (fold, n, zipf). Words are counted once."""
    counts = written(tokens.groupBy("fold").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("fold", "n", F.round(F.log10(F.lit(1e9) * F.col("n") / F.col("total")), 6).alias("zipf"))


def pair_hits(tokens: DataFrame, corpus: Corpus, zipf: DataFrame, bars: Thresholds = Thresholds()) -> DataFrame:
    """Two-word phrases of few units, one word rare and none everyday in ordinary text: (doc_id, tok, fold, next_fold, units).

    From left to right a hit takes both its words, so of neighbouring hits every other one stays.
    """
    doc = W.partitionBy("doc_id").orderBy("tok")
    return _taken(tokens.select("doc_id", "tok", "fold", F.lead("fold").over(doc).alias("next_fold")), corpus, zipf, bars)


def text_pair_hits(docs: DataFrame, corpus: Corpus, zipf: DataFrame, bars: Thresholds = Thresholds()) -> DataFrame:
    """``pair_hits`` of whole texts (doc_id, text); neighbours are met inside the rows, so that only hits are shuffled."""
    words = word_arrays(docs, ["doc_id"]).select("doc_id", F.transform("raws", F.lower).alias("fold"))
    each = words.select("doc_id", F.posexplode(F.arrays_zip("fold", F.slice("fold", F.lit(2), F.size("fold")).alias("next_fold"))).alias("tok", "p"))
    return _taken(each.select("doc_id", F.col("tok").cast("long").alias("tok"), "p.fold", "p.next_fold"), corpus, zipf, bars)


def _taken(said: DataFrame, corpus: Corpus, zipf: DataFrame, bars: Thresholds) -> DataFrame:
    known = corpus.pairs.groupBy("fold", "next_fold").agg(F.count_distinct("work", "unit").alias("units")).filter(F.col("units") <= bars.pair_units)
    z = zipf.select("fold", "zipf")
    known = known.join(z, "fold", "left").join(z.select(F.col("fold").alias("next_fold"), F.col("zipf").alias("next_zipf")), "next_fold", "left")
    known = known.fillna(0.0, ["zipf", "next_zipf"]).filter((F.least("zipf", "next_zipf") <= bars.pair_rare_zipf) & (F.greatest("zipf", "next_zipf") <= bars.pair_other_zipf))
    doc = W.partitionBy("doc_id").orderBy("tok")
    hits = said.join(corpus.small(known.select("fold", "next_fold", "units")), ["fold", "next_fold"])
    island = F.col("tok") - F.row_number().over(doc)
    hits = hits.withColumn("island", island)
    nth = F.row_number().over(W.partitionBy("doc_id", "island").orderBy("tok"))
    return hits.withColumn("nth", nth).filter("nth % 2 = 1").select("doc_id", "tok", "fold", "next_fold", "units")
