"""Quotations against the corpus: where they occur, how they are verified, whether their citation fits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verbatia.operators.corpus import Corpus

MIN_WORDS = 3


def exact_occurrences(quotes: DataFrame, corpus: Corpus, key: str = "quote_id") -> DataFrame:
    """(key, work, p0, p1): every place where the folded words of a quotation (array ``words``) stand in a row.

    The first word finds the places, and the words from there are compared as one array; the corpus's
    runs of words are made for the lengths that occur.
    """
    line = W.partitionBy("work").orderBy("pos")
    n = F.size("words")
    longest = quotes.agg(F.max(n)).first()[0] or 1
    ahead = F.collect_list("fold").over(line.rowsBetween(0, longest - 1))
    streams = corpus.tokens.select("work", F.col("pos").alias("p0"), F.col("fold").alias("first"), ahead.alias("ahead"))
    asked = quotes.filter(n > 0).select(key, "words", F.get("words", F.lit(0)).alias("first"))
    met = asked.join(corpus.small(streams), "first").filter(F.slice("ahead", F.lit(1), n) == F.col("words"))
    return met.select(key, "work", "p0", (F.col("p0") + n).alias("p1"))


def covered_units(spans: DataFrame, corpus: Corpus) -> DataFrame:
    """Spans (work, p0, p1) with their first and last unit and what they cover: full, partial or multi-partial."""
    units = corpus.bounds.select("work", "unit", F.col("p0").alias("u0"), F.col("p1").alias("u1"))
    met = spans.alias("s").join(corpus.small(units).alias("u"), (F.col("s.work") == F.col("u.work")) & (F.col("u0") < F.col("s.p1")) & (F.col("s.p0") < F.col("u1")))
    cols = [f"s.{c}" for c in spans.columns]
    out = met.groupBy(*cols).agg(F.min("unit").alias("unit0"), F.max("unit").alias("unit1"), F.min("u0").alias("u0"), F.max("u1").alias("u1"))
    whole = (F.col("u0") == F.col("p0")) & (F.col("u1") == F.col("p1"))
    return out.withColumn("coverage", F.when(whole, "full").when(F.col("unit0") == F.col("unit1"), "partial").otherwise("multi-partial")).drop("u0", "u1")


def verify(quotes: DataFrame, places: DataFrame, key: str = "quote_id") -> DataFrame:
    """(key, n_words, occurrences, confirmed, status, work, p0, p1).

    quotes: words and a citation (ref_work, ref_unit0, ref_unit1, null if none); places: ``covered_units`` of the exact
    occurrences. A single place of a long enough quotation stands, and so does a place that the citation names;
    a short quotation without a fitting citation and a quotation with several places are uncertain; one
    without a place differs from the corpus.
    """
    fits = (F.col("work") == F.col("ref_work")) & (F.col("ref_unit0").isNull() | ((F.col("ref_unit0") <= F.col("unit1")) & (F.col("unit0") <= F.col("ref_unit1"))))
    met = quotes.join(places, key, "left").withColumn("fits", F.coalesce(fits, F.lit(False)))
    place = F.struct("work", "p0", "p1")
    out = met.groupBy(key).agg(
        F.first(F.size("words")).cast("long").alias("n_words"), F.count("work").alias("occurrences"), F.count_if("fits").alias("confirmed"), F.first(F.col("ref_unit0").isNotNull()).alias("exact_ref"), F.min(F.when(F.col("fits"), place)).alias("named"), F.min(F.when(F.col("work").isNotNull(), place)).alias("any")
    )
    by_name = (F.col("confirmed") == 1) | ((F.col("confirmed") > 1) & F.col("exact_ref"))
    single = F.col("occurrences") == 1
    chosen = F.when(single, F.col("any")).when(by_name, F.col("named"))
    status = F.when(F.col("occurrences") == 0, "difference").when(by_name | (single & (F.col("n_words") >= MIN_WORDS)), "matched").otherwise("uncertain")
    return out.select(key, "n_words", "occurrences", "confirmed", status.alias("status"), chosen["work"].alias("work"), chosen["p0"].alias("p0"), chosen["p1"].alias("p1"))


def check_reference(ref_work: Column, ref0: Column, ref1: Column, problem: Column, work: Column, unit0: Column, unit1: Column, fuzzy: Column) -> Column:
    """matched, missing, incorrect or uncertain: a citation against the place that was found."""
    overlaps = (ref_work == work) & (ref0.isNull() | ((ref0 <= unit1) & (unit0 <= ref1)))
    covers = overlaps & (ref0.isNull() | ((ref0 <= unit0) & (unit1 <= ref1)))
    return F.when(ref_work.isNull(), "missing").when(problem != "none", "incorrect").when(work.isNull() | fuzzy, "uncertain").when(covers, "matched").when(overlaps, "uncertain").otherwise("incorrect")


def may_correct(similarity: Column, rival: Column, has_ref: Column, ref_fits: Column, with_ref: float = 0.75, without: float = 0.8, margin: float = 0.1) -> Column:
    """Whether a correction may be offered for the closest passage, and if not, why."""
    close = rival.isNotNull() & (rival >= similarity - margin)
    return (
        F.when(close & ~(has_ref & ref_fits), "rival")
        .when(has_ref & ~ref_fits, "other_place")
        .when(similarity < F.when(has_ref, with_ref).otherwise(without), "too_different")
        .otherwise("proposed")
    )
