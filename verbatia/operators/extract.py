"""Spans that a writer marked, numeric citations, cues before a place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Quotation marks and brackets around at most 1500 characters; quotation marks but guillemets within one line.
#: Ornate brackets pair in either order; one typed twice counts once, and a pair spans no blank line.
MARKED = (
    r'"[^"\n]{1,1500}"|“[^“”\n]{1,1500}”|”[^“”\n]{1,1500}“|«[^«»]{1,1500}»|\{[^{}]{1,1500}\}|\(\([^()]{1,1500}\)\)'
    r"|﴾(?:\s*﴾)*(?:(?!\n\n)[^﴾﴿]){1,1500}﴿(?:\s*﴿)*|﴿(?:\s*﴿)*(?:(?!\n\n)[^﴾﴿]){1,1500}﴾(?:\s*﴾)*"
)
#: chapter:verse or chapter.verse, with an optional end of a range.
NUMERIC = r"[0-9]{1,3}[:.][0-9]{1,3}(?:-[0-9]{1,3})?"


def pattern_spans(df: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(key, n, s, e, found): matches of a pattern with code-point offsets."""
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(F.col(text), pattern), F.lit(1), F.size(found))
    pairs = F.posexplode(F.arrays_zip(gaps.alias("gap"), found.alias("found")))
    rows = df.filter(F.col(text).rlike(pattern)).select(key, pairs.alias("n", "x")).select(key, "n", "x.gap", "x.found")
    end = F.sum(F.length("gap") + F.length("found")).over(W.partitionBy(key).orderBy("n"))
    return rows.withColumn("e", end).select(key, "n", (F.col("e") - F.length("found")).alias("s"), "e", "found")


def marked_spans(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Marked spans of two words or more."""
    spans = pattern_spans(df, key, text, MARKED)
    return spans.filter(F.regexp_count("found", F.lit(r"[\p{L}\p{M}]+")) >= 2)


def numeric_references(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, s, e, found, chapter, verse, last, problem): written places and what is wrong with them."""
    refs = pattern_spans(df, key, text, NUMERIC)
    part = lambda i: F.regexp_extract("found", r"([0-9]+)[:.]([0-9]+)(?:-([0-9]+))?", i)
    refs = refs.select(key, "s", "e", "found", part(1).cast("int").alias("chapter"), part(2).cast("int").alias("verse"), F.when(part(3) == "", part(2)).otherwise(part(3)).cast("int").alias("last"))
    return refs.withColumn("problem", F.when(F.col("last") < F.col("verse"), "reversed").when((F.col("chapter") == 0) | (F.col("verse") == 0), "zero").otherwise("none"))


def before_cue(text: Column, start: Column, yes: str, no: str, window: int = 70) -> Column:
    """What the sentence so far says about a place: yes, no or none; a yes word wins."""
    at = F.greatest(F.lit(0), start - window)
    seen = F.lower(F.regexp_extract(F.substring(text, at + 1, start - at), r"[^.!?\n]*$", 0))
    return F.when(seen.rlike(yes), "yes").when(seen.rlike(no), "no").otherwise("none")
