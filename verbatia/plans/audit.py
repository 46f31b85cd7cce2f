"""The whole audit as one plan: texts and a corpus to findings with tier, boundaries, citation and verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verbatia.operators import extract, intervals, phrases
from verbatia.operators.corpus import Corpus
from verbatia.operators.verify import check_reference, covered_units


def audit(docs: DataFrame, corpus: Corpus, bars: phrases.Thresholds = phrases.Thresholds(), ahead: int = 40) -> DataFrame:
    """Findings (doc_id, s, e, quote, work, p0, p1, tier, coverage, occurrences, start_status, end_status, reference, reference_status).

    Phrases are found, graded, made disjoint by mass, placed in the text, compared with the first numeric citation
    within ``ahead`` characters, and counted over the works that hold them.
    """
    runs = phrases.text_runs(docs, corpus, bars).withColumn("tier", phrases.tier(bars)).filter("tier <> 'hidden'")
    at = F.first(F.struct(F.col("s").alias("at"), F.col("e").alias("to"), "before", "after")).alias("in_text")
    same = runs.groupBy("doc_id", "d0", "d1").agg(F.count("*").alias("occurrences"), F.min(F.struct("work", "b0", "b1")).alias("place"), F.max("mass").alias("mass"), F.min("tier").alias("tier"), at)
    kept = intervals.greedy_disjoint(same.withColumnsRenamed({"d0": "s", "d1": "e"}), "doc_id", [-F.col("mass"), F.col("s"), F.col("e")])
    kept = kept.select("doc_id", F.col("s").alias("d0"), F.col("e").alias("d1"), "occurrences", F.col("place.work").alias("work"), F.col("place.b0").alias("p0"), F.col("place.b1").alias("p1"), "mass", "tier", F.col("in_text.at").alias("s"), F.col("in_text.to").alias("e"), "in_text.before", "in_text.after")
    placed = covered_units(kept, corpus)
    mark = r"[.!?:;\n]"
    whole = F.col("coverage") == "full"
    placed = placed.withColumn("start_status", F.when(whole, "unit_start").when(F.col("d0") == 0, "text_start").when(F.col("before").rlike(mark), "punctuation").otherwise("uncertain"))
    placed = placed.withColumn("end_status", F.when(whole, "unit_end").when(F.col("after").isNull(), "text_end").when(F.col("after").rlike(mark), "punctuation").otherwise("uncertain"))
    refs = extract.numeric_references(docs)
    points = refs.select("doc_id", F.col("s").alias("at"), F.struct("found", "chapter", "verse", "last", "problem").alias("ref"))
    cited = intervals.asof_forward(placed.drop("before", "after"), points, "doc_id", ahead)
    status = check_reference(F.col("ref.chapter"), F.col("ref.verse"), F.col("ref.last"), F.col("ref.problem"), F.col("work"), F.col("unit0"), F.col("unit1"), F.lit(False))
    texts = docs.select("doc_id", "text")
    out = cited.join(texts, "doc_id").withColumn("quote", F.substring(F.col("text"), F.col("s") + 1, F.col("e") - F.col("s")))
    return out.select("doc_id", "s", "e", "quote", "work", "p0", "p1", "tier", "mass", "coverage", "occurrences", "start_status", "end_status", F.col("ref.found").alias("reference"), status.alias("reference_status"))
