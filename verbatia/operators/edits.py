"""Source-backed edits: conflict removal, application, provenance, carrying decisions over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verbatia.operators.intervals import greedy_disjoint


def without_conflicts(changes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Changes in order of place; one that overlaps an earlier one that stays is dropped."""
    return greedy_disjoint(changes, key, [F.col("s"), F.col("e")])


def apply_changes(texts: DataFrame, changes: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, n): texts with their disjoint changes (s, e, replacement) applied, pieces in order.

    A text's changes are gathered into one array, and the text is met and cut once; texts without a change pass.
    """
    own = changes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("s", "e", "replacement"))).alias("own"))
    rows = texts.select(key, text).join(own, key, "left")
    last = lambda i: F.coalesce(F.get("own", i - 1)["e"], F.lit(0))
    pieces = F.transform("own", lambda x, i: F.concat(F.substring(F.col(text), last(i) + 1, x["s"] - last(i)), x["replacement"]))
    tail = F.substring(F.col(text), last(F.size("own")) + 1, F.length(text))
    done = F.when(F.col("own").isNull(), F.col(text)).otherwise(F.concat(F.array_join(pieces, ""), tail))
    return rows.select(key, done.alias(text), F.coalesce(F.when(F.col("own").isNotNull(), F.size("own")), F.lit(0)).cast("long").alias("n"))


def carry_decisions(old: DataFrame, new: DataFrame, on: list[str], order: list[str], decision: str = "decision") -> DataFrame:
    """New rows with the decision of the equal old row, first with first; each old row is used once."""
    nth = F.row_number().over(W.partitionBy(*on).orderBy(*order))
    a, b = new.withColumn("_nth", nth), old.select(*on, decision, *[c for c in order if c not in on]).withColumn("_nth", nth)
    return a.join(b.select(*on, "_nth", decision), [*on, "_nth"], "left").drop("_nth")


def unbacked(changes: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """Changes with a word that is not among the source words of their finding; must be empty."""
    return changes.join(words, key).filter(F.size(F.array_except("replacement_words", "source_words")) > 0)
