"""Corrections of quotations that differ from the corpus: closest passages with their word alignment, rivals, and what may be offered.

The words of a quotation vote for diagonals; the best places, and places that a citation or a search names, are aligned word by
word in windows of the work, one row a window. Of the closest passages of a quotation, a few, one is judged against its rivals, the
citation, how alike it is and whether the quotation's bounds are the writer's own. Only words of the corpus are ever put in, and only
inside the quotation; where anything is open, nothing is offered and the reason is given.

Cases: quotations without words, or that are null, are reviewed as not found. Repeated quotation ids are an error of the caller's.
"""

from __future__ import annotations

from dataclasses import dataclass
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verbatia.operators.corpus import Corpus
from verbatia.operators.fuzzy import best_places, diagonal_votes
from verbatia.operators.verify import MIN_WORDS, covered_units, exact_occurrences, verify

OPS = "array<struct<tag:string,i1:int,i2:int,j1:int,j2:int>>"


@dataclass(frozen=True)
class Bars:
    """Likeness from which a passage counts, and from which a correction is offered with and without a fitting citation."""

    accept: float = 0.6
    prefer: float = 0.05
    with_ref: float = 0.75
    without: float = 0.8
    margin: float = 0.1
    near: float = 0.75
    passages: int = 3


def lay(quote: list[str], window: list[str], near: float = 0.75) -> tuple | None:
    """(start, end, similarity, equal words, near words, steps) of a quotation in a window of a work, or none without an equal word.

    The part reaches from the first to the last equal word, and as many words further as the quotation has beyond them.
    """
    blocks = [b for b in SequenceMatcher(None, quote, window, autojunk=False).get_matching_blocks() if b.size]
    if not blocks:
        return None
    ahead, behind = blocks[0].a, len(quote) - blocks[-1].a - blocks[-1].size
    start, end = max(0, blocks[0].b - ahead), min(len(window), blocks[-1].b + blocks[-1].size + behind)
    steps = SequenceMatcher(None, quote, window[start:end], autojunk=False).get_opcodes()
    equal = sum(i2 - i1 for tag, i1, i2, *_ in steps if tag == "equal")
    swapped = [pair for tag, i1, i2, j1, j2 in steps if tag == "replace" for pair in zip(quote[i1:i2], window[start + j1 : start + j2])]
    alike = sum(min(map(len, pair)) >= 3 and SequenceMatcher(None, *pair, autojunk=False).ratio() >= near for pair in swapped)
    return start, end, 2 * equal / (len(quote) + end - start), equal, alike, steps


def passages(quotes: DataFrame, corpus: Corpus, named: DataFrame | None = None, bars: Bars = Bars(), max_df: int = 1 << 30) -> DataFrame:
    """(quote_id, place, work, p0, p1, similarity, equal, near, steps): the closest passages of quotations (quote_id, folds), best first.

    ``named``: further places (quote_id, work, p0, p1) to align against. Likeness counts first, then near words among the replaced.
    """
    said = quotes.select(F.col("quote_id").alias("doc_id"), F.posexplode("folds").alias("tok", "fold"))
    n = F.size("folds")
    voted = best_places(diagonal_votes(said, corpus, max_df), 8).select(F.col("doc_id").alias("quote_id"), "work", (-F.col("diag")).alias("at"))
    windows = voted.join(quotes, "quote_id").select("quote_id", "work", "folds", F.greatest(F.lit(0), F.col("at") - 4).alias("w0"), (F.col("at") + n + 4).alias("w1"))
    if named is not None:
        windows = windows.unionByName(named.join(quotes, "quote_id").select("quote_id", "work", "folds", F.col("p0").alias("w0"), F.col("p1").alias("w1")))
    windows = windows.distinct()
    words = corpus.tokens.select("work", "pos", "fold")
    met = windows.alias("w").join(corpus.small(words).alias("c"), (F.col("w.work") == F.col("c.work")) & (F.col("pos") >= F.col("w0")) & (F.col("pos") < F.col("w1")))
    rows = met.groupBy("quote_id", "w.work", "w0", "w1", "folds").agg(F.array_sort(F.collect_list(F.struct("pos", "fold"))).alias("stream"))

    def align(folds: pd.Series, stream: pd.Series, w0: pd.Series) -> pd.DataFrame:
        out = []
        for quote, window, at in zip(folds, stream, w0):
            found = lay(list(quote), list(window), bars.near)
            if found is None:
                out.append((None, None, None, None, None, None))
            else:
                start, end, similarity, equal, alike, steps = found
                out.append((at + start, at + end, round(similarity, 9), equal, alike, [dict(zip(("tag", "i1", "i2", "j1", "j2"), s)) for s in steps]))
        return pd.DataFrame(out, columns=["p0", "p1", "similarity", "equal", "near", "steps"])

    aligned = rows.withColumn("a", F.pandas_udf(align, f"p0 long, p1 long, similarity double, equal long, near long, steps {OPS}")("folds", "stream.fold", "w0"))
    found = aligned.select("quote_id", "work", "a.*").filter("p0 is not null")
    once = F.row_number().over(W.partitionBy("quote_id", "work", "p0", "p1").orderBy(F.desc("similarity")))
    rank = F.row_number().over(W.partitionBy("quote_id").orderBy(F.desc("similarity"), F.desc("near"), "work", "p0", "p1"))
    best = found.withColumn("once", once).filter("once = 1").drop("once")
    return best.withColumn("place", rank.cast("long")).filter(F.col("place") <= bars.passages)


def _one_swapped(steps: Column) -> tuple[Column, Column]:
    """Whether one word stands in place of another and nothing else differs, and whether one word is missing besides."""
    equal = F.aggregate(F.filter(steps, lambda s: s["tag"] == "equal"), F.lit(0), lambda acc, s: acc + s["i2"] - s["i1"])
    others = F.filter(steps, lambda s: s["tag"] != "equal")
    swapped = F.size(F.filter(others, lambda s: (s["tag"] == "replace") & (s["i2"] - s["i1"] == 1) & (s["j2"] - s["j1"] == 1)))
    missing = F.size(F.filter(others, lambda s: (s["tag"] == "insert") & (s["j2"] - s["j1"] == 1)))
    return (equal >= 2) & (F.size(others) == 1) & (swapped == 1), (equal >= 3) & (F.size(others) == 2) & (swapped == 1) & (missing == 1)


def verdict(bars: Bars = Bars()) -> Column:
    """What may be offered for the chosen passage: ``proposed``, or why nothing is.

    Columns: n_words, similarity (null: no passage), rival (the likeness of the closest other passage), rival_named (of the closest one
    that the citation names), has_ref, has_unit, ref_fits, swapped, swapped_missing, bounded, edits, edge (a deletion at an edge).
    """
    c = F.col
    floor = c("similarity") - bars.margin - 1e-9
    close, close_named = F.coalesce(c("rival") >= floor, F.lit(False)), F.coalesce(c("rival_named") >= floor, F.lit(False))
    waived = c("bounded") & c("has_unit") & (c("swapped") | c("swapped_missing"))
    return (
        F.when(c("similarity").isNull(), "not_found")
        .when(c("n_words") < MIN_WORDS, "too_short")
        .when(close & c("has_unit") & close_named, "rival_in_reference")
        .when(close & ~c("has_unit"), "rival")
        .when(c("has_ref") & ~c("ref_fits"), "other_place")
        .when(c("has_ref") & (c("similarity") < bars.with_ref) & ~waived, "too_different")
        .when(~c("has_ref") & (c("similarity") < bars.without), "too_different")
        .when(c("edits") == 0, "no_edit")
        .when(~c("bounded") & c("edge"), "open_edge")
        .otherwise("proposed")
    )


def propose(quotes: DataFrame, corpus: Corpus, hints: DataFrame | None = None, bars: Bars = Bars(), max_df: int = 1 << 30) -> DataFrame:
    """(quote_id, n_words, occurrences, status, reason, work, p0, p1, similarity, edits): what may be corrected in each quotation.

    quotes: quote_id, words as written, folds, bounded, and a citation (ref_work, ref_unit0, ref_unit1; nulls if none). status is
    none_needed, proposed or review_only; edits (i1, i2, words) replace words i1 to i2 of the quotation by words of the corpus.
    """
    quotes = quotes.persist()  # quotations are found once, and read by each of the steps below
    asked = quotes.select("quote_id", F.col("folds").alias("words"), "ref_work", "ref_unit0", "ref_unit1")
    checked = verify(asked, covered_units(exact_occurrences(asked, corpus), corpus).select("quote_id", "work", "p0", "p1", "unit0", "unit1")).persist()
    known = checked.filter("occurrences > 0").select("quote_id", "n_words", "occurrences", F.when(F.col("status") == "matched", "none_needed").otherwise("review_only").alias("status"), F.when(F.col("status") == "matched", "equal").when(F.col("occurrences") > 1, "several_places").otherwise("too_short").alias("reason"), "work", "p0", "p1", F.lit(1.0).alias("similarity"))
    open_ = quotes.join(checked.filter("occurrences = 0").select("quote_id"), "quote_id", "left_semi").persist()
    units = corpus.small(corpus.bounds.select(F.col("work").alias("ref_work"), "unit", F.col("p0").alias("u0"), F.col("p1").alias("u1")))
    cited = open_.select("quote_id", "ref_work", "ref_unit0", "ref_unit1").join(units, "ref_work")
    cited = cited.filter(F.col("ref_unit0").isNull() | ((F.col("unit") >= F.col("ref_unit0")) & (F.col("unit") <= F.coalesce("ref_unit1", "ref_unit0"))))
    # A citation of a whole work overlaps all of it, but names no place to align against.
    cited = cited.groupBy("quote_id", "ref_work").agg(F.min("u0").alias("r0"), F.max("u1").alias("r1"), F.first(F.col("ref_unit0").isNotNull()).alias("unit_named"))
    named = cited.filter("unit_named").select("quote_id", F.col("ref_work").alias("work"), F.col("r0").alias("p0"), F.col("r1").alias("p1"))
    if hints is not None:
        named = named.unionByName(hints.select("quote_id", "work", "p0", "p1"))
    found = passages(open_.select("quote_id", "folds"), corpus, named, bars, max_df)
    good = found.filter((F.col("similarity") >= bars.accept - 1e-9) & (F.col("equal") >= 2)).join(cited, "quote_id", "left")
    good = good.withColumn("fits", F.coalesce((F.col("work") == F.col("ref_work")) & (F.col("p0") < F.col("r1")) & (F.col("r0") < F.col("p1")), F.lit(False)))
    few = good.groupBy("quote_id").agg(F.array_sort(F.collect_list(F.struct("place", "work", "p0", "p1", "similarity", "fits", "steps"))).alias("found"))
    top = F.col("found")[0]
    preferred = F.filter("found", lambda x: x["fits"] & (x["similarity"] >= top["similarity"] - bars.prefer - 1e-9))
    few = few.withColumn("best", F.coalesce(F.get(preferred, F.lit(0)), top))
    b = F.col("best")
    rivals = F.filter("found", lambda x: (x["place"] != b["place"]) & ~((x["work"] == b["work"]) & (x["p0"] < b["p1"]) & (b["p0"] < x["p1"])))
    few = few.select("quote_id", "best", F.array_max(F.transform(rivals, lambda x: x["similarity"])).alias("rival"), F.array_max(F.transform(F.filter(rivals, lambda x: x["fits"]), lambda x: x["similarity"])).alias("rival_named"))
    # The passage's words as the corpus writes them, for the edits.
    raw = corpus.tokens.select("work", "pos", "raw")
    spans = few.select("quote_id", "best.work", "best.p0", "best.p1")
    met = spans.alias("s").join(corpus.small(raw).alias("c"), (F.col("s.work") == F.col("c.work")) & (F.col("pos") >= F.col("p0")) & (F.col("pos") < F.col("p1")))
    source = met.groupBy("quote_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "raw"))), lambda x: x["raw"]).alias("source"))
    rows = open_.join(few, "quote_id", "left").join(source, "quote_id", "left")
    swapped, swapped_missing = _one_swapped(F.col("best.steps"))
    edits = F.transform(F.filter("best.steps", lambda s: s["tag"] != "equal"), lambda s: F.struct(s["i1"].alias("i1"), s["i2"].alias("i2"), F.slice("source", s["j1"] + 1, s["j2"] - s["j1"]).alias("words")))
    rows = rows.withColumn("edits", edits).withColumn("n_words", F.size("folds").cast("long"))
    named_by = F.col("ref_work").isNotNull()
    judged = rows.select(
        "quote_id", "n_words", "best", F.col("edits").alias("own"), F.col("best.similarity").alias("similarity"), "rival", "rival_named", named_by.alias("has_ref"), (named_by & F.col("ref_unit0").isNotNull()).alias("has_unit"), F.coalesce("best.fits", F.lit(False)).alias("ref_fits"),
        F.coalesce(swapped, F.lit(False)).alias("swapped"), F.coalesce(swapped_missing, F.lit(False)).alias("swapped_missing"), "bounded", F.size("edits").alias("edits"),
        F.coalesce(F.exists("edits", lambda e: (F.size(e["words"]) == 0) & ((e["i1"] == 0) | (e["i2"] == F.col("n_words")))), F.lit(False)).alias("edge"),
    )
    judged = judged.withColumn("reason", verdict(bars))
    offered = F.col("reason") == "proposed"
    none = F.expr("cast(array() as array<struct<i1:int,i2:int,words:array<string>>>)")
    fuzzy = judged.select("quote_id", "n_words", F.lit(0).cast("long").alias("occurrences"), F.when(offered, "proposed").otherwise("review_only").alias("status"), "reason", "best.work", "best.p0", "best.p1", F.round("similarity", 3).alias("similarity"), F.when(offered, F.col("own")).otherwise(none).alias("edits"))
    return known.withColumn("edits", none).unionByName(fuzzy)


def corrected(words: Column, edits: Column) -> Column:
    """The quotation's words after its edits."""
    start = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit(0).alias("at"))
    step = lambda acc, e: F.struct(F.concat(acc["done"], F.slice(words, acc["at"] + 1, e["i1"] - acc["at"]), e["words"]).alias("done"), e["i2"].alias("at"))
    return F.aggregate(edits, start, step, lambda acc: F.concat(acc["done"], F.slice(words, acc["at"] + 1, F.size(words))))
