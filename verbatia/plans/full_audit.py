"""The audit over all kinds of candidates: marked spans, exact runs and runs with edits, announced spans and word pairs.

Each kind is found by its operator, in words of the text. Runs and announced spans are reconciled, all kinds are merged into disjoint candidates
(marked before run and announced before pair), citations of all written forms are attached to them, and each is compared with the
corpus: equal, with a proposed correction, or for review. Words and offsets are found in the row of each text, and only those of candidates leave it.

Cases: a null or empty text has no candidates. Repeated document keys are not allowed. Extra columns are left out. An empty corpus leaves
marked spans, all for review.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verbatia.operators import approximate, citation_grammar, citations, cues, extract, intervals, phrases, proposals, reconcile
from verbatia.operators.corpus import Corpus
from verbatia.operators.tokens import tokenize, tokenize_with_offsets, with_ends, word_arrays
from verbatia.operators.verify import check_reference, covered_units
from verbatia.sources.tables import written

NO_HINTS = "cast(array() as array<struct<work:bigint,p0:bigint,p1:bigint>>)"


def words_before(points: DataFrame, off: DataFrame) -> DataFrame:
    """points(doc_id, at) with ``words``: how many words of the text start before that character; one pass over both in order."""
    rows = points.select("doc_id", "at").distinct().select("doc_id", "at", F.lit(0).alias("word")).union(off.select("doc_id", "start", F.lit(1)))
    before = W.partitionBy("doc_id").orderBy("at", "word").rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("words", F.coalesce(F.sum("word").over(before), F.lit(0))).filter("word = 0").drop("word")


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, d0, d1): the words of marked spans; only texts that have any are cut into words."""
    spans = written(extract.marked_spans(docs).select("doc_id", "s", "e"))
    off = tokenize_with_offsets(docs.join(spans.select("doc_id"), "doc_id", "left_semi"), ["doc_id"])
    n = written(words_before(spans.select("doc_id", F.col("s").alias("at")).union(spans.select("doc_id", "e")), off))
    out = spans.join(n.select("doc_id", F.col("at").alias("s"), F.col("words").alias("d0")), ["doc_id", "s"]).join(n.select("doc_id", F.col("at").alias("e"), F.col("words").alias("d1")), ["doc_id", "e"])
    return out.select("doc_id", "d0", "d1").filter("d0 < d1").distinct()


def quoted(candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """Candidates with quote_id, their offsets s and e, their text ``quote`` and their ``words`` and ``folds``, all cut from the row of their text."""
    own = [c for c in candidates.columns if c != "doc_id"]
    asked = candidates.groupBy("doc_id").agg(F.collect_list(F.struct(*own)).alias("asked"))
    texts = with_ends(word_arrays(docs.join(asked, "doc_id"), ["doc_id", "text", "asked"])).withColumn("folds", F.transform("raws", F.lower))
    each = texts.select("doc_id", "text", "raws", "ends", "folds", F.explode("asked").alias("c")).select("doc_id", "text", "raws", "ends", "folds", "c.*")
    d0, n = F.col("d0").cast("int"), (F.col("d1") - F.col("d0")).cast("int")
    s, e = F.get("ends", d0) - F.length(F.get("raws", d0)), F.get("ends", d0 + n - 1)
    quote_id = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("d0").cast("string"), F.col("d1").cast("string"))
    quote = F.substring(F.col("text"), (s + 1).cast("int"), (e - s).cast("int"))
    return each.select("doc_id", *own, quote_id.alias("quote_id"), s.alias("s"), e.alias("e"), quote.alias("quote"), F.slice("raws", d0 + 1, n).alias("words"), F.slice("folds", d0 + 1, n).alias("folds"))


def found_runs(docs: DataFrame, corpus: Corpus, bars: phrases.Thresholds) -> DataFrame:
    """(doc_id, d0, d1, work, b0, b1): disjoint runs, exact and with edits, the rarest first; all places of each."""
    cols = ["doc_id", "d0", "d1", "work", "b0", "b1", "mass"]
    exact = phrases.text_runs(docs, corpus, bars).withColumn("tier", phrases.tier(bars)).filter("tier <> 'hidden'").select(*cols, F.lit(0).alias("edits"))
    edited = approximate.approximate_runs(docs, corpus, bars).select(*cols, F.col("edits").cast("int").alias("edits"))
    every = written(exact.union(edited))
    spans = every.groupBy("doc_id", F.col("d0").alias("s"), F.col("d1").alias("e")).agg(F.max("mass").alias("mass"), F.min("edits").alias("edits"))
    kept = intervals.greedy_disjoint(spans, "doc_id", [-F.col("mass"), F.col("edits"), F.col("s"), F.col("e")])
    return every.join(kept.select("doc_id", F.col("s").alias("d0"), F.col("e").alias("d1")), ["doc_id", "d0", "d1"]).select(*cols[:-1]).distinct()


def announced(docs: DataFrame, tokens: DataFrame, corpus: Corpus, words: dict[str, str], least: int = 3, max_df: int = 3) -> DataFrame:
    """(doc_id, d0, d1, w0, w1, work, b0, b1): what announced windows share with a work, from the first rare word to the last."""
    rare = corpus.tokens.join(corpus.vocab.filter(F.col("df") <= max_df), "fold").select("fold", "work", "pos", "idf")
    shared = written(tokens.join(corpus.small(rare), "fold").select("doc_id", "tok", "work", (F.col("tok") - F.col("pos")).alias("diag"), "idf"))
    hits = cues.cue_hits(cues.text_windows(docs, words).drop("s", "e"), shared).filter(F.col("matched") >= least)
    met = hits.join(shared.drop("idf"), ["doc_id", "work", "diag"]).filter("tok >= w0 and tok < w1")
    said = met.groupBy("doc_id", "w0", "w1", "work", "diag").agg(F.min("tok").alias("d0"), (F.max("tok") + 1).alias("d1"))
    return said.select("doc_id", "d0", "d1", "w0", "w1", "work", (F.col("d0") - F.col("diag")).alias("b0"), (F.col("d1") - F.col("diag")).alias("b1"))


def cited(docs: DataFrame, names: DataFrame | None) -> DataFrame:
    """(doc_id, s, e, found, ref_work, ref_unit0, ref_unit1, problem): citations by name where names(work, name, n_units) is given, and by number."""
    numbers = extract.numeric_references(docs).select("doc_id", "s", "e", "found", F.col("chapter").cast("long").alias("ref_work"), F.col("verse").cast("long").alias("ref_unit0"), F.col("last").cast("long").alias("ref_unit1"), "problem")
    if names is None:
        return numbers
    named = citation_grammar.citations(docs, names).filter("work is not null")
    named = written(named.select("doc_id", "s", "e", "found", F.col("work").cast("long").alias("ref_work"), F.col("unit0").cast("long").alias("ref_unit0"), F.col("unit1").cast("long").alias("ref_unit1"), "problem"))
    alone = intervals.overlap_join(numbers, named.select("doc_id", F.col("s").alias("s2"), F.col("e").alias("e2")), ["doc_id"], "left_anti")
    return named.unionByName(alone)


def audit_all(docs: DataFrame, corpus: Corpus, announce: dict[str, str], zipf: DataFrame | None = None, names: DataFrame | None = None, bars: phrases.Thresholds = phrases.Thresholds(), proposal: proposals.Bars = proposals.Bars()) -> DataFrame:
    """(doc_id, finding, s, e, quote, sources, announced, n_words, occurrences, status, reason, work, p0, p1, similarity, coverage, edits, reference, reference_status).

    ``announce`` maps words to the kind of quotation that they announce, ``zipf`` (``prose_zipf``) opens the search for word pairs, ``names`` citations by name.
    """
    docs = docs.select("doc_id", "text")
    corpus = Corpus(written(corpus.tokens), written(corpus.vocab), written(corpus.bounds), corpus.units)
    runs = written(found_runs(docs, corpus, bars))
    near = reconcile.reconcile(runs, announced(docs, tokenize(docs, ["doc_id"]), corpus, announce)).withColumn("rank", F.lit(1))
    own = marked(docs).select("doc_id", F.lit(0).alias("rank"), "d0", "d1", F.lit("marked").alias("source"), F.lit(False).alias("announced"), F.expr(NO_HINTS).alias("hints"))
    every = near.unionByName(own)
    if zipf is not None:
        zipf = written(zipf.join(corpus.small(corpus.vocab.select("fold")), "fold", "left_semi"))
        pairs = phrases.text_pair_hits(docs, corpus, zipf, bars).select("doc_id", F.lit(2).alias("rank"), F.col("tok").alias("d0"), (F.col("tok") + 2).alias("d1"), F.lit("pair").alias("source"), F.lit(False).alias("announced"), F.expr(NO_HINTS).alias("hints"))
        every = every.unionByName(pairs.distinct())
    merged = written(quoted(written(reconcile.merge(every).select("doc_id", "d0", "d1", "sources", "announced", "hints")), docs))
    refs = written(cited(docs, names))
    held = citations.attach_references(merged.select("doc_id", "s", "e", "quote_id"), refs.select("doc_id", "s", "e", "found"))
    held = held.filter("ref_s is not null").select("doc_id", "quote_id", "ref_s", "ref_e").join(refs.withColumnsRenamed({"s": "ref_s", "e": "ref_e"}), ["doc_id", "ref_s", "ref_e"])
    held = written(held.select("quote_id", "found", "ref_work", "ref_unit0", "ref_unit1", "problem"))
    sound = held.filter("problem = 'none'").select("quote_id", "ref_work", "ref_unit0", "ref_unit1")
    quotes = written(merged.select("quote_id", "words", "folds", F.array_contains("sources", "marked").alias("bounded")).join(sound, "quote_id", "left"))
    hints = merged.select("quote_id", F.inline("hints"))
    ruled = written(proposals.propose(quotes, corpus, hints, proposal))
    placed = covered_units(ruled.filter("work is not null").select("quote_id", "work", "p0", "p1"), corpus).select("quote_id", "unit0", "unit1", "coverage")
    status = check_reference(F.col("ref_work"), F.col("ref_unit0"), F.col("ref_unit1"), F.col("problem"), F.col("work"), F.col("unit0"), F.col("unit1"), F.col("similarity") < 1.0)
    out = merged.join(ruled, "quote_id").join(placed, "quote_id", "left").join(held, "quote_id", "left")
    finding = F.row_number().over(W.partitionBy("doc_id").orderBy("s"))
    return out.select("doc_id", finding.alias("finding"), "s", "e", "quote", "sources", "announced", "n_words", "occurrences", "status", "reason", "work", "p0", "p1", "similarity", "coverage", "edits", F.col("found").alias("reference"), status.alias("reference_status"))
