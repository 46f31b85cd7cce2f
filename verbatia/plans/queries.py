"""Registered queries of the text-reuse engine over whole tables; SQL of the same name is in ``sql``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verbatia.functions.normalize import line_of
from verbatia.operators import corpus as corpora
from verbatia.operators import approximate, edits, evaluate, extract, fuzzy, intervals, phrases, suggest, verify
from verbatia.operators.tokens import segments, tokenize, tokenize_with_offsets
from verbatia.plans import audit
from verbatia.sources import files
from verbatia.streaming import state

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents")


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    return tokenize(_docs(spark, sf), ["doc_id"])


def _offsets(spark: SparkSession, sf: str) -> DataFrame:
    return tokenize_with_offsets(_docs(spark, sf), ["doc_id"])


def _corpus(spark: SparkSession, sf: str) -> corpora.Corpus:
    return corpora.build_corpus(_table(spark, sf, "benchmark"))


def _text_runs(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.text_runs(_docs(spark, sf), _corpus(spark, sf))


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return _text_runs(spark, sf).drop("s", "e", "before", "after")


def _tiered(spark: SparkSession, sf: str) -> DataFrame:
    return _runs(spark, sf).withColumn("tier", phrases.tier())


def _run_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Runs with the code-point offsets of their first and last word."""
    return _text_runs(spark, sf).drop("before", "after")


@query
def token_stats(spark, sf):
    t = _tokens(spark, sf).join(_docs(spark, sf).select("doc_id", "lang"), "doc_id")
    return t.groupBy("lang").agg(F.count("*").alias("n_tokens"), F.count_distinct("fold").alias("n_distinct"))


@query
def vocab_idf(spark, sf):
    return _corpus(spark, sf).vocab.select("fold", "df", F.round("idf", 6).alias("idf"))


@query
def unit_bounds(spark, sf):
    return _corpus(spark, sf).bounds


@query
def corpus_pairs(spark, sf):
    return _corpus(spark, sf).pairs.groupBy("fold", "next_fold").agg(F.count("*").alias("n"), F.count_distinct("work", "unit").alias("units"))


@query
def token_offsets(spark, sf):
    return _offsets(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("start").alias("sum_start"), F.sum("end").alias("sum_end"), F.max("end").alias("last_end"))


@query
def segments_of(spark, sf):
    s = segments(_offsets(spark, sf), ["doc_id"])
    return s.groupBy("doc_id").agg(F.count("*").alias("n_segments"), F.max(F.col("last") - F.col("first")).cast("long").alias("longest"))


@query
def exact_runs(spark, sf):
    return _runs(spark, sf)


@query
def phrase_tiers(spark, sf):
    return _tiered(spark, sf).select("doc_id", "work", "d0", "d1", "words", "mass", "tier")


@query
def greedy_spans(spark, sf):
    r = _runs(spark, sf).select("doc_id", "work", F.col("d0").alias("s"), F.col("d1").alias("e"), "mass")
    return intervals.greedy_disjoint(r, "doc_id", [-F.col("mass"), F.col("s"), F.col("e"), F.col("work")])


@query
def conversation_audit(spark, sf):
    turns = _table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    r = phrases.text_runs(turns, _corpus(spark, sf))
    return r.select("doc_id", "work", "d0", "d1", "words", "mass", phrases.tier().alias("tier"))


@query
def prose_zipf(spark, sf):
    return phrases.prose_zipf(_tokens(spark, sf))


@query
def pair_hits(spark, sf):
    return phrases.text_pair_hits(_docs(spark, sf), _corpus(spark, sf), phrases.prose_zipf(_tokens(spark, sf)))


@query
def overlap_join(spark, sf):
    off = _offsets(spark, sf)
    seg = F.sum(F.col("gap").contains("\n").cast("int")).over(W.partitionBy("doc_id").orderBy("tok"))
    para = off.withColumn("paragraph", seg).groupBy("doc_id", "paragraph").agg(F.min("tok").alias("s2"), (F.max("tok") + 1).alias("e2"))
    r = _runs(spark, sf).select("doc_id", "work", "d0", "d1")
    met = intervals.overlap_join(r, para, ["doc_id"], a_range=("d0", "d1"))
    return met.select("doc_id", "work", "d0", "d1", "paragraph", (F.least("d1", "e2") - F.greatest("d0", "s2")).alias("shared"))


@query
def hidden_phrases(spark, sf):
    t = _runs(spark, sf).withColumn("tier", phrases.tier(phrases.Thresholds(mass_floor=14.0)))
    shown = t.filter("tier <> 'hidden'").select("doc_id", F.col("d0").alias("s2"), F.col("d1").alias("e2"))
    alone = intervals.overlap_join(t.filter("tier = 'hidden'"), shown, ["doc_id"], "left_anti", a_range=("d0", "d1"))
    return alone.groupBy("doc_id").agg(F.count("*").alias("n_hidden"))


@query
def boundary_status(spark, sf):
    c = _corpus(spark, sf)
    r = _text_runs(spark, sf).join(c.small(c.bounds.select("work", F.col("p0").alias("b0"), F.lit(True).alias("at_start"))), ["work", "b0"], "left")
    r = r.join(c.small(c.bounds.select("work", F.col("p1").alias("b1"), F.lit(True).alias("at_end"))), ["work", "b1"], "left")
    mark = r"[.!?:;\n]"
    start = F.when(F.col("at_start"), "unit_start").when(F.col("d0") == 0, "text_start").when(F.col("before").rlike(mark), "punctuation").otherwise("uncertain")
    end = F.when(F.col("at_end"), "unit_end").when(F.col("after").isNull(), "text_end").when(F.col("after").rlike(mark), "punctuation").otherwise("uncertain")
    return r.select("doc_id", "work", "d0", "d1", start.alias("start_status"), end.alias("end_status"))


@query
def diagonal_votes(spark, sf):
    return fuzzy.best_places(fuzzy.diagonal_votes(_tokens(spark, sf), _corpus(spark, sf), 3))


@query
def marked_spans(spark, sf):
    return extract.marked_spans(_docs(spark, sf)).select("doc_id", "s", "e", "found")


@query
def numeric_references(spark, sf):
    return extract.numeric_references(_docs(spark, sf))


@query
def asof_reference(spark, sf):
    refs = extract.numeric_references(_docs(spark, sf))
    spans = _run_offsets(spark, sf).select("doc_id", "work", "s", "e")
    ahead = intervals.asof_forward(spans, refs.select("doc_id", F.col("s").alias("at"), F.col("found").alias("after")), "doc_id", 400, value="after")
    return intervals.asof_backward(ahead.drop("at"), refs.select("doc_id", F.col("e").alias("at"), F.col("found").alias("before")), "doc_id", 600, value="before").drop("at")


@query
def cue_windows(spark, sf):
    r = _run_offsets(spark, sf).join(_docs(spark, sf).select("doc_id", "text"), "doc_id")
    return r.select("doc_id", "work", "d0", "d1", extract.before_cue(F.col("text"), F.col("s"), r"(^|[^a-z])(that|which)([^a-z]|$)", r"(^|[^a-z])(for|with)([^a-z]|$)").alias("cue"))


@query
def merge_candidates(spark, sf):
    marked = extract.marked_spans(_docs(spark, sf)).select("doc_id", "s", "e", F.lit("marked").alias("source"), F.lit(0).alias("priority"))
    found = _run_offsets(spark, sf).select("doc_id", "s", "e", F.lit("phrase").alias("source"), F.lit(1).alias("priority")).distinct()
    return intervals.greedy_disjoint(marked.union(found), "doc_id", [F.col("priority"), F.col("s"), F.col("s") - F.col("e")]).drop("priority")


@query
def audit_stats(spark, sf):
    t = _docs(spark, sf).select("doc_id").join(_tiered(spark, sf), "doc_id", "left")
    count = lambda x: F.count_if(F.col("tier") == x).alias(f"n_{x}")
    return t.groupBy("doc_id").agg(
        F.count("work").alias("n_runs"), count("candidate"), count("possible"), count("hidden"), F.count_distinct("work").alias("n_works"), F.coalesce(F.sum("words"), F.lit(0)).alias("n_words"), F.coalesce(F.max("mass"), F.lit(0.0)).alias("best_mass")
    )


@query
def suggest_next(spark, sf):
    words = F.transform(F.slice(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{M}]+"), F.lit(0)), -2, 2), F.lower)
    tails = _docs(spark, sf).filter(F.regexp_count("text", F.lit(r"[\p{L}\p{M}]+")) >= 2).select("doc_id", words.alias("tail"))
    return suggest.suggest_next(tails, _corpus(spark, sf))


@query
def apply_changes(spark, sf):
    refs = extract.numeric_references(_docs(spark, sf))
    changes = refs.select("doc_id", "s", "e", F.concat(F.lit("["), "found", F.lit("]")).alias("replacement"))
    done = edits.apply_changes(_docs(spark, sf), changes)
    return done.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "n")


@query
def grade_grouping_sets(spark, sf):
    hit = _runs(spark, sf).select("doc_id").distinct().withColumn("hit", F.lit(1))
    f = _docs(spark, sf).select("doc_id", "lang").join(_table(spark, sf, "labels"), "doc_id").join(hit, "doc_id", "left").fillna(0, ["hit"])
    g = f.groupingSets([[], [F.col("lang")], [F.col("quality")]], "lang", "quality")
    return g.agg(F.count("*").alias("n"), F.sum("hit").alias("n_hit"), evaluate.rate(F.sum("hit"), F.count("*")).alias("rate"))


@query
def compare_runs(spark, sf):
    r = _runs(spark, sf)
    best = lambda x: x.groupBy("doc_id", "work").agg(F.max("mass").alias("m"))
    return evaluate.compare_runs(best(r.filter("mass >= 6")), best(r.filter("words >= 4")), ["doc_id", "work"], "m")


@query
def label_rates(spark, sf):
    n = _runs(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n"))
    f = _table(spark, sf, "labels").join(_docs(spark, sf).select("doc_id", F.length("text").alias("chars")), "doc_id").join(n, "doc_id", "left").fillna(0, ["n"])
    return f.groupBy("quality", "toxic").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_runs"), F.round(10000 * F.sum("n") / F.sum("chars"), 6).alias("per_10k"))


@query
def request_rate(spark, sf):
    return state.demand(_table(spark, sf, "events"), 86400).select("event_id", "user_id", "n_window")


@query
def rate_limiter(spark, sf):
    return state.rate_limit(_table(spark, sf, "events"), 3, 86400)


@query
def call_tracker(spark, sf):
    return state.track_calls(_table(spark, sf, "events"), "event_type <> 'error'").select("event_id", "user_id", "calls", "ok", "failed", "last_failure")


@query
def cooldown_skips(spark, sf):
    return state.cooldown(_table(spark, sf, "events"), "event_type <> 'error'", 43200)


@query
def latency_ranks(spark, sf):
    return evaluate.nearest_rank(_table(spark, sf, "events"), "event_type", "value")


@query
def cost_summary(spark, sf):
    e = _table(spark, sf, "events")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.median("value").alias("median"), F.max("value").alias("most"))


@query
def resume_calls(spark, sf):
    rank = W.partitionBy("user_id").orderBy(F.when(F.col("event_type") != "error", 0).otherwise(1), "ts", "event_id")
    return _table(spark, sf, "events").withColumn("r", F.row_number().over(rank)).filter("r = 1").select("user_id", "event_id", "event_type")


@query
def carry_decisions(spark, sf):
    e = _table(spark, sf, "events")
    old = e.filter("event_id % 2 = 0").select("user_id", "event_type", "event_id", F.col("value").alias("decision"))
    new = e.filter("event_id % 2 = 1").select("event_id", "user_id", "event_type")
    return edits.carry_decisions(old, new, ["user_id", "event_type"], ["event_id"])


@query
def harm_check(spark, sf):
    r = _runs(spark, sf)
    return r.exceptAll(r.filter("mass >= 6 and rarest <= 2"))


@query
def page_text(spark, sf):
    p = _table(spark, sf, "pages").select("page_id", files.page_text(F.col("html")).alias("t"))
    return p.select("page_id", F.md5(F.col("t").cast("binary")).alias("text_md5"), F.length("t").cast("long").alias("n_chars"))


@query
def privacy_scrub(spark, sf):
    from verbatia.functions.normalize import scrub

    return _docs(spark, sf).select("doc_id", F.md5(scrub(F.col("text"), 12).cast("binary")).alias("text_md5"))


@query
def line_counts(spark, sf):
    last = _offsets(spark, sf).groupBy("doc_id").agg(F.max("start").alias("start"))
    return last.join(_docs(spark, sf).select("doc_id", "text"), "doc_id").select("doc_id", line_of(F.col("text"), F.col("start")).cast("long").alias("last_line"))


@query
def checksums(spark, sf):
    return _docs(spark, sf).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


@query
def character_errors(spark, sf):
    b = _table(spark, sf, "benchmark").select("item_id", F.regexp_replace("text", "[^ -~]", "").alias("text"))
    n = b.select(F.col("item_id").alias("next_item"), F.col("text").alias("next_text"))
    j = b.join(n, F.col("next_item") == F.col("item_id") + 1)
    d = F.levenshtein("text", "next_text").cast("long")
    return j.select("item_id", "next_item", d.alias("distance"), F.length("text").cast("long").alias("n_chars"), F.round(d / F.length("text"), 6).alias("cer"))


@query
def label_violations(spark, sf):
    """How every run ends: at the end of the text or of the work, or where they differ; a run that could go on is a violation."""
    t = _tokens(spark, sf).select("doc_id", F.col("tok").alias("d1"), F.col("fold").alias("said"))
    c = _corpus(spark, sf).tokens.select("work", F.col("pos").alias("b1"), F.col("fold").alias("source"))
    r = _runs(spark, sf).join(t, ["doc_id", "d1"], "left").join(c, ["work", "b1"], "left")
    verdict = F.when(F.col("said").isNull(), "text_ends").when(F.col("source").isNull(), "work_ends").when(F.col("said") == F.col("source"), "not_maximal").otherwise("differs")
    return r.select("doc_id", "work", "d0", "said", "source", verdict.alias("verdict"))


@query
def tier_pivot(spark, sf):
    t = _tiered(spark, sf).join(_docs(spark, sf).select("doc_id", "lang"), "doc_id")
    return t.groupBy("lang").pivot("tier", ["candidate", "possible", "hidden"]).count().fillna(0)


@query
def closest_passages(spark, sf):
    """Benchmark sentences of eight words with one word replaced, against the whole corpus."""
    c = _corpus(spark, sf)
    words = c.tokens.groupBy("work").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("pos", "fold"))), 3, 8), lambda x: x["fold"]).alias("w"))
    quotes = words.select(F.col("work").alias("doc_id"), F.concat(F.slice("w", 1, 3), F.array(F.lit("zzz")), F.slice("w", 5, 4)).alias("words"))
    return fuzzy.closest_passages(quotes, c)


@query
def near_words(spark, sf):
    """Near spellings among all corpus words."""
    return fuzzy.near_words(fuzzy.near_candidates(_corpus(spark, sf).vocab))


def _damaged(text: str) -> Column:
    out = F.regexp_replace(text, r"\bthe\b ?", "")
    return F.regexp_replace(F.regexp_replace(out, r"\band\b", "ant"), r"\bof\b", "of of")


@query
def word_errors(spark, sf):
    """Edit counts of a damaged copy of every item: words left out, misread and doubled."""
    b = _table(spark, sf, "benchmark")
    return evaluate.word_errors(b.select("item_id", "text", _damaged("text").alias("read")), "text", "read").select("item_id", "words.*")


@query
def exact_occurrences(spark, sf):
    """The first three words of every work's every unit, over all works."""
    return verify.exact_occurrences(_unit_heads(spark, sf), _corpus(spark, sf))


def _unit_heads(spark: SparkSession, sf: str) -> DataFrame:
    c = _corpus(spark, sf)
    heads = c.tokens.join(c.bounds, ["work", "unit"]).filter("pos < p0 + 3").groupBy("work", "unit").agg(F.array_sort(F.collect_list(F.struct("pos", "fold"))).alias("w"))
    return heads.select((F.col("work") * 1000 + F.col("unit")).alias("quote_id"), F.transform("w", lambda x: x["fold"]).alias("words"), F.col("work").alias("ref_work"), F.col("unit").alias("ref_unit0"), F.col("unit").alias("ref_unit1"))


@query
def verify_quotes(spark, sf):
    """Unit openings verified with the citation of their unit."""
    c, q = _corpus(spark, sf), _unit_heads(spark, sf)
    places = verify.covered_units(verify.exact_occurrences(q, c), c).select("quote_id", "work", "p0", "p1", "unit0", "unit1")
    return verify.verify(q, places)


@query
def approximate_runs(spark, sf):
    return approximate.approximate_runs(_docs(spark, sf), _corpus(spark, sf))


@query
def audit_findings(spark, sf):
    return audit.audit(_docs(spark, sf), _corpus(spark, sf))


@query
def word_completion(spark, sf):
    """Words of the corpus that complete the last, unfinished word of a turn after the word before it."""
    words = F.transform(F.slice(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{M}]+"), F.lit(0)), -2, 2), F.lower)
    turns = _table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), words.alias("w")).filter("size(w) = 2")
    tails = turns.select("doc_id", F.col("w")[0].alias("fold"), F.col("w")[1].alias("part"))
    known = _corpus(spark, sf).pairs.groupBy("fold", "next_fold").agg(F.count("*").alias("places"))
    met = tails.join(known, "fold").filter(F.col("next_fold").startswith(F.col("part")) & (F.length("next_fold") > F.length("part")))
    return met.select("doc_id", "part", F.col("next_fold").alias("word"), "places")


@query
def pooled_error_rates(spark, sf):
    """Word error counts of a damaged copy of every item, pooled over all and by length class; a missing page misses all words."""
    b = _table(spark, sf, "benchmark").withColumn("kind", F.when(F.length("text") < 220, "short").otherwise("long"))
    read = b.filter("item_id % 10 <> 9").select("item_id", _damaged("text").alias("read"))
    e = evaluate.word_errors(b.join(read, "item_id", "left"), "text", "read")
    c = e.select("kind", F.col("words.equal").alias("ok"), (F.col("words.substituted") + F.col("words.deleted") + F.col("words.inserted")).alias("wrong"), (F.col("words.equal") + F.col("words.substituted") + F.col("words.deleted")).alias("n"))
    return c.groupingSets([[], [F.col("kind")]], "kind").agg(F.sum("n").alias("n_words"), F.sum("wrong").alias("n_wrong"), evaluate.rate(F.sum("wrong"), F.sum("n")).alias("wer"))


@query
def event_windows(spark, sf):
    e = _table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = e.groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return w.select("event_type", F.unix_timestamp("w.start").alias("start"), "n")


# Registered under the name of its SQL.
QUERIES["segments"] = QUERIES.pop("segments_of")
