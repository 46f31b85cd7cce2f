"""Registered queries on findings: detection, citations, corrections, evaluation and state; SQL of the same name is in ``findings_sql``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from verbatia.operators import citations, cues, edits, extract, findings, intervals
from verbatia.operators.tokens import tokenize, tokenize_with_offsets, word_arrays
from verbatia.plans import queries as q
from verbatia.streaming import state

QUERIES = {}

#: The reach of citations about spans in the test tables, whose citations are sparse.
AFTER, BEFORE = 400, 600


def query(f):
    QUERIES[f.__name__] = f
    return f


def _spans(spark, sf) -> DataFrame:
    return q._run_offsets(spark, sf).select("doc_id", "s", "e").distinct()


def _places(spark, sf) -> DataFrame:
    """Runs with the units that they touch."""
    c = q._corpus(spark, sf)
    u = c.small(c.bounds.select("work", "unit", F.col("p0").alias("u0"), F.col("p1").alias("u1")))
    r = q._runs(spark, sf)
    met = r.join(u, "work").filter((F.col("u0") < F.col("b1")) & (F.col("b0") < F.col("u1")))
    return met.groupBy("doc_id", "d0", "d1", "work", "b0", "b1", "mass").agg(F.min("unit").alias("unit0"), F.max("unit").alias("unit1"))


@query
def line_columns(spark, sf):
    last = q._offsets(spark, sf).groupBy("doc_id").agg(F.max("start").alias("start"))
    return last.join(q._docs(spark, sf).select("doc_id", "text"), "doc_id").select("doc_id", findings.line_column(F.col("text"), F.col("start")).alias("p")).select("doc_id", "p.line", "p.column")


@query
def fold_index_map(spark, sf):
    m = q._docs(spark, sf).select("doc_id", findings.fold_map(F.col("text")).alias("m"))
    total = F.aggregate("m", F.lit(0).cast("long"), lambda acc, p: acc + p["at"])
    return m.select("doc_id", F.size("m").cast("long").alias("n"), total.alias("sum_at"), F.md5(F.array_join(F.transform("m", lambda p: p["x"]), "").cast("binary")).alias("folded_md5"))


@query
def diacritic_profiles(spark, sf):
    words = q._tokens(spark, sf).select("fold").distinct()
    p = words.select("fold", findings.letter_marks(F.col("fold")).alias("p"))
    return p.select("fold", F.size("p").cast("long").alias("letters"), F.size(F.filter("p", lambda x: ~x.endswith(":"))).cast("long").alias("marked"), F.md5(F.array_join("p", " ").cast("binary")).alias("profile_md5"))


@query
def marked_pairs(spark, sf):
    """Words of the documents with the same letters and other marks."""
    return findings.marked_pairs(q._tokens(spark, sf))


@query
def finding_labels(spark, sf):
    p = _places(spark, sf)
    g = p.groupBy("doc_id", "d0", "d1").agg(F.count("*").alias("n"), F.min(F.struct("work", "b0", "unit0", "unit1")).alias("x"))
    return g.select("doc_id", "d0", "d1", findings.place_label(F.col("x.work"), F.col("x.unit0"), F.col("x.unit1")).alias("label"), findings.counted(F.col("n"), "place", "places").alias("places"))


@query
def detections(spark, sf):
    """Phrases with a tier that a cue or a marked span corroborates."""
    r = q._run_offsets(spark, sf).join(q._docs(spark, sf).select("doc_id", "text"), "doc_id")
    r = r.withColumn("cue", extract.before_cue(F.col("text"), F.col("s"), r"(^|[^a-z])(that|which)([^a-z]|$)", r"(^|[^a-z])(for|with)([^a-z]|$)")).drop("text")
    met = intervals.with_overlaps(r, extract.marked_spans(q._docs(spark, sf)), "doc_id", "marked").withColumn("tier", q.phrases.tier())
    stated = F.when(F.col("marked") | (F.col("cue") == "yes"), "stated").when(F.col("cue") == "no", "possible").otherwise(F.col("tier"))
    return met.filter("tier <> 'hidden'").select("doc_id", "work", "d0", "d1", stated.alias("detection"), "marked", "cue")


@query
def marked_accepted(spark, sf):
    """Marked spans that a cue ahead or a citation behind makes quotations."""
    docs = q._docs(spark, sf)
    m = extract.marked_spans(docs).join(docs.select("doc_id", "text"), "doc_id")
    cue = F.lower(F.substring(F.col("text"), F.greatest(F.lit(0), F.col("s") - 40) + 1, F.least(F.col("s"), F.lit(40)))).rlike(r"(^|[^a-z])(that|which|of|the)([^a-z]|$)")
    refs = extract.numeric_references(docs).select("doc_id", F.col("s").alias("r"))
    near = m.select("doc_id", "s", "e").join(refs, "doc_id").filter((F.col("r") >= F.col("e")) & (F.col("r") <= F.col("e") + 25)).select("doc_id", "s").distinct().withColumn("cited", F.lit(True))
    out = m.select("doc_id", "s", "e", cue.alias("cued")).join(near, ["doc_id", "s"], "left").fillna(False, ["cited"])
    return out.withColumn("accepted", F.col("cued") | F.col("cited"))


@query
def finding_queue(spark, sf):
    """Findings numbered in order of the text, and the order in which they wait for a decision."""
    t = q._tiered(spark, sf).filter("tier <> 'hidden'").groupBy("doc_id", "d0", "d1").agg(F.count("*").alias("places"), F.min("tier").alias("tier"))
    kind = F.when(F.col("places") > 1, 0).when(F.col("tier") == "possible", 1).otherwise(2)
    doc = W.partitionBy("doc_id")
    return t.select("doc_id", "d0", "d1", kind.cast("long").alias("kind"), F.row_number().over(doc.orderBy("d0", "d1")).cast("long").alias("id"), F.row_number().over(doc.orderBy(kind, "d0", "d1")).cast("long").alias("turn"))


@query
def neighbour_limits(spark, sf):
    line = W.partitionBy("doc_id").orderBy("s", "e")
    return _spans(spark, sf).select("doc_id", "s", "e", F.lag("e").over(line).alias("floor"), F.lead("s").over(line).alias("limit"))


@query
def finding_choices(spark, sf):
    """Places offered for a finding: one of each unit, the first, four at most beside the count of all."""
    p = _places(spark, sf)
    once = p.withColumn("r", F.row_number().over(W.partitionBy("doc_id", "d0", "d1", "work", "unit0").orderBy("b0"))).filter("r = 1")
    w = W.partitionBy("doc_id", "d0", "d1")
    out = once.select("doc_id", "d0", "d1", "work", "unit0", "b0", F.count("*").over(w).alias("choices"), F.row_number().over(w.orderBy("work", "unit0", "b0")).cast("long").alias("nth"))
    return out.filter("nth <= 4")


def _all_references(spark, sf) -> DataFrame:
    docs = q._docs(spark, sf)
    pairs = extract.pattern_spans(docs, "doc_id", "text", extract.NUMERIC).select("doc_id", "s", "e", "found", F.lit("place").alias("kind"))
    return pairs.union(extract.pattern_spans(docs, "doc_id", "text", "[0-9]{1,5}").select("doc_id", "s", "e", "found", F.lit("number").alias("kind")))


@query
def resolved_references(spark, sf):
    """Citations of several forms: of those that overlap the longest stays, then the first."""
    return intervals.greedy_disjoint(_all_references(spark, sf), "doc_id", [F.col("s") - F.col("e"), F.col("s"), F.col("kind")])


@query
def first_references(spark, sf):
    r = resolved_references(spark, sf)
    return r.groupBy("doc_id").agg(F.min_by(F.struct("found", "kind"), "s").alias("x")).select("doc_id", "x.found", "x.kind")


@query
def reference_problems(spark, sf):
    """Citations checked against the works that exist: all that is wrong with each."""
    c = q._corpus(spark, sf)
    units = c.bounds.groupBy("work").agg(F.count("*").alias("units"))
    r = extract.numeric_references(q._docs(spark, sf)).withColumn("work", F.col("chapter").cast("long"))
    met = r.join(units.withColumn("work", F.col("work").cast("long")), "work", "left")
    out = F.array_compact(F.array(F.when(F.col("units").isNull(), "no_work"), F.when((F.col("verse") < 1) | (F.col("last") > F.col("units")), "no_unit"), F.when(F.col("last") < F.col("verse"), "reversed")))
    return met.select("doc_id", "s", "found", F.array_join(out, ",").alias("problems"))


@query
def located_quotes(spark, sf):
    """Where the first five words of every work stand in documents."""
    return _opened(spark, sf).drop("words")


def _opened(spark, sf) -> DataFrame:
    c = q._corpus(spark, sf)
    return findings.text_locate(q._docs(spark, sf), c.small(_openings(c)), 5)


def _openings(c) -> DataFrame:
    t = c.tokens.filter("pos < 5").groupBy("work").agg(F.array_sort(F.collect_list(F.struct("pos", "fold"))).alias("w"))
    return t.select(F.col("work").alias("quote_id"), F.transform("w", lambda x: x["fold"]).alias("words"))


@query
def open_quotes(spark, sf):
    return q._docs(spark, sf).select("doc_id", findings.open_mark(F.col("text"), {"(": ")", "{": "}", "«": "»", "“": "”"}).alias("open"))


@query
def attached_references(spark, sf):
    refs = extract.numeric_references(q._docs(spark, sf))
    return citations.attach_references(_spans(spark, sf), refs, after=AFTER, before=BEFORE)


@query
def conflict_free_changes(spark, sf):
    """Of changes that overlap, the first in the text stays."""
    r = _all_references(spark, sf).select("doc_id", "s", "e", F.col("found").alias("replacement"))
    return edits.without_conflicts(r)


def _damaged(spark, sf) -> DataFrame:
    """A copy of every item with a word misspelt."""
    return q._table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.replace("text", F.lit(" of "), F.lit(" fo ")).alias("text"))


@query
def wording_changes(spark, sf):
    """Corrections of the damaged copies."""
    c, t = q._corpus(spark, sf), tokenize(_damaged(spark, sf), ["doc_id"])
    return findings.wording_changes(q.phrases.exact_runs(t, c), t, c.tokens)


@query
def corrected_texts(spark, sf):
    """The damaged copies with a change of each differing word, by the first place, and whether that gives the item back."""
    texts, items = _damaged(spark, sf), q._table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("item"))
    c = wording_changes(spark, sf).groupBy("doc_id", "tok").agg(F.min_by("replacement", F.struct("work", "pos")).alias("replacement"))
    off = tokenize_with_offsets(texts, ["doc_id"]).select("doc_id", "tok", F.col("start").alias("s"), F.col("end").alias("e"))
    done = edits.apply_changes(texts, c.join(off, ["doc_id", "tok"]).select("doc_id", "s", "e", "replacement"))
    return done.join(items, "doc_id").select("doc_id", "n", F.md5(F.col("text").cast("binary")).alias("text_md5"), (F.col("text") == F.col("item")).alias("restored"))


@query
def unbacked_changes(spark, sf):
    """How many changes there are, and how many have a word that their source does not hold."""
    c = q._corpus(spark, sf)
    words = c.tokens.groupBy("work").agg(F.collect_set("raw").alias("source_words"))
    changes = wording_changes(spark, sf).select("work", F.array("replacement").alias("replacement_words"))
    return changes.agg(F.count("*").alias("changes")).crossJoin(edits.unbacked(changes, words, "work").agg(F.count("*").alias("unbacked")))


@query
def word_levels(spark, sf):
    """At which level the words of a run equal the source's: as written, or but for case."""
    t, c = q._tokens(spark, sf), q._corpus(spark, sf)
    r = q._runs(spark, sf).select("doc_id", "work", "d0", "d1", "b0", F.explode(F.sequence("d0", F.col("d1") - 1)).alias("tok")).withColumn("pos", F.col("tok") - F.col("d0") + F.col("b0"))
    met = r.join(t.select("doc_id", "tok", "raw"), ["doc_id", "tok"]).join(c.tokens.select("work", "pos", F.col("raw").alias("source")), ["work", "pos"])
    return met.groupBy("doc_id", "work", "d0", "d1").agg(F.count_if(F.col("raw") == F.col("source")).alias("literal"), F.count_if(F.col("raw") != F.col("source")).alias("folded"))


@query
def edited_findings(spark, sf):
    """Findings after every citation in the text was put in brackets."""
    x = extract.numeric_references(q._docs(spark, sf)).select("doc_id", "s", "e", F.lit(2).alias("added"))
    before = q._run_offsets(spark, sf).select("doc_id", F.col("s").alias("s0"), "s", "e").distinct()
    return findings.shift_spans(before, x)


@query
def next_chunks(spark, sf):
    c = q._corpus(spark, sf)
    return findings.chunk_ends(c.tokens, c.bounds)


def _gold(spark, sf) -> DataFrame:
    return located_quotes(spark, sf).select("doc_id", F.col("d0").alias("g0"), F.col("d1").alias("g1"), F.col("quote_id").alias("gold_work"))


@query
def gold_findings(spark, sf):
    return findings.match_gold(_gold(spark, sf), q._runs(spark, sf).select("doc_id", "d0", "d1", "work"))


@query
def gold_summary(spark, sf):
    g = gold_findings(spark, sf)
    grade = F.when(F.col("work").isNull(), "missed").when(F.col("work") == F.col("gold_work"), "right").otherwise("other_place")
    n = g.groupBy(grade.alias("grade")).agg(F.count("*").alias("n"))
    return n.select("grade", "n", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 6).alias("share"))


@query
def false_per_10k(spark, sf):
    """Two-word hits inside and outside runs, by language, and those outside per 10,000 characters."""
    docs = q._docs(spark, sf).select("doc_id", "lang", F.length("text").alias("chars"))
    hits = q.pair_hits(spark, sf).select("doc_id", F.col("tok").alias("s"), (F.col("tok") + 2).alias("e"))
    r = q._runs(spark, sf).select("doc_id", F.col("d0").alias("s2"), F.col("d1").alias("e2"))
    outside = intervals.overlap_join(hits, r, ["doc_id"], "left_anti").groupBy("doc_id").agg(F.count("*").alias("outside"))
    every = hits.groupBy("doc_id").agg(F.count("*").alias("hits"))
    f = docs.join(every, "doc_id", "left").join(outside, "doc_id", "left").fillna(0, ["hits", "outside"])
    return f.groupBy("lang").agg(F.sum("hits").alias("hits"), F.sum("outside").alias("outside"), F.round(10000 * F.sum("outside") / F.sum("chars"), 6).alias("per_10k"))


@query
def paired_runs(spark, sf):
    """Every run of the plain search beside the stricter one: kept, or missing there."""
    r = q._runs(spark, sf).select("doc_id", "work", "d0", "d1", "mass")
    strict = q._runs(spark, sf).filter("rarest <= 2 and mass >= 9").select("doc_id", "work", "d0", "d1", F.lit("kept").alias("with"))
    return r.join(strict, ["doc_id", "work", "d0", "d1"], "left").fillna("missing", ["with"])


@query
def residual_pairs(spark, sf):
    """The forty most frequent pairs of words with which texts leave their source after a run."""
    r = q._runs(spark, sf)
    t = q._tokens(spark, sf).select("doc_id", F.col("tok").alias("d1"), F.col("fold").alias("written"))
    c = q._corpus(spark, sf).tokens.select("work", F.col("pos").alias("b1"), F.col("fold").alias("source"))
    n = r.join(t, ["doc_id", "d1"]).join(c, ["work", "b1"]).groupBy("written", "source").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "written", "source").limit(40)


@query
def coverage_share(spark, sf):
    """Share of the words of each language that runs cover."""
    r = intervals.merge_ranges(q._runs(spark, sf).select("doc_id", F.col("d0").alias("s"), F.col("d1").alias("e")), "doc_id")
    covered = r.groupBy("doc_id").agg(F.sum(F.col("e") - F.col("s")).alias("covered"))
    words = q._docs(spark, sf).select("doc_id", "lang", F.regexp_count("text", F.lit(r"[\p{L}\p{M}]+")).cast("long").alias("n"))
    f = words.join(covered, "doc_id", "left").fillna(0, ["covered"]).groupBy("lang").agg(F.sum("n").alias("words"), F.sum("covered").alias("covered"))
    return f.withColumn("share", F.round(F.col("covered") / F.col("words"), 9))


@query
def distinct_in_order(spark, sf):
    """The different words of every turn in the order in which they first come."""
    words = F.transform(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{M}]+"), F.lit(0)), F.lower)
    return q._table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(F.array_distinct(words), " ").alias("words"))


@query
def densest_runs(spark, sf):
    """The longest cluster of rare corpus words in every document."""
    rare = q._corpus(spark, sf).vocab.filter("df <= 2").select("fold")
    return findings.densest_runs(q._tokens(spark, sf).join(rare, "fold", "left_semi"), "doc_id", "tok")


@query
def source_counters(spark, sf):
    """Phrases alone, marked spans alone, and those that overlap, by language."""
    r = _spans(spark, sf).groupBy("doc_id").agg(F.collect_list(F.struct("s", "e")).alias("r"))
    m = extract.marked_spans(q._docs(spark, sf)).groupBy("doc_id").agg(F.collect_list(F.struct("s", "e")).alias("m"))
    none = F.expr("cast(array() as array<struct<s:bigint,e:bigint>>)")
    met = r.join(m, "doc_id", "full").select("doc_id", F.coalesce("r", none).alias("r"), F.coalesce("m", none).alias("m"))
    count = lambda a, b, meets: F.size(F.filter(a, lambda x: F.exists(b, lambda y: (x["s"] < y["e"]) & (y["s"] < x["e"])) == F.lit(meets))).cast("long")
    n = met.select("doc_id", count("r", "m", True).alias("both"), count("r", "m", False).alias("phrase"), count("m", "r", False).alias("marked")).filter("both + phrase + marked > 0")
    return n.join(q._docs(spark, sf).select("doc_id", "lang"), "doc_id").groupBy("lang").agg(*[F.sum(c).alias(c) for c in ("both", "phrase", "marked")])


@query
def aligned_blocks(spark, sf):
    """Blocks of rare words that a document and a work share along a diagonal: cut where a word lies between."""
    rows = word_arrays(q._docs(spark, sf), ["doc_id"]).filter("raws is not null").select("doc_id", F.transform("raws", F.lower).alias("words"))
    return q.approximate.shared_diagonals(rows, q._corpus(spark, sf), 3)


@query
def selected_findings(spark, sf):
    """Findings that the first paragraph of their document touches."""
    first = q._docs(spark, sf).select("doc_id", F.lit(0).cast("long").alias("s2"), F.length(F.substring_index("text", "\n", 1)).cast("long").alias("e2"))
    return intervals.overlap_join(_spans(spark, sf), first, ["doc_id"], "left_semi")


@query
def export_partitions(spark, sf):
    """Decisions of every user by what an export does with them."""
    e = q._table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "error", "unresolved").when(F.col("value") >= 50, "approved").when(F.col("value") >= 20, "optional").when(F.col("value") > 0, "pending").otherwise("rejected")
    return e.groupBy("user_id", kind.alias("kind")).agg(F.count("*").alias("n"))


@query
def request_problems(spark, sf):
    """Requests with all that is wrong with them."""
    e = q._table(spark, sf, "events")
    out = F.array_compact(F.array(F.when(F.col("value").isNull() | (F.col("value") < 1), "value_low"), F.when(F.col("value") > 100, "value_high"), F.when(F.col("user_id").isNull(), "no_user"), F.when(~F.col("event_type").isin("click", "view", "purchase"), "kind")))
    return e.select("event_id", F.array_join(out, ",").alias("problems")).filter("problems <> ''")


@query
def source_freshness(spark, sf):
    """What each call should do about its user's cached source, by the last success and the last failure before it."""
    before = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    t = F.col("ts").cast("timestamp").cast("double")
    e = q._table(spark, sf, "events").select("event_id", t.alias("now"), F.last(F.when(F.col("event_type") != "error", t), True).over(before).alias("fetched"), F.last(F.when(F.col("event_type") == "error", t), True).over(before).alias("failed"))
    return e.select("event_id", state.freshness(F.col("now"), F.col("fetched"), F.col("failed"), 86400, 7 * 86400, 3600).alias("decision"))


@query
def payload_units(spark, sf):
    """Conversations as one nested document each, written as JSON, read back, flattened and checked."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    nested = q._table(spark, sf, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(turns.alias("turns"))).alias("payload"))
    read = nested.select("conv_id", F.from_json("payload", "turns array<struct<turn long, role string, text string>>").alias("p"))
    rows = read.select("conv_id", F.size("p.turns").cast("long").alias("n"), F.explode("p.turns").alias("t"))
    problem = F.when(F.coalesce(F.trim("t.text"), F.lit("")) == "", "empty").when(F.col("n") < 2, "incomplete").otherwise("none")
    return rows.select("conv_id", "t.turn", F.length("t.text").cast("long").alias("n_chars"), problem.alias("problem"))


@query
def confirmations(spark, sf):
    """Whether a user who knows the place of a gold quotation is offered it, and with how many actions it is confirmed."""
    g = gold_findings(spark, sf).filter("work is not null")
    offered = finding_choices(spark, sf).select("doc_id", "d0", "d1", F.col("work").alias("gold_work"), "choices").dropDuplicates(["doc_id", "d0", "d1", "gold_work"])
    met = g.drop("work").join(offered, ["doc_id", "d0", "d1", "gold_work"], "left")
    return met.select("doc_id", "g0", "gold_work", F.when(F.col("choices").isNull(), 0).when(F.col("choices") == 1, 1).otherwise(2).cast("long").alias("actions"))


@query
def unavailable_results(spark, sf):
    """What is said of marked spans when there is no corpus."""
    return extract.marked_spans(q._docs(spark, sf)).select("doc_id", "s", F.lit("unavailable").alias("status"), F.lit(True).alias("needs_review"))


@udtf(returnType="quote string, at long")
class QuoteProvider:
    """A provider of proposals: spans in straight quotation marks."""

    def eval(self, text: str):
        import re

        for m in re.finditer(r'"([^"\n]{2,1500})"', text or ""):
            yield m.group(1), m.start()


@query
def provider_proposals(spark, sf):
    """Proposals of a registered provider, located in their text."""
    spark.udtf.register("quote_provider", QuoteProvider)
    q._docs(spark, sf).createOrReplaceTempView("provider_documents")
    return spark.sql("select doc_id, quote, at from provider_documents, lateral quote_provider(text)")


@query
def label_checks(spark, sf):
    """Checks of the labels: how many were made and how many failed."""
    # The words that a text has at a place are compared there with the work's, and each place is met once.
    c = q._corpus(spark, sf)
    source = _openings(c).select("quote_id", F.col("words").alias("source"))
    said = _opened(spark, sf).join(c.small(source), "quote_id").withColumn("pairs", F.when(F.col("doc_id").isNotNull(), F.arrays_zip("words", "source")))
    other = F.size(F.filter("pairs", lambda x: x["words"] != x["source"]))
    places = said.select("doc_id", "d0", F.greatest(F.size("pairs"), F.lit(0)).alias("made"), F.greatest(other, F.lit(0)).alias("failed")).groupBy("doc_id", "d0").agg(F.count("*").alias("n"), F.sum("made").alias("made"), F.sum("failed").alias("failed"))
    sums = places.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("made", "failed")], F.count("*").alias("places"), F.count_if(F.col("n") > 1).alias("several"))
    return sums.select(F.expr("stack(2, 'contained', made, failed, 'unambiguous', places, several) as (check, made, failed)"))


#: Words that announce quotations in the test tables' languages.
CUES = {"the": "article", "that": "lead_in", "which": "lead_in", "for": "lead_in", "der": "article", "la": "article"}


def _cue_windows(spark, sf) -> DataFrame:
    return cues.text_windows(q._docs(spark, sf), CUES).drop("s", "e")


@query
def writer_cues(spark, sf):
    return _cue_windows(spark, sf)


def _cue_hits(spark, sf) -> DataFrame:
    c = q._corpus(spark, sf)
    rare = c.tokens.join(c.vocab.filter("df <= 3"), "fold").select("fold", "work", "pos", "idf")
    shared = q._tokens(spark, sf).join(c.small(rare), "fold").select("doc_id", "tok", "work", (F.col("tok") - F.col("pos")).alias("diag"), "idf")
    return cues.cue_hits(_cue_windows(spark, sf), shared)


@query
def cue_hits(spark, sf):
    return _cue_hits(spark, sf)


@query
def greedy_cue_hits(spark, sf):
    """Cue hits that do not overlap: lead-ins first, then those with more words, then the first."""
    h = _cue_hits(spark, sf).select("doc_id", F.col("w0").alias("s"), F.col("w1").alias("e"), "kind", "work", "matched")
    return intervals.greedy_disjoint(h, "doc_id", [F.when(F.col("kind") == "lead_in", 0).otherwise(1), -F.col("matched"), F.col("s"), F.col("e")])


@query
def reconciled_cues(spark, sf):
    """Accepted cue hits beside the runs that they overlap, and how the two lie to each other."""
    h = _cue_hits(spark, sf).filter("matched >= 3 or (kind = 'lead_in' and mass >= 6)").select("doc_id", "w0", "w1", "kind", "work", "matched")
    r = q._runs(spark, sf).select("doc_id", "d0", "d1", F.col("work").alias("run_work"))
    met = h.alias("h").join(r.alias("r"), (F.col("h.doc_id") == F.col("r.doc_id")) & (F.col("d0") < F.col("w1")) & (F.col("w0") < F.col("d1")), "left")
    return met.select("h.doc_id", "w0", "w1", "kind", "work", "d0", "d1", F.when(F.col("d0").isNull(), "alone").otherwise(cues.relation("w0", "w1", "d0", "d1")).alias("relation"), F.coalesce(F.col("work") == F.col("run_work"), F.lit(False)).alias("same_work"))


@query
def unmarked_cues(spark, sf):
    """Cue windows that no marked span overlaps, by document."""
    w = intervals.with_overlaps(cues.text_windows(q._docs(spark, sf), CUES), extract.marked_spans(q._docs(spark, sf)), "doc_id", "marked")
    return w.filter("not marked").groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@query
def announced_runs(spark, sf):
    """Runs with the word directly before them, and whether it announces a quotation."""
    before = q._tokens(spark, sf).select("doc_id", (F.col("tok") + 1).alias("d0"), F.col("fold").alias("before"))
    r = q._runs(spark, sf).select("doc_id", "work", "d0", "d1").join(before, ["doc_id", "d0"], "left")
    return r.withColumn("announced", F.coalesce(F.col("before").isin(*CUES), F.lit(False)))


@query
def suggest_triggers(spark, sf):
    """Why a suggestion would be made at the end of each text, and whether the gates let it."""
    docs = q._docs(spark, sf).select("doc_id", "text")
    words = F.transform(F.slice(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{M}]+"), F.lit(0)), -2, 2), F.lower)
    opened = findings.open_mark(F.col("text"), {"(": ")", "{": "}", "«": "»", "“": "”"})
    tails = docs.filter(F.regexp_count("text", F.lit(r"[\p{L}\p{M}]+")) >= 2).select("doc_id", words.alias("w"), opened.alias("open"))
    known = q._corpus(spark, sf).pairs.groupBy("fold", "next_fold").agg(F.count("*").alias("places"))
    met = tails.select("doc_id", "open", F.col("w")[0].alias("fold"), F.col("w")[1].alias("next_fold")).join(known, ["fold", "next_fold"], "left").fillna(0, ["places"])
    trigger = F.when(F.col("open") != "", "opener").when(F.col("fold").isin(*CUES), "cue").when(F.col("places") == 1, "distinct").otherwise("none")
    return met.select("doc_id", trigger.alias("trigger"), "places", ((trigger != "none") & (F.col("places") > 0) & (F.col("places") <= 4)).alias("passes"))


@query
def suggest_insertions(spark, sf):
    """Words of the source that were left out between two words of a document, by document and pair."""
    w = W.partitionBy("work").orderBy("pos")
    c = q._corpus(spark, sf)
    three = c.tokens.select("work", "pos", F.col("fold").alias("a"), F.lead("fold", 1).over(w).alias("x"), F.lead("fold", 2).over(w).alias("b")).filter("b is not null")
    rare = c.vocab.filter("df <= 3").select(F.col("fold").alias("a"))
    three = three.join(rare, "a", "left_semi").groupBy("a", "b").agg(F.min("x").alias("inserted"), F.count("*").alias("places"))
    t = q._tokens(spark, sf).select("doc_id", "tok", F.col("fold").alias("a"), F.lead("fold").over(W.partitionBy("doc_id").orderBy("tok")).alias("b"))
    return t.join(c.small(three), ["a", "b"]).select("doc_id", "tok", "a", "b", "inserted", "places")


@query
def suggest_crosstab(spark, sf):
    """Texts by language and why a suggestion would be made."""
    t = suggest_triggers(spark, sf).join(q._docs(spark, sf).select("doc_id", "lang"), "doc_id")
    return t.groupBy("lang").pivot("trigger", ["opener", "cue", "distinct", "none"]).count().fillna(0)


@query
def checked_spans(spark, sf):
    """Marked spans of up to sixty words looked up in the corpus: how many places, and the verdict."""
    words = F.transform(F.regexp_extract_all("found", F.lit(r"[\p{L}\p{M}]+"), F.lit(0)), F.lower)
    m = extract.marked_spans(q._docs(spark, sf)).select(F.struct("doc_id", "s").alias("span"), words.alias("words")).filter("size(words) <= 60")
    places = q.verify.exact_occurrences(m, q._corpus(spark, sf), "span").groupBy("span").agg(F.count("*").alias("places"))
    out = m.join(places, "span", "left").fillna(0, ["places"])
    status = F.when(F.col("places") == 0, "difference").when((F.col("places") == 1) & (F.size("words") >= q.verify.MIN_WORDS), "matched").otherwise("uncertain")
    return out.select("span.doc_id", "span.s", F.size("words").cast("long").alias("n_words"), "places", status.alias("status"))


@query
def capped_findings(spark, sf):
    """At most two findings of a document, and the notice of how many more there are from which word on."""
    r = q._runs(spark, sf).groupBy("doc_id", "d0", "d1").agg(F.max("mass").alias("mass"))
    doc = W.partitionBy("doc_id")
    n = r.select("doc_id", "d0", "d1", F.row_number().over(doc.orderBy("d0", "d1")).alias("nth"), F.count("*").over(doc).alias("n"))
    n = n.withColumn("cut_at", F.min(F.when(F.col("nth") > 2, F.col("d0"))).over(doc))
    return n.filter("nth <= 2").select("doc_id", "d0", "d1", (F.col("n") - F.least("n", F.lit(2))).cast("long").alias("hidden"), "cut_at")


@query
def source_status(spark, sf):
    """The state of every user's source at the end of the log."""
    e = q._table(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp").cast("double"))
    end = e.agg(F.max("t").alias("end"))
    s = e.groupBy("user_id").agg(F.max(F.when(F.col("event_type") != "error", F.col("t"))).alias("fetched"), F.max(F.when(F.col("event_type") == "error", F.col("t"))).alias("failed"))
    out = s.crossJoin(F.broadcast(end)).withColumn("age", F.round(F.col("end") - F.col("fetched"), 3))
    return out.select("user_id", F.col("fetched").isNotNull().alias("loaded"), "age", F.coalesce(F.col("age") > 86400, F.lit(False)).alias("stale"), F.coalesce(F.col("failed") > F.col("fetched"), F.col("failed").isNotNull()).alias("error"))


@query
def preview_segments(spark, sf):
    """Texts cut into what stays and what a change would replace, with their lengths."""
    docs = q._docs(spark, sf).select("doc_id", F.length("text").cast("long").alias("n"))
    c = extract.numeric_references(q._docs(spark, sf)).select("doc_id", "s", "e")
    line = W.partitionBy("doc_id").orderBy("s")
    changed = c.select("doc_id", "s", "e", F.lit("changed").alias("kind"))
    before = c.select("doc_id", F.coalesce(F.lag("e").over(line), F.lit(0)).cast("long").alias("s"), F.col("s").alias("e"), F.lit("kept").alias("kind"))
    tail = docs.join(c.groupBy("doc_id").agg(F.max("e").alias("s")), "doc_id", "left").select("doc_id", F.coalesce("s", F.lit(0)).cast("long").alias("s"), F.col("n").alias("e"), F.lit("kept").alias("kind"))
    every = changed.union(before).union(tail).filter("e > s")
    return every.groupBy("doc_id", "kind").agg(F.count("*").alias("segments"), F.sum(F.col("e") - F.col("s")).alias("chars"))
