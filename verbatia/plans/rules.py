"""Registered queries of rules over vocabularies and alignments, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verbatia.operators import approximate, citation_grammar, continuations, extract, intervals, phrases, proposals, reconcile, spellings
from verbatia.plans import findings, full_audit
from verbatia.plans import queries as q
from verbatia.plans.findings_sql import PLACED, REFS
from verbatia.plans.sql import CORPUS, OFFSETS, tokens_of
from verbatia.sources.corpus_source import publish
from verbatia.sources.tables import shared_folder
from verbatia.streaming import edits

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def met_spellings(spark, sf):
    """Pairs of words of the documents that are two spellings of one form."""
    words = q._tokens(spark, sf).select("fold")
    return spellings.met_words(words, words).filter("fold < other")


@query
def form_occurrences(spark, sf):
    """The first three words of every work's every unit, each in any of its forms, over all works."""
    corpus, heads = q._corpus(spark, sf), q._unit_heads(spark, sf)
    each = heads.select("quote_id", F.posexplode("words").alias("i", "fold"))
    forms = spellings.latin_forms(each).groupBy("fold").agg(F.collect_set("form").alias("own"))
    quotes = each.join(forms, "fold").groupBy("quote_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "own"))), lambda x: x["own"]).alias("forms"))
    return spellings.occurrences_by_forms(quotes, corpus)


def _quotations(spark, sf):
    """Marked spans, whose bounds are the writer's own, and runs with edits, whose bounds the search has found; their citations are unknown."""
    words = lambda text: F.regexp_extract_all(text, F.lit(r"[\p{L}\p{M}]+"), F.lit(0))
    marked = extract.marked_spans(q._docs(spark, sf)).select(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit("m"), F.col("s").cast("string")).alias("quote_id"), words(F.col("found")).alias("words"), F.lit(True).alias("bounded"))
    runs = approximate.approximate_runs(q._docs(spark, sf), q._corpus(spark, sf)).select("doc_id", "d0", "d1").distinct()
    said = q._docs(spark, sf).select("doc_id", words(F.col("text")).alias("w"))
    found = runs.join(said, "doc_id").select(F.concat_ws(":", F.col("doc_id").cast("string"), F.lit("r"), F.col("d0").cast("string"), F.col("d1").cast("string")).alias("quote_id"), F.slice("w", F.col("d0").cast("int") + 1, (F.col("d1") - F.col("d0")).cast("int")).alias("words"), F.lit(False).alias("bounded"))
    rows = marked.unionByName(found).withColumn("folds", F.transform("words", F.lower))
    return rows.withColumns({c: F.lit(None).cast("long") for c in ("ref_work", "ref_unit0", "ref_unit1")})


@query
def wording_proposals(spark, sf):
    """What may be corrected in every marked span of the documents and in every run with edits."""
    rows = proposals.propose(_quotations(spark, sf), q._corpus(spark, sf))
    written = F.array_join(F.transform("edits", lambda e: F.concat(e["i1"].cast("string"), F.lit("-"), e["i2"].cast("string"), F.lit("="), F.array_join(e["words"], " "))), "; ")
    return rows.withColumn("edits", written)


@query
def written_citations(spark, sf):
    """Citations of all forms in the documents; the works are named by their first three words."""
    c = q._corpus(spark, sf)
    sizes = c.bounds.groupBy("work").agg(F.count("*").alias("n_units"))
    heads = c.tokens.filter("pos < 3").groupBy("work").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "fold"))), lambda x: x["fold"]), " ").alias("name"))
    return citation_grammar.citations(q._docs(spark, sf), heads.join(sizes, "work"))


@query
def merged_candidates(spark, sf):
    """Disjoint runs of the documents and spans that cue words announce, brought together."""
    c = q._corpus(spark, sf)
    rare = c.tokens.join(c.vocab.filter("df <= 3"), "fold").select("fold", "work", "pos", "idf")
    shared = q._tokens(spark, sf).join(c.small(rare), "fold").select("doc_id", "tok", "work", (F.col("tok") - F.col("pos")).alias("diag"), "idf")
    hits = findings._cue_hits(spark, sf).filter("matched >= 3")
    met = hits.join(shared.drop("idf"), ["doc_id", "work", "diag"]).filter("tok >= w0 and tok < w1")
    said = met.groupBy("doc_id", "w0", "w1", "work", "diag").agg(F.min("tok").alias("d0"), (F.max("tok") + 1).alias("d1"))
    said = said.select("doc_id", "d0", "d1", "w0", "w1", "work", (F.col("d0") - F.col("diag")).alias("b0"), (F.col("d1") - F.col("diag")).alias("b1"))
    runs = q._runs(spark, sf).select("doc_id", "work", F.col("d0").alias("s"), F.col("d1").alias("e"), "b0", "b1", "mass")
    runs = intervals.greedy_disjoint(runs, "doc_id", [-F.col("mass"), F.col("s"), F.col("e"), F.col("work")]).withColumnsRenamed({"s": "d0", "e": "d1"})
    rows = reconcile.reconcile(runs, said)
    written = F.transform("hints", lambda h: F.concat_ws(":", h["work"].cast("string"), h["p0"].cast("string"), h["p1"].cast("string")))
    return rows.withColumn("hints", F.array_join(written, " "))


@query
def edits_in_order(spark, sf):
    """Runs after all citations of their document have been rewritten one after the other, each three characters longer."""
    spans = findings._spans(spark, sf).select("doc_id", "s", "e", F.row_number().over(W.partitionBy("doc_id").orderBy("s", "e")).alias("finding_id"))
    line = W.partitionBy("doc_id").orderBy("s")
    refs = extract.numeric_references(q._docs(spark, sf)).select("doc_id", "s", "e", (F.row_number().over(line) - 1).alias("seq"))
    changes = refs.select("doc_id", "seq", (F.col("s") + 3 * F.col("seq")).alias("start"), (F.col("e") + 3 * F.col("seq")).alias("old_end"), (F.col("e") + 3 * F.col("seq") + 3).alias("new_end"))
    return edits.edited(spans.withColumns({"z0": F.col("s"), "z1": F.col("e")}), changes).select("doc_id", "finding_id", "s", "e", "stale")


#: Words before a quotation that let a caret after two words of it suggest.
LEAD_INS = sorted(w for w, kind in findings.CUES.items() if kind == "lead_in")
HIDDEN, SHORTEST = 4, 8


#: A segment from its first word on, with the opening mark directly before it.
SEGMENT, WORD = r'(?:[«“{"]\s*)?[\p{L}\p{M}][\p{L}\p{M} \t,;]*', r"[\p{L}\p{M}]+"


def _carets(spark, sf):
    """A caret before the last four words of every segment of eight words or more: at most forty words before it, the hidden next word, the text's
    language, and the number of words behind an opening mark directly before the segment.

    A text is cut into segments and each of them into words, so that no row holds more than its own segment's.
    """
    cut = F.posexplode(F.regexp_extract_all("text", F.lit(SEGMENT), F.lit(0))).alias("seg", "said")
    each = q._docs(spark, sf).select("doc_id", "lang", cut).withColumn("all", F.regexp_extract_all("said", F.lit(WORD), F.lit(0)))
    # The caret stands before the word at ``caret``.
    each = each.filter(F.size("all") >= SHORTEST).withColumn("caret", F.size("all") - HIDDEN)
    start = F.greatest(F.lit(0), F.col("caret") - 40)
    words = F.transform(F.slice("all", start + 1, F.col("caret") - start), F.lower)
    since = F.when(F.col("said").rlike(r'\A[«“{"]'), F.col("caret"))
    return each.select("doc_id", "lang", F.col("seg").cast("long").alias("seg"), words.alias("words"), since.cast("long").alias("since"), F.lower(F.get("all", F.col("caret"))).alias("hidden"))


def _verdicts(spark, sf):
    return continuations.judged(_carets(spark, sf), q._corpus(spark, sf), LEAD_INS)[0]


@query
def caret_verdicts(spark, sf):
    """What the corpus holds of the words before every caret that two words or more match, and why nothing is suggested there."""
    rows = _verdicts(spark, sf).filter("matched >= 2 or matched1 >= 2")
    return rows.select("doc_id", "seg", "matched", F.coalesce(F.col("hi") - F.col("lo"), F.lit(0)).alias("places"), "mass", "matched1", F.coalesce(F.col("hi1") - F.col("lo1"), F.lit(0)).alias("places1"), "trigger", "blocked", "mends")


def _choices(spark, sf, *more):
    return continuations.suggest(_carets(spark, sf), ["doc_id", "seg", *more], q._corpus(spark, sf), LEAD_INS)


@query
def caret_choices(spark, sf):
    """What is suggested at every caret."""
    return _choices(spark, sf)


@query
def caret_accuracy(spark, sf):
    """By language: carets, carets with a suggestion, and first continuations whose first word is the hidden one."""
    carets = _carets(spark, sf).filter("doc_id is not null").groupBy("lang").agg(F.count("*").alias("carets"))
    best = _choices(spark, sf, "lang", "hidden").filter("rank = 1 and doc_id is not null")
    on, said = F.col("kind") == "continue", F.lower(F.substring_index("to_text", " ", 1))
    met = best.groupBy("lang").agg(F.count("*").alias("suggested"), F.count_if(on).alias("continued"), F.count_if(on & (said == F.col("hidden"))).alias("hits"))
    every = carets.unionByName(met, allowMissingColumns=True)
    return every.groupBy("lang").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("carets", "suggested", "continued", "hits")])


@query
def corpus_source_units(spark, sf):
    """The lines of every work, written as a version of the corpus source and read back through it."""
    root = shared_folder(spark, "corpus")
    lines = q._table(spark, sf, "benchmark").select(F.col("item_id").alias("work"), F.posexplode(F.split("text", "\n")).alias("unit", "text"))
    publish(lines.filter("trim(text) <> ''"), root, 1, 0.0)
    back = spark.read.format("corpus_units").option("path", root).load()
    return back.select("work", "unit", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def _audited(spark, sf):
    c = q._corpus(spark, sf)
    sizes = c.bounds.groupBy("work").agg(F.count("*").alias("n_units"))
    heads = c.tokens.filter("pos < 3").groupBy("work").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "fold"))), lambda x: x["fold"]), " ").alias("name"))
    return full_audit.audit_all(q._docs(spark, sf), c, dict.fromkeys(LEAD_INS, "lead_in"), phrases.prose_zipf(q._tokens(spark, sf)), heads.join(sizes, "work"))


@query
def full_audit_findings(spark, sf):
    """Findings of all kinds in the documents, merged, cited and compared with the corpus."""
    written = F.transform("edits", lambda e: F.concat(e["i1"].cast("string"), F.lit("-"), e["i2"].cast("string"), F.lit("="), F.array_join(e["words"], " ")))
    return _audited(spark, sf).withColumns({"sources": F.array_join("sources", " "), "edits": F.array_join(written, "; ")})


@query
def full_audit_summary(spark, sf):
    """Findings by what found them, verdict, reason and citation."""
    rows = _audited(spark, sf).groupBy(F.array_join("sources", " ").alias("sources"), "status", "reason", "reference_status")
    return rows.agg(F.count("*").alias("findings"), F.count_distinct("doc_id").alias("documents"), F.count_if("announced").alias("announced"))


def _forms(words: str, name: str) -> str:
    """Rows (fold, form) of a table of words."""
    paired = "fold"
    for letter, pair in spellings.LATIN_PAIRS.items():
        paired = f"replace({paired}, '{letter}', '{pair}')"
    bare = f"replace(translate(fold, '{spellings.PLAIN[0]}', '{spellings.PLAIN[1]}'), 'ß', 'ss')"
    return f"{name} as (select distinct fold, unnest([fold, {paired}, {bare}]) as form from {words})"


_GATES = continuations.Gates()
_BAR = lambda bars, n: "case " + " ".join(f"when {n} = {k} then {v}" for k, v in bars[:-1]) + f" else {bars[-1][1]} end"
_LED = ", ".join(f"'{w}'" for w in LEAD_INS)


def _triggered(n: str, words: str, since: str) -> str:
    return f"case when {since} - {n} between 0 and 1 then 'opener' when len({words}) > {n} and {words}[len({words}) - {n}] in ({_LED}) then 'cue' else 'distinct' end"


#: Every place is laid beside every run whose last two words end there, word by word.
CARETS = f"""with {CORPUS.replace('ctok as (', 'ctok as materialized (')},\n{OFFSETS},
brk as (select doc_id, tok, lower(raw) as fold, gap, case when tok > 0 and regexp_full_match(gap, '[ \\t,;]*') then 0 else 1 end as b from doff),
seg as (select *, sum(b) over (partition by doc_id order by tok) - 1 as seg from brk),
span as (select *, min(tok) over s as f, max(tok) over s as l from seg window s as (partition by doc_id, seg)),
carets as materialized (
  select doc_id, cast(seg as bigint) as seg, coalesce(list(fold order by tok) filter (tok <= l - {HIDDEN} and tok > l - {HIDDEN} - 40), []) as w,
         max(case when tok = l - {HIDDEN} + 1 then fold end) as hidden, max(case when tok = f and regexp_matches(gap, '[«“{{"]\\s*$') then l - {HIDDEN} - f + 1 end) as since
  from span where l - f + 1 >= {SHORTEST} group by doc_id, seg),
place as materialized (select c.work, c.pos, list(d.fold order by d.pos desc) as b from ctok c join ctok d on d.work = c.work and d.pos between c.pos - 39 and c.pos group by c.work, c.pos),
run as materialized (select distinct list_reverse(w) as r from carets union select distinct list_reverse(w[1:len(w) - 1]) from carets),
laid as materialized (
  select r, work, pos, least(len(r), len(b)) as k, r[1:least(len(r), len(b))] as x, b[1:least(len(r), len(b))] as y
  from run join place on r[1] = b[1] and r[2] = b[2]),
common as materialized (select r, work, pos, coalesce(list_min(list_filter(range(1, k + 1), lambda i: x[i] <> y[i])) - 1, k) as n from laid),
top as (select r, max(n) as n from common group by r),
hit as materialized (select c.r, c.n, c.work, c.pos from common c join top t on t.r = c.r and t.n = c.n),
massed as (select r, round(sum(idf), 6) as mass from (select r, unnest(r[1:n]) as fold from top) u join vocab using (fold) group by r),
stat as materialized (select h.r, cast(h.n as integer) as n, count(*) as places, any_value(m.mass) as mass from hit h join massed m on m.r = h.r group by h.r, h.n),
looked as (
  select c.doc_id, c.seg, c.w, c.since, c.hidden, coalesce(a.n, 0) as matched, coalesce(a.places, 0) as places, a.mass, coalesce(b.n, 0) as matched1, coalesce(b.places, 0) as places1, b.mass as mass1
  from carets c left join stat a on a.r = list_reverse(c.w) left join stat b on b.r = list_reverse(c.w[1:len(c.w) - 1])),
named as (
  select *, matched1 >= 3 and matched1 >= matched + 2 as wins, {_triggered('matched', 'w', 'since')} as trigger, {_triggered('matched1', 'w[1:len(w) - 1]', '(since - 1)')} as trigger1 from looked),
verdict as materialized (
  select *, case when matched < 2 or wins then 'no_match' when trigger = 'distinct' and matched < 4 then 'too_short'
                 when mass < case when trigger = 'distinct' then {_GATES.distinct_mass} else {_BAR(_GATES.mass, 'matched')} end then 'too_common'
                 when places > {_BAR(_GATES.places, 'matched')} then 'ambiguous' end as blocked,
         coalesce(matched1 >= 3 and (matched < 3 or wins) and mass1 >= {_GATES.correction_mass} and places1 <= 2, false) as mends from named),
asked as (
  select doc_id, seg, w[len(w)] as odd, 0 as mend, matched as typed, places, list_reverse(w) as r from verdict where blocked is null
  union all select doc_id, seg, w[len(w)], 1, matched1, places1, list_reverse(w[1:len(w) - 1]) from verdict where mends),
ahead as (
  select c.work, c.pos, c.unit, list(d.raw order by d.pos) as raws, list(d.fold order by d.pos) as folds
  from ctok c join ctok d on d.work = c.work and d.unit = c.unit and d.pos > c.pos and d.pos <= c.pos + 6 group by c.work, c.pos, c.unit),
choice as (
  select a.doc_id, a.seg, a.typed, a.places, h.work, e.unit, h.pos,
         case when mend = 0 then 'continue' when folds[2] = odd or folds[3] = odd then 'insert' else 'replace' end as kind,
         array_to_string(case when mend = 0 then case when len(raws) <= 5 then raws else raws[1:4] end when folds[2] = odd then raws[1:1] when folds[3] = odd then raws[1:2] else raws[1:1] end, ' ') as to_text
  from asked a join hit h on h.r = a.r join ahead e on e.work = h.work and e.pos = h.pos where mend = 0 or folds[1] <> odd),
one as (select doc_id, seg, kind, typed, places, work, unit, arg_min(to_text, pos) as to_text from choice group by doc_id, seg, kind, typed, places, work, unit),
listed as (
  select *, cast(row_number() over (partition by doc_id, seg order by case kind when 'continue' then 0 when 'insert' then 1 else 2 end, typed desc, work, unit) as integer) as rank from one
  qualify rank <= 4),
counted as (select doc_id, seg, max(places) as most, count(distinct lower(to_text)) as texts, count(distinct (work, unit)) as units from listed group by doc_id, seg),
final as (
  select l.doc_id, l.seg, l.kind, l.typed, l.work, cast(l.unit as bigint) as unit, l.to_text, l.rank, greatest(c.most, c.units) as places, c.texts > 1 or c.units > 1 as ambiguous
  from listed l join counted c on c.doc_id = l.doc_id and c.seg = l.seg)"""


ORACLE: dict[str, str] = {
    "corpus_source_units": """select cast(item_id as varchar) as work, i - 1 as unit, length(l[i]) as n_chars, md5(l[i]) as text_md5
from (select item_id, string_split(text, chr(10)) as l from benchmark) x, unnest(range(1, len(l) + 1)) as t(i) where trim(l[i]) <> ''""",
    "caret_verdicts": f"{CARETS} select doc_id, seg, matched, places, mass, matched1, places1, trigger, blocked, mends from verdict where matched >= 2 or matched1 >= 2",
    "caret_choices": f"{CARETS} select * from final",
    "caret_accuracy": f"""{CARETS}, best as (select doc_id, seg, kind, lower(split_part(to_text, ' ', 1)) as said from final where rank = 1)
select d.lang, count(*) as carets, count(b.kind) as suggested, count(*) filter (b.kind = 'continue') as continued, count(*) filter (b.kind = 'continue' and b.said = c.hidden) as hits
from carets c join documents d on d.doc_id = c.doc_id left join best b on b.doc_id = c.doc_id and b.seg = c.seg group by d.lang""",
    "edits_in_order": f"""{PLACED},\n{REFS},
found as (select doc_id, s, e, row_number() over (partition by doc_id order by s, e) as finding_id from sp),
based as (select f.*, coalesce((select min(r.s) from ref r where r.doc_id = f.doc_id and r.s < f.s and f.s < r.e), f.s) as s0,
                 coalesce((select max(r.e) from ref r where r.doc_id = f.doc_id and r.s < f.e and f.e < r.e), f.e) as e0 from found f)
select doc_id, finding_id, s0 + 3 * (select count(*) from ref r where r.doc_id = b.doc_id and r.e <= b.s0) as s,
       e0 + 3 * (select count(*) from ref r where r.doc_id = b.doc_id and r.e <= b.e0) as e,
       exists (select 1 from ref r where r.doc_id = b.doc_id and r.s <= b.e and b.s <= r.e) as stale
from based b""",
    "met_spellings": f"""with {tokens_of('dtok', 'documents', 'doc_id')}, words as (select distinct fold from dtok), {_forms('words', 'forms')}
select distinct a.fold, b.fold as other from forms a join forms b using (form) where a.fold < b.fold""",
    "form_occurrences": f"""with {CORPUS},
head as (select work * 1000 + unit as quote_id, pos - p0 as i, fold from ctok join bounds using (work, unit) where pos < p0 + 3),
sized as (select quote_id, count(*) as n from head group by quote_id),
words as (select distinct fold from head), {_forms('words', 'forms')},
met as (select distinct h.quote_id, c.work, c.pos - h.i as p0, h.i from head h join forms f using (fold) join ctok c on c.fold = f.form)
select cast(quote_id as bigint) as quote_id, work, p0, p0 + n as p1 from met join sized using (quote_id) group by quote_id, work, p0, n having count(*) = n""",
}
