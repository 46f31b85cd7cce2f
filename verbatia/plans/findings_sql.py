"""DuckDB SQL of the queries in ``findings``."""

from __future__ import annotations

import unicodedata

from verbatia.plans.sql import BASE, CORPUS, DOC, MARKED, NUMERIC, OFFSETS, TIER, TOKEN, greedy, spans_of

#: A copy of every item with a word misspelt.
DAMAGED = "(select item_id as doc_id, replace(text, ' of ', ' fo ') as text from benchmark)"
WRONG = BASE.replace(" from documents) x", f" from {DAMAGED}) x")
PLACED = f"""{BASE},\n{OFFSETS},
off1 as materialized (select r.*, a.start as s, r.d1 - 1 as d_last from runs r join doff a on a.doc_id = r.doc_id and a.tok = r.d0),
placed as materialized (select o.*, z."end" as e from off1 o join doff z on z.doc_id = o.doc_id and z.tok = o.d_last),
sp as materialized (select distinct doc_id, s, e from placed)"""
UNITS = """pl as materialized (
  select r.doc_id, r.d0, r.d1, r.work, r.b0, r.b1, r.mass, min(cast(b.unit as bigint)) as unit0, max(cast(b.unit as bigint)) as unit1
  from runs r join bounds b on b.work = r.work and b.p0 < r.b1 and r.b0 < b.p1 group by all)"""
MARKS = f"{spans_of('m0', 'documents', MARKED)},\nm as materialized (select doc_id, cast(s as bigint) as s, cast(e as bigint) as e, found from m0 where len(regexp_extract_all(found, '{TOKEN}')) >= 2)"
REFS = f"{spans_of('x', 'documents', NUMERIC)},\nref as materialized (select doc_id, cast(s as bigint) as s, cast(e as bigint) as e, found from x)"
FORMS = f"""{REFS},\n{spans_of('y', 'documents', '[0-9]{1,5}')},
src as (select doc_id, s, e, found, 'place' as kind from ref union all select doc_id, cast(s as bigint), cast(e as bigint), found, 'number' from y)"""
PART = "'([0-9]+)[:.]([0-9]+)(?:-([0-9]+))?'"
GOLD = """opening as (select work as quote_id, list(fold order by pos) as words from ctok where pos < 5 group by work having count(*) = 5),
five as (select doc_id, tok as d0, list(fold) over (partition by doc_id order by tok rows between current row and 4 following) as words from dtok),
gold as materialized (select quote_id as gold_work, doc_id, d0 as g0, d0 + 5 as g1 from five join opening using (words)),
over_half as (select g.*, r.d0, r.d1, r.work from gold g left join runs r on r.doc_id = g.doc_id and r.d0 < g.g1 and g.g0 < r.d1 and least(g.g1, r.d1) - greatest(g.g0, r.d0) >= 0.5 * (g.g1 - g.g0)),
graded as (select doc_id, g0, g1, gold_work, min(struct_pack(d0 := d0, d1 := d1, work := work)) filter (work is not null) as f from over_half group by all)"""
CHANGES = """nxt as (select *, lead(d0) over (partition by doc_id, work, d0 - b0 order by d0) as n from runs),
hole as (select distinct doc_id, work, d0 - b0 as diag, unnest(range(d1, n)) as tok from nxt where n > d1 and n <= d1 + 2),
chg as materialized (select h.doc_id, h.work, h.tok, h.tok - h.diag as pos, d.raw as original, c.raw as replacement
  from hole h join dtok d on d.doc_id = h.doc_id and d.tok = h.tok join ctok c on c.work = h.work and c.pos = h.tok - h.diag)"""


def _letters() -> str:
    """Values (letter, parts) of all letters of the Latin, Greek and Cyrillic blocks that are composed."""
    blocks = (*range(0xC0, 0x530), *range(0x1E00, 0x2000))
    return ", ".join(f"('{chr(c)}', '{apart}')" for c in blocks if (apart := unicodedata.normalize("NFD", chr(c))) != chr(c) and unicodedata.category(chr(c))[0] == "L")


#: Each distinct word of the documents as letters with their marks, ``letter:marks``.
APART = f"""letters(letter, parts) as (values {_letters()}),
spelt as (select fold, unnest(string_split(fold, '')) as c, generate_subscripts(string_split(fold, ''), 1) as i from (select distinct fold from dtok) w),
parted as (select fold, string_agg(coalesce(parts, c), '' order by i) as word from spelt left join letters on c = letter group by fold),
profiles as materialized (select fold, list_transform(regexp_extract_all(word, '\\p{{L}}\\p{{M}}*'), lambda x: regexp_extract(x, '^\\p{{L}}') || ':' || regexp_extract(x, '\\p{{M}}*$')) as p from parted)"""
CUED = """cue(fold, kind) as (values ('the', 'article'), ('that', 'lead_in'), ('which', 'lead_in'), ('for', 'lead_in'), ('der', 'article'), ('la', 'article')),
stops as materialized (select doc_id, tok, lower(raw) as fold, coalesce(min(case when regexp_matches(gap, '[.!?\\n]') then tok end) over (partition by doc_id order by tok rows between 1 following and unbounded following),
  max(tok) over (partition by doc_id) + 1) as stop from doff),
win0 as (select doc_id, tok + 1 as w0, least(stop, tok + 41) as w1, kind from stops join cue using (fold)),
win as materialized (select * from win0 where w1 - w0 >= 2 qualify row_number() over (partition by doc_id, w1 order by w0 desc, kind) = 1)"""
CUE_HITS = f"""{CUED},
shared as materialized (select d.doc_id, d.tok, c.work, d.tok - c.pos as diag, v.idf from dtok d join ctok c on c.fold = d.fold join vocab v on v.fold = c.fold where v.df <= 3),
votes as (select w.doc_id, w.w0, w.w1, w.kind, s.work, s.diag, count(*) as matched, round(sum(s.idf), 6) as mass from win w join shared s on s.doc_id = w.doc_id and s.tok >= w.w0 and s.tok < w.w1 group by all),
hit as materialized (select * from votes where matched >= 2 qualify row_number() over (partition by doc_id, w0, w1 order by matched desc, mass desc, work, diag) = 1)"""
OPEN = """marks as (select doc_id, regexp_extract_all(text, '[(){}«»“”]') as marks from documents),
opens as (select doc_id, right(list_reduce(list_prepend('', marks), lambda st, c: case when c in ('(', '{', '«', '“') then st || c
  when right(st, 1) = case c when ')' then '(' when '}' then '{' when '»' then '«' else '“' end then left(st, length(st) - 1) else st end), 1) as open from marks)"""
TRIGGER = f"""with {CORPUS},\n{DOC},\n{OPEN},
n as (select doc_id, count(*) as n from dtok group by doc_id having count(*) >= 2),
tails as (select n.doc_id, a.fold, b.fold as next_fold from n join dtok a on a.doc_id = n.doc_id and a.tok = n.n - 2 join dtok b on b.doc_id = n.doc_id and b.tok = n.n - 1),
cp as (select fold, lead(fold) over (partition by work order by pos) as next_fold from ctok),
known as (select fold, next_fold, count(*) as places from cp where next_fold is not null group by fold, next_fold),
t as (select doc_id, coalesce(places, 0) as places, case when open <> '' then 'opener' when fold in ('the', 'that', 'which', 'for', 'der', 'la') then 'cue' when places = 1 then 'distinct' else 'none' end as trigger
  from tails join opens using (doc_id) left join known using (fold, next_fold))"""

ORACLE: dict[str, str] = {
    "line_columns": f"""with {OFFSETS}, z as (select doc_id, max(start) as start from doff group by doc_id)
select z.doc_id, len(string_split(substring(d.text, 1, z.start), chr(10))) as line, length(string_split(substring(d.text, 1, z.start), chr(10))[-1]) + 1 as "column" from z join documents d using (doc_id)""",
    "fold_index_map": """with c as (select doc_id, regexp_extract_all(text, '(?s).') as l from documents),
k as (select doc_id, list_filter(list_zip(l, range(len(l))), lambda p: not regexp_matches(p[1], '[\\p{M}­]')) as k from c)
select doc_id, len(k) as n, coalesce(cast(list_sum(list_transform(k, lambda p: p[2])) as bigint), 0) as sum_at, md5(lower(array_to_string(list_transform(k, lambda p: p[1]), ''))) as folded_md5 from k""",
    "diacritic_profiles": f"""with {DOC}, {APART}
select fold, len(p) as letters, len(list_filter(p, lambda x: not suffix(x, ':'))) as marked, md5(array_to_string(p, ' ')) as profile_md5 from profiles""",
    "marked_pairs": f"""with {DOC}, {APART},
bare as materialized (select fold, list_transform(p, lambda x: x[1]) as l, list_transform(p, lambda x: x[3:]) as m from profiles where len(p) > 0),
met as (select a.fold, b.fold as other, a.m as ma, b.m as mb from bare a join bare b on a.l = b.l and a.fold < b.fold)
select fold, other,
       len([i for i in range(1, len(ma) + 1) if len([x for x in string_split(ma[i], '') if x <> '' and not contains(mb[i], x)]) > 0]) > 0 as conflict,
       len([i for i in range(1, len(ma) + 1) if len([x for x in string_split(mb[i], '') if x <> '' and not contains(ma[i], x)]) > 0]) > 0 as other_conflict from met""",
    "finding_labels": f"""{BASE},\n{UNITS}, g as (select doc_id, d0, d1, count(*) as n, min(struct_pack(work := work, b0 := b0, u0 := unit0, u1 := unit1)) as x from pl group by doc_id, d0, d1)
select doc_id, d0, d1, x.work || ':' || x.u0 || case when x.u1 > x.u0 then '-' || x.u1 else '' end as label, n || case when n = 1 then ' place' else ' places' end as places from g""",
    "detections": f"""{PLACED},\n{MARKS},
w as (select p.*, {TIER} as tier, lower(regexp_extract(substring(d.text, cast(greatest(0, p.s - 70) + 1 as bigint), cast(p.s - greatest(0, p.s - 70) as bigint)), '[^.!?\\n]*$')) as seen,
  exists (select 1 from m where m.doc_id = p.doc_id and m.s < p.e and p.s < m.e) as marked from placed p join documents d using (doc_id)),
c as (select *, case when regexp_matches(seen, '(^|[^a-z])(that|which)([^a-z]|$)') then 'yes' when regexp_matches(seen, '(^|[^a-z])(for|with)([^a-z]|$)') then 'no' else 'none' end as cue from w)
select doc_id, work, d0, d1, case when marked or cue = 'yes' then 'stated' when cue = 'no' then 'possible' else tier end as detection, marked, cue from c where tier <> 'hidden'""",
    "marked_accepted": f"""with {MARKS},\n{REFS},
f as (select m.doc_id, m.s, m.e, regexp_matches(lower(substring(d.text, greatest(0, m.s - 40) + 1, least(m.s, 40))), '(^|[^a-z])(that|which|of|the)([^a-z]|$)') as cued,
  exists (select 1 from ref r where r.doc_id = m.doc_id and r.s >= m.e and r.s <= m.e + 25) as cited from m join documents d using (doc_id))
select *, cued or cited as accepted from f""",
    "finding_queue": f"""{BASE}, t as (select doc_id, d0, d1, count(*) as places, min({TIER}) as tier from runs where {TIER} <> 'hidden' group by doc_id, d0, d1),
k as (select *, cast(case when places > 1 then 0 when tier = 'possible' then 1 else 2 end as bigint) as kind from t)
select doc_id, d0, d1, kind, row_number() over (partition by doc_id order by d0, d1) as id, row_number() over (partition by doc_id order by kind, d0, d1) as turn from k""",
    "neighbour_limits": f"{PLACED} select doc_id, s, e, lag(e) over (partition by doc_id order by s, e) as floor, lead(s) over (partition by doc_id order by s, e) as \"limit\" from sp",
    "finding_choices": f"""{BASE},\n{UNITS}, once as (select *, row_number() over (partition by doc_id, d0, d1, work, unit0 order by b0) as r from pl),
n as (select doc_id, d0, d1, work, unit0, b0, count(*) over (partition by doc_id, d0, d1) as choices, row_number() over (partition by doc_id, d0, d1 order by work, unit0, b0) as nth from once where r = 1)
select * from n where nth <= 4""",
    "resolved_references": f"with recursive {FORMS},\n{greedy('src', 's - e, s, kind')} select doc_id, s, e, found, kind from kept",
    "first_references": f"with recursive {FORMS},\n{greedy('src', 's - e, s, kind')} select doc_id, min_by(found, s) as found, min_by(kind, s) as kind from kept group by doc_id",
    "reference_problems": f"""with {CORPUS},\n{REFS}, n as (select work, count(*) as units from bounds group by work),
p as (select *, cast(regexp_extract(found, {PART}, 1) as bigint) as work, cast(regexp_extract(found, {PART}, 2) as int) as verse,
  coalesce(cast(nullif(regexp_extract(found, {PART}, 3), '') as int), cast(regexp_extract(found, {PART}, 2) as int)) as last from ref)
select p.doc_id, p.s, p.found, concat_ws(',', case when n.units is null then 'no_work' end, case when p.verse < 1 or p.last > n.units then 'no_unit' end, case when p.last < p.verse then 'reversed' end) as problems
from p left join n using (work)""",
    "located_quotes": f"{BASE},\n{GOLD} select gold_work as quote_id, doc_id, g0 as d0, g1 as d1 from gold",
    "open_quotes": f"with {OPEN} select doc_id, open from opens",
    "attached_references": f"""{PLACED},\n{REFS},
b as (select *, lead(s) over (partition by doc_id order by s, e) as nx, lag(e) over (partition by doc_id order by s, e) as lt from sp),
a0 as (select b.doc_id, b.s, b.e, r.s as ref_s, r.e as ref_e, r.s - b.e as gap from b join ref r on r.doc_id = b.doc_id and r.s >= b.e and r.s <= b.e + 400 and (b.nx is null or r.s < b.nx)),
a1 as (select * from a0 qualify row_number() over (partition by doc_id, s, e order by gap, ref_s) = 1),
ahead as materialized (select doc_id, s, e, ref_s, ref_e from a1 qualify row_number() over (partition by doc_id, ref_s order by gap, s) = 1),
c0 as (select b.doc_id, b.s, b.e, r.s as ref_s, r.e as ref_e, b.s - r.e as gap from b join ref r on r.doc_id = b.doc_id and r.e <= b.s and r.e >= b.s - 600 and (b.lt is null or r.s >= b.lt)
  where not exists (select 1 from ahead h where h.doc_id = b.doc_id and h.s = b.s and h.e = b.e)),
c1 as (select * from c0 qualify row_number() over (partition by doc_id, s, e order by gap, ref_s) = 1),
c2 as (select doc_id, s, e, ref_s, ref_e from c1 qualify row_number() over (partition by doc_id, ref_s order by gap, s) = 1),
every as (select * from ahead union all select * from c2 where not exists (select 1 from ahead h where h.doc_id = c2.doc_id and h.ref_s = c2.ref_s))
select sp.doc_id, sp.s, sp.e, ref_s, ref_e from sp left join every using (doc_id, s, e)""",
    "conflict_free_changes": f"with recursive {FORMS},\n{greedy('src', 's, e')} select doc_id, s, e, found as replacement from kept",
    "wording_changes": f"{WRONG},\n{CHANGES} select * from chg",
    "corrected_texts": f"""{WRONG},\n{OFFSETS.replace('from documents) x', f'from {DAMAGED}) x')},\n{CHANGES},
one as (select doc_id, tok, min_by(replacement, struct_pack(w := work, p := pos)) as replacement from chg group by doc_id, tok),
o as (select one.doc_id, f.start as s, f."end" as e, one.replacement from one join doff f using (doc_id, tok)),
parts as (select o.doc_id, o.s, substring(d.text, coalesce(lag(o.e) over w, 0) + 1, o.s - coalesce(lag(o.e) over w, 0)) || o.replacement as piece, o.e
  from o join {DAMAGED} d using (doc_id) window w as (partition by o.doc_id order by o.s)),
heads as (select doc_id, string_agg(piece, '' order by s) as head, max(e) as e, count(*) as n from parts group by doc_id)
select d.doc_id, coalesce(h.n, 0) as n, md5(case when h.n is null then d.text else h.head || substring(d.text, h.e + 1) end) as text_md5,
  case when h.n is null then d.text else h.head || substring(d.text, h.e + 1) end = b.text as restored
from {DAMAGED} d join benchmark b on b.item_id = d.doc_id left join heads h using (doc_id)""",
    "unbacked_changes": f"{WRONG},\n{CHANGES} select count(*) as changes, count(*) filter (not exists (select 1 from ctok c where c.work = chg.work and c.raw = chg.replacement)) as unbacked from chg",
    "word_levels": f"""{BASE}, w as (select doc_id, work, d0, d1, b0, unnest(range(d0, d1)) as tok from runs)
select w.doc_id, w.work, w.d0, w.d1, count(*) filter (d.raw = c.raw) as literal, count(*) filter (d.raw <> c.raw) as folded
from w join dtok d on d.doc_id = w.doc_id and d.tok = w.tok join ctok c on c.work = w.work and c.pos = w.tok - w.d0 + w.b0 group by w.doc_id, w.work, w.d0, w.d1""",
    "edited_findings": f"""{PLACED},\n{REFS},
f as (select sp.doc_id, sp.s as s0, sp.s, sp.e, coalesce(cast(sum(case when r.e <= sp.s then 2 else 0 end) as bigint), 0) as by_, count(*) filter (r.e > sp.s) > 0 as stale
  from sp left join ref r on r.doc_id = sp.doc_id and r.s < sp.e group by sp.doc_id, sp.s, sp.e)
select doc_id, s0, s + by_ as s, e + by_ as e, stale from f""",
    "next_chunks": f"with {CORPUS} select c.work, c.pos, least(c.pos + 5, b.p1) as chunk_end from ctok c join bounds b using (work, unit)",
    "gold_findings": f"{BASE},\n{GOLD} select doc_id, g0, g1, gold_work, f.d0 as d0, f.d1 as d1, f.work as work from graded",
    "gold_summary": f"""{BASE},\n{GOLD}, n as (select case when f is null then 'missed' when f.work = gold_work then 'right' else 'other_place' end as grade, count(*) as n from graded group by 1)
select grade, n, round(n * 1.0 / (select sum(n) from n), 6) as share from n""",
    "false_per_10k": f"""{BASE},
zipf as (select fold, round(log10(1e9 * count(*) / (select count(*) from dtok)), 6) as z from dtok group by fold),
cp as (select work, unit, fold, lead(fold) over (partition by work order by pos) as next_fold from ctok),
known as (select fold, next_fold from cp where next_fold is not null group by fold, next_fold having count(distinct (work, unit)) <= 4),
good as (select k.* from known k left join zipf a on a.fold = k.fold left join zipf b on b.fold = k.next_fold
  where least(coalesce(a.z, 0), coalesce(b.z, 0)) <= 4.5 and greatest(coalesce(a.z, 0), coalesce(b.z, 0)) <= 6.0),
dp as (select doc_id, tok, fold, lead(fold) over (partition by doc_id order by tok) as next_fold from dtok),
isl as (select dp.doc_id, tok, tok - row_number() over (partition by doc_id order by tok) as island from dp join good using (fold, next_fold)),
hits as materialized (select doc_id, tok from isl qualify row_number() over (partition by doc_id, island order by tok) % 2 = 1),
o as (select h.doc_id, h.tok, not exists (select 1 from runs r where r.doc_id = h.doc_id and r.d0 < h.tok + 2 and h.tok < r.d1) as outside from hits h),
n as (select doc_id, count(*) as hits, count(*) filter (outside) as outside from o group by doc_id)
select d.lang, coalesce(cast(sum(n.hits) as bigint), 0) as hits, coalesce(cast(sum(n.outside) as bigint), 0) as outside, round(10000.0 * coalesce(sum(n.outside), 0) / sum(length(d.text)), 6) as per_10k
from documents d left join n using (doc_id) group by d.lang""",
    "paired_runs": f"{BASE} select doc_id, work, d0, d1, mass, case when rarest <= 2 and mass >= 9 then 'kept' else 'missing' end as \"with\" from runs",
    "residual_pairs": f"""{BASE} select d.fold as written, c.fold as source, count(*) as n from runs r join dtok d on d.doc_id = r.doc_id and d.tok = r.d1 join ctok c on c.work = r.work and c.pos = r.b1
group by 1, 2 order by n desc, written, source limit 40""",
    "coverage_share": f"""{BASE}, w as (select distinct doc_id, unnest(range(d0, d1)) as tok from runs), k as (select doc_id, count(*) as covered from w group by doc_id),
n as (select doc_id, count(*) as n from dtok group by doc_id)
select d.lang, coalesce(cast(sum(n.n) as bigint), 0) as words, coalesce(cast(sum(k.covered) as bigint), 0) as covered, round(coalesce(sum(k.covered), 0) * 1.0 / sum(n.n), 9) as share
from documents d left join n using (doc_id) left join k using (doc_id) group by d.lang""",
    "distinct_in_order": f"""with t as (select conv_id, turn, list_transform(regexp_extract_all(text, '{TOKEN}'), lambda x: lower(x)) as l from conversations)
select conv_id, turn, array_to_string(list_transform(list_filter(list_zip(l, range(1, len(l) + 1)), lambda p: list_position(l, p[1]) = p[2]), lambda p: p[1]), ' ') as words from t""",
    "densest_runs": f"""{BASE}, p as (select doc_id, tok from dtok where fold in (select fold from vocab where df <= 2)),
b as (select *, case when tok - lag(tok) over (partition by doc_id order by tok) <= 3 then 0 else 1 end as new from p),
r as (select *, sum(new) over (partition by doc_id order by tok) as run from b),
g as (select doc_id, min(tok) as first, max(tok) as last, count(*) as n from r group by doc_id, run)
select doc_id, first, last, n from g qualify row_number() over (partition by doc_id order by n desc, first) = 1""",
    "source_counters": f"""{PLACED},\n{MARKS},
k as (select doc_id, case when exists (select 1 from m where m.doc_id = sp.doc_id and m.s < sp.e and sp.s < m.e) then 'both' else 'phrase' end as k from sp
  union all select doc_id, 'marked' from m where not exists (select 1 from sp where sp.doc_id = m.doc_id and m.s < sp.e and sp.s < m.e))
select d.lang, count(*) filter (k = 'both') as both, count(*) filter (k = 'phrase') as phrase, count(*) filter (k = 'marked') as marked from k join documents d using (doc_id) group by d.lang""",
    "aligned_blocks": f"""{BASE}, met as (select d.doc_id, c.work, d.tok, d.tok - c.pos as diag from dtok d join ctok c on c.fold = d.fold join vocab v on v.fold = c.fold where v.df <= 3),
b as (select *, case when tok - lag(tok) over (partition by doc_id, work, diag order by tok) = 1 then 0 else 1 end as new from met),
r as (select *, sum(new) over (partition by doc_id, work, diag order by tok) as block from b),
n as (select doc_id, work, diag, block, count(*) as words from r group by all)
select doc_id, work, diag, count(*) as blocks, max(words) as longest from n group by doc_id, work, diag""",
    "selected_findings": f"{PLACED} select sp.* from sp join documents d using (doc_id) where sp.s < length(string_split(d.text, chr(10))[1])",
    "export_partitions": """select user_id, case when event_type = 'error' then 'unresolved' when value >= 50 then 'approved' when value >= 20 then 'optional' when value > 0 then 'pending' else 'rejected' end as kind, count(*) as n
from events group by all""",
    "request_problems": """with p as (select event_id, concat_ws(',', case when value is null or value < 1 then 'value_low' end, case when value > 100 then 'value_high' end, case when user_id is null then 'no_user' end,
  case when event_type not in ('click', 'view', 'purchase') then 'kind' end) as problems from events) select * from p where problems <> ''""",
    "source_freshness": """with e as (select event_id, epoch_us(ts) / 1000000.0 as now, last_value(case when event_type <> 'error' then epoch_us(ts) / 1000000.0 end ignore nulls) over w as fetched,
  last_value(case when event_type = 'error' then epoch_us(ts) / 1000000.0 end ignore nulls) over w as failed from events
  window w as (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding))
select event_id, case when now - fetched <= 86400 then 'use' when not (failed is not null and now - failed < 3600) then 'refresh' when now - fetched <= 604800 then 'use_stale' else 'unavailable' end as decision from e""",
    "payload_units": """select conv_id, cast(turn as bigint) as turn, length(text) as n_chars, case when coalesce(trim(text), '') = '' then 'empty' when count(*) over (partition by conv_id) < 2 then 'incomplete' else 'none' end as problem from conversations""",
    "confirmations": f"""{BASE},\n{GOLD},\n{UNITS}, once as (select *, row_number() over (partition by doc_id, d0, d1, work, unit0 order by b0) as r from pl),
n as (select doc_id, d0, d1, work, count(*) over (partition by doc_id, d0, d1) as choices, row_number() over (partition by doc_id, d0, d1 order by work, unit0, b0) as nth from once where r = 1),
k as (select doc_id, d0, d1, work, any_value(choices) as choices from n where nth <= 4 group by doc_id, d0, d1, work)
select g.doc_id, g.g0, g.gold_work, cast(case when k.choices is null then 0 when k.choices = 1 then 1 else 2 end as bigint) as actions
from graded g left join k on k.doc_id = g.doc_id and k.d0 = g.f.d0 and k.d1 = g.f.d1 and k.work = g.gold_work where g.f is not null""",
    "unavailable_results": f"with {MARKS} select doc_id, s, 'unavailable' as status, true as needs_review from m",
    "provider_proposals": f"""with {spans_of('x', 'documents', '"[^"\\n]{2,1000}"')} select doc_id, substring(found, 2, length(found) - 2) as quote, cast(s as bigint) as at from x""",
    "label_checks": f"""{BASE},\n{GOLD}, w as (select doc_id, g0, gold_work, unnest(range(g0, g1)) as tok from gold)
select 'contained' as "check", count(*) as made, count(*) filter (d.fold <> c.fold) as failed from w join dtok d on d.doc_id = w.doc_id and d.tok = w.tok join ctok c on c.work = w.gold_work and c.pos = w.tok - w.g0
union all select 'unambiguous', count(*), count(*) filter (n > 1) from (select count(*) as n from gold group by doc_id, g0)""",
    "writer_cues": f"with {OFFSETS},\n{CUED} select doc_id, w0, w1, kind from win",
    "cue_hits": f"{BASE},\n{OFFSETS},\n{CUE_HITS} select * from hit",
    "greedy_cue_hits": f"""{BASE},\n{OFFSETS},\n{CUE_HITS}, src as (select doc_id, w0 as s, w1 as e, kind, work, matched from hit),
{greedy('src', "case when kind = 'lead_in' then 0 else 1 end, -matched, s, e")} select * from kept""",
    "reconciled_cues": f"""{BASE},\n{OFFSETS},\n{CUE_HITS}, h as (select * from hit where matched >= 3 or (kind = 'lead_in' and mass >= 6))
select h.doc_id, w0, w1, kind, h.work, d0, d1, case when d0 is null then 'alone' when w0 = d0 and w1 = d1 then 'same' when w0 >= d0 and w1 <= d1 then 'narrower' when w0 <= d0 and w1 >= d1 then 'wider' else 'shifted' end as relation,
  coalesce(h.work = r.work, false) as same_work from h left join runs r on r.doc_id = h.doc_id and r.d0 < h.w1 and h.w0 < r.d1""",
    "unmarked_cues": f"""with {OFFSETS},\n{CUED},\n{MARKS},
c as (select w.doc_id, w.kind, a.start as s, z."end" as e from win w join doff a on a.doc_id = w.doc_id and a.tok = w.w0 join doff z on z.doc_id = w.doc_id and z.tok = w.w1 - 1)
select doc_id, kind, count(*) as n from c where not exists (select 1 from m where m.doc_id = c.doc_id and m.s < c.e and c.s < m.e) group by doc_id, kind""",
    "announced_runs": f"""{BASE} select r.doc_id, r.work, r.d0, r.d1, t.fold as before, coalesce(t.fold in ('the', 'that', 'which', 'for', 'der', 'la'), false) as announced
from runs r left join dtok t on t.doc_id = r.doc_id and t.tok = r.d0 - 1""",
    "suggest_triggers": f"{TRIGGER} select doc_id, trigger, places, trigger <> 'none' and places > 0 and places <= 4 as passes from t",
    "suggest_insertions": f"""with {CORPUS},\n{DOC}, c3 as (select fold as a, lead(fold, 1) over w as x, lead(fold, 2) over w as b from ctok window w as (partition by work order by pos)),
k as (select a, b, min(x) as inserted, count(*) as places from c3 where b is not null and a in (select fold from vocab where df <= 3) group by a, b),
t as (select doc_id, tok, fold as a, lead(fold) over (partition by doc_id order by tok) as b from dtok)
select doc_id, tok, a, b, inserted, places from t join k using (a, b)""",
    "suggest_crosstab": f"""{TRIGGER} select d.lang, count(*) filter (trigger = 'opener') as opener, count(*) filter (trigger = 'cue') as cue, count(*) filter (trigger = 'distinct') as "distinct", count(*) filter (trigger = 'none') as "none"
from t join documents d using (doc_id) group by d.lang""",
    "checked_spans": f"""with {CORPUS},\n{MARKS}, w as (select doc_id, s, list_transform(regexp_extract_all(found, '{TOKEN}'), lambda x: lower(x)) as words from m),
st as (select fold, list(fold) over (partition by work order by pos rows between current row and 59 following) as ahead from ctok),
n as (select w.doc_id, w.s, len(w.words) as n_words, count(st.ahead) as places from w left join st on st.fold = w.words[1] and st.ahead[1:len(w.words)] = w.words where len(w.words) <= 60 group by all)
select *, case when places = 0 then 'difference' when places = 1 and n_words >= 3 then 'matched' else 'uncertain' end as status from n""",
    "capped_findings": f"""{BASE}, r as (select distinct doc_id, d0, d1 from runs), n as (select *, row_number() over (partition by doc_id order by d0, d1) as nth, count(*) over (partition by doc_id) as n from r),
c as (select *, min(case when nth > 2 then d0 end) over (partition by doc_id) as cut_at from n) select doc_id, d0, d1, n - least(n, 2) as hidden, cut_at from c where nth <= 2""",
    "source_status": """with e as (select user_id, event_type, epoch_us(ts) / 1000000.0 as t from events),
s as (select user_id, max(case when event_type <> 'error' then t end) as fetched, max(case when event_type = 'error' then t end) as failed from e group by user_id),
a as (select *, round((select max(t) from e) - fetched, 3) as age from s)
select user_id, fetched is not null as loaded, age, coalesce(age > 86400, false) as stale, coalesce(failed > fetched, failed is not null) as error from a""",
    "preview_segments": f"""with {REFS}, k as (select doc_id, s, e, 'changed' as kind from ref
  union all select doc_id, coalesce(lag(e) over (partition by doc_id order by s), 0), s, 'kept' from ref
  union all select d.doc_id, coalesce(max(r.e), 0), length(any_value(d.text)), 'kept' from documents d left join ref r using (doc_id) group by d.doc_id)
select doc_id, kind, count(*) as segments, cast(sum(e - s) as bigint) as chars from k where e > s group by doc_id, kind""",
}
