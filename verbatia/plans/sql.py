"""DuckDB SQL of the registered queries; shared parts are common table expressions."""

from __future__ import annotations

TOKEN = r"[\p{L}\p{M}]+"


def tokens_of(name: str, table: str, key: str) -> str:
    """Tokens of a table's texts: (key, tok, raw, fold)."""
    return f"""{name} as (
  select {key}, i - 1 as tok, l[i] as raw, lower(l[i]) as fold
  from (select {key}, regexp_extract_all(text, '{TOKEN}') as l from {table}) x, unnest(range(1, len(l) + 1)) as t(i))"""


CORPUS = f"""ctok0 as (
  select item_id as work, i - 1 as pos, l[i] as raw, lower(l[i]) as fold,
         case when i > 1 and regexp_matches(g[i], '[.!?\\n]') then 1 else 0 end as ends
  from (select item_id, regexp_extract_all(text, '{TOKEN}') as l, regexp_split_to_array(text, '{TOKEN}') as g from benchmark) x,
       unnest(range(1, len(l) + 1)) as t(i)),
ctok as (select work, pos, raw, fold, sum(ends) over (partition by work order by pos) as unit from ctok0),
bounds as (select work, unit, min(pos) as p0, max(pos) + 1 as p1 from ctok group by work, unit),
n_units as (select count(*) as n from bounds),
vocab as (
  select fold, count(distinct (work, unit)) as df, ln(cast((select n from n_units) as double) / count(distinct (work, unit))) as idf
  from ctok group by fold)"""


def runs(tokens: str, key: str = "doc_id", name: str = "runs", seed_df: int = 4, words: int = 3) -> str:
    """Maximal runs of three words or more: only diagonals that hold three words in a row, one of them rare, are laid out."""
    ahead = lambda k, at: f"lead(fold, 1) over (partition by {k} order by {at}) as f1, lead(fold, 2) over (partition by {k} order by {at}) as f2"
    return f"""{name}_rare as (select fold from vocab where df <= {seed_df}),
{name}_work as materialized (
  select * from (select work, pos, fold, {ahead('work', 'pos')} from ctok) g
  where fold in (select fold from {name}_rare) or f1 in (select fold from {name}_rare) or f2 in (select fold from {name}_rare)),
{name}_said as materialized (select {key} as doc_id, tok, fold, {ahead(key, 'tok')} from {tokens}),
{name}_diag as materialized (select distinct d.doc_id, c.work, d.tok - c.pos as diag from {name}_said d join {name}_work c on d.fold = c.fold and d.f1 = c.f1 and d.f2 = c.f2),
{name}_laid as materialized (select k.doc_id, k.work, k.diag, c.pos, c.pos + k.diag as tok, c.fold from {name}_diag k join ctok c on c.work = k.work),
{name}_met as materialized (
  select l.*, v.idf, v.df from {name}_laid l join {name}_said d on d.doc_id = l.doc_id and d.tok = l.tok and d.fold = l.fold join vocab v on v.fold = l.fold),
{name}_isl as (select *, tok - row_number() over (partition by doc_id, work, diag order by tok) as island from {name}_met),
{name} as (
  select doc_id, work, min(tok) as d0, max(tok) + 1 as d1, min(pos) as b0, max(pos) + 1 as b1, count(*) as words,
         round(sum(idf), 6) as mass, min(df) as rarest
  from {name}_isl group by doc_id, work, diag, island
  having count(*) >= {words} and min(df) <= {seed_df})"""


DOC = tokens_of("dtok", "documents", "doc_id")
TURN = tokens_of("ttok", "(select conv_id * 1000 + turn as doc_id, text from conversations)", "doc_id")
#: Shared parts are derived once.
BASE = f"with recursive {CORPUS},\n{DOC},\n{runs('dtok')}".replace("ctok as (", "ctok as materialized (").replace("dtok as (", "dtok as materialized (").replace("runs as (", "runs as materialized (")
TIER = "case when mass < 6.0 then 'hidden' when (words >= 4 and mass >= 12.0) or (words >= 5 and mass >= 9.0) then 'candidate' else 'possible' end"


def greedy(source: str, order: str, name: str = "kept") -> str:
    """Greedy disjoint choice as a recursion over each document's ranks; source has doc_id, s, e."""
    return f"""ranked as materialized (select *, row_number() over (partition by doc_id order by {order}) as rn from {source}),
walk as (
  select doc_id, rn, [{{'s': s, 'e': e}}] as taken, true as stays from ranked where rn = 1
  union all
  select r.doc_id, r.rn,
         case when len(list_filter(w.taken, lambda k: k.s < r.e and r.s < k.e)) = 0 then list_append(w.taken, {{'s': r.s, 'e': r.e}}) else w.taken end,
         len(list_filter(w.taken, lambda k: k.s < r.e and r.s < k.e)) = 0
  from walk w join ranked r on r.doc_id = w.doc_id and r.rn = w.rn + 1),
{name} as (select r.* exclude (rn) from ranked r join walk w on r.doc_id = w.doc_id and r.rn = w.rn and w.stays)"""


def spans_of(name: str, table: str, pattern: str, key: str = "doc_id") -> str:
    """Matches of a pattern with offsets: (key, n, s, e, found)."""
    return f"""{name}_l as (
  select {key}, regexp_extract_all(text, '{pattern}') as l, regexp_split_to_array(text, '{pattern}') as g from {table}
  where regexp_matches(text, '{pattern}')),
{name}_r as (select {key}, i - 1 as n, l[i] as found, length(g[i]) + length(l[i]) as step from {name}_l, unnest(range(1, len(l) + 1)) as t(i)),
{name} as (
  select {key}, n, found, sum(step) over (partition by {key} order by n) - length(found) as s, sum(step) over (partition by {key} order by n) as e
  from {name}_r)"""


OFFSETS = f"""doff0 as (
  select doc_id, i - 1 as tok, l[i] as raw, g[i] as gap, length(g[i]) + length(l[i]) as step
  from (select doc_id, regexp_extract_all(text, '{TOKEN}') as l, regexp_split_to_array(text, '{TOKEN}') as g from documents) x,
       unnest(range(1, len(l) + 1)) as t(i)),
doff as materialized (
  select doc_id, tok, raw, gap, cast(sum(step) over (partition by doc_id order by tok) - length(raw) as bigint) as start,
         cast(sum(step) over (partition by doc_id order by tok) as bigint) as "end" from doff0)"""

MARKED = r'"[^"\n]{1,1000}"|«[^»\n]{1,1000}»|\{[^}\n]{1,1000}\}'
NUMERIC = r"[0-9]{1,3}[:.][0-9]{1,3}(?:-[0-9]{1,3})?"
EPOCH = "epoch_us(ts) / 1000000.0"

def edit_counts(pairs: str) -> str:
    """Least edit scripts of ``pairs`` (item_id, a, b: lists of words): tables of distances row by row, then the way back."""
    return f"""{pairs},
dist as (
  select item_id, 0 as i, cast(range(0, len(b) + 1) as bigint[]) as line, a, b from pairs
  union all
  select item_id, i + 1, [list_min(least_to[1:j + 1]) + j for j in range(0, len(b) + 1)], a, b
  from (select *, list_concat([cast(i + 1 as bigint)], [least(line[j] + case when a[i + 1] = b[j] then 0 else 1 end, line[j + 1] + 1) - j for j in range(1, len(b) + 1)]) as least_to
        from dist where i < len(a)) x),
tables as (select item_id, a, b, list(line order by i) as d from dist group by item_id, a, b),
back as (
  select item_id, cast(len(a) as bigint) as i, cast(len(b) as bigint) as j, 0 as equal, 0 as substituted, 0 as deleted, 0 as inserted from tables
  union all
  select item_id, i - case when k < 3 then 1 else 0 end, j - case when k <> 2 then 1 else 0 end,
         equal + case when k = 0 then 1 else 0 end, substituted + case when k = 1 then 1 else 0 end, deleted + case when k = 2 then 1 else 0 end, inserted + case when k = 3 then 1 else 0 end
  from (select w.*, case when i > 0 and j > 0 and d[i + 1][j + 1] = d[i][j] + case when a[i] = b[j] then 0 else 1 end then case when a[i] = b[j] then 0 else 1 end
                         when i > 0 and d[i + 1][j + 1] = d[i][j + 1] + 1 then 2 else 3 end as k
        from back w join tables t using (item_id) where i > 0 or j > 0) x),
scripts as (select item_id, equal, substituted, deleted, inserted from back where i = 0 and j = 0)"""


DAMAGED = r"regexp_replace(regexp_replace(regexp_replace(text, '\bthe\b ?', '', 'g'), '\band\b', 'ant', 'g'), '\bof\b', 'of of', 'g')"
READ = rf"regexp_extract_all({DAMAGED}, '\S+')"
SAID = r"regexp_extract_all(text, '\S+')"

ORACLE: dict[str, str] = {
    "word_errors": f"with recursive {edit_counts(f'pairs as (select item_id, {SAID} as a, {READ} as b from benchmark)')} select * from scripts",
    "pooled_error_rates": f"""with recursive {edit_counts(f"pairs as (select item_id, {SAID} as a, case when item_id % 10 <> 9 then {READ} else [] end as b from benchmark)")},
e as (select case when length(text) < 220 then 'short' else 'long' end as kind, s.* from scripts s join benchmark using (item_id))
select kind, cast(sum(equal + substituted + deleted) as bigint) as n_words, cast(sum(substituted + deleted + inserted) as bigint) as n_wrong,
       round(sum(substituted + deleted + inserted) / sum(equal + substituted + deleted), 6) as wer
from e group by grouping sets ((), (kind))""",
    "token_stats": f"with {DOC} select d.lang, count(*) as n_tokens, count(distinct fold) as n_distinct from dtok t join documents d using (doc_id) group by d.lang",
    "vocab_idf": f"with {CORPUS} select fold, df, round(idf, 6) as idf from vocab",
    "unit_bounds": f"with {CORPUS} select work, cast(unit as bigint) as unit, p0, p1 from bounds",
    "corpus_pairs": f"""with {CORPUS}, p as (select work, unit, fold, lead(fold) over (partition by work order by pos) as next_fold from ctok)
select fold, next_fold, count(*) as n, count(distinct (work, unit)) as units from p where next_fold is not null group by fold, next_fold""",
    "token_offsets": f'with {OFFSETS} select doc_id, count(*) as n, cast(sum(start) as bigint) as sum_start, cast(sum("end") as bigint) as sum_end, max("end") as last_end from doff group by doc_id',
    "segments": f"""with {OFFSETS}, b as (select doc_id, tok, case when tok > 0 and regexp_full_match(gap, '[ \\t,;]*') then 0 else 1 end as brk from doff),
g as (select doc_id, tok, sum(brk) over (partition by doc_id order by tok) - 1 as seg from b),
s as (select doc_id, seg, count(*) as n from g group by doc_id, seg)
select doc_id, count(*) as n_segments, max(n) as longest from s group by doc_id""",
    "exact_runs": f"{BASE} select * from runs",
    "phrase_tiers": f"{BASE} select doc_id, work, d0, d1, words, mass, {TIER} as tier from runs",
    "greedy_spans": f"{BASE}, src as (select doc_id, work, d0 as s, d1 as e, mass from runs),\n{greedy('src', '-mass, s, e, work')} select doc_id, work, s, e, mass from kept",
    "conversation_audit": f"with {CORPUS},\n{TURN},\n{runs('ttok')} select doc_id, work, d0, d1, words, mass, {TIER} as tier from runs",
    "prose_zipf": f"with {DOC} select fold, count(*) as n, round(log10(1e9 * count(*) / (select count(*) from dtok)), 6) as zipf from dtok group by fold",
    "pair_hits": f"""with {CORPUS},\n{DOC},
zipf as (select fold, round(log10(1e9 * count(*) / (select count(*) from dtok)), 6) as z from dtok group by fold),
cp as (select work, unit, fold, lead(fold) over (partition by work order by pos) as next_fold from ctok),
known as (select fold, next_fold, count(distinct (work, unit)) as units from cp where next_fold is not null group by fold, next_fold having count(distinct (work, unit)) <= 4),
good as (
  select k.* from known k left join zipf a on a.fold = k.fold left join zipf b on b.fold = k.next_fold
  where least(coalesce(a.z, 0), coalesce(b.z, 0)) <= 4.5 and greatest(coalesce(a.z, 0), coalesce(b.z, 0)) <= 6.0),
dp as (select doc_id, tok, fold, lead(fold) over (partition by doc_id order by tok) as next_fold from dtok),
hits as (select dp.*, units from dp join good using (fold, next_fold)),
isl as (select *, tok - row_number() over (partition by doc_id order by tok) as island from hits),
nth as (select *, row_number() over (partition by doc_id, island order by tok) as nth from isl)
select doc_id, tok, fold, next_fold, units from nth where nth % 2 = 1""",
    "overlap_join": f"""{BASE}, para as (
  select doc_id, seg, min(tok) as s2, max(tok) + 1 as e2 from (
    select doc_id, tok, sum(case when contains(gap, chr(10)) then 1 else 0 end) over (partition by doc_id order by tok) as seg
    from (select doc_id, i - 1 as tok, g[i] as gap from (select doc_id, regexp_extract_all(text, '{TOKEN}') as l, regexp_split_to_array(text, '{TOKEN}') as g from documents) x, unnest(range(1, len(l) + 1)) as t(i)))
  group by doc_id, seg)
select r.doc_id, r.work, r.d0, r.d1, cast(p.seg as bigint) as paragraph, least(r.d1, p.e2) - greatest(r.d0, p.s2) as shared
from runs r join para p on r.doc_id = p.doc_id and r.d0 < p.e2 and p.s2 < r.d1""",
    "hidden_phrases": f"""{BASE}, t as (select *, case when mass < 14.0 then 'hidden' else 'shown' end as tier from runs)
select h.doc_id, count(*) as n_hidden from t h where h.tier = 'hidden'
  and not exists (select 1 from t k where k.tier <> 'hidden' and k.doc_id = h.doc_id and k.d0 < h.d1 and h.d0 < k.d1) group by h.doc_id""",
    "boundary_status": f"""{BASE},\n{OFFSETS},
s1 as materialized (select r.*, o.gap as before from runs r join doff o on o.doc_id = r.doc_id and o.tok = r.d0),
s2 as materialized (select r.*, x.gap as after from s1 r left join doff x on x.doc_id = r.doc_id and x.tok = r.d1),
s3 as materialized (select r.*, b.p0 as at_start from s2 r left join bounds b on b.work = r.work and b.p0 = r.b0),
s4 as materialized (select r.*, b.p1 as at_end from s3 r left join bounds b on b.work = r.work and b.p1 = r.b1)
select doc_id, work, d0, d1,
  case when at_start is not null then 'unit_start' when d0 = 0 then 'text_start' when regexp_matches(before, '[.!?:;\\n]') then 'punctuation' else 'uncertain' end as start_status,
  case when at_end is not null then 'unit_end' when after is null then 'text_end' when regexp_matches(after, '[.!?:;\\n]') then 'punctuation' else 'uncertain' end as end_status
from s4""",
    "diagonal_votes": f"""with {CORPUS},\n{DOC},
met as (select d.doc_id, c.work, d.tok - c.pos as diag, v.idf from dtok d join ctok c on d.fold = c.fold join vocab v on v.fold = c.fold where v.df <= 3),
votes as (select doc_id, work, diag, round(sum(idf + 0.1), 6) as votes from met group by doc_id, work, diag),
smooth as (select *, round(sum(votes) over (partition by doc_id, work order by diag range between 2 preceding and 2 following), 6) as smoothed from votes),
blocks as (select *, row_number() over (partition by doc_id, work, floor(diag / 4.0) order by smoothed desc, diag) as in_block from smooth),
places as (select *, row_number() over (partition by doc_id order by smoothed desc, work, diag) as place from blocks where in_block = 1)
select doc_id, work, diag, votes, smoothed, place from places where place <= 3""",
    "marked_spans": f"with {spans_of('m', 'documents', MARKED)} select doc_id, cast(s as bigint) as s, cast(e as bigint) as e, found from m where len(regexp_extract_all(found, '{TOKEN}')) >= 2",
    "numeric_references": f"""with {spans_of('m', 'documents', NUMERIC)},
p as (select *, cast(regexp_extract(found, '([0-9]+)[:.]([0-9]+)(?:-([0-9]+))?', 1) as int) as chapter, cast(regexp_extract(found, '([0-9]+)[:.]([0-9]+)(?:-([0-9]+))?', 2) as int) as verse,
  nullif(regexp_extract(found, '([0-9]+)[:.]([0-9]+)(?:-([0-9]+))?', 3), '') as l from m)
select doc_id, cast(s as bigint) as s, cast(e as bigint) as e, found, chapter, verse, coalesce(cast(l as int), verse) as last,
  case when coalesce(cast(l as int), verse) < verse then 'reversed' when chapter = 0 or verse = 0 then 'zero' else 'none' end as problem from p""",
    "asof_reference": f"""{BASE},\n{OFFSETS},\n{spans_of('m', 'documents', NUMERIC)},
sp as (select r.doc_id, r.work, a.start as s, z."end" as e from runs r join doff a on a.doc_id = r.doc_id and a.tok = r.d0 join doff z on z.doc_id = r.doc_id and z.tok = r.d1 - 1)
select sp.doc_id, sp.work, sp.s, sp.e,
  (select min_by(m.found, m.s) from m where m.doc_id = sp.doc_id and m.s >= sp.e and m.s <= sp.e + 400) as after,
  (select max_by(m.found, m.e) from m where m.doc_id = sp.doc_id and m.e <= sp.s and m.e >= sp.s - 600) as before
from sp""",
    "cue_windows": f"""{BASE},\n{OFFSETS},
w as (select r.doc_id, r.work, r.d0, r.d1, lower(regexp_extract(substring(d.text, cast(greatest(0, o.start - 70) + 1 as bigint), cast(o.start - greatest(0, o.start - 70) as bigint)), '[^.!?\\n]*$')) as seen
  from runs r join doff o on o.doc_id = r.doc_id and o.tok = r.d0 join documents d on d.doc_id = r.doc_id)
select doc_id, work, d0, d1, case when regexp_matches(seen, '(^|[^a-z])(that|which)([^a-z]|$)') then 'yes' when regexp_matches(seen, '(^|[^a-z])(for|with)([^a-z]|$)') then 'no' else 'none' end as cue from w""",
    "merge_candidates": f"""{BASE},\n{OFFSETS},\n{spans_of('m', 'documents', MARKED)},
src as (
  select doc_id, s, e, 'marked' as source, 0 as priority from m where len(regexp_extract_all(found, '{TOKEN}')) >= 2
  union all
  select distinct r.doc_id, a.start, z."end", 'phrase', 1 from runs r join doff a on a.doc_id = r.doc_id and a.tok = r.d0 join doff z on z.doc_id = r.doc_id and z.tok = r.d1 - 1),
{greedy('src', 'priority, s, s - e')} select doc_id, cast(s as bigint) as s, cast(e as bigint) as e, source from kept""",
    "audit_stats": f"""{BASE}, t as (select *, {TIER} as tier from runs)
select d.doc_id, count(t.work) as n_runs, count(*) filter (t.tier = 'candidate') as n_candidate, count(*) filter (t.tier = 'possible') as n_possible,
  count(*) filter (t.tier = 'hidden') as n_hidden, count(distinct t.work) as n_works, coalesce(cast(sum(t.words) as bigint), 0) as n_words, coalesce(max(t.mass), 0) as best_mass
from documents d left join t on t.doc_id = d.doc_id group by d.doc_id""",
    "suggest_next": f"""with {CORPUS},\n{DOC},
n as (select doc_id, count(*) as n from dtok group by doc_id having count(*) >= 2),
tails as (select n.doc_id, a.fold as f0, b.fold as f1 from n join dtok a on a.doc_id = n.doc_id and a.tok = n.n - 2 join dtok b on b.doc_id = n.doc_id and b.tok = n.n - 1),
g as (select work, pos as p0, fold as g0, lead(fold, 1) over w as g1, lead(fold, 2) over w as w2, lead(fold, 3) over w as w3, lead(fold, 4) over w as w4 from ctok window w as (partition by work order by pos)),
met as (select doc_id, work, p0, concat_ws(' ', w2, w3, w4) as next, count(*) over (partition by doc_id) as places, row_number() over (partition by doc_id order by work, p0) as r
  from tails join g on f0 = g0 and f1 = g1 where w2 is not null)
select doc_id, work, p0, next, places, places > 1 as ambiguous from met where r <= 4""",
    "apply_changes": f"""with {spans_of('m', 'documents', NUMERIC)},
parts as (select m.doc_id, m.s, substring(d.text, cast(coalesce(lag(m.e) over w, 0) + 1 as bigint), cast(m.s - coalesce(lag(m.e) over w, 0) as bigint)) || '[' || m.found || ']' as piece, m.e
  from m join documents d using (doc_id) window w as (partition by m.doc_id order by m.s)),
heads as (select doc_id, string_agg(piece, '' order by s) as head, max(e) as e, count(*) as n from parts group by doc_id)
select d.doc_id, md5(case when h.n is null then d.text else h.head || substring(d.text, cast(h.e + 1 as bigint)) end) as text_md5, coalesce(h.n, 0) as n
from documents d left join heads h using (doc_id)""",
    "grade_grouping_sets": f"""{BASE}, f as (select d.doc_id, d.lang, l.quality, cast(exists (select 1 from runs r where r.doc_id = d.doc_id) as int) as hit from documents d join labels l using (doc_id))
select lang, quality, count(*) as n, cast(sum(hit) as bigint) as n_hit, round(sum(hit) * 1.0 / count(*), 6) as rate from f group by grouping sets ((), (lang), (quality))""",
    "compare_runs": f"""{BASE}, a as (select doc_id, work, max(mass) as m from runs where mass >= 6 group by doc_id, work), b as (select doc_id, work, max(mass) as m from runs where words >= 4 group by doc_id, work)
select coalesce(a.doc_id, b.doc_id) as doc_id, coalesce(a.work, b.work) as work, a.m as before, b.m as after,
  case when a.m is null then 'gained' when b.m is null then 'lost' when a.m = b.m then 'same' else 'changed' end as status
from a full join b on a.doc_id = b.doc_id and a.work = b.work""",
    "label_rates": f"""{BASE}, f as (select l.quality, l.toxic, (select count(*) from runs r where r.doc_id = l.doc_id) as n_runs, length(d.text) as chars from labels l join documents d using (doc_id))
select quality, toxic, count(*) as n_docs, cast(sum(n_runs) as bigint) as n_runs, round(10000.0 * sum(n_runs) / sum(chars), 6) as per_10k from f group by quality, toxic""",
    "request_rate": f"select event_id, user_id, count(*) over (partition by user_id order by {EPOCH} range between 86400 preceding and current row) as n_window from events",
    "rate_limiter": f"""with recursive o as (select user_id, event_id, {EPOCH} as t, row_number() over (partition by user_id order by ts, event_id) as rn from events),
w as (
  select user_id, event_id, rn, [t] as recent, true as accepted from o where rn = 1
  union all
  select o.user_id, o.event_id, o.rn,
    case when len(list_filter(w.recent, lambda x: o.t - x <= 86400)) < 3 then list_append(list_filter(w.recent, lambda x: o.t - x <= 86400), o.t) else list_filter(w.recent, lambda x: o.t - x <= 86400) end,
    len(list_filter(w.recent, lambda x: o.t - x <= 86400)) < 3
  from w join o on o.user_id = w.user_id and o.rn = w.rn + 1)
select user_id, event_id, accepted from w""",
    "call_tracker": """select event_id, user_id, count(*) over w as calls, cast(sum(case when event_type <> 'error' then 1 else 0 end) over w as bigint) as ok,
  cast(sum(case when event_type = 'error' then 1 else 0 end) over w as bigint) as failed,
  last_value(case when event_type = 'error' then event_id end ignore nulls) over w as last_failure
from events window w as (partition by user_id order by ts, event_id rows between unbounded preceding and current row)""",
    "cooldown_skips": f"""with recursive o as (select user_id, event_id, {EPOCH} as t, event_type <> 'error' as ok, row_number() over (partition by user_id order by ts, event_id) as rn from events),
w as (
  select user_id, event_id, rn, false as skipped, case when ok then -1e18 else t + 43200 end as until from o where rn = 1
  union all
  select o.user_id, o.event_id, o.rn, o.t < w.until, case when o.t < w.until then w.until when o.ok then -1e18 else o.t + 43200 end
  from w join o on o.user_id = w.user_id and o.rn = w.rn + 1)
select user_id, event_id, skipped from w""",
    "latency_ranks": """with r as (select event_type, value, row_number() over (partition by event_type order by value) as r, count(*) over (partition by event_type) as n from events)
select event_type, max(case when r = greatest(1, least(n, cast(round_even(50 / 100.0 * n + 0.5, 0) as bigint))) then value end) as p50,
  max(case when r = greatest(1, least(n, cast(round_even(95 / 100.0 * n + 0.5, 0) as bigint))) then value end) as p95 from r group by event_type""",
    "cost_summary": "select event_type, count(*) as n, round(sum(value), 4) as total, round(avg(value), 6) as mean, median(value) as median, max(value) as most from events group by event_type",
    "resume_calls": """select user_id, event_id, event_type from (
  select *, row_number() over (partition by user_id order by case when event_type <> 'error' then 0 else 1 end, ts, event_id) as r from events) where r = 1""",
    "carry_decisions": """with a as (select *, row_number() over (partition by user_id, event_type order by event_id) as nth from events where event_id % 2 = 1),
b as (select *, row_number() over (partition by user_id, event_type order by event_id) as nth from events where event_id % 2 = 0)
select a.event_id, a.user_id, a.event_type, b.value as decision from a left join b using (user_id, event_type, nth)""",
    "harm_check": f"{BASE}, seeded as (select * from runs where mass >= 6 and rarest <= 2) select * from runs except all select * from seeded",
    "page_text": """select page_id, md5(t) as text_md5, length(t) as n_chars from (select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\\b.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \\t\\r\\n]+', ' ', 'g')) as t from pages)""",
    "privacy_scrub": "select doc_id, md5(regexp_replace(text, '\\p{L}{13,}', '[removed]', 'g')) as text_md5 from documents",
    "line_counts": f"with {OFFSETS} select o.doc_id, max(len(regexp_extract_all(substring(d.text, 1, o.start), '\\n')) + 1) as last_line from doff o join (select doc_id, max(tok) as tok from doff group by doc_id) z on o.doc_id = z.doc_id and o.tok = z.tok join documents d on d.doc_id = o.doc_id group by o.doc_id",
    "checksums": "select doc_id, sha256(text) as sha256 from documents",
    "character_errors": """with b as (select item_id, regexp_replace(text, '[^ -~]', '', 'g') as text from benchmark)
select a.item_id, b.item_id as next_item, levenshtein(a.text, b.text) as distance, length(a.text) as n_chars, round(levenshtein(a.text, b.text) * 1.0 / length(a.text), 6) as cer
from b a join b on b.item_id = a.item_id + 1""",
    "label_violations": f"""{BASE}, k as (select r.*, x.fold as said, c.fold as source from runs r left join dtok x on x.doc_id = r.doc_id and x.tok = r.d1 left join ctok c on c.work = r.work and c.pos = r.b1)
select doc_id, work, d0, said, source, case when said is null then 'text_ends' when source is null then 'work_ends' when said = source then 'not_maximal' else 'differs' end as verdict from k""",
    "tier_pivot": f"""{BASE}, t as (select *, {TIER} as tier from runs)
select d.lang, count(*) filter (t.tier = 'candidate') as candidate, count(*) filter (t.tier = 'possible') as possible, count(*) filter (t.tier = 'hidden') as hidden
from t join documents d using (doc_id) group by d.lang""",
    "exact_occurrences": f"""with {CORPUS},
heads as (select c.work * 1000 + c.unit as quote_id, list(c.fold order by c.pos) as words from ctok c join bounds b on b.work = c.work and b.unit = c.unit where c.pos < b.p0 + 3 group by c.work, c.unit),
streams as (select work, pos as p0, list(fold) over (partition by work order by pos rows between current row and 2 following) as ahead from ctok)
select cast(quote_id as bigint) as quote_id, work, p0, p0 + len(words) as p1 from heads join streams on ahead[1] = words[1] and ahead[1:len(words)] = words""",
    "verify_quotes": f"""with {CORPUS},
heads as (select c.work * 1000 + c.unit as quote_id, c.work as ref_work, c.unit as ref_unit, list(c.fold order by c.pos) as words from ctok c join bounds b on b.work = c.work and b.unit = c.unit where c.pos < b.p0 + 3 group by c.work, c.unit),
streams as (select work, pos as p0, list(fold) over (partition by work order by pos rows between current row and 2 following) as ahead from ctok),
met as (select h.*, s.work, s.p0, s.p0 + len(words) as p1 from heads h join streams s on s.ahead[1:len(h.words)] = h.words),
placed as (select m.*, (select min(unit) from bounds b where b.work = m.work and b.p0 < m.p1 and m.p0 < b.p1) as unit0, (select max(unit) from bounds b where b.work = m.work and b.p0 < m.p1 and m.p0 < b.p1) as unit1 from met m),
fit as (select *, work = ref_work and ref_unit <= unit1 and unit0 <= ref_unit as fits from placed),
agg as (select quote_id, len(any_value(words)) as n_words, count(*) as occurrences, count(*) filter (fits) as confirmed,
  min(struct_pack(w := work, a := p0, b := p1)) filter (fits) as named, min(struct_pack(w := work, a := p0, b := p1)) as anywhere from fit group by quote_id),
pick as (select *, case when occurrences = 1 then anywhere when confirmed >= 1 then named end as chosen from agg)
select cast(quote_id as bigint) as quote_id, n_words, occurrences, confirmed,
  case when occurrences = 0 then 'difference' when confirmed >= 1 or (occurrences = 1 and n_words >= 3) then 'matched' else 'uncertain' end as status,
  chosen.w as work, chosen.a as p0, chosen.b as p1 from pick""",
    "audit_findings": f"""{BASE},\n{OFFSETS},\n{spans_of('m', 'documents', NUMERIC)},
t as (select *, {TIER} as tier from runs), shown as (select * from t where tier <> 'hidden'),
src as materialized (select doc_id, d0 as s, d1 as e, count(*) as occurrences, min(struct_pack(w := work, a := b0, b := b1)) as place, max(mass) as mass, min(tier) as tier from shown group by doc_id, d0, d1),
{greedy('src', '-mass, s, e')},
k as (select doc_id, s as d0, e as d1, occurrences, place.w as work, place.a as p0, place.b as p1, mass, tier from kept),
u as (select k.*, min(b.unit) as unit0, max(b.unit) as unit1, min(b.p0) as u0, max(b.p1) as u1 from k join bounds b on b.work = k.work and b.p0 < k.p1 and k.p0 < b.p1 group by all),
c as (select *, case when u0 = p0 and u1 = p1 then 'full' when unit0 = unit1 then 'partial' else 'multi-partial' end as coverage from u),
pl1 as materialized (select c.*, a.start as s, a.gap as before, c.d1 - 1 as d_last from c join doff a on a.doc_id = c.doc_id and a.tok = c.d0),
pl2 as materialized (select p.*, z."end" as e from pl1 p join doff z on z.doc_id = p.doc_id and z.tok = p.d_last),
pl as materialized (select p.*, x.gap as after from pl2 p left join doff x on x.doc_id = p.doc_id and x.tok = p.d1),
ref as (select *, cast(regexp_extract(found, '([0-9]+)[:.]([0-9]+)(?:-([0-9]+))?', 1) as int) as chapter, cast(regexp_extract(found, '([0-9]+)[:.]([0-9]+)(?:-([0-9]+))?', 2) as int) as verse,
  coalesce(cast(nullif(regexp_extract(found, '([0-9]+)[:.]([0-9]+)(?:-([0-9]+))?', 3), '') as int), cast(regexp_extract(found, '([0-9]+)[:.]([0-9]+)(?:-([0-9]+))?', 2) as int)) as last from m),
nr as (select pl.doc_id, pl.d0, pl.d1, min(r.s) as at from pl join ref r on r.doc_id = pl.doc_id and r.s >= pl.e and r.s <= pl.e + 40 group by all),
f as (select pl.*, r.found, r.chapter, r.verse, r.last from pl left join nr on nr.doc_id = pl.doc_id and nr.d0 = pl.d0 and nr.d1 = pl.d1 left join ref r on r.doc_id = pl.doc_id and r.s = nr.at)
select f.doc_id, f.s, f.e, substring(d.text, f.s + 1, f.e - f.s) as quote, work, p0, p1, tier, mass, coverage, occurrences,
  case when coverage = 'full' then 'unit_start' when d0 = 0 then 'text_start' when regexp_matches(before, '[.!?:;\\n]') then 'punctuation' else 'uncertain' end as start_status,
  case when coverage = 'full' then 'unit_end' when after is null then 'text_end' when regexp_matches(after, '[.!?:;\\n]') then 'punctuation' else 'uncertain' end as end_status,
  found as reference,
  case when chapter is null then 'missing' when last < verse or chapter = 0 or verse = 0 then 'incorrect' when chapter = work and verse <= unit0 and unit1 <= last then 'matched'
    when chapter = work and verse <= unit1 and unit0 <= last then 'uncertain' else 'incorrect' end as reference_status
from f join documents d on d.doc_id = f.doc_id""",
    "word_completion": f"""with {CORPUS},\n{TURN},
n as (select doc_id, max(tok) as last from ttok group by doc_id having count(*) >= 2),
tails as (select n.doc_id, a.fold, b.fold as part from n join ttok a on a.doc_id = n.doc_id and a.tok = n.last - 1 join ttok b on b.doc_id = n.doc_id and b.tok = n.last),
p as (select fold, lead(fold) over (partition by work order by pos) as next_fold from ctok),
known as (select fold, next_fold, count(*) as places from p where next_fold is not null group by fold, next_fold)
select doc_id, part, next_fold as word, places from tails join known using (fold) where starts_with(next_fold, part) and length(next_fold) > length(part)""",
    "event_windows": "select event_type, cast(epoch(date_trunc('day', ts)) as bigint) as start, count(*) as n from events group by event_type, date_trunc('day', ts)",
}
