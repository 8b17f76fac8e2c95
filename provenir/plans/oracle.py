"""SQL that computes each named query another way, for a plain SQL engine over the same tables."""

from __future__ import annotations

from provenir.functions.classes import CLASS_LABELS
from provenir.operators.export import LABELLED_EDGES, STYLES
from provenir.operators.recommend import FLOOR, LIMIT
from provenir.schema import EDGE_TYPES, NODE_KINDS, SELF_STATED
from provenir.sources import derived_log

CUSTOMER, SUPPLIER, PART, SECOND = "Q100000001", "Q200000001", "Q300000001", "Q200000002"


def _plain(sql: str) -> str:
    return sql.replace(" div ", " // ")


def _round(k: int, emptied: str) -> str:
    """Edge ends folded with one idea of what is emptied, and the stand-ins that follow."""
    return f"""
ends{k} as materialized (
  select s.seq, s.qid, s.to_qid, s.type_code, s.valid_from, s.valid_to, s.source_id, s.source_ref, s.asserted_at, s.confidence,
         coalesce(ma.canonical, s.qid) f, coalesce(mb.canonical, s.to_qid) t
  from surv s left join merges ma on s.qid = ma.local left join merges mb on s.to_qid = mb.local where s.kind in ('EDGE', 'OWNER_EDGE')),
fated{k} as materialized (
  select e.*, case when f in (select qid from {emptied}) or t in (select qid from {emptied}) then 'withdrawn'
                   when f = t and (f <> qid or t <> to_qid) then 'loop' else 'kept' end fate from ends{k} e),
named{k} as (select qid r from fated{k} where fate = 'kept' union select to_qid from fated{k} where fate = 'kept'),
standing{k} as (select * from sa where is_last or canonical in (select r from named{k})),
asof{k} as (
  select s.seq, s.canonical, arg_max(c.node_kind, c.seq) nk, arg_max(c.label, c.seq) lb
  from standing{k} s join claimed c on c.qid = s.local and c.seq < s.seq group by 1, 2),
stand{k} as materialized (
  select canonical qid, arg_min(nk, seq) kind, arg_min(lb, seq) label from asof{k}
  where canonical not in (select qid from claimed) and canonical not in (select qid from {emptied}) group by 1)"""


_WEIGHT = "case type_code " + " ".join(f"when '{t[0]}' then {t[4]}" for t in EDGE_TYPES) + " else 0.5 end"
_DIRECTED = "(" + ", ".join(f"'{t[0]}'" for t in EDGE_TYPES if t[5]) + ")"

BASE = f"""
with log as materialized ({_plain(derived_log.LOG_SQL)}),
ratings as materialized ({_plain(derived_log.RATINGS_SQL)}),
file as materialized ({_plain(derived_log.KNOWN_SQL)}),
signals as materialized ({_plain(derived_log.SIGNALS_SQL)}),
cuts as materialized (select qid, max(seq) cut from log where kind = 'RETRACT' group by qid),
surv as materialized (
  select l.* from log l left join cuts a on l.qid = a.qid left join cuts b on l.to_qid = b.qid
  where kind <> 'RETRACT' and seq >= coalesce(a.cut, -1) and seq >= coalesce(b.cut, -1)),
sa as materialized (select seq, qid as "local", to_qid canonical, seq = max(seq) over (partition by qid) is_last from surv where kind = 'SAME_AS'),
merges as materialized (select "local", canonical from sa where is_last),
claimed as materialized (select * from surv where kind in ('NODE', 'LOCAL')),
reached as materialized (select distinct s.to_qid qid from log s join cuts c on s.qid = c.qid and c.cut > s.seq where s.kind = 'SAME_AS'),
em0 as (select qid from reached where false),
{_round(0, 'em0')},
em1 as materialized (select qid from reached except select qid from claimed except select qid from stand0),
{_round(1, 'em1')},
em2 as materialized (select qid from reached except select qid from claimed except select qid from stand1),
{_round(2, 'em2')},
nodes as materialized (
  select qid, arg_max(node_kind, seq) kind, arg_max(label, seq) label, arg_max(coalesce(instance_of, ''), seq) classes from claimed group by 1
  union all select qid, kind, label, '' from stand2),
sources as materialized (
  select f, type_code, t, source_id, source_ref, min(seq) seq, arg_min(asserted_at, seq) asserted_at, arg_min(confidence, seq) confidence
  from fated2 where fate = 'kept' group by all),
alledges as materialized (
  select f from_qid, type_code, t to_qid, count(*) n_sources, count(distinct source_id) filter (where source_id <> 'owner') corroboration,
         max(cast(confidence as double)) best, bool_and(source_id like 'llm:%') guess, arg_min(source_id, seq) first_source,
         (select arg_min(valid_from, seq) from fated2 z where z.f = s.f and z.t = s.t and z.type_code = s.type_code and z.fate = 'kept' and z.valid_from is not null) valid_from,
         cast(null as date) valid_to
  from sources s group by f, type_code, t),
edges as materialized (select * from alledges where from_qid in (select qid from nodes) and to_qid in (select qid from nodes)),
half as materialized (
  select from_qid src, to_qid dst, type_code, false backwards, best, guess from edges
  union all select to_qid, from_qid, type_code, true, best, guess from edges where from_qid <> to_qid),
degrees as materialized (select n.qid, count(h.src) degree from nodes n left join half h on n.qid = h.src group by 1),
hubs as materialized (
  select n.qid, n.kind, d.degree from nodes n join degrees d using (qid) where (n.kind = 'CONCEPT' and d.degree >= 10) or list_has_any(string_split(n.classes, ' '), ['Q955824', 'Q414147', 'Q178790', 'Q1046088', 'Q829080', 'Q748019', 'Q12057459'])),
firsts as materialized (select "local", min(seq) prio, arg_max(canonical, seq) canonical from sa group by 1),
resolved as materialized (
  select coalesce(f.canonical, r.qid) qid, arg_min(r.rating, coalesce(f.prio, -1)) rating, arg_min(r.updated_at, coalesce(f.prio, -1)) updated_at
  from ratings r left join firsts f on r.qid = f.local group by 1),
known as materialized (select qid, 0 part from file union all select qid, 1 from resolved where rating >= 4 and qid not in (select qid from file)),
suppressed as (select qid from resolved where rating <= 2),
notoffered as (select qid from suppressed union select "local" from merges),
heard as (
  select coalesce(m.canonical, s.qid) qid, max(case when loved or favorited then 0.7 when play_count >= 25 then 0.6 when play_count >= 5 then 0.55 else 0.5 end) level
  from signals s left join merges m on s.qid = m.local group by 1),
interest as materialized (
  select qid, cast((rating - 1) / 4.0 as double) confidence, 'RATED' evidence from resolved
  union all select qid, cast(level as double), 'INFERRED' from heard where level > 0.5 and qid not in (select qid from resolved)),
expanded as materialized (
  select distinct case when regexp_matches(source_ref, '^wdqs:.*:Q[0-9]+$') then list_last(string_split(source_ref, ':')) else upper(string_split(source_ref, '$')[1]) end qid
  from log where kind = 'EDGE' and (regexp_matches(source_ref, '^wdqs:.*:Q[0-9]+$') or regexp_matches(source_ref, '^[Qq][0-9]+\\$'))),
members as materialized (select distinct qid from file where qid in (select qid from nodes)),
plainhalf as materialized (select distinct src, dst from half where src <> dst),
near1 as (select h.src q from plainhalf h where h.src in (select qid from members) and h.dst in (select qid from members)),
near2 as (select a.src q from plainhalf a join plainhalf b on a.dst = b.src and b.dst <> a.src where a.src in (select qid from members) and b.dst in (select qid from members)),
lonely as materialized (select qid from members where qid not in (select q from near1) and qid not in (select q from near2)),
strong as materialized (
  select src, dst, max(w) w, max(w * k) w_to from (
    select from_qid src, to_qid dst, {_WEIGHT} w, 1.0 k from edges
    union all select to_qid, from_qid, {_WEIGHT}, case when type_code in {_DIRECTED} then {SELF_STATED} else 1.0 end from edges) x where src <> dst group by 1, 2),
everyone as materialized (
  select b.dst candidate, dc.degree, a.src seed, a.dst via, dv.degree via_degree, a.w * coalesce((4 * i.confidence + 1) / 3, 1.0) w1, b.w_to w2
  from strong a join strong b on a.dst = b.src join degrees dv on dv.qid = a.dst join degrees dc on dc.qid = b.dst join nodes n on n.qid = b.dst
  left join interest i on i.qid = a.src
  where a.src in (select qid from known) and a.src in (select qid from nodes) and a.dst not in (select qid from hubs)
    and b.dst not in (select qid from known) and b.dst not in (select qid from notoffered) and n.kind in ('PERSON', 'GROUP')),
evidence as materialized (select * from everyone where degree >= {FLOOR})
"""

_EDGE = "from_qid, type_code, to_qid, n_sources, corroboration, best, valid_from, valid_to"
_DISCOUNT = {"raw": "1.0", "adamic_adar": "ln(via_degree)", "resource_allocation": "via_degree", "lift": "ln(via_degree)"}


def _scored(scorer: str, evidence: str = "evidence") -> str:
    score = f"sum(w1 * w2 / {_DISCOUNT[scorer]})" + (" / degree" if scorer == "lift" else "")
    return f"select candidate, degree, {score} score, count(distinct seed) known_reached, count(distinct via) intermediates from {evidence} group by candidate, degree"


def _ranked(scorer: str) -> str:
    return f"select row_number() over (order by round(score, 9) desc, candidate) as rank, * from ({_scored(scorer)}) s qualify rank <= {LIMIT}"


def _paths(hops: int, start: str = CUSTOMER, goal: str = SUPPLIER) -> str:
    return f""", recursive_paths as (
  with recursive walk as (
    select '{start}' cur, ['{start}'] walked, '{start}' signature, cast('infinity' as double) weakest, 0 hubs, false guess, 0 length
    union all
    select h.dst, list_append(w.walked, h.dst), w.signature || case when h.backwards then ' <-[' || h.type_code || ']- ' else ' -[' || h.type_code || ']-> ' end || h.dst,
           least(w.weakest, h.best), w.hubs + case when h.dst <> '{goal}' and h.dst in (select qid from hubs) then 1 else 0 end, w.guess or h.guess, w.length + 1
    from walk w join half h on h.src = w.cur
    where w.length < {hops} and w.cur <> '{goal}' and not list_contains(w.walked, h.dst)
      and (w.length < {hops} - 1 or h.dst = '{goal}'))
  select length, signature, weakest, hubs, guess from walk where cur = '{goal}')"""


def _path_hops(start: str, goal: str, hops: int) -> str:
    return f""", cites as (select f, type_code tc, t, string_agg(source_id || coalesce(' ' || source_ref, ''), ', ' order by seq) c from sources group by 1, 2, 3),
walks as (
  with recursive walk as (
    select '{start}' cur, ['{start}'] walked, '{start}' signature, cast('infinity' as double) weakest, 0 hubs, false guess, 0 length, cast([] as struct(a varchar, tc varchar, b varchar, back boolean)[]) steps
    union all
    select h.dst, list_append(w.walked, h.dst), w.signature || case when h.backwards then ' <-[' || h.type_code || ']- ' else ' -[' || h.type_code || ']-> ' end || h.dst,
           least(w.weakest, h.best), w.hubs + case when h.dst <> '{goal}' and h.dst in (select qid from hubs) then 1 else 0 end, w.guess or h.guess, w.length + 1, list_append(w.steps, {{'a': w.cur, 'tc': h.type_code, 'b': h.dst, 'back': h.backwards}})
    from walk w join half h on h.src = w.cur
    where w.length < {hops} and w.cur <> '{goal}' and not list_contains(w.walked, h.dst) and (w.length < {hops} - 1 or h.dst = '{goal}'))
  select *, row_number() over (order by guess, hubs, weakest desc, length, signature) as rank from walk where cur = '{goal}' qualify rank <= 50),
each as (select rank, unnest(range(len(steps))) place, unnest(steps) s from walks),
ends as (select rank, place, case when s.back then s.b else s.a end from_qid, s.tc type_code, case when s.back then s.a else s.b end to_qid, s.back backwards, s from each)
select rank, place, from_qid, type_code, to_qid, backwards, coalesce(a.label, s.a) || case when backwards then ' <-[' || type_code || ']- ' else ' -[' || type_code || ']-> ' end || coalesce(b.label, s.b) || ' [' || c || ']' line
from ends e join cites x on x.f = from_qid and x.tc = type_code and x.t = to_qid join nodes a on a.qid = s.a join nodes b on b.qid = s.b"""


def _grid_free() -> dict[str, str]:
    q = {
        "log_by_kind": "select kind, count(*) n from log group by 1",
        "nodes_fold": "select qid, kind, label, classes from nodes",
        "edges_fold": f"select {_EDGE} from edges",
        "retraction_survivors": "select kind, count(*) n from surv group by 1",
        "merge_map": "select * from merges",
        "stand_ins": "select qid, kind, label from stand2",
        "emptied_canonicals": "select qid from em2",
        "withdrawn_edges": "select qid, to_qid, type_code, f, t, fate from fated2 where fate <> 'kept'",
        "endpoints_missing": "select from_qid, type_code, to_qid, case when from_qid not in (select qid from nodes) and to_qid not in (select qid from nodes) then from_qid || ',' || to_qid when from_qid not in (select qid from nodes) then from_qid else to_qid end missing from alledges where from_qid not in (select qid from nodes) or to_qid not in (select qid from nodes)",
        "audit_source_since": f"select {_EDGE} from edges where (from_qid, type_code, to_qid) in (select (f, type_code, t) from sources where source_id = 'musicbrainz' and asserted_at >= timestamp '2000-01-01')",
        "valid_at": f"select {_EDGE} from edges where '{PART}' in (from_qid, to_qid) and coalesce(valid_from <= date '2000-01-01', true) and coalesce(valid_to >= date '2000-01-01', true)",
        **{f"corroborated_{n}": f"select type_code, count(*) n from edges where corroboration >= {n} group by 1" for n in range(4)},
        "hypotheses": f"select {_EDGE} from edges where guess",
        "incident_edges": f"select {_EDGE} from edges where '{SUPPLIER}' in (from_qid, to_qid)",
        "neighbours_by_type": f"select type_code, string_agg(o, ' ' order by o) neighbours from (select type_code, case when from_qid = '{SUPPLIER}' then to_qid else from_qid end o from edges where '{SUPPLIER}' in (from_qid, to_qid)) x group by 1",
        "degree_incident": "select * from degrees",
        "degree_endpoint": "select n.qid, coalesce(a.k, 0) + coalesce(b.k, 0) degree from nodes n left join (select from_qid q, count(*) k from edges group by 1) a on n.qid = a.q left join (select to_qid q, count(*) k from edges group by 1) b on n.qid = b.q",
        "hubs": "select * from hubs",
        "neighbourhood_depth2": f", inner_ as (select '{CUSTOMER}' q union select dst from half where src = '{CUSTOMER}') select from_qid, type_code, to_qid from edges semi join inner_ on from_qid = q union select from_qid, type_code, to_qid from edges semi join inner_ on to_qid = q",
        "induced_subgraph": "select from_qid, type_code, to_qid from edges where from_qid in (select qid from known) and to_qid in (select qid from known)",
        "isolated_members": "select * from lonely",
        "to_expand_beside": "select distinct h.dst qid from half h join nodes n on n.qid = h.dst where h.src in (select qid from lonely) and n.kind in ('PERSON', 'GROUP') and h.dst not like 'Q00%' and h.dst not in (select qid from expanded)",
        "expanded_seeds": "select * from expanded",
        "view_edges": "select e.from_qid, e.type_code, e.to_qid, e.valid_from, e.valid_to, e.best confidence, (select string_agg(source_id, '|' order by seq) from (select source_id, min(seq) seq from sources s where s.f = e.from_qid and s.t = e.to_qid and s.type_code = e.type_code group by 1) y) source_ids from edges e",
        "census_nodes": "select k.kind, count(n.qid) n from (values " + ", ".join(f"('{k}')" for k in NODE_KINDS) + ") k(kind) left join nodes n on n.kind = k.kind group by 1",
        "census_edges_by_type": "select type_code, count(*) n from edges group by 1",
        "census_edges_by_source": "select source_id, count(*) n from (select distinct s.f, s.type_code, s.t, s.source_id from sources s join edges e on s.f = e.from_qid and s.t = e.to_qid and s.type_code = e.type_code) x group by 1",
        "census_edges_by_corroboration": "select corroboration, count(*) n from edges group by 1",
        "census_degree": ", d as (select n.kind, coalesce(a.k, 0) + coalesce(b.k, 0) degree from nodes n left join (select from_qid q, count(*) k from edges group by 1) a on n.qid = a.q left join (select to_qid q, count(*) k from edges group by 1) b on n.qid = b.q) select kind, quantile_disc(degree, 0.5) p50, quantile_disc(degree, 0.9) p90, quantile_disc(degree, 0.99) p99, max(degree) top, count(*) n, count(*) filter (where degree <= 5) low, (200 * count(*) filter (where degree <= 5) + count(*)) // (2 * count(*)) low_percent from d group by rollup (kind)",
        "census_bridge": "select count(*) touched, count(*) filter (where classes <> '') classed from nodes where qid in (select f from sources where source_id = 'musicbrainz' and (f, type_code, t) in (select (from_qid, type_code, to_qid) from edges) union select t from sources where source_id = 'musicbrainz' and (f, type_code, t) in (select (from_qid, type_code, to_qid) from edges))",
        "census_concept_classes": "select c as class, count(*) n from (select distinct qid, unnest(string_split(classes, ' ')) c from nodes where kind = 'CONCEPT' and classes <> '') x group by 1 order by n desc, class limit 10",
        "census_taste": "select g.r::int rating, count(t.qid) n, count(t.qid) filter (where t.qid like 'Q00%') on_local, count(t.qid) filter (where t.qid in (select qid from stand2)) on_stand_in, count(t.qid) filter (where t.qid in (select qid from cuts)) on_retracted from range(1, 6) g(r) left join ratings t on t.rating = g.r group by 1",
        "census_claims": "select (select count(*) from log) claims, (select count(*) from log where kind = 'RETRACT') retractions, (select count(*) from surv where kind = 'LOCAL') minted, (select count(*) from cuts) entities_retracted, (select count(*) from sa where not is_last and canonical in (select r from named2)) superseded_referenced, (select count(*) from stand2 where qid not in (select src from half) and qid not in (select from_qid from edges)) stand_ins_edgeless, (select count(*) from sa where is_last) merges_standing, (select count(*) from sa where not is_last) merges_superseded, (select count(*) from stand2) stand_ins, (select count(*) from fated2 where fate = 'withdrawn') withdrawn, (select count(*) from fated2 where fate = 'loop') loops, (select count(*) from log where kind <> 'RETRACT') - (select count(*) from surv) rows_retracted",
        "census_known": "select count(*) named, count(*) filter (where qid in (select qid from nodes)) in_graph, count(*) filter (where qid like 'Q00%' and qid in (select qid from nodes)) as \"local\", count(*) filter (where qid in (select qid from nodes) and qid not like 'Q00%' and qid not in (select qid from expanded)) never_expanded, count(*) filter (where qid in (select qid from lonely)) isolated from (select distinct qid from known) k",
        "ratings_resolved": "select qid, rating from resolved",
        "known_promoted": "select qid, part from known",
        "suppressed": "select qid from suppressed",
        "not_offered": "select qid from notoffered",
        "signals_combined": "select qid, source, sum(play_count)::bigint play_count, bool_or(loved) loved, bool_or(favorited) favorited from signals group by 1, 2",
        "interest": "select qid, confidence, evidence from interest",
        "regard": "select qid, round((4 * confidence + 1) / 3, 6) regard from interest",
        "ratings_listing": "select r.qid, r.rating, coalesce(n.label, '(not in the graph)') label from resolved r left join nodes n using (qid)",
        "sweep_evidence": "select candidate, count(*) ways, round(sum(w1 * w2), 6) weight from evidence group by 1",
        "rec_explained": f", ranked as (select * from ({_ranked('resource_allocation')}) r), reach as (select candidate, seed, sum(w1 * w2) reach, arg_max(via, {{'w': w1 * w2 / via_degree, 'v': via}}) best_via from evidence where candidate in (select candidate from ranked) group by 1, 2) select candidate, seed, row_number() over (partition by candidate order by round(reach, 9) desc, seed) k, round(reach, 6) reach, best_via from reach qualify k <= 3",
        "floor_reading": f", head as (select * from ({_ranked('resource_allocation')}) r), pool as (select distinct candidate, degree from evidence), people as (select distinct candidate, degree from everyone) select (select min(degree) from (select degree, sum(count(*)) over (order by degree) upto from pool group by 1) x where upto > (select count(*) from pool) // 2) pool_median, (select count(*) from pool) pool, (select count(*) from people where degree < {FLOOR}) held_out, (select count(*) from people where degree = 1) held_out_at_one, (select list_sort(list(degree))[count(*) // 2 + 1] from head) head_median, (select count(*) from head where degree = {FLOOR}) on_floor, (select count(*) from head where intermediates = degree) every_edge_counted",
        "eval_holdout": "select r.qid, r.rating, ((row_number() over (order by r.qid) - 1) % 5)::int fold from resolved r join nodes n using (qid) where r.rating >= 4 and n.kind in ('PERSON', 'GROUP') and r.qid not in (select qid from file)",
        "deck_revision": "select r.qid, r.rating, d.degree from resolved r join degrees d using (qid) where r.rating = 5 and (r.qid in (select qid from known) or r.qid in (select qid from suppressed))",
        "deck_fresh": f", top as (select candidate, rank from ({_ranked('resource_allocation')}) r where candidate not in (select qid from resolved)), mine as (select distinct k.qid, d.degree from known k join degrees d using (qid) where k.qid not in (select qid from resolved)), a as (select qid, row_number() over (order by degree desc, qid) k from mine qualify k <= 200), b as (select candidate qid, row_number() over (order by rank) k from top), cards as (select qid, 'known' source, k + (k - 1) // 4 place from a union all select qid, 'candidate', 5 * k from b) select row_number() over (order by place, source, qid) slot, qid, source from cards qualify slot <= 200",
        **{f"rec_{s}": f"select rank, candidate, degree, round(score, 6) score, known_reached, intermediates from ({_ranked(s)}) r" for s in _DISCOUNT},
        "ratings_carried": ", best as (select s.canonical qid, max({'u': r.updated_at, 'f': -s.seq, 'r': r.rating}) b from sa s join ratings r on r.qid = s.\"local\" where s.is_last group by 1) select coalesce(r.qid, b.qid) qid, case when r.qid is null or b.b.u > r.updated_at then b.b.r else r.rating end rating, r.note, case when r.qid is null or b.b.u > r.updated_at then b.b.u else r.updated_at end updated_at from ratings r full join best b on r.qid = b.qid",
        "ratings_upserted": ", versions as (select 'Q1' || lpad(o_custkey::varchar, 8, '0') qid, (1 + o_orderkey % 5)::int rating, case when o_orderkey % 3 = 0 then 'note ' || o_orderkey end note, date_trunc('year', o_orderdate)::timestamp updated_at, o_orderkey seq from orders union all select qid, rating, note, updated_at, 0 from ratings where qid like 'Q1%') select qid, arg_max(rating, {'u': updated_at, 's': seq}) rating, arg_max(note, {'u': updated_at, 's': seq}) filter (where note is not null) note, max(updated_at) updated_at from versions group by 1",
        "seeds_resolved": ", x as (select *, c_custkey % 4 way, c_custkey % 5 = 0 unfound, c_custkey % 11 = 0 or c_custkey % 13 = 0 unfit, c_custkey % 7 = 0 twice from customer) select case way when 1 then 'dr' when 3 then 'sir' else '' end || 'customer' || substr(c_name, 10) || case way when 2 then '3' else '' end key, case way when 1 then 'Dr. ' when 3 then 'Sir ' else '' end || c_name || case way when 2 then ' (3)' else '' end as name, 1::bigint n, case when unfound then 'UNRESOLVED' when unfit or twice then 'REVIEW' else 'ACCEPTED' end status, case when not unfound then 'Q1' || lpad(c_custkey::varchar, 8, '0') end qid, case when unfound then 'no candidates' when unfit then 'does not fit' when twice then 'thin margin' else 'clear' end reason, case when unfound or way = 0 then 0 else 1 end::bigint pass from x",
        "expansion_appended": ", seeds as (select s_suppkey k, 'Q2' || lpad(s_suppkey::varchar, 8, '0') qid from supplier where s_suppkey % 10 <> 3), t as (select k, s.qid from seeds s join nodes n on n.qid = s.qid), told as (select k % 6 < 4 known from t), gone as (select count(*) n from seeds where qid not in (select qid from t)), r as (select 'wikidata' source_id, 'kept' fate, count(*) n, 1 as time from t union all select 'musicbrainz', 'kept', count(*) filter (where known), 1 from told union all select 'musicbrainz', 'no description', count(*) filter (where not known), time from told, (select unnest([1, 2]) as time) z group by time union all select 'musicbrainz', 'described', count(distinct k % 6), 1 from t where k % 6 < 4 union all select 'wikidata', 'held', count(*), 2 from t union all select 'musicbrainz', 'held', count(*) filter (where known), 2 from told union all select '', 'unknown entity', 1 + n, time from gone, (select unnest([1, 2]) as time) z union all select '', 'local entity', 1, time from (select unnest([1, 2]) as time) z union all select 'log', 'NODE', count(distinct k % 6), 0 from t where k % 6 < 4 union all select 'log', 'EDGE', (select count(*) from t) + (select count(*) filter (where known) from told), 0) select source_id, fate, n::bigint n, time::bigint as time from r where n > 0",
        "refold_nodes": "select qid, kind, label, classes from nodes",
        "refold_edges": f"select {_EDGE} from edges",
        "find_paths": _paths(4, SUPPLIER, PART) + " select *, row_number() over (order by guess, hubs, weakest desc, length, signature) as rank, greatest(0, count(*) over () - 50)::bigint omitted from recursive_paths qualify rank <= 50",
        "path_hops": _path_hops(SUPPLIER, PART, 3),
        "entity_view": f"select n.qid, n.kind, n.label, r.rating, r.updated_at rated_at, h.type_code, h.dst neighbour, m.kind neighbour_kind, m.label neighbour_label from nodes n left join resolved r on r.qid = n.qid left join half h on h.src = n.qid left join nodes m on m.qid = h.dst where n.qid = '{SUPPLIER}'",
        "reverse_top": ", rev as (select distinct to_qid seed, case type_code when 'PERFORMED' then 'P175' else 'P50' end property, qid other, substr(qid, 3)::bigint * 37 % 101 sitelinks from log where kind = 'EDGE' and type_code in ('PERFORMED', 'AUTHORED')), offered as (select *, count(*) over (partition by seed) > 3 cut from rev where seed <> other) select seed, property, other, sitelinks, cut, label from (select * from offered qualify row_number() over (partition by seed order by sitelinks desc, other, property) <= 3) o left join nodes n on n.qid = o.other",
        "sources_expanded": "select seed, source_id, type_code, to_qid, 1::bigint place from (select 'Q2' || lpad(s_suppkey::varchar, 8, '0') seed, case when s_suppkey % 9 <> 0 then 'wikidata' else 'musicbrainz' end source_id, case when s_suppkey % 9 <> 0 then 'MEMBER_OF' else 'PART_OF' end type_code, 'Q4' || lpad(s_nationkey::varchar, 8, '0') to_qid from supplier union all select 'Q1' || lpad(c_custkey::varchar, 8, '0'), 'musicbrainz', 'PART_OF', 'Q4' || lpad(c_nationkey::varchar, 8, '0') from customer where c_custkey % 50 = 0) x where seed in (select qid from nodes where kind in ('GROUP', 'PERSON'))",
        "paths_2hop": _paths(2, SUPPLIER, SECOND) + " select * from recursive_paths",
        "paths_3hop": _paths(3) + " select * from recursive_paths",
        "paths_ranked_top50": _paths(3) + " select *, row_number() over (order by guess, hubs, weakest desc, length, signature) as rank from recursive_paths qualify rank <= 50",
    }
    return q


def _documents() -> dict[str, str]:
    """Both export documents, whole."""
    xml = lambda c: f"replace(replace(replace(replace(coalesce({c}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
    dot = lambda c: f"'\"' || replace(replace(replace(coalesce({c}, ''), '\\', '\\\\'), '\"', '\\\"'), chr(10), ' ') || '\"'"
    data = lambda k, c: f"'      <data key=\"{k}\">' || {xml(c)} || '</data>' || chr(10)"
    edges = """, firstseq as (select f, type_code tc, t, min(seq) first_seq, string_agg(distinct source_id, '|') x from sources group by 1, 2, 3),
names_ as (select f, type_code tc, t, string_agg(source_id, '|' order by seq) ids from (select f, type_code, t, source_id, min(seq) seq from sources group by 1, 2, 3, 4) y group by 1, 2, 3),
drawn as (select e.*, p.first_seq, i.ids, row_number() over (order by p.first_seq, e.from_qid, e.type_code, e.to_qid) - 1 number from edges e join firstseq p on e.from_qid = p.f and e.type_code = p.tc and e.to_qid = p.t join names_ i on e.from_qid = i.f and e.type_code = i.tc and e.to_qid = i.t),
"""
    rows = lambda part, lines: f"select {part} part, lpad((k - 1)::varchar, 20, '0') ord, x line from (select unnest([{', '.join(chr(39) + x.replace(chr(39), chr(39) * 2) + chr(39) for x in lines)}]) x, generate_subscripts([{', '.join('0' for _ in lines)}], 1) k) z"
    space = "http://graphml.graphdrawing.org/xmlns"
    keys = [("kind", "node", "string"), ("label", "node", "string"), ("instanceOf", "node", "string"), ("typeCode", "edge", "string"), ("confidence", "edge", "double"), ("sourceId", "edge", "string")]
    head = ['<?xml version="1.0" encoding="UTF-8"?>', f'<graphml xmlns="{space}"', '         xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"', f'         xsi:schemaLocation="{space} {space}/1.0/graphml.xsd">', "  <desc>the whole graph</desc>"]
    head += [f'  <key id="{k}" for="{w}" attr.name="{k}" attr.type="{t}"/>' for k, w, t in keys] + ['  <graph id="provenir" edgedefault="directed">']
    graphml = f"""{edges}done as (select 1)
{rows(0, head)}
union all select 1, qid, '    <node id="' || {xml('qid')} || '">' || chr(10) || {data('kind', 'kind')} || {data('label', 'label')} || case when classes <> '' then {data('instanceOf', 'classes')} else '' end || '    </node>' from nodes
union all select 2, lpad(first_seq::varchar, 20, '0'), '    <edge id="e' || number || '" source="' || from_qid || '" target="' || to_qid || '">' || chr(10) || {data('typeCode', 'type_code')} || {data('confidence', 'best::varchar')} || {data('sourceId', 'ids')} || '    </edge>' from drawn
union all {rows(3, ['  </graph>', '</graphml>'])}"""
    style = lambda k: "case kind " + " ".join(f"when '{n}' then '{s[k]}'" for n, s in STYLES.items()) + " end"
    called = "list_transform(string_split(classes, ' '), lambda c: case c " + " ".join(f"when '{q}' then '{n.replace(chr(39), chr(39) * 2)}'" for q, n in CLASS_LABELS.items()) + " else c end)"
    label = f"(select case when count(*) <= {LABELLED_EDGES} then 1 else 0 end from edges)"
    dotted = f"""{edges}done as (select 1)
{rows(0, ['digraph "the whole graph" {', '  graph [overlap=false, splines=true];', '  node [style=filled, fillcolor=white, fontcolor=black];'])}
union all select 1, qid, '  ' || {dot('qid')} || ' [label=' || {dot('label')} || ', shape=' || {style(0)} || ', fillcolor="' || {style(1)} || '", tooltip=' || case when classes = '' then '"no stated class"' else {dot(f"array_to_string({called}, ', ')")} end || '];' from nodes
union all select 2, lpad(first_seq::varchar, 20, '0'), '  ' || {dot('d.from_qid')} || ' -> ' || {dot('d.to_qid')} || ' [' || case when {label} = 1 then 'label=' || {dot('d.type_code')} || ', ' else '' end || 'tooltip=' || {dot("coalesce(a.label, d.from_qid) || ' -' || d.type_code || '-> ' || coalesce(b.label, d.to_qid)")} || '];'
  from drawn d left join nodes a on a.qid = d.from_qid left join nodes b on b.qid = d.to_qid
union all {rows(3, ['}'])}"""
    return {"export_graphml_lines": graphml, "export_dot_lines": dotted}


def _grid() -> str:
    """The hold-out grid over all folds at once."""
    scored = " union all ".join(f"select fold, candidate, degree, '{n}' scorer, sum(w1 * w2 / {d})" + (" / degree" if n == "lift" else "") + " score from ev group by fold, candidate, degree" for n, d in _DISCOUNT.items())
    order = "row_number() over (partition by fold, scorer, floor order by round(score, 9) desc, candidate)"
    return f""",
age as (select qid, updated_at >= timestamp '2026-06-01' is_new from resolved),
held as materialized (select r.qid, ((row_number() over (order by r.qid) - 1) % 5)::int fold from resolved r join nodes n using (qid) where r.rating >= 4 and n.kind in ('PERSON', 'GROUP') and r.qid not in (select qid from file)),
turns as (select fold::int fold from range(5) g(fold)),
kept as materialized (select k.fold, r.qid, r.rating from turns k join resolved r on true where (k.fold, r.qid) not in (select (fold, qid) from held)),
told as materialized (select k.fold, f.qid from turns k join file f on true union select fold, qid from kept where rating >= 4),
ev as materialized (
  select s.fold, b.dst candidate, dc.degree, dv.degree via_degree, a.w * coalesce(r.rating / 3.0, 1.0) w1, b.w_to w2
  from told s join nodes o on o.qid = s.qid join strong a on a.src = s.qid join strong b on a.dst = b.src join degrees dv on dv.qid = a.dst join degrees dc on dc.qid = b.dst join nodes n on n.qid = b.dst
  left join kept r on r.fold = s.fold and r.qid = s.qid left join told z on z.fold = s.fold and z.qid = b.dst
  where z.qid is null and a.dst not in (select qid from hubs) and b.dst not in (select "local" from merges) and n.kind in ('PERSON', 'GROUP')),
every as materialized (
  select s.*, g.floor, h.qid held, x.is_new, q.qid neg from ({scored}) s join (values (2), (5), (8), (12)) g(floor) on s.degree >= g.floor
  left join held h on h.fold = s.fold and h.qid = s.candidate left join age x on x.qid = h.qid left join kept q on q.fold = s.fold and q.qid = s.candidate and q.rating <= 2),
shipped as (select *, {order} r from every where neg is null),
ranked as (select *, {order} r from every),
good as (
  select scorer, floor, count(*) pool, count(held) held_in_pool, count(*) filter (where held is not null and not is_new) old_in_pool, count(*) filter (where held is not null and is_new) new_in_pool,
         count(held) filter (where r <= {LIMIT}) hits, coalesce(sum(r) filter (where r <= {LIMIT} and held is not null), 0)::bigint hit_rank_sum,
         count(held) filter (where r <= {LIMIT} and not is_new) old_hits, count(held) filter (where r <= {LIMIT} and is_new) new_hits from shipped group by 1, 2),
bad as (select scorer, floor, count(neg) filter (where r <= {LIMIT}) negatives_offered, coalesce(sum(r) filter (where r <= {LIMIT} and neg is not null), 0)::bigint negative_rank_sum from ranked group by 1, 2)
select scorer, floor::int floor, negatives_offered, negative_rank_sum, coalesce(pool, 0) pool, coalesce(held_in_pool, 0) held_in_pool, coalesce(old_in_pool, 0) old_in_pool, coalesce(new_in_pool, 0) new_in_pool,
       coalesce(hits, 0) hits, coalesce(hit_rank_sum, 0) hit_rank_sum, coalesce(old_hits, 0) old_hits, coalesce(new_hits, 0) new_hits from bad left join good using (scorer, floor)"""


def _retraction_effect() -> str:
    """The folds of the log and of the log with the retractions, side by side."""
    log = _plain(derived_log.LOG_SQL)
    gone = " union all ".join(f"select 90 * {derived_log.BLOCK}, 'RETRACT', '{q}', null, null, null, null, null, null, null, 'owner', null, timestamp '2026-08-01 09:00:00', 1.0, 'gone'" for q in ("Q200000001", "Q009000004"))
    after = BASE.replace(f"log as materialized ({log})", f"log as materialized ({log} union all {gone})")
    edge = "select from_qid, type_code, to_qid from edges"
    return f"""
with nb as materialized ({BASE} select qid from nodes), na as materialized ({after} select qid from nodes), eb as materialized ({BASE} {edge}), ea as materialized ({after} {edge}),
fresh as materialized (select * from ({after} select qid from em2) x except select * from ({BASE} select qid from em2) y)
select (select count(*) from (from nb except from na) x) nodes_lost, (select count(*) from (from eb except from ea) x) edges_lost, (select count(*) from fresh) newly_emptied,
       (select count(*) from eb where from_qid in (select qid from fresh) or to_qid in (select qid from fresh)) edges_stranded"""


_POPULATIONS = """,
listed as (select coalesce(m.canonical, f.qid) qid, min(ord) ord from file f left join merges m on m."local" = f.qid group by 1),
seeds as materialized (select distinct coalesce(m.canonical, e.qid) qid from expanded e left join merges m on m."local" = e.qid),
off as (select qid from resolved where rating >= 4 and qid not in (select qid from listed)),
act as (select qid from (select qid, arg_max(node_kind, seq) k from surv where kind = 'NODE' group by 1) x where k = 'GROUP' union select qid from surv where kind = 'EDGE' and type_code = 'PERFORMED'),
answered as (select *, case source_id when 'wikidata' then 0 when 'musicbrainz' then 1 else 2 end adapter from (select seq, qid, to_qid, type_code, source_id, unnest([qid, to_qid]) seed from surv where kind = 'EDGE') x),
bounds as (select qid, case kind when 'CONCEPT' then 25 else 40 end::bigint bound from nodes)
"""


def _populations() -> dict[str, str]:
    """Populations, their censuses and expansions."""
    fresh = "n.qid not like 'Q00%' and n.qid not in (select qid from seeds)"
    kinds = ", ".join(f"('{k}')" for k in NODE_KINDS)
    beside = "(select distinct h.src, h.dst from half h join nodes n on n.qid = h.dst where h.src in (select qid from lonely) and n.kind in ('PERSON', 'GROUP') and " + fresh + ")"
    by_kind = lambda name, members: f"select k.kind, count(n.qid) in_graph, count(n.qid) filter (where {fresh}) never_expanded, '{name}' population from (values {kinds}) k(kind) left join (select * from nodes where qid in ({members})) n on n.kind = k.kind group by 1"
    return {
        "census_concept_totals": "select count(*) concepts, count(*) filter (where classes = '') no_class, (select count(distinct c) from (select unnest(string_split(classes, ' ')) c from nodes where kind = 'CONCEPT' and classes <> '') x) classes from nodes where kind = 'CONCEPT'",
        "census_edge_totals": "select (select count(*) from edges) total, (select count(*) from alledges) - (select count(*) from edges) dangling, (select count(*) from (select distinct f, type_code, t from fated2 where fate = 'withdrawn') x) withdrawn",
        "census_known_by_kind": by_kind("file", "select qid from listed") + " union all " + by_kind("with promotions", "select qid from listed union select qid from off"),
        "census_known_isolation": f"select count(distinct src) with_someone, (select count(*) from lonely) - count(distinct src) with_no_one, count(distinct dst) to_expand from {beside} b",
        "acts": "select qid from act",
        "promotions_off_list": "select qid from off",
        "names_out": "select coalesce(c.lb, o.qid) as name, o.qid, c.lb is not null in_log from off o left join (select qid, arg_max(label, seq) lb from claimed group by 1) c on c.qid = o.qid where o.qid in (select qid from act)",
        "rated_since": "select qid from resolved where rating > 3 and updated_at >= timestamp '2026-06-01'",
        "rating_age": "select qid, not (updated_at < timestamp '2026-06-01') is_new from resolved",
        "to_expand_known": f"select n.qid from nodes n where n.qid in (select qid from listed) and {fresh}",
        "to_expand_promoted": f"select n.qid from nodes n where n.qid in (select qid from off) and {fresh}",
        "expansion_summary": "select seed, bound, count(*) offered, least(count(*), bound) kept, count(*) > bound cut from answered a join bounds b on b.qid = a.seed group by seed, bound",
        "expansion_tally": "select source_id, count(*) kept, count(distinct seed) entities from (select a.*, b.bound from answered a join bounds b on b.qid = a.seed qualify row_number() over (partition by seed order by adapter, seq, a.qid, to_qid, type_code) <= bound) x group by 1",
    }


def _reports(q: dict[str, str], signals: str) -> dict[str, str]:
    """Lines of reports, from the same aggregates."""
    ord_ = lambda *c: " || '.' || ".join(f"lpad(({x})::varchar, 12, '0')" for x in c)
    facts = lambda part, base, names, sql: " union all ".join(f"select {part} part, {base + k} place, '{label}' as label, ({c})::bigint n from one{part}" for k, (c, label) in enumerate(names.items()))
    named = lambda part, base, name, prefix, sql: f"select {part}, {base} + row_number() over (order by {name}), '{prefix}' || {name}, n::bigint from ({sql}) x"
    claims = {
        "claims": "rows of the log", "retractions": "retractions", "rows_retracted": "rows they removed", "entities_retracted": "entities they name", "minted": "local entities minted", "merges_standing": "merges standing",
        "merges_superseded": "merges superseded", "superseded_referenced": "superseded, named by an edge", "stand_ins": "stand-ins", "stand_ins_edgeless": "stand-ins without an edge",
    }
    totals = _populations()["census_edge_totals"]
    census = f""", one1 as (select count(*) n from nodes), one2 as ({totals}), one3 as ({q['census_claims']}),
body as (select 1 part, 0 place, 'nodes' as label, null::bigint n union all select 2, 0, 'edges', null union all select 3, 0, 'claims', null
union all {facts(1, 1, {'n': 'total'}, '')} union all {named(1, 1, 'kind', '', q['census_nodes'])}
union all {facts(2, 1, {'total': 'total', 'dangling': 'dangling', 'withdrawn': 'withdrawn'}, '')} union all {named(2, 1000, 'source_id', 'stated by ', q['census_edges_by_source'])}
union all {named(2, 2000, 'type_code', 'of type ', q['census_edges_by_type'])} union all {named(2, 3000, 'corroboration', 'corroborated by ', q['census_edges_by_corroboration'])}
union all {facts(3, 1, claims, '')}),
wide as (select max(length(label)) w, max(length(n::varchar)) c from body where n is not null)
select {ord_('part', 'place')} || '.0' ord, case when n is null then '' else rpad(label, w::int, ' ') || '  ' || lpad(n::varchar, c::int, ' ') end line from body, wide
union all select {ord_('part', 'place')} || '.1', label from body where n is null"""
    said = f""", ranked as materialized (select * from ({_ranked('resource_allocation')}) r), routes as (select * from ({q['rec_explained'].split('), reach as', 1)[0].replace(', ranked as (', 'with ranked2 as (') + '), reach as' + q['rec_explained'].split('), reach as', 1)[1]}) e),
listed as (select distinct qid from known),
num as (select (select count(*) from ranked) head, (select count(distinct candidate) from evidence) pool, (select count(*) from listed where qid in (select qid from nodes)) found, (select count(*) from listed where qid not in (select qid from nodes)) missing)
select {ord_('0', '0')} ord, '# ' || head || ' of ' || pool || ' candidates, from ' || found || ' known entities' || case when missing > 0 then ' (' || missing || ' of the list not in the graph)' else '' end line from num
union all select {ord_('0', '1')}, '# scored by resource_allocation; at least {FLOOR} edges'
union all select {ord_('rank')} || '.0', printf('%3d. %.4f  %s (%s), %s: %d edges, %d known over %d between', rank, score, n.label, candidate, n.kind, r.degree, known_reached, intermediates) from ranked r join nodes n on n.qid = r.candidate
union all select {ord_('r.rank')} || '.1.' || {ord_('k')}, '      from ' || coalesce(a.label, seed) || ' (' || seed || ') over ' || coalesce(b.label, best_via) || ' (' || best_via || ')' from routes x join ranked r using (candidate) left join nodes a on a.qid = seed left join nodes b on b.qid = best_via"""
    signal = f"""with s as ({signals}) select lpad(k::varchar, 12, '0') ord, line from (
select 0 k, count(*) || ' rows' line from s union all select 1, count(*) filter (where outcome = 'resolved' and qid not like 'Q00%') || ' resolved' from s union all select 2, count(*) filter (where outcome = 'resolved' and qid like 'Q00%') || ' resolved to local entities' from s
union all select 3, count(*) filter (where outcome = 'in_review') || ' left for review' from s union all select 4, count(*) filter (where outcome = 'unanswered') || ' not answered' from s union all select 5, count(distinct qid) || ' entities with a signal' from s) x"""
    grid = f"select scorer || '.' || lpad(floor::varchar, 12, '0') ord, printf('%-20s floor %2d: %d of %d held out hit (%d new), mean rank %s, %d disliked offered', scorer, floor, hits, held_in_pool, new_hits, case when hits > 0 then ((20 * hit_rank_sum + hits) // (2 * hits) // 10)::bigint || '.' || ((20 * hit_rank_sum + hits) // (2 * hits) % 10)::bigint else '-' end, negatives_offered) line from ({BASE}{_grid()}) g"
    return {"report_census": BASE + census, "report_recommendations": BASE + said, "report_signals": signal, "report_evaluation": grid}


def queries() -> dict[str, str]:
    out = {name: BASE + ("" if body.startswith(",") else " ") + body for name, body in _grid_free().items()}
    key = lambda c: f"regexp_replace(regexp_replace(lower(trim({c})), '^the\\s+', ''), '[^a-z0-9]', '', 'g')"
    out["name_fold"] = f"select c_custkey, {key("' The ' || c_name")} folded from customer"
    out["name_groups"] = f"select folded, arg_min(name, ord) as name, count(*) n from (select 'The ' || p_name as name, p_partkey ord, {key("'The ' || p_name")} folded from part) x group by 1"
    out["minted"] = BASE + f"""select 'Q00' || (k + (select coalesce(max(substr(id, 4)::bigint), 0) from (select qid id from log union all select to_qid from log) i where regexp_matches(id, '^Q00[0-9]+$'))) local_qid, name, 'WORK' kind
from (select name, row_number() over (order by ord) k from (select 'The ' || p_name as name, p_partkey ord from part qualify row_number() over (partition by {key("'The ' || p_name")} order by p_partkey) = 1) x) y"""
    out["adjudicate"] = f"""
with c as (
  select p_name as name, p_partkey pos, 'Q3' || lpad(p_partkey::varchar, 8, '0') qid, case when p_partkey % 3 = 0 then upper(p_name) else p_brand end label,
         case when p_partkey % 3 = 1 then p_name else p_type end alias, p_size > 10 fits, floor(p_retailprice * p_size)::bigint sitelinks from part),
m as (select *, case when {key('label')} = {key('name')} then 2 when length({key('name')}) >= 3 and {key('alias')} = {key('name')} then 1 else 0 end match from c),
p as (select *, match > 0 and fits and match = max(match) filter (where match > 0 and fits) over (partition by name) playing from m),
r as (select *, coalesce(playing, false) in_play from p),
k as (
  select *, row_number() over w k, lead(case when in_play then sitelinks end) over w nxt from r
  window w as (partition by name order by in_play desc, case when in_play then sitelinks end desc nulls last, match > 0 desc, pos))
select name, case when in_play and (nxt is null or sitelinks > 2 * nxt) then 'ACCEPTED' else 'REVIEW' end status, qid,
       case when in_play and (nxt is null or sitelinks > 2 * nxt) then 'clear' when in_play then 'thin margin' when match > 0 then 'does not fit' else 'no name matches' end reason
from k where k = 1"""
    out["signals_resolved"] = """
with e as (select user_id, count(*) play_count from events group by 1)
select printf('The Customer #%09d', user_id) artist, play_count, case when c_custkey % 7 <> 0 and c_custkey % 5 <> 0 then 'Q1' || lpad(c_custkey::varchar, 8, '0') end qid,
       case when c_custkey is null then 'unanswered' when c_custkey % 7 <> 0 and c_custkey % 5 <> 0 then 'resolved' else 'in_review' end outcome
from e left join (select * from customer where c_custkey % 11 <> 0) c on c.c_custkey = e.user_id"""
    out["statements_to_edges"] = """
select 'Q2' || lpad(s_suppkey::varchar, 8, '0') from_qid, 'MEMBER_OF' type_code, 'Q4' || lpad(s_nationkey::varchar, 8, '0') to_qid,
       case when s_suppkey % 2 = 1 then make_date(1910 + s_suppkey % 90, 5, 1) end valid_from, cast(null as date) valid_to,
       case when s_suppkey % 2 = 0 then 0.8 else 1.0 end::double confidence, 's' || s_suppkey source_ref from supplier where s_suppkey % 9 <> 0
union all select 'Q1', 'PERFORMED', 'Q2' || lpad(s_suppkey::varchar, 8, '0'), null, null, 0.8, 'Q2' || lpad(s_suppkey::varchar, 8, '0') || '$P175$Q1' from supplier"""
    out |= {name: BASE + sql for name, sql in _documents().items()}
    out |= _reports(_grid_free(), out["signals_resolved"])
    out |= {"eval_grid": BASE + _grid(), "retraction_effect": _retraction_effect()}
    out |= {name: BASE + _POPULATIONS + sql for name, sql in _populations().items()}
    out["kinds_derived"] = "select p_partkey, case when p_partkey % 13 = 0 then 'PLACE' when p_partkey % 8 = 0 then 'PERSON' when p_partkey % 3 = 0 then 'WORK' when p_partkey % 5 = 0 then 'GROUP' when p_partkey % 7 = 0 then 'EVENT' when p_partkey % 11 = 0 then 'PLACE' else 'CONCEPT' end kind from part"
    out["entity_facts"] = """
select 'Q2' || lpad(s_suppkey::varchar, 8, '0') qid, s_name as label, 'no. ' || s_suppkey description, 'both|m' || s_suppkey aliases, case when s_suppkey % 2 = 0 then 'GROUP' else 'PERSON' end kind,
       case when s_suppkey % 2 = 0 then 'Q215380' else 'Q5' end instance_of, 'Q639669' occupations, case when s_suppkey % 3 = 0 then 2 else 1 end::bigint sitelinks from supplier where s_suppkey % 10 <> 9 and s_suppkey % 4 <> 0"""
    out["entity_search"] = """
select p_brand query, pos, 'Q' || p_partkey qid, p_name as label, p_type description, 'CONCEPT' kind from (select *, row_number() over (partition by p_brand order by p_partkey) - 1 pos from part) x where pos < 50 and p_partkey % 4 <> 0"""
    out["next_local"] = BASE + " select max(substr(id, 4)::bigint) + 1 as number from (select qid id from log union all select to_qid from log) x where id like 'Q00%'"
    out["events_windowed"] = "select time_bucket(interval '1 hour', ts) begins, event_type, count(*) n, round(sum(value), 4) total from events group by 1, 2"
    return out
