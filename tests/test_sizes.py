"""What is shuffled and built stays in proportion to the input."""

import datetime

from pyspark.sql import functions as F

from provenir.operators import graph, recommend, writes
from provenir.operators.fold import Fold, cuts, endpoints_missing, merge_claims, survivors
from provenir.schema import LOG
from provenir.sources.shared import compact
from provenir.streaming import state as state_tables
from provenir.streaming.incremental import GraphState


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _log(spark):
    made = [(k, "NODE", f"Q{k}", None, None) for k in range(1, 9)]
    made += [(10 + k, "EDGE", f"Q{k}", f"Q{k + 1}", "PART_OF") for k in range(1, 10)]  # Q9 and Q10 have no node
    made += [(30, "EDGE", "Q1", None, "PART_OF"), (31, "EDGE", "Q1", "Q2", "PART_OF"), (40, "RETRACT", "Q4", None, None), (41, "EDGE", "Q4", "Q5", "PART_OF")]
    rows = [(s, k, q, t, c, "GROUP" if k == "NODE" else None, [], q, None, None, "s", str(s), None, None, 1.0, None) for s, k, q, t, c in made]
    return spark.createDataFrame(rows, LOG)


def test_few_retractions_are_broadcast_whatever_is_estimated(spark):
    log, before = _log(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _plan(survivors(log, compact(cuts(log))))
        assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_claims_are_shuffled_once(spark):
    f = Fold(_log(spark), keep=True)
    assert _plan(merge_claims(f.edge_claims)).count("Exchange hashpartitioning") == 1


def test_pairs_of_claims_are_shuffled_once(spark):
    f = Fold(_log(spark), keep=True, derived=True)
    made = []
    f._kept = lambda df: made.append(df) or df
    assert f.nodes and f.missing is not None  # tables that the pairs need, or that aren't theirs
    made.clear()
    got = sorted((r["f"], r["t"] or "") for r in f.pairs.collect())
    assert got == [("Q1", ""), ("Q1", "Q2"), ("Q2", "Q3"), ("Q4", "Q5"), ("Q5", "Q6"), ("Q6", "Q7"), ("Q7", "Q8"), ("Q8", "Q9"), ("Q9", "Q10")]
    assert _plan(made[-1].select("*")).count("Exchange hashpartitioning") == 1


def test_edges_and_dangling_are_those_of_all_merged_edges(spark):
    for keep in (True, False):
        f = Fold(_log(spark), keep)
        merged = merge_claims(f.edge_claims.where("fate = 'kept'"))
        lost = {(r["from_qid"], r["to_qid"], tuple(r["missing"])) for r in endpoints_missing(merged, f.nodes).collect()}
        assert {(r["from_qid"], r["to_qid"], tuple(r["missing"])) for r in f.dangling.collect()} == lost
        assert {x[:2] for x in lost} == {("Q4", "Q5"), ("Q8", "Q9"), ("Q9", "Q10"), ("Q1", None)}
        assert {(r["from_qid"], r["to_qid"], len(r["sources"])) for r in f.edges.collect()} == {("Q1", "Q2", 2), ("Q2", "Q3", 1), ("Q5", "Q6", 1), ("Q6", "Q7", 1), ("Q7", "Q8", 1)}


def test_a_derived_log_gives_nodes_and_links_without_edges(spark):
    log, whole = _log(spark), Fold(_log(spark), keep=True)
    f = Fold(log, keep=True, derived=True)
    assert f.nodes.count() == whole.nodes.count() and f.merges.count() == 0
    key = ["from_qid", "type_code", "to_qid"]
    want = sorted(map(tuple, whole.edges.select(key).collect()))
    assert sorted(map(tuple, f.links.collect())) == want
    assert sorted(map(tuple, graph.degree_incident(f.nodes, f.links).collect())) == sorted(map(tuple, graph.degree_incident(whole.nodes, whole.edges).collect()))
    about = sorted(map(str, whole.edges.where("from_qid = 'Q2' or to_qid = 'Q2'").collect()))
    assert sorted(map(str, f.edges_of("Q2").collect())) == about and len(about) == 2
    assert "edges" not in f.__dict__ and "_stored" not in f.__dict__
    assert sorted(map(str, f.edges.collect())) == sorted(map(str, whole.edges.collect()))
    assert sorted(map(tuple, f.links.collect())) == want and sorted(map(str, f.edges_of("Q2").collect())) == about


def test_claims_of_a_source_are_merged_without_sorting(spark):
    f = Fold(_log(spark), keep=True)
    assert "SortAggregate" not in _plan(merge_claims(f.edge_claims))


def test_the_first_date_that_a_claim_states_counts(spark):
    day = datetime.date
    made = [(3, None, day(2003, 1, 1), "a", "1", 0.3), (1, None, None, "a", "1", 0.1), (2, day(2002, 1, 1), None, "a", "1", 0.2), (4, day(2004, 1, 1), day(2004, 1, 1), "b", None, 0.4), (5, None, None, "b", None, 0.5)]
    rows = [(s, "EDGE", "Q1", "Q2", "PART_OF", None, None, None, a, b, source, ref, None, None, c, None) for s, a, b, source, ref, c in made]
    claims = spark.createDataFrame(rows, LOG).withColumns({"f": F.col("qid"), "t": F.col("to_qid")})
    (e,) = merge_claims(claims).collect()
    assert (e["valid_from"], e["valid_to"], e["first_seq"]) == (day(2002, 1, 1), day(2003, 1, 1), 1)
    assert [(x["seq"], x["source_id"], x["source_ref"], x["confidence"]) for x in e["sources"]] == [(1, "a", "1", 0.1), (4, "b", None, 0.4)]


def test_half_edges_of_some_ids(spark):
    edges = Fold(_log(spark), keep=True).edges
    at = spark.createDataFrame([("Q2",), ("Q7",)], "qid string")
    one, two = graph.half_edges(edges).where("src in ('Q2', 'Q7')").collect(), graph.half_edges(edges, at).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two)) and len(two) == 4


def test_a_via_of_many_seeds_and_candidates_has_no_row_for_each_pair(spark):
    seeds, candidates = [f"S{k}" for k in range(30)], [f"C{k}" for k in range(40)]
    pairs = [(s, "V") for s in seeds] + [(c, "V") for c in candidates] + [("S1", "W"), ("S2", "W"), ("C7", "W"), ("C8", "W")]
    edges = spark.createDataFrame([(a, b, "MEMBER_OF") for a, b in pairs], "from_qid string, to_qid string, type_code string")
    ids = [(q, "PERSON", []) for q in seeds + candidates] + [("V", "PLACE", []), ("W", "PLACE", [])]
    nodes = spark.createDataFrame(ids, "qid string, kind string, instance_of array<string>")
    degrees = edges.select(F.explode(F.array("from_qid", "to_qid")).alias("qid")).groupBy("qid").agg(F.count("*").alias("degree"))
    known, none = spark.createDataFrame([(s,) for s in seeds], "qid string"), nodes.select("qid").limit(0)
    regard = spark.createDataFrame([("S1", 2.0)], "qid string, regard double")
    s = recommend.sweep(nodes, edges, degrees, none, known, none, regard)
    assert s.one.count() == 32 and s.candidates.count() == 40
    got = {r["candidate"]: r for r in s.candidates.collect()}
    over_v = 0.25 * 31 / 70  # weights of half by half, one seed counting twice
    assert got["C0"]["ways"] == 30 and got["C7"]["ways"] == 32 and got["C7"]["intermediates"] == 2
    assert abs(got["C0"]["resource_allocation"] - over_v) < 1e-12 and abs(got["C7"]["resource_allocation"] - over_v - 0.25 * 3 / 4) < 1e-12
    head = s.ranked("resource_allocation", 1, 3).orderBy("rank").collect()
    assert [(r["candidate"], r["known_reached"]) for r in head] == [("C7", 30), ("C8", 30), ("C0", 30)]


def test_a_retraction_loses_what_a_second_fold_lacks(spark):
    log = _log(spark)
    gone = spark.createDataFrame([(90, "RETRACT", "Q2") + (None,) * 4 + (None,) * 9], LOG)
    before, after = Fold(log, keep=True), Fold(log.unionByName(gone), keep=True)
    key = ["from_qid", "type_code", "to_qid"]
    lost = before.edges.select(key).join(after.edges.select(key), key, "left_anti").count()
    got = writes.retraction_effect(log, gone, before).head()
    assert (got["nodes_lost"], got["edges_lost"], got["edges_stranded"]) == (1, lost, 0) and lost == 2
    folds = []

    class Watched(Fold):
        def __init__(self, *args, **more):
            super().__init__(*args, **more)
            folds.append(self)

    original, writes.Fold = writes.Fold, Watched
    try:
        writes.retraction_effect(log, gone, before).collect()
    finally:
        writes.Fold = original
    assert folds and all("edges" not in f.__dict__ for f in folds)


def test_state_keeps_claims_and_edges_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state_tables, "BUCKETS", 3)
    state, log = GraphState(spark, tmp_path.as_uri()), _log(spark)
    state.apply(log.where("seq < 40"), 0)
    assert state.links.read().where("twin and source_id is not null").count() == 0 < state.links.read().where("twin").count()
    assert state._edges.read().where("at <> from_qid and sources is not null").count() == 0 < state._edges.read().where("at <> from_qid").count()
    state.apply(log.where("seq >= 40"), 1)  # Q4 is retracted: its edges are found from either end
    want = Fold(log, keep=True)
    assert sorted(map(str, state.edges().select(want.edges.columns).collect())) == sorted(map(str, want.edges.collect()))
    assert state._edges.read().where("batch = 1 and gone and at = from_qid").count() == 2


def test_a_hop_is_shuffled_once_by_its_via(spark):
    edges = spark.createDataFrame([("A", "V", "MEMBER_OF"), ("B", "V", "MEMBER_OF")], "from_qid string, to_qid string, type_code string")
    few = F.broadcast(spark.createDataFrame([("A", 1.0)], "qid string, regard double"))
    assert _plan(recommend.first_hop(edges, few).groupBy("via").agg(F.sum("w1"))).count("Exchange hashpartitioning") == 1
    assert _plan(recommend.second_hop(edges, few.select("qid")).groupBy("via").count()).count("Exchange hashpartitioning") == 1


def test_hypotheses_are_found_without_the_other_edges(spark):
    log = _log(spark)
    more = [(60, "Q1", "Q2", "PART_OF", "llm:x"), (61, "Q1", "Q3", "PART_OF", "llm:x"), (62, "Q1", "Q3", "PART_OF", "llm:y"), (63, "Q2", "Q1", "ABOUT", "llm:x"), (64, "Q2", "Q6", None, "llm:x"), (65, "Q2", "Q7", None, "llm:x"), (66, "Q2", "Q7", None, None), (67, "Q1", "Q9", "ABOUT", "llm:x")]
    log = log.unionByName(spark.createDataFrame([(s, "EDGE", a, b, c, None, [], a, None, None, x, str(s), None, None, 0.3, None) for s, a, b, c, x in more], LOG))
    f, whole = Fold(log, keep=True, derived=True), Fold(log, keep=True)
    want = sorted(map(str, graph.hypotheses(whole.edges).collect()))
    assert sorted(map(str, f.guesses.collect())) == want and len(want) == 3
    assert "edges" not in f.__dict__ and "_stored" not in f.__dict__
    assert sorted(map(str, whole.guesses.collect())) == want


def test_a_retraction_folds_nothing_as_a_whole(spark):
    log = _log(spark)
    gone = spark.createDataFrame([(90, "RETRACT", "Q2") + (None,) * 4 + (None,) * 9], LOG)
    before = Fold(log, keep=True, derived=True)
    got = writes.retraction_effect(log, gone, before).head()
    assert not {"nodes", "edges", "_stored", "missing"} & set(before.__dict__)
    assert got == writes.retraction_effect(log, gone, Fold(log, keep=True)).head() and got["edges_lost"] == 2
