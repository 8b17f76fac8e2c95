"""The fold on small fixtures with known answers."""

import datetime

import pytest

from provenir.operators import fold, graph, paths
from provenir.schema import LOG

T0 = datetime.datetime(2026, 8, 1, 9)
D = datetime.date


def row(seq, kind, qid, to=None, type_code=None, node_kind=None, label=None, classes=(), vf=None, vt=None, source="wikidata", ref=None, at=T0, confidence=1.0, reason=None):
    return (seq, kind, qid, to, type_code, node_kind, list(classes), label, vf, vt, source, ref, at, at.isoformat() + "Z", confidence, reason)


def frame(spark, rows):
    return spark.createDataFrame(rows, LOG)


def q(n):
    return f"Q70{n:02d}"


# Five people, two groups and three works, with answers worked out by hand.
W, M = ("wikidata", 1.0, T0), ("musicbrainz", 0.8, T0)
HEARD, GUESS, OWN = ("lastfm", 0.5, T0 + datetime.timedelta(days=10)), ("llm:any", 0.3, T0), ("owner", 1.0, T0)
STATED = {
    (1, "MEMBER_OF", 6): ([W, M], D(1990, 1, 1), None),
    (2, "MEMBER_OF", 6): ([W], D(1992, 3, 1), D(1999, 12, 31)),
    (2, "MEMBER_OF", 7): ([M], D(2001, 1, 1), None),
    (3, "MEMBER_OF", 7): ([W, M], None, None),
    (1, "AUTHORED", 8): ([W], None, None),
    (2, "AUTHORED", 8): ([OWN], None, None),
    (4, "DIRECTED", 9): ([W], None, None),
    (9, "BASED_ON", 8): ([W, M], None, None),
    (5, "COMPOSED_FOR", 9): ([GUESS], None, None),
    (3, "SIMILAR_TO", 5): ([HEARD], None, None),
    (10, "BASED_ON", 9): ([M], None, None),
}


@pytest.fixture(scope="module")
def core(spark):
    rows = [row(n, "NODE", q(n), node_kind="PERSON" if n <= 5 else "GROUP" if n <= 7 else "WORK", label=str(n)) for n in range(1, 11)]
    for (a, t, b), (sources, vf, vt) in STATED.items():
        for s, c, at in sources:
            rows.append(row(len(rows) + 100, "EDGE", q(a), q(b), t, vf=vf, vt=vt, source=s, ref=f"r{len(rows)}", at=at, confidence=c))
    f = fold.Fold(frame(spark, rows), keep=True)
    return f.nodes, f.edges


def test_claims_merge_into_edges(core):
    _, edges = core
    assert [graph.corroborated(edges, n).count() for n in range(4)] == [11, 10, 3, 0]
    assert [(r["from_qid"], r["to_qid"]) for r in graph.hypotheses(edges).collect()] == [(q(5), q(9))]


def test_time_travel_and_audit(core, spark):
    _, edges = core
    at = lambda day: {r["from_qid"] for r in graph.edges_valid_at(graph.incident(edges, q(6)), day).collect()}
    assert at(D(1995, 6, 1)) == {q(1), q(2)}
    assert at(D(2000, 6, 1)) == {q(1)}
    from pyspark.sql import functions as F

    assert [graph.asserted_by(edges, "lastfm", F.lit(T0 + datetime.timedelta(days=d))).count() for d in (5, 11)] == [1, 0]


def test_degrees(core):
    nodes, edges = core
    for f in (graph.degree_incident, graph.degree_endpoint):
        got = {r["qid"]: r["degree"] for r in f(nodes, edges).collect()}
        assert [got[q(n)] for n in range(1, 11)] == [2, 3, 2, 1, 2, 2, 2, 3, 4, 1]


def test_paths(core):
    nodes, edges = core
    hubs = graph.hubs(nodes, graph.degree_incident(nodes, edges))
    assert [r["length"] for r in paths.simple_paths(edges, hubs, q(1), q(4), 4).collect()] == [3]
    best = paths.ranked(paths.simple_paths(edges, hubs, q(1), q(3), 4)).orderBy("rank").collect()
    assert [(r["length"], r["guess"], r["weakest"]) for r in best] == [(4, False, 0.8), (4, False, 0.8), (4, True, 0.3)]
    assert best[0]["signature"].startswith(f"{q(1)} -[AUTHORED]-> {q(8)} <-[AUTHORED]- {q(2)} -[MEMBER_OF]-> ")
    assert paths.simple_paths(edges, hubs, q(1), q(1), 4).count() == 0


def test_merges_retractions_and_emptied(spark):
    a, b, c = "Q00900042", "Q00900043", "Q00900045"
    rows = [
        row(1, "NODE", "Q0902", node_kind="PERSON", label="two"), row(2, "LOCAL", a, node_kind="GROUP", label="a"), row(3, "SAME_AS", a, "Q10000000900"), row(4, "RETRACT", a, reason="no"),
        row(5, "SAME_AS", a, "Q10000000900"), row(6, "LOCAL", b, node_kind="GROUP", label="b"), row(7, "SAME_AS", b, "Q10000000901"), row(8, "EDGE", "Q0902", a, "INFLUENCED_BY"),
        row(9, "LOCAL", c, node_kind="WORK", label="c"), row(10, "SAME_AS", c, "Q10000000903"), row(11, "SAME_AS", c, "Q10000000904"),
    ]
    f = fold.Fold(frame(spark, rows))
    assert [r["qid"] for r in f.emptied.collect()] == ["Q10000000900"]
    assert [r["qid"] for r in f.stand_ins.orderBy("seq").collect()] == ["Q10000000901", "Q10000000904"]
    assert f.edge_claims.where("fate = 'withdrawn'").count() == 1
    assert f.edges.count() == 0


def test_retraction_reaches_backwards_only(spark):
    rows = [row(1, "NODE", "Q1", node_kind="PERSON", label="old"), row(2, "RETRACT", "Q1", reason="x"), row(3, "NODE", "Q1", node_kind="PERSON", label="new")]
    assert [r["label"] for r in fold.Fold(frame(spark, rows)).nodes.collect()] == ["new"]


def test_dates_come_from_the_first_claim_that_has_one_and_sources_from_the_first_of_their_kind(spark):
    rows = [row(1, "NODE", "Q1", node_kind="PERSON"), row(2, "NODE", "Q2", node_kind="WORK")]
    rows += [row(3, "EDGE", "Q1", "Q2", "AUTHORED", ref="r", confidence=0.5), row(4, "EDGE", "Q1", "Q2", "AUTHORED", ref="r", vf=D(2000, 1, 1)), row(5, "EDGE", "Q1", "Q2", "AUTHORED", vf=D(1990, 1, 1), vt=D(2001, 1, 1))]
    (e,) = fold.Fold(frame(spark, rows)).edges.collect()
    assert (e["valid_from"], e["valid_to"]) == (D(2000, 1, 1), D(2001, 1, 1))
    assert [(s["source_ref"], s["confidence"]) for s in e["sources"]] == [("r", 0.5), (None, 1.0)]


def test_an_empty_log(spark):
    f = fold.Fold(frame(spark, []))
    assert f.nodes.count() == 0 and f.edges.count() == 0
