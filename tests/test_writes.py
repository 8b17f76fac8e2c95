"""Appends, ratings, seeds and expansion: small cases with known answers."""

import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from provenir.operators import expand, resolve, taste
from provenir.operators.fold import Fold
from provenir.schema import LOG
from provenir.sources import log_store
from provenir.sources.spi import Adapter, Adapters
from provenir.streaming.ratings import RATINGS, RatingState

T0 = datetime.datetime(2026, 8, 1, 9)
NEW = "kind string, qid string, to_qid string, type_code string, node_kind string, instance_of array<string>, label string, valid_from date, valid_to date, source_id string, source_ref string, asserted_at timestamp, asserted_at_iso string, confidence double, reason string, ord long"


def row(ord, kind, qid, to=None, type_code=None, node_kind=None, label=None, source="wikidata", confidence=1.0, reason=None, vf=None, vt=None):
    return (kind, qid, to, type_code, node_kind, None, label, vf, vt, source, None, T0, "t", confidence, reason, ord)


def test_numbers_go_on_without_gaps_in_order(spark, tmp_path):
    path = tmp_path.as_uri() + "/log"
    nodes = [row(k, "NODE", f"Q{k}", node_kind="PERSON", label=str(k)) for k in range(1, 200)]
    shuffled = random.Random(1).sample(nodes, len(nodes))
    assert log_store.append(spark, path, spark.createDataFrame(shuffled, NEW).repartition(7), "a", ["ord"]) == 199
    assert log_store.append(spark, path, spark.createDataFrame(nodes[:3], NEW), "b", ["ord"]) == 3
    assert log_store.append(spark, path, spark.createDataFrame(nodes[:3], NEW), "b", ["ord"]) == 0  # the run is there
    got = [(r["seq"], r["qid"]) for r in log_store.read_log(spark, path).orderBy("seq").collect()]
    assert got == list(enumerate([f"Q{k}" for k in range(1, 200)] + ["Q1", "Q2", "Q3"]))


BAD = [
    row(1, "NOTE", "Q1"), row(1, "NODE", "x", node_kind="PERSON", label="x"), row(1, "NODE", None, node_kind="PERSON", label="x"), row(1, "NODE", "Q1", node_kind="THING", label="x"), row(1, "NODE", "Q1", node_kind="PERSON", label=" "),
    row(1, "LOCAL", "Q1", node_kind="PERSON", label="x"), row(1, "EDGE", "Q1", None, "AUTHORED"), row(1, "EDGE", "Q1", "Q2", "LIKES"), row(1, "SAME_AS", "Q001", "Q002"), row(1, "SAME_AS", "Q1", "Q2"),
    row(1, "RETRACT", "Q1"), row(1, "NODE", "Q1", node_kind="PERSON", label="x", source=""), row(1, "EDGE", "Q1", "Q2", "AUTHORED", confidence=1.5), row(1, "EDGE", "Q1", "Q2", "AUTHORED", confidence=None),
    row(1, "EDGE", "Q1", "Q2", "AUTHORED", vf=datetime.date(2001, 1, 1), vt=datetime.date(2000, 1, 1)),
]


def test_each_rule_refuses_its_row(spark):
    good = [row(2, "NODE", "Q1", node_kind="PERSON", label="x"), row(3, "LOCAL", "Q001", node_kind="WORK", label="y"), row(4, "SAME_AS", "Q001", "Q7"), row(5, "RETRACT", "Q1", reason="z"), row(6, "OWNER_EDGE", "Q1", "Q2", "AUTHORED")]
    refused = log_store.refusals(spark.createDataFrame(BAD + good, NEW))
    assert refused.count() == len(BAD) and refused.where("ord > 1").count() == 0


def test_one_bad_row_refuses_the_batch_before_anything_is_written(spark, tmp_path):
    path = tmp_path.as_uri() + "/log"
    good = row(2, "NODE", "Q1", node_kind="PERSON", label="x")
    with pytest.raises(log_store.RefusedBatch, match="unknown edge type"):
        log_store.append(spark, path, spark.createDataFrame([good, BAD[7]], NEW), "a", ["ord"])
    assert not (tmp_path / "log").exists()


def test_a_log_written_before_a_column_was_added_can_be_read_and_grow(spark, tmp_path):
    path = tmp_path.as_uri() + "/log"
    old = spark.createDataFrame([(0, "NODE", "Q1", "PERSON", "one", "wikidata", 1.0, "gone by now")], "seq long, kind string, qid string, node_kind string, label string, source_id string, confidence double, dropped string")
    old.write.parquet(path + "/run=old")
    log_store.append(spark, path, spark.createDataFrame([row(1, "RETRACT", "Q2", reason="why")], NEW), "new", ["ord"])
    rows = log_store.read_log(spark, path).orderBy("seq").collect()
    assert [(r["seq"], r["qid"], r["reason"]) for r in rows] == [(0, "Q1", None), (1, "Q2", "why")] and rows[0].asDict().keys() == {f.name for f in LOG}


VERSIONS = [("Q1", 3, "first", T0, 1), ("Q1", 4, None, T0, 2), ("Q1", 5, None, T0 - datetime.timedelta(days=1), 9), ("Q1", 2, "late", T0 - datetime.timedelta(days=2), 12), ("Q2", 1, None, None, 1), ("Q2", 2, None, T0, 0)]


def test_the_newest_rating_counts_in_whatever_order_versions_come(spark, tmp_path):
    want = {("Q1", 4, "first", T0, 2), ("Q2", 2, None, T0, 0)}
    frame = lambda rows: spark.createDataFrame(rows, RATINGS)
    assert {tuple(r) for r in taste.upsert_ratings(frame(VERSIONS)).collect()} == want
    for k, order in enumerate([VERSIONS[::-1], random.Random(2).sample(VERSIONS, 6)]):
        state = RatingState(spark, f"{tmp_path.as_uri()}/{k}")
        for n, part in enumerate(itertools.batched(order, 3)):
            state.apply(frame(list(part)), n)
            state.apply(frame(list(part)), n)
        assert {tuple(r) for r in state.current().select(RATINGS.names).collect()} == want


def test_a_newer_rating_follows_a_merge_and_an_older_one_does_not(spark):
    day = lambda d: T0 + datetime.timedelta(days=d)
    ratings = spark.createDataFrame([("Q001", 5, "mine", day(3), 1), ("Q10", 1, "its own", day(1), 2), ("Q002", 4, None, day(1), 3), ("Q20", 2, None, day(1), 4), ("Q003", 3, None, day(2), 5), ("Q004", 1, None, day(2), 6)], RATINGS)
    merges = spark.createDataFrame([(1, "Q001", "Q10"), (2, "Q002", "Q20"), (3, "Q003", "Q30"), (4, "Q004", "Q30"), (5, "Q005", "Q50")], "seq long, local string, canonical string")
    once = taste.carry_ratings(ratings, merges)
    got = {r["qid"]: (r["rating"], r["note"], r["updated_at"]) for r in once.collect()}
    assert got == {"Q001": (5, "mine", day(3)), "Q10": (5, "its own", day(3)), "Q002": (4, None, day(1)), "Q20": (2, None, day(1)), "Q003": (3, None, day(2)), "Q004": (1, None, day(2)), "Q30": (3, None, day(2))}
    assert sorted(map(tuple, taste.carry_ratings(once, merges).collect())) == sorted(map(tuple, once.collect()))


def test_noting_a_rating(spark):
    ratings, nodes = spark.createDataFrame([("Q1", 3, "kept", T0, 1)], RATINGS), spark.createDataFrame([("Q1",)], "qid string")
    at = F.lit(T0 + datetime.timedelta(days=1))
    assert [tuple(r)[:3] for r in taste.note_affinity(ratings, "Q1", 5, "  ", at, 2, nodes).collect()] == [("Q1", 5, "kept")]
    for qid, rating in (("Q2", 3), ("Q1", 0), ("Q1", 6)):
        with pytest.raises(ValueError):
            taste.note_affinity(ratings, qid, rating, None, at, 2, nodes)


@pytest.fixture
def search(spark):
    seeds = [("Dr. Ann Lee", "person", 0), ("ann lee", "person", 1), ("Bo", "person", 2), ("Cy (2)", "person", 3), ("Dee", "work", 4), ("?!", "person", 5), ("Eve", "unknown", 6)]
    hits = [("Dr. Ann Lee", 0, "Q1"), ("Ann Lee", 0, "Q2"), ("ann lee", 0, "Q2"), ("Cy", 0, "Q3"), ("Cy", 9, "Q4"), ("Dee", 0, "Q5"), ("Dee", 1, "Q6"), ("Eve", 0, "Q7")]
    facts = [("Q1", "Another", [], "PERSON", [], ["Q900"], 1), ("Q2", "Ann Lee", [], "PERSON", [], ["Q900"], 9), ("Q3", "Someone", ["CY"], "PERSON", [], [], 4), ("Q4", "Cy", [], "PERSON", [], ["Q900"], 4), ("Q5", "Dee", [], "WORK", ["Q77"], [], 50), ("Q6", "Dee", [], "WORK", ["Q78"], [], 5), ("Q7", "Eve", [], "PERSON", [], [], 5)]
    expected = [("person", ["PERSON"], [], ["Q900"]), ("work", ["WORK"], ["Q78"], [])]
    make = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    return (
        make(seeds, "name string, expects string, ord long"), make(hits, "spelling string, pos long, qid string"),
        make(facts, "qid string, label string, aliases array<string>, kind string, instance_of array<string>, occupations array<string>, sitelinks long"), make(expected, "expects string, kinds array<string>, classes array<string>, occupations array<string>"),
    )


WANT = {
    "drannlee": ("ACCEPTED", "Q2", "clear", 1),  # the whole name only finds another; without the title it is clear
    "annlee": ("ACCEPTED", "Q2", "clear", 0),
    "bo": ("UNRESOLVED", None, "no candidates", 0),
    "cy2": ("REVIEW", "Q3", "no name matches", 1),  # too short an alias; the one that would do is beyond the candidates
    "dee": ("ACCEPTED", "Q6", "clear", 0),  # the class decides before fame
    "eve": ("REVIEW", "Q7", "does not fit", 0),
}


def test_seeds_are_asked_for_under_one_spelling_after_the_other(search):
    got = {r["key"]: (r["status"], r["qid"], r["reason"], r["pass"]) for r in resolve.resolve_seeds(*search).collect()}
    assert got == WANT


def test_a_resumed_run_equals_a_whole_one(search, spark, tmp_path, monkeypatch):
    path, whole = tmp_path.as_uri() + "/seeds", resolve.resolve_seeds
    calls = []

    def failing(*a):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("stopped")
        return whole(*a)

    monkeypatch.setattr(resolve, "resolve_seeds", failing)
    with pytest.raises(RuntimeError):
        resolve.resolve_in_chunks(*search, path, 2)
    got = {r["key"]: (r["status"], r["qid"], r["reason"], r["pass"]) for r in resolve.resolve_in_chunks(*search, path, 2).collect()}
    assert got == WANT and len(calls) == 3


class Told(Adapter):
    def __init__(self, id, rows):
        self.id, self.rows = id, rows

    def claims(self, seeds):
        made = seeds.sparkSession.createDataFrame([(s, a, t, b, None, None, 0.8, ref) for s, a, t, b, ref in self.rows], "seed string, from_qid string, type_code string, to_qid string, valid_from date, valid_to date, confidence double, source_ref string")
        return made.join(seeds.select(F.col("qid").alias("seed")), "seed", "left_semi")


def test_an_expansion_is_one_run_and_adds_nothing_twice(spark, tmp_path):
    path, at = tmp_path.as_uri() + "/log", F.lit(T0)
    start = [row(k, "NODE", f"Q{k}", node_kind="PERSON", label=str(k)) for k in (1, 2)] + [row(3, "EDGE", "Q1", "Q2", "SIMILAR_TO")]
    log_store.append(spark, path, spark.createDataFrame(start, NEW), "0", ["ord"])
    one = Told("wikidata", [("Q1", "Q1", "SIMILAR_TO", "Q2", None), ("Q1", "Q1", "AUTHORED", "Q50", "s1"), ("Q1", "Q1", "AUTHORED", "Q60", "s2"), ("Q2", "Q2", "AUTHORED", "Q50", "s3")])
    two = Told("musicbrainz", [("Q1", "Q1", "AUTHORED", "Q50", "m1"), ("Q2", "Q2", "AUTHORED", "Q50", "m2"), ("Q2", "Q2", "AUTHORED", "Q50", "m2")])
    facts = spark.createDataFrame([("Q50", "WORK", "Fifty", ["Q7"]), ("Q99", "WORK", "Never named", [])], "qid string, kind string, label string, instance_of array<string>")
    seeds = spark.createDataFrame([("Q1",), ("Q1",), ("Q2",), ("Q001",), ("Q404",)], "qid string")
    told = lambda run: {(r["source_id"], r["fate"]): r["n"] for r in expand.expand_entities(spark, path, seeds, Adapters(one, two), facts, run, 10, at).collect()}
    refused = {("", "local entity"): 1, ("", "unknown entity"): 1}
    assert told("1") == {("wikidata", "held"): 1, ("wikidata", "kept"): 2, ("wikidata", "no description"): 1, ("wikidata", "described"): 1, ("musicbrainz", "kept"): 2, ("musicbrainz", "repeated"): 1} | refused
    rows = log_store.read_log(spark, path).orderBy("seq").collect()
    assert [r["kind"] for r in rows] == ["NODE", "NODE", "EDGE", "NODE", "EDGE", "EDGE", "EDGE", "EDGE"]
    graph = Fold(log_store.read_log(spark, path))
    assert {(r["from_qid"], r["to_qid"], len(r["sources"])) for r in graph.edges.collect()} == {("Q1", "Q2", 1), ("Q1", "Q50", 2), ("Q2", "Q50", 2)}
    assert {r["qid"]: r["label"] for r in graph.nodes.collect()} == {"Q1": "1", "Q2": "2", "Q50": "Fifty"}
    again = told("2")
    assert again["wikidata", "held"] == 3 and ("wikidata", "kept") not in again and log_store.read_log(spark, path).count() == 8
