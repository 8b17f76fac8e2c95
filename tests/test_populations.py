import datetime

import pytest
from pyspark.sql import functions as F

from provenir.functions.kinds import KIND_CLASSES, kind_of, rederive
from provenir.operators import census, expand, population
from provenir.sources import entities


def test_kinds(spark):
    rows = [(0, []), (1, ["Q999", "Q5"]), (2, ["Q515", "Q11424"]), (3, ["Q132241", "Q43229"]), (4, ["Q999"]), (5, None), (6, [None, "Q515"]), (7, [None])]
    df = spark.createDataFrame(rows, "k int, c array<string>").orderBy("k")
    assert [r[0] for r in df.select(kind_of(F.col("c"))).collect()] == ["CONCEPT", "PERSON", "WORK", "GROUP", "CONCEPT", "CONCEPT", "PLACE", "CONCEPT"]
    # Without classes the claim's own kind stays; with classes that say nothing it doesn't.
    assert [r[0] for r in df.select(rederive(F.lit("EVENT"), F.col("c"))).collect()] == ["EVENT", "PERSON", "WORK", "GROUP", "CONCEPT", "EVENT", "PLACE", "CONCEPT"]
    every = [c for ids in KIND_CLASSES.values() for c in ids]
    assert len(every) == len(set(every))


def test_entities(spark):
    rows = [
        ("Q1", '{"labels":{"mul":{"value":"any"},"en":{"value":"one"}},"aliases":{"en":[{"value":"a"},{"value":" "}],"mul":[{"value":"b"},{"value":"a"}]},"claims":{"P31":[{"mainsnak":{"datavalue":{"value":{"id":"Q5"}}}},{"mainsnak":{"datavalue":{"value":"text"}}},{"mainsnak":{}}]}}'),
        ("Q2", '{"missing":"","labels":{"en":{"value":"two"}}}'),
        ("Q3", '{"labels":{"en":{"value":"  "}}}'),
        ("Q4", None),
        ("Q5", "no json"),
        ("Q6", '{"labels":{"mul":{"value":"six"}},"sitelinks":{"a":{},"b":{}}}'),
        ("Q6", '{"labels":{"mul":{"value":"six"}},"sitelinks":{"a":{},"b":{}}}'),
    ]
    got = {r["qid"]: (r["label"], r["aliases"], r["kind"], r["instance_of"], r["occupations"], r["sitelinks"]) for r in entities.entity_facts(spark.createDataFrame(rows, "qid string, json string")).collect()}
    assert got == {"Q1": ("one", ["a", "b"], "PERSON", ["Q5"], [], 0), "Q6": ("six", [], "CONCEPT", [], [], 2)}
    for bad in ("x1", None):
        with pytest.raises(Exception, match="not an id"):
            entities.entity_facts(spark.createDataFrame([(bad, "{}")], "qid string, json string")).collect()


def test_search_limit_is_held_between_1_and_50(spark):
    hits = ",".join(f'{{"id":"Q{k}","label":"l"}}' for k in range(60))
    answers = spark.createDataFrame([("a", f'{{"search":[{hits}]}}'), ("b", "{}"), ("c", None), ("d", '{"search":[{"id":"Q1"}]}')], "query string, json string")
    assert [entities.search_hits(answers, n).count() for n in (0, 7, 99)] == [1, 7, 50]


def test_expansion_is_cut_after_the_sources_are_joined(spark):
    answers = spark.createDataFrame([("Q1", a, k, f"s{a}") for a in (1, 0) for k in range(30)] + [("Q2", 0, 1, "s0"), ("Q9", 0, 1, "s0")], "seed string, adapter int, seq long, source_id string")
    nodes = spark.createDataFrame([("Q1", "CONCEPT"), ("Q2", "PERSON")], "qid string, kind string")
    kept = expand.bounded(answers, nodes, 40)
    assert {r["source_id"]: (r["kept"], r["entities"]) for r in expand.tally(kept).collect()} == {"s0": (26, 2)}
    assert {r["seed"]: tuple(r)[1:] for r in expand.summary(answers, nodes, 40).collect()} == {"Q1": (25, 60, 25, True), "Q2": (40, 1, 1, False)}
    assert {r["source_id"]: r["kept"] for r in expand.tally(expand.bounded(answers, nodes.withColumn("kind", F.lit("PERSON")), 40)).collect()} == {"s0": 31, "s1": 10}


def test_populations(spark):
    file = spark.createDataFrame([("Q001", 3), ("Q1", 2), ("Q7", 1)], "qid string, ord long")
    merges = spark.createDataFrame([("Q001", "Q7")], "local string, canonical string")
    listed = population.canonical_list(file, merges)
    assert {tuple(r) for r in listed.collect()} == {("Q7", 1), ("Q1", 2)}
    old, new = datetime.datetime(2026, 1, 1), datetime.datetime(2026, 6, 1)
    resolved = spark.createDataFrame([("Q1", 5, old), ("Q2", 4, new), ("Q3", 3, new), ("Q4", 5, old)], "qid string, rating int, updated_at timestamp")
    off = population.promotions_off_list(listed, resolved)
    assert {r[0] for r in off.collect()} == {"Q2", "Q4"}
    since = F.to_timestamp(F.lit("2026-06-01"))
    assert {r[0] for r in population.rated_since(resolved, since).collect()} == {"Q2"}
    assert {r[0] for r in population.rating_age(resolved, since).where("is_new").collect()} == {"Q2", "Q3"}
    with pytest.raises(Exception, match="no time"):
        population.rating_age(resolved.withColumn("updated_at", F.lit(None).cast("timestamp")), since).collect()
    claims = spark.createDataFrame([(1, "NODE", "Q2", None, "GROUP", "Zed", None), (2, "NODE", "Q2", None, "WORK", "Abe", None), (3, "EDGE", "Q4", "Q2", None, None, "PERFORMED")], "seq long, kind string, qid string, to_qid string, node_kind string, label string, type_code string")
    assert {r[0] for r in population.acts(claims).collect()} == {"Q4"}
    assert [tuple(r) for r in population.names_out(off, claims.where("kind = 'NODE'")).collect()] == [("Abe", "Q2", True), ("Q4", "Q4", False)]


def test_isolated_members_with_and_without_somebody_to_expand(spark):
    nodes = spark.createDataFrame([(q, "PERSON") for q in ("Q1", "Q2", "Q3", "Q4")], "qid string, kind string")
    edges = spark.createDataFrame([("Q1", "SIMILAR_TO", "Q3", []), ("Q2", "SIMILAR_TO", "Q4", [])], "from_qid string, type_code string, to_qid string, sources array<struct<source_id string, confidence double>>")
    lonely, seeds = spark.createDataFrame([("Q1",), ("Q2",)], "qid string"), spark.createDataFrame([("Q4",)], "qid string")
    assert tuple(census.known_isolation(nodes, edges, lonely, seeds).head()) == (1, 1, 1)
