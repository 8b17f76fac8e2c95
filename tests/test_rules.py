import pytest
from pyspark.sql import functions as F

from provenir.functions.names import spellings
from provenir.operators import graph, taste
from provenir.sources import files, statements


def test_neutral_signals_infer_nothing(spark):
    signals = spark.createDataFrame([("Q1", 4, False, False), ("Q2", 5, False, False), ("Q3", 25, False, False), ("Q4", 0, True, False), ("Q5", 0, False, True), ("Q6", 99, False, False)], "qid string, play_count long, loved boolean, favorited boolean")
    resolved = spark.createDataFrame([("Q6", 1)], "qid string, rating int")
    merges = spark.createDataFrame([], "local string, canonical string")
    got = {r["qid"]: (r["confidence"], r["evidence"]) for r in taste.interest(resolved, signals, merges).collect()}
    assert got == {"Q2": (0.55, "INFERRED"), "Q3": (0.6, "INFERRED"), "Q4": (0.7, "INFERRED"), "Q5": (0.7, "INFERRED"), "Q6": (0.0, "RATED")}


def test_spellings(spark):
    names = ["Sir John (2)", "St Vincent", "Prof. X", "Dame", "(3)", "Madonna"]
    got = [r[0] for r in spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, n string").orderBy("k").select(spellings(F.col("n"))).collect()]
    assert got == [["Sir John (2)", "Sir John", "John"], ["St Vincent"], ["Prof. X", "X"], ["Dame"], ["(3)"], ["Madonna"]]


def test_hubs_by_degree_and_by_recognition(spark):
    nodes = spark.createDataFrame([("Q1", "CONCEPT", []), ("Q2", "CONCEPT", []), ("Q3", "GROUP", ["Q1046088"]), ("Q4", "GROUP", ["Q215380"])], "qid string, kind string, instance_of array<string>")
    degrees = spark.createDataFrame([("Q1", 10), ("Q2", 9), ("Q3", 1), ("Q4", 99)], "qid string, degree long")
    assert {r["qid"] for r in graph.hubs(nodes, degrees).collect()} == {"Q1", "Q3"}


def test_lists_of_ids(spark, tmp_path):
    one, none = tmp_path / "one.csv", tmp_path / "none.csv"
    one.write_text('name,qid\nA,"Q7"\nB,Q5,Q6\nC,Q7\n')
    none.write_text("name\nA\n")
    assert [(r["qid"], r["ord"]) for r in files.read_qids(spark, str(one)).orderBy("ord").collect()] == [("Q7", 1), ("Q5", 2)]
    with pytest.raises(ValueError):
        files.read_qids(spark, str(none))


def test_signal_files_refuse_odd_values(spark, tmp_path):
    def read(text):
        path = tmp_path / f"{abs(hash(text))}.csv"
        path.write_text("artist,play_count,loved,favorited\n" + text)
        return [tuple(r) for r in files.read_signals(spark, str(path)).collect()]

    assert read('"A, B", 3 ,Yes,\n') == [("A, B", 3, True, False)]
    for bad in ("A,x,,\n", "A,3,maybe,\n", "A,3,,2\n"):
        with pytest.raises(Exception):
            read(bad)


def test_claims_have_line_numbers(spark, tmp_path):
    path = tmp_path / "claims.csv"
    path.write_text("# mine\nfrom,to,type\nQ1,Q2,MEMBER_OF\n\nQ1,Q2\nQ1,x,MEMBER_OF\n")
    good, bad = files.read_claims(spark, str(path))
    assert [tuple(r) for r in good.collect()] == [("Q1", "Q2", "MEMBER_OF")]
    assert sorted(tuple(r) for r in bad.collect()) == [(5, "Q1,Q2"), (6, "Q1,x,MEMBER_OF")]


def test_catalogue_relations(spark):
    mbid = lambda k: f"{k:08x}-0000-0000-0000-000000000000"
    rows = [("Q1", mbid(1), "member of band", "forward", "1990-01-02", "1990", mbid(2)), ("Q1", mbid(1), "collaboration", "forward", None, None, mbid(2)), ("Q1", mbid(1), "member of band", "backward", None, None, mbid(3))]
    relations = spark.createDataFrame(rows, "seed_qid string, seed_mbid string, type string, direction string, begin string, end string, mbid string")
    bridge = spark.createDataFrame([(mbid(2), "Q9"), (mbid(2), "Q8"), (mbid(3), "Q7")], "mbid string, qid string")
    got = sorted((r["from_qid"], r["type_code"], r["to_qid"], str(r["valid_from"]), r["valid_to"]) for r in statements.relations_to_edges(relations, bridge).collect())
    assert got == [("Q1", "MEMBER_OF", "Q8", "1990-01-02", None), ("Q7", "MEMBER_OF", "Q1", "None", None)]
