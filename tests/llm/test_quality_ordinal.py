from llm_odd import ODD
from provenir.llm.quality_ordinal import keep_good, score, train


def corpus(prose):
    good = [(k, prose(k, 60)) for k in range(120)]
    junk = [(200 + k, " ".join(w + "%%%" for w in prose(k + 500, 60).split())) for k in range(60)]
    toxic = [(300 + k, prose(k + 900, 30) + " vile " + prose(k + 950, 30)) for k in range(60)]
    return good, junk, toxic


def test_grades_and_what_is_kept(spark, make, prose):
    good, junk, toxic = corpus(prose)
    rated = [(i, 1, 0) for i, _ in good[:80]] + [(i, 0, 0) for i, _ in junk[:40]] + [(i, 1, 1) for i, _ in toxic[:40]] + [(1, None, None), (None, 1, 0), (2, 1, None)]
    labels = spark.createDataFrame(rated, "doc_id long, quality int, toxic int")
    documents = make(good + junk + toxic)
    kept = keep_good(documents, labels)
    assert kept.columns == documents.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert len(ids & {i for i, _ in good}) >= 115 and len(ids & {i for i, _ in junk}) <= 2 and len(ids & {i for i, _ in toxic}) <= 6
    model = train(documents, labels)
    grade = {r["doc_id"]: r["expected_grade"] for r in score(documents.select("doc_id", "text"), model).collect()}
    mean = lambda rows: sum(grade[i] for i, _ in rows) / len(rows)
    assert mean(junk) < mean(toxic) < mean(good)
    assert model.thresholds[0] <= model.thresholds[1]


def test_odd_rows(spark, make):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = [(r["doc_id"], r["text"]) for r in keep_good(make(ODD), none).collect()]
    assert sorted(map(repr, kept)) == sorted(repr(x) for x in ODD if (x[1] or "").strip())
    assert keep_good(make([]), none).count() == 0


def test_own_columns_of_the_same_names(spark):
    documents = spark.createDataFrame([(1, "some words", "mine", 7, "x"), (2, None, None, None, "y"), (3, "some words", "mine", 7, "x")], "doc_id long, text string, kept string, tail_good int, `a.b` string")
    out = score(documents, None)
    assert out.columns == ["doc_id", "text", "a.b", "expected_grade", "tail_good", "kept"]
    assert sorted((r["doc_id"], r["a.b"], r["kept"]) for r in out.collect()) == [(1, "x", True), (2, "y", False), (3, "x", True)]
    assert score(documents.limit(0), None).count() == 0


def test_rated_documents_reach_the_driver_as_arrays(spark, make, monkeypatch):
    from provenir.llm import quality_ordinal

    documents = make([(k, f"word{k % 3} common text") for k in range(12)])
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(12)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality_ordinal, "fit", seen.extend)
    monkeypatch.setattr(type(documents), "collect", lambda _: 1 / 0)
    quality_ordinal.train(documents, labels)
    assert sorted(g for _, g in seen) == [0] * 6 + [2] * 6
    assert all(p.dtype == "int32" and len(p) > 3 and (p[1:] > p[:-1]).all() for p, _ in seen)
