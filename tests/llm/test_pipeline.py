import corpus_pipeline
from provenir.llm import registry


def test_stages_keep_columns_and_their_decisions(spark, prose, tmp_path):
    clean = [(k, prose(k, 80)) for k in range(60)]
    junk = [(100 + k, " ".join(w + "%%%" for w in prose(700 + k, 80).split())) for k in range(30)]
    rows = [*clean, *junk, (200, clean[3][1] + " more"), (201, prose(800, 20) + " " + prose(9000, 30) + " " + prose(801, 20)), (202, "\n".join([clean[5][1], prose(802, 40)])), (203, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, prose(9000, 30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(i, 1, 0) for i, _ in clean[:40]] + [(i, 0, 0) for i, _ in junk[:20]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        if k < 4:
            assert now.columns == docs.columns, name
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
    ids = {r["doc_id"] for r in now.collect()}
    assert {i for i, _ in clean} <= ids and not ids & {i for i, _ in junk} and not ids & {200, 201, 203} and 202 in ids
    dedup = {r["doc_id"]: r for r in spark.read.parquet(f"{tmp_path}/lines").collect()}
    assert dedup[202]["text"] == prose(802, 40) and dedup[202]["n_chars"] == len(dedup[202]["text"])
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, now.collect()))


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 11))
