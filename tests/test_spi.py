"""Statement files as a data source, adapters, and reverse lookups cut at a bound."""

import json

import pytest

from provenir.sources.spi import Adapters, StatementAdapter, read_statement_files
from provenir.sources.statements import top_reverse_rows


def statement(prop, obj, sid):
    return {prop: [{"id": sid, "rank": "normal", "mainsnak": {"snaktype": "value", "datavalue": {"value": {"id": obj}}}, "references": []}]}


def write(folder, entities, files=2):
    folder.mkdir()
    for k in range(files):
        (folder / f"part-{k}.json").write_text("".join(json.dumps(e, ensure_ascii=False) + "\n" for e in entities[k::files]))
    (folder / "_SUCCESS").write_text("not read")
    return folder.as_uri()


@pytest.fixture
def entities():
    return [{"id": f"Q{k}", "claims": statement("P463", f"Q{100 + k % 3}", f"s{k}"), "note": "ü" * (k % 40)} for k in range(1, 60)]


@pytest.mark.parametrize("split", [211, 10**6])
def test_every_line_is_read_once_however_files_are_split(spark, tmp_path, entities, split):
    got = read_statement_files(spark, write(tmp_path / "s", entities), split).collect()
    assert sorted(r["qid"] for r in got) == sorted(e["id"] for e in entities)
    assert {r["qid"]: json.loads(r["json"]) for r in got} == {e["id"]: e for e in entities}


def test_an_id_that_is_asked_for_reaches_the_reader(spark, tmp_path, entities):
    df = read_statement_files(spark, write(tmp_path / "s", entities))
    assert [r["qid"] for r in df.where("qid = 'Q7'").collect()] == ["Q7"]
    assert sorted(r["qid"] for r in df.where("qid in ('Q7', 'Q8', 'Q404') and json like '%s8%'").collect()) == ["Q8"]
    plan = df.where("qid = 'Q7'")._jdf.queryExecution().executedPlan().toString()
    assert "(qid" not in plan.replace("isnotnull(qid", "")  # nothing is compared again above the scan


def test_an_empty_folder(spark, tmp_path):
    assert read_statement_files(spark, write(tmp_path / "s", [], 1)).count() == 0


def test_adapters_answer_in_order_up_to_the_bound(spark, tmp_path, entities):
    one = StatementAdapter("first", read_statement_files(spark, write(tmp_path / "a", entities)), kinds=("GROUP",))
    two = StatementAdapter("second", read_statement_files(spark, write(tmp_path / "b", entities + [{"id": "Q3", "claims": statement("P361", "Q200", "x")}])))
    seeds = spark.createDataFrame([("Q3", "GROUP"), ("Q4", "PERSON"), ("Q999", "GROUP")], "qid string, kind string")
    got = {(r["seed"], r["source_id"], r["type_code"], r["place"]) for r in Adapters(one, two).expand(seeds, 2).collect()}
    assert got == {("Q3", "first", "MEMBER_OF", 1), ("Q3", "second", "MEMBER_OF", 2), ("Q4", "second", "MEMBER_OF", 1)}
    with pytest.raises(ValueError):
        Adapters(one, two).expand(seeds, 0)


@pytest.mark.parametrize("ids", [["a", "a"], [""], [" "], ["a\tb"], ["a", "b\n"]])
def test_bad_adapter_ids_are_refused(ids):
    with pytest.raises(ValueError):
        Adapters(*(StatementAdapter(i, None) for i in ids))


def test_reverse_rows_are_cut_at_the_bound_and_say_so(spark):
    rows = [("Q1", "P175", f"Q{k}", 5000 - k) for k in range(10, 3000)]  # a seed with very many others
    rows += [("Q2", "P175", "Q20", 3), ("Q2", "P175", "Q20", 3), ("Q2", "P50", "Q20", 3), ("Q2", "P175", "Q2", 99), ("Q2", "P999", "Q21", 98), ("Q2", "P527", "Q22", 97)]
    rows += [("Q3", "P175", "Q30", 1), ("Q3", "P175", "Q31", 1), ("Q3", "P175", "L5", 0)]
    got = top_reverse_rows(spark.createDataFrame(rows, "seed string, property string, other string, sitelinks long"), 2).collect()
    assert sorted((r["seed"], r["other"], r["cut"]) for r in got) == [("Q1", "Q10", True), ("Q1", "Q11", True), ("Q3", "Q30", False), ("Q3", "Q31", False)]
    wide = top_reverse_rows(spark.createDataFrame(rows, "seed string, property string, other string, sitelinks long"), 5).where("seed = 'Q2'").collect()
    assert sorted((r["property"], r["other"], r["cut"]) for r in wide) == [("P175", "Q20", False), ("P50", "Q20", False)]
    with pytest.raises(ValueError):
        top_reverse_rows(None, 0)
