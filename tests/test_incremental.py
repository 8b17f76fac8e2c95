"""State kept by batches against a fold of all rows."""

import datetime
import random
import uuid

import pytest

from provenir.operators.fold import Fold
from provenir.schema import LOG
from provenir.streaming import incremental
from provenir.streaming import state as state_tables
from provenir.streaming.incremental import GraphState, maintain

T0 = datetime.datetime(2026, 8, 1, 9)


def entry(seq, kind, qid, to=None, type_code=None, node_kind=None, label=None, vf=None, source="wikidata", ref=None, classes=()):
    return (seq, kind, qid, to, type_code, node_kind, list(classes), label, vf, None, source, ref, T0, "t", 1.0, None)


def some_log(r, n):
    """Rows about few ids, so that merges, retractions and stand-ins meet often."""
    plain, local, canonical = [f"Q{k}" for k in range(1, 7)], [f"Q00{k}" for k in range(1, 5)], [f"Q{k}" for k in range(90, 94)]
    rows = []
    for seq in range(1, n + 1):
        kind = r.choices(["NODE", "EDGE", "OWNER_EDGE", "LOCAL", "SAME_AS", "RETRACT"], [5, 8, 4, 4, 4, 2])[0]
        if kind in ("NODE", "LOCAL"):
            rows.append(entry(seq, kind, r.choice(local if kind == "LOCAL" else plain + canonical[:1]), node_kind=r.choice(["PERSON", "WORK"]), label=f"n{seq}"))
        elif kind == "SAME_AS":
            rows.append(entry(seq, kind, r.choice(local), r.choice(canonical + plain[:1]), source="owner"))
        elif kind == "RETRACT":
            rows.append(entry(seq, kind, r.choice(plain + local + canonical), source="(retraction)"))
        else:
            a, b = r.choice(plain + local + canonical), r.choice(plain + local + canonical)
            rows.append(entry(seq, kind, a, b, r.choice(["MEMBER_OF", "AUTHORED"]), vf=r.choice([None, datetime.date(2000, 1, r.randrange(1, 9))]), source=r.choice(["wikidata", "musicbrainz"]), ref=r.choice([None, "x"])))
    return rows


def same(state, rows, spark):
    want = Fold(spark.createDataFrame(rows, LOG), keep=True)
    view = lambda df: sorted(map(repr, (r.asDict(True) for r in df.select(sorted(df.columns)).collect())))
    assert view(state.nodes()) == view(want.nodes)
    assert view(state.edges()) == view(want.edges)
    assert view(state.emptied()) == view(want.emptied)


@pytest.fixture(autouse=True)
def few_buckets(monkeypatch):
    monkeypatch.setattr(state_tables, "BUCKETS", 3)


def fresh(spark, tmp_path):
    return GraphState(spark, f"{tmp_path.as_uri()}/{uuid.uuid4().hex}")


@pytest.mark.parametrize("seed", [3])
def test_batches_equal_a_fold_of_all_rows(spark, tmp_path, seed):
    r = random.Random(seed)
    rows, state = some_log(r, 60), fresh(spark, tmp_path)
    if seed % 2:  # rows arrive in any order; their positions stay
        r.shuffle(rows)
    cuts = [0, 40, 52, 60]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        state.apply(spark.createDataFrame(rows[a:b], LOG), k)
        if seed == 3 and k == 1:  # delivered again
            state.apply(spark.createDataFrame(rows[a:b], LOG), k)
        same(state, rows[:b], spark)
    assert state.log().count() == 60


def test_only_what_a_batch_bears_on_is_written(spark, tmp_path):
    state = fresh(spark, tmp_path)
    people = [entry(k, "NODE", f"Q{k}", node_kind="PERSON", label=str(k)) for k in range(1, 50)]
    links = [entry(100 + k, "EDGE", "Q1", f"Q{k}", "MEMBER_OF") for k in range(2, 50)]
    state.apply(spark.createDataFrame(people + links, LOG), 0)
    state.apply(spark.createDataFrame([entry(200, "NODE", "Q1", node_kind="PERSON", label="busy")], LOG), 1)
    assert state._nodes.read().where("batch = 1").count() == 1 and state._edges.read().where("batch = 1").count() == 0
    state.apply(spark.createDataFrame([entry(201, "EDGE", "Q1", "Q7", "MEMBER_OF", source="musicbrainz")], LOG), 2)
    assert state._nodes.read().where("batch = 2").count() == 0 and state._edges.read().where("batch = 2").count() == 2  # one edge, at either end
    state.apply(spark.createDataFrame([entry(202, "RETRACT", "Q7")], LOG), 3)
    assert state.edges().count() == 47 and state.nodes().count() == 48


def test_a_stream_of_files_in_three_batches_equals_a_batch_fold(spark, tmp_path):
    rows, state = some_log(random.Random(11), 70), fresh(spark, tmp_path)
    arriving, done = tmp_path / "arriving", 0
    for k, n in enumerate((40, 15, 15)):
        spark.createDataFrame(rows[done : done + n], LOG).coalesce(1).write.mode("append").parquet(str(arriving))
        done += n
        query = maintain(spark.readStream.schema(LOG).parquet(str(arriving)), state, str(tmp_path / "checkpoint"), availableNow=True)
        query.awaitTermination(300)
        assert query.exception() is None
        same(state, rows[:done], spark)
        assert state.log().count() == done  # nothing counted twice
    assert k == 2


def test_an_empty_batch(spark, tmp_path):
    state = fresh(spark, tmp_path)
    state.apply(spark.createDataFrame([], LOG), 0)
    assert state.nodes().count() == 0 and state.edges().count() == 0
    state.apply(spark.createDataFrame([entry(1, "NODE", "Q1", node_kind="PERSON", label="a")], LOG), 1)
    assert state.nodes().count() == 1


def test_a_merge_leaves_the_other_edges_of_its_canonical_alone(spark, tmp_path, monkeypatch):
    """Of an id that a local is merged with only edges that the local's claims bear on are merged again."""
    state, own, merged = fresh(spark, tmp_path), incremental.merge_claims, []
    ids = [entry(k, "NODE", f"Q{k}", node_kind="PERSON", label=str(k)) for k in range(1, 30)] + [entry(50, "LOCAL", "Q001", node_kind="PERSON", label="l")]
    links = [entry(100 + k, "EDGE", "Q1", f"Q{k}", "MEMBER_OF") for k in range(2, 30)] + [entry(200, "EDGE", "Q001", "Q5", "MEMBER_OF", ref="y"), entry(201, "EDGE", "Q7", "Q001", None)]
    state.apply(spark.createDataFrame(ids + links, LOG), 0)
    monkeypatch.setattr(incremental, "merge_claims", lambda claims: merged.append(claims.count()) or own(claims))
    merge = [entry(300, "SAME_AS", "Q001", "Q1", source="owner")]
    state.apply(spark.createDataFrame(merge, LOG), 1)
    assert merged == [3]
    same(state, ids + links + merge, spark)
