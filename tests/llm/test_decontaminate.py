import itertools

import pytest

from llm_odd import ODD
from provenir.llm.decontaminate import MASKS, SPAN, drop_contaminated, find_overlaps


def test_masks_leave_out_any_two_positions_together():
    assert all(any(a not in m and b not in m for m in MASKS) for a, b in itertools.combinations(range(SPAN), 2))


@pytest.fixture(scope="module")
def bench(spark, prose):
    return spark.createDataFrame([(k, prose(5000 + k, 30), "x") for k in range(20)] + [(50, "six words make this short item", "x"), (51, "too short", "x"), (52, None, "x"), (None, prose(6000, 20), "x")], "item_id long, text string, overlaps string")


def test_passages_with_up_to_two_substitutions_in_a_span(bench, make, prose):
    item = prose(5003, 30).split()
    rows = [(k, prose(k, 80)) for k in range(30)]
    for k, (a, b) in enumerate(itertools.combinations(range(13), 2)):
        part = item[8:21]
        part[a], part[b] = "new", "newer"
        rows.append((100 + k, prose(900 + k, 20) + " " + " ".join(part) + " " + prose(950 + k, 20)))
    three = item[8:21]
    three[2] = three[6] = three[10] = "new"
    rows += [(300, "A " + " ".join(three)), (301, ", ".join(prose(5004, 30).upper().split())), (302, "here: Six words, make this SHORT item."), (303, "six words make this item"), (304, prose(6000, 20))]
    got = {r["doc_id"]: r["overlaps"] for r in find_overlaps(make(rows), bench).collect()}
    hit = {i for i, o in got.items() if o}
    assert hit == {100 + k for k in range(78)} | {301, 302, 304}
    assert {o["item_id"] for o in got[301]} == {4} and [(o["begin"], o["end"]) for o in got[301]] == [(0, 30)]
    assert [o["item_id"] for o in got[304]] == [-1]


def test_odd_rows_and_own_columns(spark, bench, make):
    documents = make(ODD)
    kept = drop_contaminated(documents, bench)
    assert kept.columns == documents.columns and kept.count() == len(ODD)
    assert drop_contaminated(make([]), bench).count() == 0
    assert drop_contaminated(documents, bench.limit(0)).count() == len(ODD)
