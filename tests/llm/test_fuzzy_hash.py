import hashlib

from pyspark.sql import functions as F

from llm_odd import ODD
from provenir.llm.fuzzy_hash import fingerprint, likeness, with_next


def test_every_row_meets_its_successor(spark, make, prose):
    rows = [(k * 7 % 50, prose(k, 5 + k * 3)) for k in range(50)]
    got = {r["doc_id"]: r for r in with_next(make(rows)).collect()}
    order = sorted(rows)
    assert len(got) == 50
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % 50][1]
        n = len(t) // 4
        edited = t[: len(t) - n] + following[:n]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"], r["next_fingerprint"]) == (fingerprint(t), fingerprint(edited), fingerprint(following))


def test_likeness(spark, prose):
    a, b = prose(1, 600), prose(2, 600)
    half = a[: len(a) * 3 // 4] + b[: len(a) // 4]
    rows = [(fingerprint(x), fingerprint(y)) for x, y in ((a, a), (a, half), (a, b), ("", ""), ("", a))]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(likeness(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 1 and 0.5 < got[1] < 1 and got[2] < 0.2 and got[3] == 1 and got[4] == 0


def test_odd_rows(spark, make):
    got = with_next(make(ODD)).collect()
    assert len(got) == len(ODD) and {r["n_chars"] for r in got if r["doc_id"] in (90, 91)} == {0}
    (one,) = with_next(make([(5, "abcdefgh")])).collect()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
    assert with_next(make([])).count() == 0
    assert fingerprint("ab" * 500_000) == fingerprint("ab" * 500_000)
