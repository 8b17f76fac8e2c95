from fractions import Fraction

import numpy as np
import pytest

from provenir.llm import whitening as w
from provenir.llm.whitening import Fit, jacobi, op12_jacobi_whitening, triangle


@pytest.fixture
def query(spark, tmp_path):
    def query(rows, kind="float"):
        spark.createDataFrame([(i, v, "own") for i, v in rows], f"vec_id long, embedding array<{kind}>, component string").repartition(5).write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
        return op12_jacobi_whitening(spark, str(tmp_path))

    return query


def vectors(n, d, seed=0):
    r = np.random.default_rng(seed)
    return (r.normal(size=(n, d)) * np.geomspace(3, 0.2, d)) @ np.linalg.qr(r.normal(size=(d, d)))[0] + 0.3


def brute(rows):
    """By a covariance and a library's symmetric eigenvalues, with exact sums."""
    x = np.array([np.floor(64 * np.array(v, np.float32).astype(float)).astype(int) + 10**6 for _, v in rows], dtype=object)
    n, s = len(x), x.sum(0)
    mean = [Fraction(int(v), n) for v in s]
    c = np.array([[float(Fraction(int(v)) - m) for v, m in zip(row, mean)] for row in x])
    values, vectors = np.linalg.eigh(c.T @ c / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return {
        "n": n, "deviation": [sum(int(n * v - t) ** 2 for v, t in zip(row, s)) for row in x], "whitened": c @ vectors[:, :32] / np.sqrt(values[:32]), "explained": values[:32] / values.sum(),
    }


def test_query_equals_covariance_eigenvectors(query):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(400, 40))]
    odd = [(900, None), (901, [1.0, None] + [0.0] * 38), (902, [float("nan")] + [0.0] * 39), (903, [float("inf")] + [0.0] * 39), (904, []), (905, [1.0] * 39)]
    rows += [(None, rows[0][1]), (7, rows[7][1])]
    want = brute(rows)
    got = query(rows + odd).collect()
    assert len(got) == 32 * len(rows)
    assert {r["n"] for r in got} == {len(rows)} and got[0]["identity_error"] < 1e-9
    by = {}
    for r in got:
        by.setdefault((str(r["vec_id"]), r["deviation"]), {}).setdefault(r["component"], r)
    for (i, _), deviation, line in zip(rows, want["deviation"], want["whitened"]):
        own = by[str(i), deviation]
        for k in range(32):
            assert abs(own[k + 1]["whitened"]) == pytest.approx(abs(line[k]), rel=1e-6, abs=1e-8)
            assert own[k + 1]["explained"] == pytest.approx(want["explained"][k], rel=1e-9)


def test_signs_are_the_same_for_all_rows(query):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(120, 6, 4))]
    want, got = brute(rows)["whitened"], {(r["vec_id"], r["component"]): r["whitened"] for r in query(rows).collect()}
    for k in range(6):
        ratio = [got[i, k + 1] / want[i][k] for i, _ in rows if abs(want[i][k]) > 1e-3]
        assert max(ratio) - min(ratio) < 1e-6 and abs(abs(ratio[0]) - 1) < 1e-6


def test_factors_by_blocks_are_those_of_all_rows(query, monkeypatch):
    monkeypatch.setattr(w, "ELEMENTS", 30)
    monkeypatch.setattr(w, "FAN", 2)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(90, 5, 2))]
    got = {(r["vec_id"], r["component"]): abs(r["whitened"]) for r in query(rows).collect()}
    want = brute(rows)["whitened"]
    assert all(got[i, k + 1] == pytest.approx(abs(want[i][k]), abs=1e-8) for i, _ in rows for k in range(5))


def test_jacobi_keeps_small_deviations():
    r = np.random.default_rng(1)
    for d in (1, 2, 7, 16):
        q, p = np.linalg.qr(r.normal(size=(50, d)))[0], np.linalg.qr(r.normal(size=(d, d)))[0]
        s = np.geomspace(1, 1e-6, d)
        v, lengths = jacobi(triangle((q * s) @ p.T))
        assert np.allclose(lengths, s, rtol=1e-9) and np.allclose(np.abs((v * p).sum(0)), 1, atol=1e-9)


def test_odd_tables(query):
    assert query([]).collect() == [] and query([(1, None), (2, [])]).collect() == []
    one = query([(1, [1.0, 2.0])]).collect()
    assert [(r["component"], r["whitened"], r["deviation"], r["identity_error"]) for r in one] == [(1, 0.0, 0, 0.0), (2, 0.0, 0, 0.0)]
    same = query([(k, [float(k % 3), 5.0, float(k % 3)]) for k in range(9)]).collect()  # two places are equal and one is constant
    assert len(same) == 27 and same[0]["identity_error"] < 1e-9
    assert all(r["whitened"] == 0.0 for r in same if r["component"] > 1) and all(r["explained"] == pytest.approx(1.0) for r in same if r["component"] == 1)
    assert query([(1, [1e30, 0.0]), (2, [-1e30, 1.0])], "double").count() == 4


def test_deviations_are_exact_or_null():
    x = np.array([[10**12, 0], [0, 10**12]], np.int64)
    f = Fit(2, [10**12, 10**12])
    assert f.deviations(x) == [None, None]
    f, x = Fit(3, [3_000_000, 3_000_300]), np.array([[10**6, 10**6 + 100], [10**6 + 5, 10**6]], np.int64)
    assert f.deviations(x) == [0, 15**2 + 300**2]
