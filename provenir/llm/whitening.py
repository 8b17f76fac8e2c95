"""Embedding whitening by a one-sided Jacobi SVD of a blockwise TSQR factor.

Each task centres its rows and folds them, block by block, into one upper triangular factor; the factors are merged by QR in groups of
FAN, and so on, until one R is left, whose square is that of all centred rows. No covariance is formed for the fit, so small standard
deviations keep their accuracy. Plane rotations make R's columns orthogonal; the accumulated rotations are the components, and
the columns' lengths the standard deviations. The driver holds arrays of the dimension's square at most.

Defined results: null vectors, and vectors with a null or non-finite entry, are dropped. The dimension is the commonest length of the rest
(of equally common ones the longest); vectors of another length can't be compared and are dropped too. Entries beyond LARGEST in size count
as LARGEST. Repeated rows count each time; a null vec_id stays null; other columns are ignored; an empty table gives an empty result.
A component without variance (its deviation below EPS of the largest) has whitened 0.0 and isn't part of identity_error.
A deviation that doesn't fit in a long is null. The sign of a component makes its largest entry positive.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.llm._io import Scratch, table

FAN, ELEMENTS, KEPT, EPS = 16, 2_000_000, 32, 1e-13
SCALE, SHIFT, LARGEST = 64, 1_000_000, 10**12
LONG_MAX = 2**63 - 1


def _whole(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors of so many finite entries, and those entries as rows."""
    at = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), length), False).to_numpy(zero_copy_only=False))
    flat = pc.list_flatten(column.take(pa.array(at)))
    rows = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), length)  # a null entry is read as not a number
    good = np.isfinite(rows).all(1)
    return at[good], rows[good]


def quantised(rows: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * rows) + SHIFT, -LARGEST, LARGEST).astype(np.int64)


def _pieces(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and quantised vectors, a bounded number of entries at a time."""
    step = max(1, ELEMENTS // max(1, length))
    for batch in batches:
        for k in range(0, batch.num_rows, step):
            run = batch.slice(k, step)
            at, rows = _whole(run.column(1), length)
            if len(at):
                yield run.column(0).take(pa.array(at)), quantised(rows)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """length, n, and the exact sum of each place over a task's vectors of that length."""
    found: dict[int, list] = {}
    for batch in batches:
        for length in pc.unique(pc.list_value_length(batch.column(1)).drop_null()).to_pylist():
            for _, x in _pieces([batch], length):
                n, s = found.get(length, (0, [0] * length))
                found[length] = [n + len(x), [a + int(b) for a, b in zip(s, x.sum(0))]]
    if found:
        decimals = pa.list_(pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.int32()), pa.array([n for n, _ in found.values()], pa.int64()), pa.array([[Decimal(v) for v in s] for _, s in found.values()], decimals)], ["length", "n", "sums"]
        )


@dataclass
class Fit:
    """n vectors with per-place sums; components: unit columns; values: their eigenvalues, falling; trace of the covariance."""

    n: int
    sums: list[int]
    components: np.ndarray | None = None
    values: np.ndarray | None = None
    trace: float = 0.0

    @property
    def length(self) -> int:
        return len(self.sums)

    def offsets(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact: as longs where they fit."""
        if (LARGEST + SHIFT) * self.n < 2**62 or self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0) < 2**62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.offsets(x).astype(np.float64) / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        d = self.offsets(x)
        if d.dtype != object and int(np.abs(d).max(initial=0)) ** 2 * max(1, self.length) < 2**63:
            return (d * d).sum(1).tolist()
        exact = [sum(int(v) ** 2 for v in row) for row in d]
        return [v if v <= LONG_MAX else None for v in exact]

    def whitened(self, x: np.ndarray) -> np.ndarray:
        kept = self.components[:, :KEPT]
        scale = np.sqrt(self.values[:KEPT])
        return self.centred(x) @ np.divide(kept, scale, out=np.zeros_like(kept), where=scale > 0)


def triangle(rows: np.ndarray) -> np.ndarray:
    """The square factor R of rows = QR, padded with zero rows where there are few."""
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((rows.shape[1] - len(r), rows.shape[1]))])


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Components as columns and the lengths of r's rotated columns, by falling length.

    Each round rotates disjoint pairs of columns until every pair has met, as in a round-robin; sweeps go on until no pair is oblique.
    """
    d = r.shape[1]
    odd = d % 2
    u, v = np.pad(r.astype(np.float64), ((0, 0), (0, odd))), np.pad(np.eye(d), ((0, 0), (0, odd)))
    order, floor = np.arange(d + odd), (EPS * max(np.linalg.norm(r), np.finfo(float).tiny)) ** 2
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(order) - 1):
            p, q = order[: len(order) // 2], order[len(order) // 2 :][::-1]
            a, b = u[:, p], u[:, q]
            alpha, beta, gamma = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            oblique = np.divide(np.abs(gamma), np.sqrt(alpha * beta), out=np.zeros(len(p)), where=(alpha > floor) & (beta > floor))
            turn = oblique > 2e-16
            worst = max(worst, oblique.max(initial=0.0))
            zeta = np.divide(beta - alpha, 2 * gamma, out=np.zeros(len(p)), where=turn)
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta)), 0.0)
            c = 1 / np.hypot(1, t)
            s = c * t
            for m in (u, v):
                x, y = m[:, p], m[:, q]
                m[:, p], m[:, q] = c * x - s * y, s * x + c * y
            order[1:] = np.roll(order[1:], 1)
        if worst < 1e-15 * max(1.0, d**0.5):
            break
    lengths = np.sqrt((u[:, :d] ** 2).sum(0))
    by = np.argsort(-lengths, kind="stable")
    v = v[:, by]
    v = v / np.linalg.norm(v, axis=0)
    return v * np.where(v[np.abs(v).argmax(0), np.arange(d)] < 0, -1.0, 1.0), lengths[by]


def _packed(part: int, *arrays: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([[a.tobytes() for a in arrays]], pa.list_(pa.binary()))], ["part", "arrays"])


PACKED = "part int, arrays array<binary>"


def _merged(scratch: Scratch, packed: DataFrame, merge: Callable[[list[list[np.ndarray]]], list[np.ndarray]], name: str) -> list[np.ndarray]:
    """The packed arrays of all tasks merged in groups of FAN neighbours, then those, and so on: what is left is one row of bounded size."""
    level = scratch.write(packed, name)
    parts, wide = (level.agg(F.max("part")).head()[0] or 0) + 1, 1

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, xs in zip(*(c.to_pylist() for c in batch.columns)):
                rows = [x["arrays"] for x in sorted(xs, key=lambda x: x["part"])]
                yield _packed(part, *merge([[np.frombuffer(a) for a in row] for row in rows]))

    while wide < parts:
        wide *= FAN
        level = level.groupBy((F.col("part") / wide).cast("int").alias("g")).agg(F.collect_list(F.struct((F.col("part") / (wide // FAN)).cast("int").alias("part"), "arrays")).alias("xs")).mapInArrow(fold, PACKED)
        level = level.withColumn("part", F.col("part") * wide)
    return [np.frombuffer(a) for a in level.head()["arrays"]]


def _moments(rows: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Counts, means and centred sums of products, merged pairwise."""
    n, mean, products = 0.0, None, None
    for count, m, p in rows:
        c = float(count[0])
        if not n:
            n, mean, products = c, m, p
            continue
        gap = m - mean
        products = products + p + (np.outer(gap, gap) * (n * c / (n + c))).ravel()
        mean, n = mean + gap * (c / (n + c)), n + c
    return [np.array([n]), mean, products]


def _vectors(embeddings: DataFrame, id: str, column: str) -> DataFrame:
    return embeddings.select(F.col(id).alias("id"), F.col(column).cast("array<double>").alias("v"))


def fit(scratch: Scratch, vectors: DataFrame) -> Fit | None:
    """vectors: id, v. None where nothing is left to fit."""
    sums = scratch.write(vectors.mapInArrow(_sums, "length int, n long, sums array<decimal(38,0)>"), "sums")
    most = sums.groupBy("length").agg(F.sum("n").alias("n")).where("length > 0").orderBy(F.desc("n"), F.desc("length")).head()
    if most is None:
        return None
    places = sums.where(F.col("length") == most["length"]).select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
    found = Fit(most["n"], [int(r["s"]) for r in places])
    n, length, plain = found.n, found.length, Fit(found.n, found.sums)

    def factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for _, x in _pieces(batches, length):
            rows = plain.centred(x)
            r = triangle(rows if r is None else np.vstack([r, rows]))
        if r is not None:
            yield _packed(TaskContext.get().partitionId(), r)

    merge = lambda rows: [triangle(np.vstack([a.reshape(length, length) for (a,) in rows]))]
    r = _merged(scratch, vectors.mapInArrow(factors, PACKED), merge, "factors")[0].reshape(length, length)
    found.components, lengths = jacobi(r)
    lengths = np.where(lengths > EPS * lengths[0], lengths, 0.0)
    found.values, found.trace = lengths**2 / n, float((lengths**2).sum() / n)
    return found


def identity_error(scratch: Scratch, vectors: DataFrame, model: Fit) -> float:
    """The largest entry of the whitened rows' covariance minus the identity, over components with variance."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for _, x in _pieces(batches, model.length):
            w = model.whitened(x)
            mean = w.mean(0)
            own = [np.array([float(len(w))]), mean, ((w - mean).T @ (w - mean)).ravel()]
            total = own if total is None else _moments([total, own])
        if total is not None:
            yield _packed(TaskContext.get().partitionId(), *total)

    n, _, products = _merged(scratch, vectors.mapInArrow(moments, PACKED), _moments, "moments")
    k = min(KEPT, model.length)
    live = model.values[:k] > 0
    gap = np.abs(products.reshape(k, k) / n[0] - np.eye(k))[np.ix_(live, live)]
    return float(gap.max(initial=0.0))


def whiten(embeddings: DataFrame, id: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, Fit | None, float]:
    """(id, deviation, whitened array<double>) of every vector that fits, the model, and its identity error."""
    scratch, vectors = Scratch(embeddings.sparkSession), _vectors(embeddings, id, column)
    kind = vectors.schema["id"].dataType.simpleString()
    ddl = f"id {kind}, deviation long, whitened array<double>"
    model = fit(scratch, vectors)
    if model is None:
        return embeddings.sparkSession.createDataFrame([], ddl), None, 0.0

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _pieces(batches, model.length):
            w = model.whitened(x)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1]), pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(model.deviations(x), pa.int64()), flat], ["id", "deviation", "whitened"])

    return vectors.mapInArrow(rows, ddl), model, identity_error(scratch, vectors, model)


def op12_jacobi_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each vector and component up to KEPT."""
    rows, model, error = whiten(table(spark, sf_dir, "embeddings"))
    out = rows.select(F.col("id").alias("vec_id"), "deviation", F.posexplode("whitened").alias("_i", "whitened"))
    shares = F.array(*(F.lit(float(e / model.trace if model.trace else 0.0)) for e in model.values[:KEPT])) if model else F.array().cast("array<double>")
    return out.select(
        "vec_id", (F.col("_i") + 1).cast("int").alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("_i")).alias("explained"), F.lit(error).alias("identity_error")
    )


QUERIES = {"op12_jacobi_whitening": op12_jacobi_whitening}
