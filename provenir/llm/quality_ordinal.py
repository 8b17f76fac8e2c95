"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades: 0 junk (quality 0), 1 sound but toxic (quality 1, toxic 1), 2 good. One weight vector over hashed text features is
shared by all thresholds: P(grade > k) = sigmoid(w.x - theta_k) with theta_0 <= theta_1. The expected grade
is the sum of those tails; a document is kept where P(grade > 1) reaches KEEP.

Features of a text, hashed into 2**BITS places: each distinct lower-case word (presence); for each shape of token (trailing
marks, capitals, bars) the binned share of tokens that have it; the binned shares of distinct tokens and of tokens
equal to the one before; the binned length. Fitting is proximal AdaGrad, first with an L1 penalty to pick features, in numpy on the
driver, over at most SAMPLE rated documents, the first by a hash of doc_id: the documented bound. Every document is scored
on its whole text, by tasks that keep the fitted weights of words; nothing is shuffled for scoring.

Defined results: a text that is null or has no token gets expected grade 0 and tail 0 and is rejected; labels with null
quality count as unrated, null toxic as 0; several ratings of a doc_id, or several documents of one, all count; without ratings of
at least two grades every non-empty document is kept with expected grade 2. Repeated rows are scored alike and all
returned; other columns pass through keep_good untouched; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.llm._io import slices, table

BITS = 18
SAMPLE = 6_000
KEEP = 0.5
CACHE = 200_000
EDGE = re.compile(r"^[^\w]+|[^\w]+$")
TAIL = re.compile(r"([^\w\s]+)$")


def _place(name: str) -> int:
    return xxhash.xxh32_intdigest(name) & ((1 << BITS) - 1)


def _bin(share: float) -> int:
    """0 for none, then doubling bins up to 1."""
    return 0 if share <= 0 else max(1, 9 + int(np.floor(np.log2(share))))


class Featurizer:
    """Places of a text's features. Remembers tokens, at most CACHE of them."""

    def __init__(self) -> None:
        self.seen: dict[str, tuple[int, str]] = {}

    def _token(self, token: str) -> tuple[int, str]:
        found = self.seen.get(token)
        if found is None:
            if len(self.seen) >= CACHE:
                self.seen.clear()
            marks = TAIL.search(token)
            shape = ("C" if len(token) > 1 and token.upper() == token and token.lower() != token else "") + (marks[1][:3] if marks else "")
            word = EDGE.sub("", token).lower()
            found = self.seen[token] = (_place("w:" + word) if word else -1, shape)
        return found

    def __call__(self, text: str) -> np.ndarray:
        tokens = text.split()
        if not tokens:
            return np.zeros(0, np.int32)
        counts: dict[str, int] = {}
        for t in tokens:
            counts[t] = counts.get(t, 0) + 1
        places, shapes = set(), {}
        for t, n in counts.items():
            place, shape = self._token(t)
            places.add(place)
            if shape:
                shapes[shape] = shapes.get(shape, 0) + n
        places.discard(-1)
        total = len(tokens)
        places.update(_place(f"s:{s}:{_bin(n / total)}") for s, n in shapes.items())
        marks = sum(n for s, n in shapes.items() if s.lstrip("C") not in {"", ".", ",", ";", ":", "?", "!", ")", '"', "'"})
        places.add(_place(f"marks:{_bin(marks / total)}"))
        places.add(_place(f"capitals:{_bin(sum(n for s, n in shapes.items() if s[:1] == 'C') / total)}"))
        size = int(np.log2(total))
        again = sum(a == b for a, b in zip(tokens, tokens[1:]))
        places.add(_place(f"again:{_bin(again / total)}"))
        places.add(_place(f"distinct:{size}:{int(8 * len(counts) / total)}"))
        places.add(_place(f"size:{size}"))
        return np.fromiter(places, np.int32)


class OrdinalModel:
    """Shared weights and two ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, places: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(self.thresholds - float(self.weights[places].sum()), -30, 30)))


def fit(rows: list[tuple[np.ndarray, int]], penalty: float = 4e-3) -> OrdinalModel | None:
    """Rows of feature places and a grade of 0 to 2. None unless two grades occur.

    A first fit with an L1 penalty picks the features, a second one with next to none sets their weights.
    """
    rows = [r for r in rows if len(r[0])]
    grades = np.array([g for _, g in rows])
    if len(set(grades.tolist())) < 2:
        return None
    places, flat = np.unique(np.concatenate([p for p, _ in rows]).astype(np.int64), return_inverse=True)
    # Words of one or two rated documents say nothing about others.
    common = np.bincount(flat)[flat] >= 3
    of, flat = np.repeat(np.arange(len(rows)), [len(p) for p, _ in rows])[common], flat[common]
    w, theta = _descend(grades, of, flat, len(places), 300, 0.1, penalty)
    picked = w[flat] != 0
    w, theta = _descend(grades, of[picked], flat[picked], len(places), 500, 0.4, 1e-5)
    full = np.zeros(1 << BITS, np.float32)
    full[places] = w
    return OrdinalModel(full, theta)


def _descend(grades: np.ndarray, of: np.ndarray, flat: np.ndarray, size: int, steps: int, rate: float, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Proximal AdaGrad on the cumulative-link likelihood; row of[i] has feature flat[i]."""
    n = len(grades)
    at = np.arange(n)
    above = np.array([(grades > k).mean() for k in range(2)])
    theta = np.maximum.accumulate(np.log((1 - above + 1e-3) / (above + 1e-3)))
    w, w_sum, theta_sum = np.zeros(size), np.full(size, 1e-8), np.full(2, 1e-8)
    for _ in range(steps):
        score = np.bincount(of, w[flat], n)
        p = 1 / (1 + np.exp(np.clip(theta[:, None] - score, -30, 30)))
        # A grade's likelihood is the difference of neighbouring tails.
        tail = np.vstack([np.ones(n), p, np.zeros(n)])
        slope = np.vstack([np.zeros(n), p * (1 - p), np.zeros(n)])
        like = np.maximum(tail[grades, at] - tail[grades + 1, at], 1e-9)
        w_grad = -np.bincount(flat, ((slope[grades, at] - slope[grades + 1, at]) / like)[of], size) / n
        theta_grad = np.array([np.sum(slope[k + 1] * ((grades == k + 1).astype(float) - (grades == k)) / like) for k in range(2)]) / n
        w_sum += w_grad**2
        step = rate / np.sqrt(w_sum)
        w = w - step * w_grad
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
        theta_sum += theta_grad**2
        theta = np.maximum.accumulate(theta - rate / np.sqrt(theta_sum) * theta_grad)
    return w, theta


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> OrdinalModel | None:
    grade = F.when(F.col("quality") == 0, 0).when(F.coalesce("toxic", F.lit(0)) == 1, 1).otherwise(2)
    rated = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("rated"), grade.alias("grade"))
    # At most `sample` rows, so the join's small side and what the driver gets are bounded.
    rated = rated.orderBy(F.xxhash64("rated"), "rated", "grade").limit(sample)
    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(rated), F.col("doc_id") == F.col("rated"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Featurizer()
        for run, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([run.column("doc_id"), run.column("grade"), pa.array([places(t) for t in texts], pa.list_(pa.int32()))], ["doc_id", "grade", "places"])

    got = chosen.select("doc_id", "grade", "text").mapInArrow(features, "doc_id long, grade int, places array<int>")
    first = got.orderBy(F.xxhash64("doc_id"), "doc_id", "grade", F.hash("places")).limit(sample).select("grade", "places").toArrow()
    # As arrays: lists of numbers would take the driver many times the space.
    rows = [(np.sort(p.values.to_numpy()), g) for g, p in zip(first.column("grade").to_pylist(), first.column("places"))]
    return fit(rows)


def score(documents: DataFrame, model: OrdinalModel | None, keep: float = KEEP) -> DataFrame:
    """Adds expected_grade, tail_good and kept to documents. Their other columns stay, and columns of these three names give way."""

    @F.pandas_udf("struct<expected_grade: double, tail_good: double>")
    def graded(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        places = Featurizer()
        for batch in texts:
            out = []
            for t in batch:
                p = places(t or "")
                out.append((0.0, 0.0) if not len(p) else (2.0, 1.0) if model is None else (float((v := model.tails(p)).sum()), float(v[1])))
            yield pd.DataFrame(out, columns=["expected_grade", "tail_good"])

    own = F.struct(*(F.col(f"`{c}`") for c in documents.columns if c not in ("expected_grade", "tail_good", "kept")))
    packed = documents.select(own.alias("own"), graded(F.col("text")).alias("graded"))
    return packed.select("own.*", "graded.expected_grade", "graded.tail_good", (F.col("graded.tail_good") >= keep).alias("kept"))


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject, with their own columns."""
    scored = score(documents.select(F.struct("*").alias("_row"), "text"), train(documents, labels))
    return scored.where("kept").select("_row.*")


def op6_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    scored = score(documents.select("doc_id", "text"), train(documents, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "expected_grade", "tail_good", "kept")


QUERIES = {"op6_ordinal_quality": op6_ordinal_quality}
