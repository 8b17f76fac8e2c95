"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy.

Every text is cut into windows of WINDOW bytes, and the network reads each forwards and backwards from a zero state, so every
position of the whole text gets language probabilities; a document's probabilities are the mean over its positions. The
gates use the hard sigmoid clip(x / 4 + 1/2, 0, 1) and the candidate a hard tanh clip(x, -1, 1), which numpy
evaluates much faster than exponentials; backpropagation through time uses their slopes.

Training reads the first PER_LANGUAGE documents, in expectation, of each language: a language's documents are taken by a hash
of doc_id at the rate PER_LANGUAGE / its count, which is the documented bound, with WINDOWS windows from evenly
spaced places in each. The network depends on text and language only.

Defined results: a text that is null or has no letter is "und" with score 0; without any labelled document every text
is "und" with score 0; with one language, that language with score 1; a tie goes to the first language in order. Repeated rows are
judged alike and all returned; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.llm._io import slices, table

WINDOW = 64
HIDDEN = 8
PER_LANGUAGE = 300
WINDOWS = 6
LETTER = regex.compile(r"\p{L}")
PAD = 256  # the input past the end of a text


class GruTagger:
    """Weights: E (byte, direction) -> gate inputs, U recurrent, V and b the output layer."""

    def __init__(self, languages: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        h, k = HIDDEN, len(languages)
        self.languages = languages
        f = np.float32
        self.w = {
            "E": rng.normal(0, 0.3, (2, 257, 3 * h)).astype(f),
            "U": rng.normal(0, 0.3, (2, h, 3 * h)).astype(f),
            "V": rng.normal(0, 0.3, (2, h, k)).astype(f),
            "b": np.zeros(k, f),
        }

    def _states(self, x: np.ndarray, d: int, keep: bool):
        """x (steps, windows) -> states (steps, windows, HIDDEN), and what the backward pass needs."""
        h, u = HIDDEN, self.w["U"][d]
        e = self.w["E"][d]
        state = np.zeros((x.shape[1], h), np.float32)
        out, saved = np.empty((*x.shape, h), np.float32), []
        for t in range(len(x)):
            a = e[x[t]]
            gates = a[:, : 2 * h] + state @ u[:, : 2 * h]
            gates *= 0.25
            gates += 0.5
            np.clip(gates, 0, 1, out=gates)
            z, r = gates[:, :h], gates[:, h:]
            rs = r * state
            c = a[:, 2 * h :] + rs @ u[:, 2 * h :]
            np.clip(c, -1, 1, out=c)
            new = c - state
            new *= z
            new += state
            if keep:
                saved.append((state, gates, rs, c))
            out[t] = state = new
        return out, saved

    def logits(self, x: np.ndarray) -> np.ndarray:
        """Of every position: x (steps, windows) -> (steps, windows, languages)."""
        forward, _ = self._states(x, 0, False)
        backward, _ = self._states(x[::-1], 1, False)
        return forward @ self.w["V"][0] + backward[::-1] @ self.w["V"][1] + self.w["b"]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the positions that hold text, and its gradient."""
        h = HIDDEN
        runs = [self._states(x, 0, True), self._states(x[::-1], 1, True)]
        hidden = [runs[0][0], runs[1][0][::-1]]
        logits = hidden[0] @ self.w["V"][0] + hidden[1] @ self.w["V"][1] + self.w["b"]
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        real = (x != PAD).astype(np.float32)
        n = max(1.0, float(real.sum()))
        loss = -float((np.log(np.maximum(np.take_along_axis(p, np.broadcast_to(y[None, :, None], (*x.shape, 1)), 2)[..., 0], 1e-9)) * real).sum()) / n
        d_logits = p
        d_logits[:, np.arange(len(y)), y] -= 1
        d_logits *= (real / n)[..., None]
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        g["b"] = d_logits.sum(axis=(0, 1))
        for d in range(2):
            g["V"][d] = np.einsum("twh,twk->hk", hidden[d], d_logits)
            d_hidden = d_logits @ self.w["V"][d].T
            xs = x
            if d:
                d_hidden, xs = d_hidden[::-1], x[::-1]
            u, carry = self.w["U"][d], np.zeros((x.shape[1], h), np.float32)
            for t in range(len(xs) - 1, -1, -1):
                state, gates, rs, c = runs[d][1][t]
                z, r = gates[:, :h], gates[:, h:]
                ds = d_hidden[t] + carry
                dc = ds * z * (np.abs(c) < 1)
                d_rs = dc @ u[:, 2 * h :].T
                slope = 0.25 * ((gates > 0) & (gates < 1))
                dg = np.concatenate([ds * (c - state), d_rs * state], axis=1) * slope
                carry = ds * (1 - z) + d_rs * r + dg @ u[:, : 2 * h].T
                g["U"][d][:, : 2 * h] += state.T @ dg
                g["U"][d][:, 2 * h :] += rs.T @ dc
                np.add.at(g["E"][d], xs[t], np.concatenate([dg, dc], axis=1))
        return loss, g

    def train(self, windows: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 256, rate: float = 0.01, seed: int = 7) -> None:
        """Adam over shuffled batches of windows (windows, steps)."""
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(w) for k, w in self.w.items()} for _ in range(2))
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), batch):
                some = order[at : at + batch]
                _, g = self.gradients(np.ascontiguousarray(windows[some].T), y[some])
                step += 1
                for k in self.w:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All windows (windows, WINDOW) of non-empty texts, and which text each is of."""
    counts = [-(-len(t) // WINDOW) for t in texts]
    out = np.full((sum(counts), WINDOW), PAD, np.int16)
    flat, at = out.reshape(-1), 0
    for t, n in zip(texts, counts):
        flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
        at += n * WINDOW
    return out, np.repeat(np.arange(len(texts)), counts)


def document_probabilities(model: GruTagger, texts: list[bytes], block: int = 4096) -> np.ndarray:
    """The mean over all positions of each text (none empty)."""
    w, of = windows_of(texts)
    sums = np.zeros((len(texts), len(model.languages)))
    for at in range(0, len(w), block):
        x = np.ascontiguousarray(w[at : at + block].T)
        p = model.logits(x)
        p -= p.max(axis=2, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=2, keepdims=True)
        p *= (x != PAD)[..., None]
        np.add.at(sums, of[at : at + block], p.sum(axis=0))
    return sums / np.array([len(t) for t in texts])[:, None]


def fit(documents: DataFrame, per_language: int = PER_LANGUAGE) -> GruTagger | None:
    """From documents(doc_id, text, lang); None without a labelled text."""
    known = documents.select("doc_id", "text", "lang").where("lang is not null and text is not null and length(text) > 0")
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    languages = sorted(counts)
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1 << 30))
    rate = F.lit(None).cast("long")
    for lang, n in counts.items():
        rate = F.when(F.col("lang") == lang, F.lit(min(1 << 30, -(-(per_language << 30) // n)))).otherwise(rate)
    size = F.length(F.encode("text", "utf-8"))
    cut = lambda k: F.substring(F.encode("text", "utf-8"), (F.floor((size - WINDOW) * k / (WINDOWS - 1)) + 1).cast("int"), F.lit(WINDOW))
    pieces = F.when(size <= WINDOW, F.array(F.encode("text", "utf-8"))).otherwise(F.array(*(cut(k) for k in range(WINDOWS))))
    rows = known.where(draw < rate).select("doc_id", "lang", F.explode(pieces).alias("piece")).orderBy(F.xxhash64("doc_id", "piece"), "piece").collect()
    model = GruTagger(languages)
    if len(languages) > 1:
        w, of = windows_of([bytes(r["piece"]) for r in rows])
        model.train(w, np.array([languages.index(rows[k]["lang"]) for k in of]))
    return model


def identify(documents: DataFrame, model: GruTagger | None) -> DataFrame:
    """documents(doc_id, text) -> doc_id, lang_pred, score."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, texts in slices(batches, size=2_000_000):
            best, score = ["und"] * len(texts), np.zeros(len(texts))
            some = [k for k, t in enumerate(texts) if model and LETTER.search(t)]
            if some and len(model.languages) == 1:
                score[some] = 1.0
                for k in some:
                    best[k] = model.languages[0]
            elif some:
                p = document_probabilities(model, [texts[k].encode() for k in some])
                score[some] = np.clip(p.max(axis=1), 0, 1)
                for k, j in zip(some, p.argmax(axis=1)):
                    best[k] = model.languages[j]
            yield pa.RecordBatch.from_arrays([run.column("doc_id"), pa.array(best), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return documents.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op5_byte_gru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = fit(documents.where(~held_out(F.col("doc_id"))))
    return identify(documents, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op5_byte_gru_language": op5_byte_gru_language}
