"""N-gram Jaccard join: adaptive multi-match prefixes over word shingles.

A document's set holds the hashes of its distinct shingles of SHINGLE words (64 bits). Documents with equal sets, known by
a 64-bit hash of the set (two different ones of n share one with a probability of about n**2 / 2**65), form a class, and
classes are joined:

1. Document frequencies are counted over all shingles of all documents. Each task counts what it holds and packs sorted 40-bit hashes as
   deltas by ranges of hashes, as many as the number of shingles asks for; a range is counted in one place and gives its part of a sketch of 2**SKETCH_BITS bytes: the
   binary logarithm of the highest frequency that falls on a place. The sketch (8 MB whatever the input) is broadcast.
2. A global order of shingles goes by that logarithm, then by hash. It need not be exact to be right: any order that
   all documents share gives correct prefixes, and this one puts frequent shingles last.
3. A set of n has the prefix of its first n - ceil(0.8 n) + m shingles: two sets that are similar share at least m there.
   m from 1 to MATCHES is chosen for each document by estimated cost: postings to read in the longer prefix, plus
   candidates to verify, of which there are at most postings / m. Two documents must share min(m, m') prefix shingles.
4. Shingles that the sketch proves to be in under 2**HOT documents are grouped in one place each; others are aggregated before
   the shuffle and joined back, which adaptive execution splits.
5. Each shingle's documents have a hub (the least set, then others by hash), and in each of ROUNDS rounds a set is compared
   to HUBS of its shingles' hubs, so that a group of near copies becomes one component by few comparisons. Then all pairs that share enough prefix shingles
   and are still in different components are compared, so that no link between components is missed.
6. Candidates are verified on their whole sets: 100 * |intersection| >= 80 * |union|.

Components come from a distributed union-find over links and copies.

Defined results: a null or empty text has an empty set and is linked to nothing; under SHINGLE words the whole sequence is the one
shingle; rows of one doc_id are one document with the links of all its texts, and each row is returned with its own
n_shingles; rows without doc_id are returned with a null component_id and link nothing; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provenir.llm._components import components, merged
from provenir.llm._io import Scratch, slices, table
from provenir.llm._words import spaced, word_hashes

SHINGLE = 5
PERCENT = 80
MATCHES = 4
HOT = 10
ROUNDS = 2
HUBS = 3
SKETCH_BITS = 23
COUNT_BITS = 40
#: Shingles that a task holds before it counts them: counting takes some 30 bytes for each, in every task of an executor.
FLUSH = 1_000_000
RANGE = 2_000_000
FREQUENT = 8
BROADCAST_IDS = 4_000_000


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, begins = word_hashes(texts)
    rolled = spaced(words, list(range(SHINGLE)))
    out = []
    for a, b in zip(begins.tolist(), begins[1:].tolist()):
        if b - a >= SHINGLE:
            out.append(np.unique(rolled[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(spaced(words[a:b], list(range(b - a)), salt=b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _pack(tokens: np.ndarray) -> bytes:
    """Sorted 40-bit values as deltas, in planes of bytes of which the high ones compress well."""
    deltas = np.diff(tokens, prepend=np.uint64(0))
    return np.ascontiguousarray(deltas.view(np.uint8).reshape(-1, 8)[:, :5].T).tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(5, -1)
    deltas = np.zeros((planes.shape[1], 8), np.uint8)
    deltas[:, :5] = planes.T
    return np.cumsum(deltas.view(np.uint64).reshape(-1), dtype=np.uint64)


def frequency_sketch(documents: DataFrame, shingles: int) -> np.ndarray:
    """For the SKETCH_BITS high bits of a shingle hash: floor(log2) of the highest document frequency there, 0 under FREQUENT.

    shingles, the sum of the sets' sizes, decides how many ranges of hashes are counted apart. Tasks count what they hold before
    they send it, so a frequent shingle is a few rows of its range whatever the number of its documents.
    """
    bits = min(SKETCH_BITS - 4, max(4, (shingles // RANGE).bit_length()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            part = (tokens >> np.uint64(COUNT_BITS - bits)).astype(np.int32)
            cuts = np.flatnonzero(np.diff(part, prepend=-1, append=1 << bits)).tolist()
            rows = []
            for a, b in zip(cuts, cuts[1:]):
                more = n[a:b] > 1
                rows.append((int(part[a]), _pack(tokens[a:b]), np.flatnonzero(more).astype(np.int32).tobytes(), n[a:b][more].astype(np.int64).tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), [pa.int32(), *[pa.binary()] * 3])], ["part", "blob", "at", "n"])

        for _, texts in slices(batches):
            for s in shingle_sets(texts):
                held.append(s >> np.uint64(64 - COUNT_BITS))
                size += len(s)
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    def reduce(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = [], []
        for batch in batches:
            for blob, at, n in zip(*(batch.column(c).to_pylist() for c in ("blob", "at", "n"))):
                tokens.append(_unpack(blob))
                counts.append(np.ones(len(tokens[-1]), np.int64))
                counts[-1][np.frombuffer(at, np.int32)] = np.frombuffer(n, np.int64)
        each, every = np.concatenate(tokens), np.concatenate(counts)
        order = np.argsort(each, kind="stable")
        each = each[order]
        edge = np.flatnonzero(np.diff(each, prepend=each[0] ^ np.uint64(1)))
        n = np.add.reduceat(every[order], edge)
        often = n >= FREQUENT
        sketch = np.zeros(1 << (SKETCH_BITS - bits), np.uint8)
        at = (each[edge[often]] >> np.uint64(COUNT_BITS - SKETCH_BITS)).astype(np.int64) & (len(sketch) - 1)
        np.maximum.at(sketch, at, np.log2(n[often]).astype(np.uint8))
        if often.any():
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([sketch.tobytes()], pa.binary())], ["part", "sketch"])

    packed = documents.select("text").mapInArrow(count, "part int, blob binary, at binary, n binary")
    parts = packed.groupBy("part").applyInArrow(reduce, "part int, sketch binary").collect()  # 2**SKETCH_BITS bytes at most
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    for r in parts:
        width = 1 << (SKETCH_BITS - bits)
        out[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(bytes(r["sketch"]), np.uint8)
    return out


def prefix(tokens: np.ndarray, sketch: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """The matches asked for, and the shingles of the prefix: those in few documents, and the others."""
    n = len(tokens)
    level = sketch[(tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    order = np.lexsort((tokens, level))
    first = n - -(-PERCENT * n // 100) + 1
    postings = np.cumsum((1 << level[order[: first + MATCHES - 1]].astype(np.int64)) - 1)
    matches, best = 1, None
    for m in range(1, min(MATCHES, n - first + 1) + 1):
        read = float(postings[first + m - 2])
        cost = read + (read / m) * (n / 8)
        if best is None or cost < best:
            matches, best = m, cost
    chosen = order[: first + matches - 1]
    hot = level[chosen] >= HOT
    return matches, tokens[chosen[~hot]], tokens[chosen[hot]]


def _set_key(tokens: np.ndarray) -> int:
    return int(np.frombuffer(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), np.int64)[0])


def _sets(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles and the 64 bits k that stand for the set."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, texts in slices(batches):
            found = shingle_sets(texts)
            columns = [pa.array([f(s) for s in found], pa.int64()) for f in (len, _set_key)]
            yield pa.RecordBatch.from_arrays([run.column("doc_id"), *columns], ["doc_id", "n_shingles", "k"])

    return documents.mapInArrow(sets, "doc_id long, n_shingles long, k long")


def _prefixes(documents: DataFrame, sketch: np.ndarray) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(sketch)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = shared.value
        for run, texts in slices(batches):
            rows = []
            for doc_id, s in zip(run.column("doc_id").to_pylist(), shingle_sets(texts)):
                if len(s) and doc_id is not None:
                    m, cold, hot = prefix(s, levels)
                    rows.append((_set_key(s), len(s), m, cold.view(np.int64), hot.view(np.int64)))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["k", "n", "m", "cold", "hot"])

    return documents.mapInArrow(prefixes, "k long, n long, m int, cold array<long>, hot array<long>")


def _token_sets(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """k, tokens of the sets in wanted(k, doc), read from the texts of the documents doc. A repeated row gives a repeated set."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches):
            found = shingle_sets(texts)
            lists = pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([_set_key(s) for s in found], pa.int64()), lists], ["k", "tokens"])

    ids = _few(wanted.selectExpr("doc id").distinct())
    return documents.join(ids, F.col("doc_id") == F.col("id"), "left_semi").mapInArrow(tokens, "k long, tokens array<long>")


def _few(df: DataFrame) -> DataFrame:
    """Marked for a broadcast if it has no more than BROADCAST_IDS rows (of one or two numbers)."""
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def _similar_sizes(a: str, b: str) -> str:
    return f"100 * least({a}, {b}) >= {PERCENT} * greatest({a}, {b})"


def _grouped(rows: DataFrame, aggregates: dict[str, Column]) -> DataFrame:
    """rows with aggregates over the rows of their token.

    Tokens that aren't hot have under 2**HOT rows, so a window holds them; the rows of hot ones are aggregated before
    they are shuffled, and their join can be split.
    """
    cold, hot = rows.where("not hot"), rows.where("hot")
    near = cold.select("*", *(a.over(Window.partitionBy("token")).alias(n) for n, a in aggregates.items()))
    total = hot.groupBy(F.col("token").alias("of")).agg(*(a.alias(n) for n, a in aggregates.items()))
    return near.unionByName(hot.join(total, F.col("token") == F.col("of")).drop("of"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The links among pairs (a, b) of sets."""
    own = sets.join(_few(pairs.select(F.explode(F.array("a", "b")).alias("of")).distinct()), F.col("k") == F.col("of"), "left_semi")
    both = pairs.join(own.toDF("x", "s"), F.col("a") == F.col("x")).join(own.toDF("y", "r"), F.col("b") == F.col("y"))
    shared = both.select("a", "b", (F.size("s") + F.size("r")).alias("both"), F.size(F.array_intersect("s", "r")).alias("shared"))
    return shared.where(f"100 * shared >= {PERCENT} * (both - shared)").select("a", "b").distinct()


def _links(documents: DataFrame, least: DataFrame, shingles: int, scratch: Scratch) -> DataFrame:
    """The components (id, component) of the keys of different sets, by links between them. least: k, doc."""
    one = _prefixes(documents, frequency_sketch(documents, shingles)).groupBy("k").agg(*(F.first(c).alias(c) for c in ("n", "m", "cold", "hot")))
    one = scratch.write(one, "prefixes")
    sizes = scratch.write(one.select(F.col("k").alias("of_k"), "n", "m"), "sizes")
    tagged = lambda c, hot: F.transform(c, lambda t: F.struct(t.alias("token"), F.lit(hot).alias("hot")))
    rows = one.select("k", F.inline(F.concat(tagged("cold", False), tagged("hot", True))))
    joined = documents.sparkSession.createDataFrame([], "id long, component long")
    sets, before = None, "prefixes"
    for turn in range(ROUNDS + 1):
        placed = rows.withColumn("comp", F.col("k"))
        if turn:
            placed = rows.join(_few(joined), F.col("k") == F.col("id"), "left").withColumn("comp", F.coalesce("component", "k")).drop("id", "component")
        hub = F.min_by(F.struct("k", "comp"), F.xxhash64("k", "token", F.lit(turn)) if turn else F.col("k"))
        # The rows of a token in one component only, at first those of one set only, need no more comparisons.
        apart = _grouped(placed, {"low": F.min("comp"), "high": F.max("comp"), "hub": hub}).where("low < high").drop("low", "high")
        apart = scratch.write(apart, f"apart{turn}")
        scratch.drop(before)
        before = f"apart{turn}"
        if apart.isEmpty():
            break
        if sets is None:
            sets = scratch.write(_token_sets(documents, least.join(apart.select("k").distinct(), "k", "left_semi")), "sets")
        a, b = sizes, sizes.toDF("of_k2", "n2", "m2")
        if turn < ROUNDS:
            # A few hubs for each set, which sets with common shingles choose alike; the last turn sees all that stays apart.
            own = F.struct(F.xxhash64("hub.k", F.lit(turn)).alias("h"), F.col("hub.k").alias("b"))
            chosen = apart.where("comp <> hub.comp").groupBy(F.col("k").alias("a")).agg(F.slice(F.array_sort(F.collect_set(own)), 1, HUBS).alias("hubs"))
            pairs = chosen.select("a", F.explode("hubs.b").alias("b"))
            pairs = pairs.join(a, F.col("a") == F.col("of_k")).join(b, F.col("b") == F.col("of_k2")).where(_similar_sizes("n", "n2"))
        else:
            sized = apart.drop("hub").join(_few(a), F.col("k") == F.col("of_k")).drop("of_k")
            other = sized.selectExpr("token token2", "k b", "n n2", "m m2", "comp comp2")
            near = sized.join(other, F.expr("token = token2 and comp < comp2 and " + _similar_sizes("n", "n2")))
            pairs = near.groupBy(F.col("k").alias("a"), "b").agg(F.count("*").alias("x"), F.first(F.least("m", "m2")).alias("asked")).where("x >= asked")
        pairs = scratch.write(pairs.select("a", "b"), "pairs")
        found = scratch.write(_verified(pairs, sets), "found")
        grown = scratch.write(merged(joined, found, scratch), f"joined{turn}")
        scratch.drop("pairs", "found", "stars", f"joined{turn - 1}")
        joined, rows = grown, apart.drop("hub", "comp")
    scratch.drop("sets", "sizes", before)
    return joined


def link_documents(documents: DataFrame) -> DataFrame:
    """documents(doc_id, text) -> doc_id, n_shingles, component_id."""
    docs = documents.selectExpr("cast(doc_id as long) doc_id", "text")
    scratch = Scratch(documents.sparkSession)
    sets = scratch.write(_sets(docs), "documents")
    full = sets.where("n_shingles > 0 and doc_id is not null")
    least = scratch.write(full.groupBy("k").agg(F.min("doc_id").alias("doc")), "least")
    shingles = full.agg(F.sum("n_shingles")).head()[0] or 0
    joined = _links(docs, least, shingles, scratch)
    # A document of a set to that set's component, and the component to its least document: all by the least doc of a key.
    comp = least.join(joined, F.col("k") == F.col("id"), "left").select("k", F.coalesce("component", "k").alias("comp"), "doc")
    root = comp.groupBy(F.col("comp").alias("c")).agg(F.min("doc").alias("root"))
    of_set = scratch.write(comp.join(root, F.col("comp") == F.col("c")).select("k", "root"), "roots")
    placed = full.join(of_set, "k").select("doc_id", "root")
    # Rows of one doc_id with several texts link their components.
    links = placed.groupBy("doc_id").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b")
    every = placed.where("doc_id <> root").selectExpr("doc_id a", "root b")
    if not links.isEmpty():
        of = components(every, scratch)
    else:
        of = every.distinct().selectExpr("a id", "b component")
    of = scratch.write(of, "components")
    scratch.drop("roots", "least", "stars", *(f"joined{k}" for k in range(ROUNDS + 1)))
    return sets.join(of, F.col("doc_id") == F.col("id"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_representatives(documents: DataFrame) -> DataFrame:
    """The rows of each component's least doc_id, with their own columns; rows without doc_id stay."""
    gone = link_documents(documents).where("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return documents.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")


def op7_adaptive_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op7_adaptive_prefix_join": op7_adaptive_prefix_join}
