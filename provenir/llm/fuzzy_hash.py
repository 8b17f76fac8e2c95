"""Document fingerprints: context-triggered piecewise hashing.

A rolling hash over WINDOW bytes sets the chunk boundaries, every chunk gives one character of the signature, and
a fingerprint is blocksize:signature:signature at twice that block size. The block size is the smallest of
3 * 2**k whose signature has at most LENGTH chunks, so it follows from the text alone and equal texts have equal
fingerprints. Two fingerprints are compared where they have a block size in common: 1 - edit distance / longer
length of those signatures, the better of two if both match, and 0 where both have GRAM characters or more but no
GRAM in a row occur in both (as unrelated signatures agree by chance). Runs of over three equal signature
characters are cut to three before comparing.

Defined results: a null text is empty and has the fingerprint "3::", which is like another empty one (1) and
unlike any other (0). next_documents orders rows by doc_id, nulls first, and rows of one doc_id by a hash of their text;
with one row, it is its own successor. Texts of any length are hashed whole; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.llm._io import Scratch, table

WINDOW = 7
LENGTH = 64
GRAM = 4
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
STEP = 1_000_000


def _triggers(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the rolling hash is -1 modulo 3, and how often the rest of it, plus one, can be halved."""
    at, level = [], []
    for begin in range(0, len(data), STEP):
        head = min(begin, WINDOW - 1)
        x = np.frombuffer(data, np.uint8, min(STEP, len(data) - begin) + head, begin - head).astype(np.uint32)
        h = x.copy()
        for k in range(1, WINDOW):  # Horner's rule over the window: 7 bytes back weigh 2**0 * multiplier**6
            h[k:] += x[:-k] * np.uint32(pow(2654435761, k, 1 << 32))
        h = h[head:]
        h ^= h >> np.uint32(15)
        h *= np.uint32(2246822519)
        h ^= h >> np.uint32(13)
        v = h.astype(np.uint64) + np.uint64(1)
        hit = np.flatnonzero(v % np.uint64(3) == 0)
        third = v[hit] // np.uint64(3)
        low = third & (~third + np.uint64(1))
        at.append(hit + begin)
        level.append(np.log2(low.astype(np.float64)).astype(np.int64))
    return (np.concatenate(at), np.concatenate(level)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _signature(data: bytes, ends: np.ndarray) -> str:
    cuts = [0, *(ends + 1).tolist()]
    if cuts[-1] < len(data):
        cuts.append(len(data))
    view = memoryview(data)
    return "".join(ALPHABET[(zlib.crc32(view[a:b]) * 2654435761 >> 26) & 63] for a, b in zip(cuts, cuts[1:]))


def fingerprint(text: str | None) -> str:
    data = (text or "").encode()
    at, level = _triggers(data)
    counts = np.bincount(level, minlength=1)
    reach = counts[::-1].cumsum()[::-1]  # boundaries at block size 3 * 2**k
    k = int(np.argmax(reach < LENGTH)) if (reach < LENGTH).any() else len(reach)
    one, two = at[level >= k], at[level >= k + 1]
    return f"{3 << k}:{_signature(data, one)}:{_signature(data, two)}"


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 for two fingerprints."""

    def alike(x: Column, y: Column) -> Column:
        cut = lambda s: F.regexp_replace(s, r"(.)\1{3,}", "$1$1$1")
        p, q = cut(x), cut(y)
        grams = F.transform(F.sequence(F.lit(1), F.length(p) - (GRAM - 1)), lambda i: F.substring(p, i, GRAM))
        shared = (F.least(F.length(p), F.length(q)) < GRAM) | F.exists(F.when(F.length(p) >= GRAM, grams).otherwise(F.array(F.lit(""))), lambda g: (g != "") & F.contains(q, g))
        near = 1 - F.levenshtein(p, q) / F.greatest(F.length(p), F.length(q))
        return F.when(x == y, F.lit(1.0)).when(shared, near).otherwise(F.lit(0.0))

    p, q = F.split(a, ":"), F.split(b, ":")
    m, n = p[0].cast("long"), q[0].cast("long")
    return (
        F.when(a == b, F.lit(1.0))
        .when((m == n) & (p[1] != "") & (q[1] != ""), F.greatest(alike(p[1], q[1]), alike(p[2], q[2])))
        .when(((m * 2) == n) & (q[1] != ""), alike(p[2], q[1]))
        .when((m == (n * 2)) & (p[1] != ""), alike(p[1], q[2]))
        .otherwise(F.lit(0.0))
    )


def _edited(text: str, following: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def with_next(documents: DataFrame) -> DataFrame:
    """documents(doc_id, text) -> doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint.

    One range shuffle brings neighbours together; each range also gets the first row of the next one, so no order over
    all rows is ever formed in one task.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = Scratch(spark)
    plain = ids.write(rows.select("doc_id"), "ids")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = 4 * n  # several to a partition, which evens them out
    cuts = sorted(set(plain.where("doc_id is not null").approxQuantile("doc_id", [k / ranges for k in range(1, ranges)], 0.2 / ranges)))
    # A row's range: how many cuts it reaches. Nulls come first.
    cut = F.lit([int(c) for c in cuts]) if cuts else F.array().cast("array<bigint>")
    part = F.when(F.col("doc_id").isNull(), 0).otherwise(_count_reached(F.col("doc_id"), cut, len(cuts)))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    marked = rows.withColumn("part", part)
    starts = [(r["part"], r["doc_id"]) for r in plain.withColumn("part", part).groupBy("part").agg(F.min("doc_id").alias("doc_id"), F.max(F.col("doc_id").isNull()).alias("none")).select("part", F.when(~F.col("none"), F.col("doc_id")).alias("doc_id")).orderBy("part").collect()]
    if not starts:
        firsts = marked.limit(0).withColumn("head", F.lit(True))
    else:
        goes_to = [(first, starts[k - 1][0]) for k, (_, first) in enumerate(starts)]
        small = F.broadcast(spark.createDataFrame(goes_to, "doc_id bigint, part int"))  # a row for each range at most
        heads = rows.join(small, rows["doc_id"].eqNullSafe(small["doc_id"])).select(rows["doc_id"], "text", "part")
        least = F.min_by("text", F.struct(F.xxhash64("text"), F.col("text")))
        firsts = heads.groupBy("part", "doc_id").agg(least.alias("text")).select("doc_id", "text", "part", F.lit(True).alias("head"))
    both = marked.withColumn("head", F.lit(False)).unionByName(firsts)
    dealt = both.repartition(n, "part").sortWithinPartitions("part", "head", *order)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # part, doc_id, text, fingerprint of the row whose successor comes next

        def done(text: str, mark: str) -> tuple:
            edited = _edited(held[2], text)
            return held[1], len(held[2]), hashlib.sha256(edited.encode()).hexdigest(), held[3], fingerprint(edited), mark

        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint"]
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 4]
        for batch in batches:
            out = []
            for p, doc_id, text, head in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "text", "head"))):
                mark = fingerprint(text)
                if held and held[0] == p:
                    out.append(done(text, mark))
                held = None if head else (p, doc_id, text, mark)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, kinds)], names)

    return dealt.mapInArrow(walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string")


def _count_reached(value: Column, cuts: Column, n: int) -> Column:
    """By bisection over sorted cuts."""
    steps = [1 << k for k in range(max(1, n.bit_length()))][::-1]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda low, step: F.when(F.get(cuts, low + step - 1) <= value, low + step).otherwise(low))


def op4_piecewise_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


QUERIES = {"op4_piecewise_hash": op4_piecewise_hash}
