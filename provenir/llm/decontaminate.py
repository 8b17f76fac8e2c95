"""Benchmark decontamination: spaced-seed hashing.

Fixed masks over a span of SPAN words ignore some of its positions; a document's masked hashes that are also a benchmark
item's are hits, and around each hit the two texts are compared word by word on that alignment. A document is
contaminated where some SPAN aligned words hold at most WRONG substitutions; overlaps of more such
windows join up. MASKS cover every choice of WRONG positions: for any two of them some mask ignores both, so no
such window is missed. Words are runs of letters and digits (marks of ASCII part them), lower-cased.

The benchmark comes in blocks of about BLOCK_WORDS words by a hash of the item, one after the other, each against all documents;
so what the driver and a task hold of it is bounded whatever the benchmark's size; between two blocks the overlaps so far are written to
the shared folder. Documents are independent rows: nothing is shuffled, and a common passage costs each document that has it, no more. Hits are
verified PAIRS at a time and joined up for each alignment at once, so a word repeated throughout a text and an item is not slow.

Defined results: a null text is empty and never contaminated; items of under SPAN words are compared whole, without
substitutions, if they have LEAST words or more, else ignored (as are null ones); repeated documents are
judged alike and all returned; items with the same text count once each by item_id; items without an id report as -1;
other columns of the documents pass through drop_contaminated untouched, but overlaps in the result of find_overlaps stands for a column of that name; an empty benchmark contaminates nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.llm._io import Scratch, table
from provenir.llm._words import MARKS, spaced, word_hashes

SPAN = 13
WRONG = 2
LEAST = 6
BLOCK_WORDS = 2_000_000
FILTER_BITS = 22
PAIRS = 500_000


def _cover(span: int, ignored: int) -> list[list[int]]:
    """Masks such that any two positions are ignored together by one, built greedily and in a fixed order."""
    left = {(a, b) for a in range(span) for b in range(a + 1, span)}
    masks = []
    while left:
        chosen: list[int] = []
        while len(chosen) < ignored:
            gain = lambda x: sum((min(x, c), max(x, c)) in left for c in chosen) + 1e-3 * sum(x in p for p in left)
            chosen.append(max((x for x in range(span) if x not in chosen), key=lambda x: (gain(x), -x)))
        left -= {(a, b) for a in chosen for b in chosen if a < b}
        masks.append([x for x in range(span) if x not in chosen])
    return masks


#: The sampled positions of each mask.
MASKS = _cover(SPAN, 6)


class Seeds:
    """A block of benchmark items, indexed by their masked hashes."""

    def __init__(self, items: list[tuple[int, str]]):
        words, begins = word_hashes([t for _, t in items], MARKS, fold=True)
        self.words, self.begins, self.ids = words, begins, np.array([i for i, _ in items], np.int64)
        self.tables = []  # of each seed: offsets, span, sorted hashes, their places in words
        sizes = np.diff(begins)
        ends = np.repeat(begins[1:], sizes)
        place = np.arange(len(words))
        for salt, mask in enumerate(MASKS):
            fits = np.flatnonzero(place + SPAN <= ends)
            self._add(mask, SPAN, salt, fits)
        for size in range(LEAST, SPAN):  # short items, whole
            self._add(list(range(size)), size, 100 + size, begins[:-1][sizes == size])

    def _add(self, mask: list[int], span: int, salt: int, fits: np.ndarray) -> None:
        if len(fits):
            h = _at(self.words, mask, salt, fits)
            order = np.argsort(h, kind="stable")
            bits = np.zeros(1 << FILTER_BITS, bool)
            bits[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
            self.tables.append((mask, span, salt, h[order], fits[order], bits))

    def find(self, words: np.ndarray, begins: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """For each of several texts (their words, and where each begins): (item_id, first word, end word) of its overlaps,
        joined up for each item and alignment."""
        ends = begins[1:]
        kept = []  # of windows that hold: text, item, alignment, first word in the text, end word
        for mask, span, salt, hashes, places, bits in self.tables:
            h = spaced(words, mask, salt)[: max(0, len(words) - span + 1)]
            at = np.flatnonzero(bits[h >> np.uint64(64 - FILTER_BITS)])
            at = at[at + span <= ends[np.searchsorted(ends, at, side="right")]]  # within one text
            low, high = (np.searchsorted(hashes, h[at], side=s) for s in ("left", "right"))
            hits = high - low
            for part in _bounded(hits):
                p = np.repeat(at[part], hits[part])
                first = np.repeat(low[part] - np.concatenate([[0], np.cumsum(hits[part])[:-1]]), hits[part])
                q = places[first + np.arange(len(p))]
                same = sum((words[p + k] == self.words[q + k]).astype(np.int16) for k in range(span)) if len(p) else np.zeros(0)
                good = same >= span - (WRONG if span == SPAN else 0)
                p, q = p[good], q[good]
                text, item = np.searchsorted(ends, p, side="right"), np.searchsorted(self.begins, q, side="right") - 1
                kept.append(_runs(np.stack([text, item, p - q, p - begins[text], p - begins[text] + span])))
        found: list[list[tuple[int, int, int]]] = [[] for _ in ends]
        if kept:
            for text, item, _, begin, end in _runs(np.concatenate(kept, axis=1)).T.tolist():
                found[text].append((int(self.ids[item]), begin, end))
        return [sorted(f) for f in found]


def _bounded(hits: np.ndarray) -> Iterator[slice]:
    """Slices of places with about PAIRS hits each."""
    group = np.cumsum(hits) // PAIRS
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(hits)]
    return (slice(a, b) for a, b in zip(cuts, cuts[1:]) if b > a)


def _runs(windows: np.ndarray) -> np.ndarray:
    """Windows of one text, item and alignment that touch or overlap, joined up: as many rows, fewer columns."""
    if not windows.shape[1]:
        return windows
    windows = windows[:, np.lexsort(windows[3::-1])]
    fresh = np.ones(windows.shape[1], bool)
    fresh[1:] = (windows[:3, 1:] != windows[:3, :-1]).any(axis=0) | (windows[3, 1:] > windows[4, :-1])
    if (windows[4, 1:] < windows[4, :-1])[~fresh[1:]].any():  # a short window inside a longer one: the furthest end so far counts
        group = np.cumsum(fresh)
        far = np.maximum.accumulate(windows[4] + group * (windows[4].max() + 1)) - group * (windows[4].max() + 1)
        fresh[1:] = (windows[:3, 1:] != windows[:3, :-1]).any(axis=0) | (windows[3, 1:] > far[:-1])
    starts = np.flatnonzero(fresh)
    return np.concatenate([windows[:4, starts], np.maximum.reduceat(windows[4], starts)[None, :]])


def _at(words: np.ndarray, mask: list[int], salt: int, places: np.ndarray) -> np.ndarray:
    """spaced() at some places only; the last may be past where it ends."""
    padded = np.concatenate([words, np.zeros(SPAN, np.uint64)])
    return spaced(padded, mask, salt)[places]


_FIELDS = "array<struct<item_id: bigint, begin: int, end: int>>"


def _blocks(benchmark: DataFrame) -> list[Column]:
    """Conditions that part the benchmark into blocks of bounded size."""
    words = benchmark.agg(F.sum(F.length("text"))).head()[0] or 0
    n = max(1, -(-words // (5 * BLOCK_WORDS)))
    return [F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k for k in range(n)]


def _overlaps(seeds: Seeds):
    @F.pandas_udf(_FIELDS)
    def overlaps(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            found, step = [], 200
            for k in range(0, len(batch), step):
                for spans in seeds.find(*word_hashes([t or "" for t in batch[k : k + step]], MARKS, fold=True)):
                    found.append([{"item_id": i, "begin": a, "end": b} for i, a, b in spans])
            yield pd.Series(found, dtype=object)

    return overlaps


def find_overlaps(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """documents(text, ...) with the column overlaps: item_id, begin and end in words of the document."""
    own = [F.col(f"`{c}`") for c in documents.columns if c != "overlaps"]
    out = documents.select(*own, F.array().cast(_FIELDS).alias("overlaps"))
    bench = benchmark.selectExpr("cast(coalesce(item_id, -1) as long) item_id", "text").where("text is not null")
    blocks = _blocks(bench)
    scratch = Scratch(documents.sparkSession) if len(blocks) > 1 else None
    for block in blocks:
        seeds = Seeds([(r["item_id"], r["text"]) for r in bench.where(block).collect()])
        if len(seeds.ids):
            out = out.withColumn("overlaps", F.concat("overlaps", _overlaps(seeds)("text")))
            if scratch:  # one block's seeds are let go before the next one's are made
                out = scratch.write(out, "overlaps")
                scratch.drop_but_last("overlaps")
    return out


def drop_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any overlap, with their own columns."""
    found = find_overlaps(documents.select(F.struct("*").alias("_row"), "text"), benchmark)
    return found.where(F.size("overlaps") == 0).select("_row.*")


def op9_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_overlaps(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.transform("overlaps", lambda o: o["item_id"])))
    return found.select(
        "doc_id",
        (F.size("overlaps") > 0).alias("contaminated"),
        items.alias("item_ids"),
        F.aggregate("overlaps", F.lit(0).cast("long"), lambda a, o: F.greatest(a, (o["end"] - o["begin"]).cast("long"))).alias("longest_overlap"),
    )


QUERIES = {"op9_spaced_seeds": op9_spaced_seeds}
