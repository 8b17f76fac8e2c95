"""Byte-level BPE encoding and decoding.

Texts are split by the tokenizer's pattern; the distinct words of each run of documents become byte arrays, and Spark's
higher-order functions fold the ranked merges over them: the state is an array with an entry for each token of the word, and
each step merges the leftmost pair of the lowest rank. An entry is one number: the rank that the token and its successor merge at, then the
place where the token begins, then its id; so the least entry is the pair to merge, and no two entries are equal. The rank map is a literal:
the pairs of tokens whose bytes join to a token, in one flat array, in which the pair (a, b) is at base[a] + b and names a as its owner. Decoding looks
every id up in an array of binary pieces and concatenates them, for the distinct words of a run at once. Documents are independent, so there is no shuffle, and a run's size is bounded but for a single longer text.

The fold's cost grows with the square of a word's length, so words of more than LONG bytes (runs of blanks, keys)
are merged by a heap in the Python task that splits the text; both ways give the same ids.

Defined results: a null text is empty and has no ids; repeated rows are encoded alike and all returned; other columns are
ignored; an empty table gives an empty result. The vocabulary's file is a parameter, read on the driver; one with ids of
ID_BITS bits or more is refused.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.llm._io import slices, table

LONG = 1024
RUN_BYTES = 14_000_000
PIECES = 512
WINDOW = 1024
ID_BITS, PLACE_BITS = 17, 26
NONE = (1 << 63 - ID_BITS - PLACE_BITS) - 1  # a rank above all
IDS = (1 << ID_BITS) - 1
BELOW = (1 << ID_BITS + PLACE_BITS) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _literal(values: list[int], kind: str) -> Column:
    """Folded to one literal by the optimizer."""
    return F.from_json(F.lit("[" + ",".join(map(str, values)) + "]"), f"array<{kind}>")


def _displaced(pairs: dict[int, list[tuple[int, int]]]) -> tuple[list[int], list[int]]:
    """base and slots: of pairs[a] = [(b, rank), ...], owner and rank at slots[base[a] + b]; -1 stands in free slots.

    The tokens with the most partners are placed first, each from a place that its id decides and on, where its partners first fit.
    Three places of four stay free, so that this is soon.
    """
    room = 4 * sum(map(len, pairs.values())) + WINDOW
    width = room + WINDOW + max((b for p in pairs.values() for b, _ in p), default=0) + 1
    base, slots = np.zeros(max(pairs, default=-1) + 1, np.int64), np.full(width, -1, np.int64)
    for a in sorted(pairs, key=lambda a: -len(pairs[a])):
        partners = np.array([b for b, _ in pairs[a]], np.int64)
        at = a * 2654435761 % room
        while True:
            fits = np.arange(at, at + WINDOW)
            for b in partners.tolist():
                fits = fits[slots[fits + b] < 0]
                if not len(fits):
                    break
            if len(fits):
                break
            at = (at + WINDOW) % room
        base[a] = fits[0]
        slots[base[a] + partners] = [a << ID_BITS | rank for _, rank in pairs[a]]
    return base.tolist(), slots[: int(np.flatnonzero(slots >= 0).max(initial=-1)) + 1].tolist()


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The literal that maps two neighbouring ids to the id, and so the rank, of their joined bytes.

    A struct: single, the id of each byte; base and slots of the pairs.
    """
    if max(ranks.values()) > IDS:
        raise ValueError(f"the vocabulary has ids of over {ID_BITS} bits")
    pairs: dict[int, list[tuple[int, int]]] = {}
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None:
                pairs.setdefault(a, []).append((b, rank))
    base, slots = _displaced(pairs)
    return F.struct(_literal([ranks[bytes([b])] for b in range(256)], "bigint").alias("single"), _literal(base, "int").alias("base"), _literal(slots, "bigint").alias("slots"))


def _rank(table_: Column, a: Column, b: Column) -> Column:
    """NONE if the bytes of both don't join to a token. A place beyond the arrays is null, which equals nothing."""
    entry = F.get(table_["slots"], (F.get(table_["base"], a.cast("int")) + b).cast("int"))
    return _let(entry, lambda e: F.when(F.shiftright(e, ID_BITS) == a, e.bitwiseAND(F.lit(IDS))).otherwise(F.lit(NONE)))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Computes value once for all its uses in body."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda acc, _: acc, body)


def fold_merges(word: Column, table_: Column) -> Column:
    """The ids of a word, given as an array of its bytes (0 to 255), by a rank map."""

    def ranked(rank: Column, rest: Column) -> Column:
        return F.shiftleft(rank.cast("long"), ID_BITS + PLACE_BITS).bitwiseOR(rest)

    def id_of(entry: Column) -> Column:
        return entry.bitwiseAND(F.lit(IDS))

    def start(ids: Column) -> Column:
        rank = lambda x, i: F.when(i + 1 < F.size(ids), _rank(table_, x, F.get(ids, i + 1))).otherwise(F.lit(NONE))
        return F.transform(ids, lambda x, i: ranked(rank(x, i), F.shiftleft(i.cast("long"), ID_BITS).bitwiseOR(x)))

    def merged(entries: Column, low: Column, i: Column) -> Column:
        """Entry i (from 0) is low and takes the id that is its rank, and the entry after it goes."""
        id_, before, after = F.shiftright(low, ID_BITS + PLACE_BITS), F.get(entries, i - 1), F.get(entries, i + 2)
        rank = F.when(after.isNull(), F.lit(NONE)).otherwise(_rank(table_, id_, id_of(after)))
        own = ranked(rank, low.bitwiseAND(F.lit(BELOW - IDS)).bitwiseOR(id_))
        ahead = F.when(i > 0, ranked(_rank(table_, id_of(before), id_), before.bitwiseAND(F.lit(BELOW))))
        left = F.array_remove(entries, F.get(entries, i + 1))
        return _let(own, lambda own: _let(ahead, lambda ahead: F.transform(left, lambda x, j: F.when(j == i, own).when(j == i - 1, ahead).otherwise(x))))

    def step(entries: Column, _: Column) -> Column:
        found = lambda low: _let((F.array_position(entries, low) - 1).cast("int"), lambda i: merged(entries, low, i))
        return _let(F.array_min(entries), lambda low: F.when(low > F.lit(NONE << ID_BITS + PLACE_BITS), entries).otherwise(found(low)))

    steps = F.when(F.size(word) > 1, F.sequence(F.lit(2), F.size(word))).otherwise(F.array().cast("array<int>"))
    begin = _let(F.transform(word, lambda b: F.get(table_["single"], b.cast("int"))), start)
    return F.aggregate(steps, begin, step, lambda entries: F.transform(entries, lambda x: id_of(x).cast("int")))


def _heap_merges(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges in n log n, for long words."""
    n = len(word)
    end, prev, nxt, dead = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [False] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        r, i, upto = heapq.heappop(heap)
        if dead[i] or (j := nxt[i]) >= n or end[j] != upto or ranks.get(word[i:upto]) != r:
            continue
        end[i], nxt[i], dead[j] = upto, nxt[j], True
        if nxt[i] < n:
            prev[nxt[i]] = i
            if (q := ranks.get(word[i : end[nxt[i]]])) is not None:
                heapq.heappush(heap, (q, i, end[nxt[i]]))
        if (p := prev[i]) >= 0 and (q := ranks.get(word[p:upto])) is not None:
            heapq.heappush(heap, (q, p, upto))
    return [ranks[word[i : end[i]]] for i in range(n) if not dead[i]]


def encode(documents: DataFrame, ranks: dict[bytes, int], pattern: str, digests: bool = False) -> DataFrame:
    """documents(doc_id, text) -> doc_id, ids array<int>; or with digests doc_id, n_tokens, ids_sha256 (of the decimal ids
    joined by commas) and decoded_sha256 (of the bytes that the ids decode to), which spares sending the ids back."""
    # words: distinct, as bytes; long_ids: those of the words that come after them, merged already.
    out = "words array<array<smallint>>, long_ids array<array<int>>, docs array<struct<doc_id: bigint, at: array<int>>>"
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).findall
        for run, texts in slices(batches, size=RUN_BYTES):
            words: dict[str, int] = {}
            at = [np.array([words.setdefault(w, len(words)) for w in find(t)], np.int32) for t in texts]
            coded = [w.encode() for w in words]
            new, short, long_ids = [0] * len(coded), [], []
            for k, w in enumerate(coded):
                if len(w) <= LONG:
                    new[k] = len(short)
                    short.append(w)
            for k, w in enumerate(coded):
                if len(w) > LONG:
                    new[k] = len(short) + len(long_ids)
                    long_ids.append(_heap_merges(w, ranks))
            bytes_ = pa.ListArray.from_arrays(
                pa.array(np.cumsum([0, *map(len, short)]), pa.int32()), pa.array(np.frombuffer(b"".join(short), np.uint8).astype(np.int16))
            )
            counts, flat = np.cumsum([0, *map(len, at)]), np.concatenate(at)
            if long_ids:
                flat = np.array(new, np.int32)[flat]
            docs = pa.StructArray.from_arrays([run.column("doc_id"), pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.array(flat))], ["doc_id", "at"])
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            yield pa.RecordBatch.from_arrays([one(bytes_), one(pa.array(long_ids, pa.list_(pa.int32()))), one(docs)], ["words", "long_ids", "docs"])

    runs = documents.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(split, out)
    coded = F.concat(_let(rank_map(ranks), lambda m: F.transform("words", lambda w: fold_merges(w, m))), F.col("long_ids"))
    folded = runs.select(coded.alias("coded"), "docs")
    if digests:  # each distinct word's ids are decoded where they were made; a document's bytes are those of its words
        folded = folded.select("coded", "docs", _let(_piece_map(ranks), lambda m: F.transform("coded", lambda ids: _concatenated(ids, m))).alias("decoded"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                coded, docs = batch.column("coded")[k].values, batch.column("docs")[k].values
                flat, begins = coded.flatten().to_numpy(), coded.offsets.to_numpy()
                begins = begins - begins[0]
                at = docs.field("at")
                decoded = batch.column("decoded")[k].values.to_pylist() if digests else []
                words, ends = at.flatten().to_numpy(), at.offsets.to_numpy() - at.offsets[0].as_py()
                sizes = np.diff(begins)[words]
                upto = np.concatenate([[0], np.cumsum(sizes)])
                for a in range(0, len(docs), 500):  # so many documents a batch
                    b = min(a + 500, len(docs))
                    w, n = words[ends[a] : ends[b]], sizes[ends[a] : ends[b]]
                    starts = np.cumsum(n) - n
                    ids = flat[np.repeat(begins[w] - starts, n) + np.arange(int(n.sum()))]
                    cuts = upto[ends[a : b + 1]] - upto[ends[a]]
                    own = docs.field("doc_id").slice(a, b - a)
                    if not digests:
                        lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids, pa.int32()))
                        yield pa.RecordBatch.from_arrays([own, lists], ["doc_id", "ids"])
                        continue
                    each = [ids[x:y].tolist() for x, y in zip(cuts.tolist(), cuts[1:].tolist())]
                    said = [hashlib.sha256(",".join(map(numerals.__getitem__, e)).encode()).hexdigest() for e in each]
                    back = [hashlib.sha256(b"".join(map(decoded.__getitem__, words[x:y].tolist()))).hexdigest() for x, y in zip(ends[a:b].tolist(), ends[a + 1 : b + 1].tolist())]
                    yield pa.RecordBatch.from_arrays([own, pa.array([len(e) for e in each], pa.int64()), pa.array(said), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    if digests:
        numerals = [str(k) for k in range(max(ranks.values()) + 1)]
        return folded.mapInArrow(place, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return folded.mapInArrow(place, "doc_id long, ids array<int>")


def _pieces(ranks: dict[bytes, int]) -> list[bytes]:
    pieces = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        pieces[rank] = token
    return pieces


def _piece_map(ranks: dict[bytes, int]) -> Column:
    """The pieces of all ids, as an array of binaries."""
    literal = F.split(F.lit(",".join(p.hex() for p in _pieces(ranks))), ",")
    return F.transform(literal, lambda h: F.unhex(h))


def _concatenated(ids: Column, pieces: Column) -> Column:
    """The pieces of the ids, concatenated: PIECES at a time, and then what these give, so that long arrays aren't copied for every id."""
    empty = F.lit(b"")
    join = lambda part: F.aggregate(part, empty, lambda acc, i: F.concat(acc, F.get(pieces, i)))
    starts = F.sequence(F.lit(0), F.floor(F.size(ids) / PIECES).cast("int"))
    parts = F.transform(starts, lambda k: join(F.slice(ids, k * PIECES + 1, PIECES)))
    return F.when(F.size(ids) <= PIECES, join(ids)).otherwise(F.aggregate(parts, empty, lambda acc, p: F.concat(acc, p)))


def decode(ids: Column, ranks: dict[bytes, int]) -> Column:
    """The bytes of an array of ids."""
    return _let(_piece_map(ranks), lambda m: _concatenated(ids, m))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, digests=True)


QUERIES = {"op3_byte_bpe": op3_byte_bpe}
