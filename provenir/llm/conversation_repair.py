"""Conversation structure repair by a min-plus matrix scan.

Each turn is a 4x4 matrix over (cost, audit) elements: entry (i, j) is the cheapest edit of that turn which takes the role
pattern `(s?(ua)+)?` from state i to state j, with any insertions before it (the closure). "Plus" takes the lesser element, first by
cost and then by audit; "times" adds costs and joins audits. Products are associative, so a conversation's turns may be
multiplied in any bracketing: in one task where a conversation is short, and by a tree of groups where it isn't.

Turns are dealt out by ranges of (conv_id, turn, role, text), so one conversation may lie over any number of tasks. A conversation that a
task holds from its first turn to its last, in at most BLOCK turns and BLOCK_BYTES of text, is finished there. The first and last of
each task, and longer ones, are cut into blocks of that size at most: a block's matrix is made from its turns, the matrices of a
conversation are multiplied in groups of FAN neighbours, and the audit that comes out is dealt back to the blocks.

Defined results: rows of equal turn stand in the order of role and text; null role and text count as one space, and so do null parts
of the damage key; a null conv_id is a conversation of its own; an empty table gives an empty result; repeated rows are
rows like others (the later ones are duplicates); other columns of the input, whatever their names, are ignored. Texts are taken whole.
An audit has one letter for each turn or insertion, so a conversation's audit is one string in one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from provenir.llm._io import Scratch, table

BLOCK, BLOCK_BYTES, FAN = 4096, 4_000_000, 16
WHITE = " \t\n\x0b\x0c\r"
LEGAL = {"su", "ua", "au"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Of the states nothing yet, after system, after user, after assistant: where a user or assistant turn may follow, and where it leads.
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}

LONG, INT, TEXT = pa.int64(), pa.int32(), pa.string()
REPORT = {"conv_id": LONG, "gaps": LONG, "blank": LONG, "duplicate": LONG, "truncated": LONG, "illegal": LONG, "cost": LONG, "audit": TEXT}
TURNS = pa.list_(pa.struct({"role": TEXT, "text": TEXT}))
CUT = {"part": INT, "k": INT, "turns": pa.list_(LONG), "roles": pa.list_(TEXT), "texts": pa.list_(TEXT), "kinds": pa.list_(TEXT), "digests": pa.list_(pa.binary())}
SCANNED = {"conv_id": LONG, "report": pa.struct(REPORT), "repaired": TURNS, "cut": pa.struct(CUT)}
SUMS = {"low": LONG, "high": LONG, "distinct": LONG, "head_turn": LONG, "tail_turn": LONG, "head": TEXT, "tail": TEXT, "blank": LONG, "duplicate": LONG, "truncated": LONG, "illegal": LONG, "n": LONG}
SCORED = {"conv_id": LONG, "part": INT, "k": INT, "costs": pa.list_(LONG), "audits": pa.list_(TEXT), **SUMS}
DEALT = {"conv_id": LONG, "part": INT, "k": INT, "audit": TEXT, "state": INT, "emitted": LONG}
MENDED = {"conv_id": LONG, "part": INT, "k": INT, "emitted": LONG, "repaired": TURNS}
HASHED = {"conv_id": LONG, "repaired_sha256": TEXT}

Matrix = list[list[tuple[int, str] | None]]


def times(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product. Equal costs are settled by the lesser audit; no audit of equal cost and rows is a prefix of another,
    since what it lacks would be paid insertions, so that order survives joining."""
    out: Matrix = []
    for row in a:
        new: list[tuple[int, str] | None] = [None] * 4
        for x, line in zip(row, b):
            if x is None:
                continue
            for j, y in enumerate(line):
                if y is None:
                    continue
                cost, now = x[0] + y[0], new[j]
                if now is None or cost < now[0] or cost == now[0] and x[1] + y[1] < now[1]:
                    new[j] = (cost, x[1] + y[1])
        out.append(new)
    return out


def _closure() -> Matrix:
    """Any number of insertions: the identity, and paths of user and assistant turns. Returning to a state costs, so two are enough."""
    one: Matrix = [[(0, "") if i == j else (INSERT, "I") if NEXT[i] == j else None for j in range(4)] for i in range(4)]
    return times(one, one)


def _turn(kind: str) -> Matrix:
    """kind: D must go; else the role's initial (o: no role of the pattern), upper case if the turn is truncated."""
    m: Matrix = [[None] * 4 for _ in range(4)]
    extra = TRUNCATED if kind.isupper() else 0
    for i in range(4):
        m[i][i] = (DELETE, "D")
        if kind == "D":
            continue
        m[i][NEXT[i]] = (REROLE + extra, "R")
        to = {"s": 1 if i == 0 else None, "u": 2 if i != 2 else None, "a": 3 if i == 2 else None}.get(kind.lower())
        if to is not None:
            m[i][to] = (KEEP + extra, "K")
    return m


INSERTS = _closure()
LEAVES = {kind: times(INSERTS, _turn(kind)) for kind in "DsuaoSUAO"}
UNIT: Matrix = [[(0, "") if i == j else None for j in range(4)] for i in range(4)]


@lru_cache(maxsize=1 << 15)
def _short(kinds: str) -> Matrix:
    return LEAVES[kinds] if len(kinds) == 1 else times(_short(kinds[: len(kinds) // 2]), _short(kinds[len(kinds) // 2 :]))


def product(kinds: str) -> Matrix:
    """Of the turns' matrices, as a balanced tree; runs of up to 16 turns are remembered."""
    if not kinds:
        return UNIT
    if len(kinds) <= 16:
        return _short(kinds)
    half = 1 << ((len(kinds) - 1).bit_length() - 1)
    return times(product(kinds[:half]), product(kinds[half:]))


def cheapest(m: Matrix) -> tuple[int, str]:
    """Of all edits that lead from nothing to nothing or to an assistant turn."""
    row = times(m, INSERTS)[0]
    return min(x for x in (row[0], row[3]) if x is not None)


def replay(audit: str, rows: list[tuple[str, str]], state: int = 0) -> list[tuple[str, str]]:
    """The turns that the edits make of rows, which begin in state."""
    out, at = [], 0
    for op in audit:
        new = ("assistant", "") if state == 2 else ("user", "")
        if op != "I":
            role, text = rows[at]
            at += 1
            if op == "D":
                continue
            new = (role, text) if op == "K" else (new[0], text)
        state = {"s": 1, "u": 2, "a": 3}[new[0][0]]
        out.append(new)
    return out


def _kind(role: str, truncated: bool) -> str:
    initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return initial.upper() if truncated else initial


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def _gaps(turns: list[int | None]) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage; copies: 0 for a dropped row, 2 for a repeated one; fault: B, T or none."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(key) % 20).alias("_c")
    )
    text = F.when(F.col("_c") == 1, "").when(F.col("_c") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select(
        "conv_id", "turn", F.when(F.col("_c") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("_c") == 0, 0).when(F.col("_c") == 3, 2).otherwise(1).alias("copies")
    )
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    return rows.withColumn("fault", F.when(bare == "", "B").when(F.right(bare, F.lit(1)).isin(".", "!", "?"), "").otherwise("T"))


def _digest(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=20).digest()


def _whole(conv: int | None, rows: list[tuple]) -> dict:
    """The report and the repaired turns of one conversation."""
    seen: set[tuple[str, str]] = set()
    kinds, blank, duplicate, truncated = [], 0, 0, 0
    for _, role, text, fault in rows:
        if fault == "B":
            kinds.append("D")
            blank += 1
        elif (role, text) in seen:
            kinds.append("D")
            duplicate += 1
        else:
            kinds.append(_kind(role, fault == "T"))
            truncated += fault == "T"
        seen.add((role, text))
    cost, audit = cheapest(product("".join(kinds)))
    report = {"conv_id": conv, "gaps": _gaps([r[0] for r in rows]), "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": _illegal([r[1][:1] for r in rows]), "cost": cost, "audit": audit}
    return {"report": report, "repaired": [{"role": r, "text": t} for r, t in replay(audit, [(r[1], r[2]) for r in rows])], "conv_id": conv, "cut": None}


def _block(conv: int | None, rows: list[tuple], part: int, k: int) -> dict:
    """A part of a conversation that other blocks continue; whether its turns are duplicates isn't known yet."""
    kinds = ["D" if fault == "B" else _kind(role, fault == "T") for _, role, _, fault in rows]
    digests = [None if fault == "B" else _digest(role, text) for _, role, text, fault in rows]
    cut = {"part": part, "k": k, "turns": [r[0] for r in rows], "roles": [r[1] for r in rows], "texts": [r[2] for r in rows], "kinds": kinds, "digests": digests}
    return {"report": None, "repaired": None, "conv_id": conv, "cut": cut}


def _spark(fields: dict) -> StructType:
    return from_arrow_schema(pa.schema(fields))


def _batch(rows: list[dict], fields: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, pa.schema(fields))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    out, size = [], 0
    conv, rows, held, k, first, cut = object(), [], 0, 0, True, False

    def close(last: bool) -> None:
        nonlocal rows, held, k, cut, first, size
        whole = not (first or last or cut)
        out.append(_whole(conv, rows) if whole else _block(conv, rows, part, k))
        size += held + 100
        k += not whole
        rows, held = [], 0

    for batch in batches:
        for c, turn, role, text, copies, fault in zip(*(column.to_pylist() for column in batch.columns)):
            if type(conv) is object:
                conv = c
            elif c != conv:
                close(False)
                conv, first, cut = c, False, False
            elif len(rows) >= BLOCK or held >= BLOCK_BYTES:
                cut = True
                close(False)
            rows += [(turn, role, text, fault)] * copies
            held += copies * (len(text) + 40)
            if size >= BLOCK_BYTES:
                yield _batch(out, SCANNED)
                out, size = [], 0
    if type(conv) is not object:
        close(True)
    if out:
        yield _batch(out, SCANNED)


def _flat(m: Matrix) -> dict:
    cells = [x for row in m for x in row]
    return {"costs": [None if x is None else x[0] for x in cells], "audits": [None if x is None else x[1] for x in cells]}


def _square(costs, audits) -> Matrix:
    cells = [None if a is None else (int(c), a) for c, a in zip(costs, audits)]
    return [cells[i : i + 4] for i in range(0, 16, 4)]


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's matrix and sums; firsts: places whose role and text no earlier turn of the conversation has."""
    for batch in batches:
        out = []
        for x in batch.to_pylist():
            firsts = set(x["firsts"] or ())
            blanks = [d is None for d in x["digests"]]
            kinds = "".join("D" if b or i not in firsts else kind for i, (kind, b) in enumerate(zip(x["kinds"], blanks)))
            turns, initials = x["turns"], [r[:1] for r in x["roles"]]
            known = [t for t in turns if t is not None]
            sums = {"low": min(known, default=None), "high": max(known, default=None), "distinct": len(set(known)), "head_turn": known[0] if known else None, "tail_turn": known[-1] if known else None}
            sums |= {"head": initials[0] if initials else None, "tail": initials[-1] if initials else None, "n": len(turns)}
            sums |= {"blank": sum(blanks), "duplicate": sum(not b and i not in firsts for i, b in enumerate(blanks)), "truncated": sum(kind.isupper() and kind != "D" for kind in kinds), "illegal": _illegal(initials)}
            out.append({"conv_id": x["conv_id"], "part": x["part"], "k": x["k"], **_flat(product(kinds)), **sums})
        yield _batch(out, SCORED)


def join_blocks(a: dict, b: dict) -> dict:
    """Two neighbouring stretches of one conversation as one. Associative."""
    if not a["n"] or not b["n"]:
        return a | {"part": a["part"], "k": a["k"]} if a["n"] else b | {"part": a["part"], "k": a["k"]}
    both = _flat(times(_square(a["costs"], a["audits"]), _square(b["costs"], b["audits"])))
    some = lambda f, key: f([x[key] for x in (a, b) if x[key] is not None], default=None)
    met = a["tail_turn"] is not None and a["tail_turn"] == b["head_turn"]
    return a | both | {
        "low": some(min, "low"), "high": some(max, "high"), "distinct": a["distinct"] + b["distinct"] - met, "tail": b["tail"],
        "head_turn": b["head_turn"] if a["head_turn"] is None else a["head_turn"], "tail_turn": a["tail_turn"] if b["tail_turn"] is None else b["tail_turn"],
        "illegal": a["illegal"] + b["illegal"] + (a["tail"] + b["head"] not in LEGAL), **{c: a[c] + b[c] for c in ("blank", "duplicate", "truncated", "n")},
    }


def _reduce(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of a group's blocks: at most FAN of them, or those of one task."""
    for batch in groups:
        out = []
        for row in batch.to_pylist():
            total = None
            for x in sorted(row["xs"], key=lambda x: (x["part"], x["k"])):
                x = {"conv_id": row["conv_id"]} | x
                total = x if total is None else join_blocks(total, x)
            out.append(total)
        yield _batch(out, SCORED)


def _tree(scored: DataFrame, parts: int) -> DataFrame:
    """conv_id and the product of its blocks in order: those of one task first, then of FAN tasks, and so on."""
    level, wide = scored, 1
    fields = [c for c in scored.columns if c != "conv_id"]
    while True:
        group = level.groupBy("conv_id", (F.col("part") / wide).cast("int").alias("_g")).agg(F.collect_list(F.struct(*fields)).alias("xs"))
        level = group.select("conv_id", "xs").mapInArrow(_reduce, _spark(SCORED))
        if wide >= parts:
            return level
        wide *= FAN


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's stretch of its conversation's audit, and the state in which it begins."""
    for batch in batches:
        out = []
        for x in batch.to_pylist():
            ops = np.frombuffer(x["audit"].encode(), np.uint8)
            ends = np.flatnonzero(ops != ord("I")) + 1
            made = np.concatenate([[0], np.cumsum(ops != ord("D"))])
            system = int(made[-1]) % 2  # pairs follow, so an odd number has a system turn before them
            blocks, at, rows = sorted(x["blocks"], key=lambda b: (b["part"], b["k"])), 0, 0
            for number, b in enumerate(blocks):
                rows += b["n"]
                end = len(ops) if number == len(blocks) - 1 else int(ends[rows - 1]) if rows else 0
                e = int(made[at])
                state = 0 if not e else 1 if system and e == 1 else 2 + (e - system + 1) % 2
                out.append({"conv_id": x["conv_id"], "part": b["part"], "k": b["k"], "audit": x["audit"][at:end], "state": state, "emitted": e})
                at = end
        yield _batch(out, DEALT)


def _mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.to_pylist():
            turns = replay(x["audit"], list(zip(x["roles"], x["texts"])), x["state"])
            yield _batch([{"conv_id": x["conv_id"], "part": x["part"], "k": x["k"], "emitted": x["emitted"], "repaired": [{"role": r, "text": t} for r, t in turns]}], MENDED)


class Repair:
    """report: a row for each conversation. pieces: conv_id, part, k, emitted (turns of the conversation before the piece), repaired
    (its turns); a conversation's pieces in the order of part and k are its repaired turns."""

    def __init__(self, damaged: DataFrame):
        self.scratch = Scratch(damaged.sparkSession)
        order = ["conv_id", "turn", "role", "text"]
        rows = damaged.select(*order, "copies", "fault").repartitionByRange(*order).sortWithinPartitions(*order)
        scanned = self.scratch.write(rows.mapInArrow(_scan, _spark(SCANNED)), "scanned")
        self.closed = scanned.where("cut is null")
        cut = scanned.where("cut is not null").select("conv_id", "cut.*")
        parts = (cut.agg(F.max("part")).head()[0] or 0) + 1
        said = cut.select("conv_id", "part", "k", F.posexplode("digests").alias("i", "digest")).where("digest is not null")
        first = said.groupBy("conv_id", "digest").agg(F.min(F.struct("part", "k", "i")).alias("at"))
        firsts = first.groupBy(F.col("at.part").alias("part"), F.col("at.k").alias("k")).agg(F.collect_list("at.i").alias("firsts"))
        scored = cut.select("conv_id", "part", "k", "turns", "roles", "kinds", "digests").join(firsts, ["part", "k"], "left").mapInArrow(_score, _spark(SCORED))
        scored = self.scratch.write(scored, "scored")
        total = self.scratch.write(_tree(scored, parts).mapInArrow(_finish, _spark(REPORT)), "total")
        blocks = scored.groupBy("conv_id").agg(F.collect_list(F.struct("part", "k", "n")).alias("blocks"))
        dealt = total.join(blocks, total["conv_id"].eqNullSafe(blocks["conv_id"])).select(total["conv_id"], "audit", "blocks").mapInArrow(_deal, _spark(DEALT))
        texts = cut.select("part", "k", "roles", "texts").join(dealt, ["part", "k"]).select("conv_id", "part", "k", "audit", "state", "emitted", "roles", "texts")
        self.opened = texts.mapInArrow(_mend, _spark(MENDED))
        self.report = self.closed.select("report.*").unionByName(total)
        self.total = total
        self.pieces = self.closed.selectExpr("conv_id", "cast(0 as int) part", "cast(0 as int) k", "cast(0 as bigint) emitted", "repaired").unionByName(self.opened)

    def turns(self) -> DataFrame:
        """conv_id, position (from 0), role, text of the repaired conversations."""
        return self.pieces.select("conv_id", "emitted", F.posexplode("repaired").alias("i", "t")).selectExpr("conv_id", "emitted + i position", "t.role role", "t.text text")


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for x in batch.to_pylist():
            cost, audit = cheapest(_square(x["costs"], x["audits"]))
            gaps = x["high"] - x["low"] + 1 - x["distinct"] if x["low"] is not None else 0
            out.append({c: x[c] for c in ("conv_id", "blank", "duplicate", "truncated", "illegal")} | {"gaps": gaps, "cost": cost, "audit": audit})
        yield _batch(out, REPORT)


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each conversation's lines, whose pieces come in order; only one piece is held at a time."""
    conv, digest = object(), None
    for batch in batches:
        done = []
        for c, emitted, lines in zip(*(column.to_pylist() for column in batch.columns)):
            if type(conv) is object or c != conv:
                if digest is not None:
                    done.append({"conv_id": conv, "repaired_sha256": digest.hexdigest()})
                conv, digest = c, hashlib.sha256()
            if lines is not None:
                digest.update((b"\n" if emitted else b"") + lines.encode())
        if done:
            yield _batch(done, HASHED)
    if digest is not None:
        yield _batch([{"conv_id": conv, "repaired_sha256": digest.hexdigest()}], HASHED)


def repair_conversations(damaged: DataFrame) -> Repair:
    """damaged: conv_id, turn, role, text, copies, fault as damage() gives them."""
    return Repair(damaged)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report with the digest of the repaired turns.

    A conversation that lies in one piece is hashed where it is; of the others only the pieces' lines go to one task, which reads
    them in order and holds one at a time, since a digest has one order.
    """
    found = repair_conversations(damage(table(spark, sf_dir, "conversations")))
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    closed = found.closed.select("report.*", F.sha2(lines, 256).alias("repaired_sha256"))
    pieces = found.opened.select("conv_id", "part", "k", "emitted", F.when(F.size("repaired") > 0, lines).alias("lines"))
    hashed = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "k").select("conv_id", "emitted", "lines").mapInArrow(_hash, _spark(HASHED))
    opened = found.total.join(hashed.withColumnRenamed("conv_id", "_id"), F.col("conv_id").eqNullSafe(F.col("_id"))).drop("_id")
    return closed.unionByName(opened)


QUERIES = {"op13_conversation_repair": op13_conversation_repair}
