import hashlib
import heapq
import random
import re
import zlib

import pytest

from provenir.llm import conversation_repair as cr
from provenir.llm.conversation_repair import cheapest, damage, product, repair_conversations

LEGAL = re.compile("(s?(ua)+)?")


def search(kinds):
    """Uniform-cost search over edits, without matrices: the cheapest audit that gives a legal role sequence, least in ASCII."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, roles = heapq.heappop(heap)
        tail = roles if len(roles) < 2 else "." + roles[-1]
        if at == len(kinds) and LEGAL.fullmatch(roles):
            return cost, audit
        if (at, tail) in seen:
            continue
        seen.add((at, tail))
        ways = [(5, "I", 0, c) for c in "ua"]
        if at < len(kinds):
            k = kinds[at]
            ways.append((2, "D", 1, ""))
            if k != "D":
                more = 5 if k.isupper() else 0
                ways += [(more, "K", 1, k.lower())] + [(1 + more, "R", 1, c) for c in "ua"]
        for c, op, step, role in ways:
            if re.fullmatch("s?(ua)*u?", roles + role):
                heapq.heappush(heap, (cost + c, audit + op, at + step, roles + role))
    raise AssertionError


def brute(table):
    """conv_id -> the contract's row."""
    out = {}
    for conv in {r[0] for r in table}:
        rows = []
        for c, turn, role, text in (r for r in table if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            what = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
            rows += [(turn, "user" if what == 4 else role, text)] * (0 if what == 0 else 2 if what == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        kinds, n, seen = "", {"blank": 0, "duplicate": 0, "truncated": 0}, set()
        for _, role, text in rows:
            bare = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            n |= {fault: n[fault] + 1} if fault else {}
            initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
            kinds += "D" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        cost, audit = search(kinds)
        state, at, made = "", 0, []
        for op in audit:
            new = "assistant" if state == "u" else "user"
            if op != "I":
                _, role, text = rows[at]
                at += 1
                if op == "D":
                    continue
                made.append((role if op == "K" else new) + ":" + text)
            else:
                made.append(new + ":")
            state = made[-1][0]
        turns = {t for t, _, _ in rows if t is not None}
        initials = [r[1][:1] for r in rows]
        out[conv] = {
            "conv_id": conv, "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, **n, "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(made).encode()).hexdigest(),
        }
    return out


def some(seed, conversations, turns):
    r = random.Random(seed)
    texts = ["Hello there.", "Why?", "no end", "", " \t", "Yes!", "same words again.", "grün \U0001f600.", None, "x" * 300 + "."]
    for conv in range(conversations):
        for turn in range(r.randrange(1, turns)):
            if r.random() < 0.9:
                yield conv, turn, r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), f"{r.choice(texts)} {turn}." if r.random() < 0.5 else r.choice(texts)


@pytest.fixture
def query(spark, tmp_path, monkeypatch):
    def query(rows, **settings):
        for k, v in settings.items():
            monkeypatch.setattr(cr, k, v)
        spark.createDataFrame([(*r, "own", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, part int").write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
        return cr.op13_conversation_repair(spark, str(tmp_path))

    return query


def test_products_are_the_cheapest_edits_and_bracketing_changes_nothing():
    r = random.Random(3)
    for n in [0, 1, 2, 3, 4, 5, 6, 8, 12, 20]:
        for _ in range(25):
            kinds = "".join(r.choice("DsuaoSUAOuaua") for _ in range(n))
            assert cheapest(product(kinds)) == search(kinds), kinds
            at = r.randrange(n + 1)
            assert cheapest(cr.times(product(kinds[:at]), product(kinds[at:]))) == search(kinds)


def rows_of(df):
    return {r["conv_id"]: r.asDict() for r in df.collect()}


def test_query_equals_brute_force(query):
    rows = list(some(1, 60, 14))
    rows += [(None, k, "user", f"Turn {k}.") for k in range(4)] + [(900, None, "user", "A."), (900, None, "assistant", "B."), (900, 3, None, None)]
    rows += [(901, 2, "user", "Twice.")] * 3 + [(902, 5, "assistant", "B."), (902, 5, "user", "A.")] + [(903, 1, "user", "long " * 50_000 + "end.")]
    assert rows_of(query(rows)) == brute(rows)


def test_blocks_of_long_conversations_equal_brute_force(query):
    """One conversation holds most rows, and blocks are so small that it lies over many of them."""
    rows = list(some(2, 12, 10)) + [(77, k if k % 7 else None, ["user", "assistant", "system"][k % 5 % 3], f"{'Line' if k % 4 else 'End'} {k % 90}{'.' if k % 6 else ''}") for k in range(700)]
    assert rows_of(query(rows, BLOCK=3)) == brute(rows)


def test_repaired_turns(spark):
    rows = [(1, k, ["user", "assistant"][k % 2], f"Say {k}.") for k in range(40)]
    found = repair_conversations(damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    turns = found.turns().orderBy("position").collect()
    assert [t["position"] for t in turns] == list(range(len(turns)))
    assert LEGAL.fullmatch("".join(t["role"][0] for t in turns))


def test_empty_table_and_conversations_without_rows(query):
    assert query([]).collect() == []
    gone = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Goes."), (gone + 20_000, 1, "user", "x.")]
    assert rows_of(query(rows)) == brute(rows)
    assert rows_of(query(rows))[gone]["repaired_sha256"] == hashlib.sha256(b"").hexdigest()
