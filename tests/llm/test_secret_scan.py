import random
import re

from llm_odd import ODD
from provenir.llm.secret_scan import scan_secrets, scan_text

PATTERNS = [
    ("assign", re.compile(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[1]) >= 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
]


def base(text):
    return sorted((m.start(), m.end(), kind) for kind, p, ok in PATTERNS for m in p.finditer(text) if ok(m))


def test_base_spans_are_those_of_the_patterns():
    r = random.Random(3)
    bits = ["token", "SECRET", "api_key", "apikey", "passwd", "password", "=", ":", " ", '"', "'", "AKIA", "ABCD1234", "0123456789abcdef", "deadbeef", "x", "zz", "=token=", "+/._-", "K", "ſecret"]
    for _ in range(3000):
        text = "".join(r.choice(bits) for _ in range(r.randrange(1, 18)))
        assert sorted(scan_text(text)[0]) == base(text), text


def test_weak_parts_need_each_other_within_a_scope():
    key, host = "Zx9QwErTy12UiOpAsDfGh", "db://node.internal/x"
    kinds = lambda t: sorted(k for *_, k in scan_text(t)[1])
    assert kinds(f"login: bob and {key} at {host}") == ["endpoint", "id", "secret"]
    assert kinds(f"only {key} here") == [] and kinds(f"only {host} here") == [] and kinds("login: bob") == []
    assert kinds(f"login: bob {'.' * 1000} {key}") == []


def test_a_weak_secret_of_any_length_is_linked():
    key = "Zx9QwErTy12UiOpAsDfGh" * 8
    assert scan_text(f"client_id=bob42 {key} ends")[1] == [(0, 15, "id"), (16, 16 + len(key), "secret")]


def test_odd_rows(make, spark):
    got = scan_secrets(make([*ODD, (97, "é" * 5 + "token=abcdefghijkl"), (98, "f" * 3_000_000)])).collect()
    assert len(got) == len(ODD) + 2
    by = {r["doc_id"]: r for r in got}
    assert by[97]["base_spans"] == "assign:5:23" and by[98]["base_spans"] == "hex:0:3000000"
    assert by[90]["base_spans"] == by[90]["spans"] == ""
    assert scan_secrets(make([])).count() == 0
