"""Secret scans: base patterns, and multipart credentials linked within a scope.

The base spans are assignments, access keys and long hex runs. The method adds weak candidates (identifiers,
secret-like tokens, endpoints): each is reported only when parts of the other two kinds that complete it
lie within SCOPE code points of it in the same text. A credential needs a secret: an identifier or an endpoint
counts when a secret is near, a weak secret when an identifier or an endpoint is near. Base spans are secrets
(assign, hex) or identifiers (access) for that purpose. The join of the parts' intervals is a sorted search
inside each text (n log n in its parts, never pairs); texts are independent rows, so nothing is shuffled.

Defined results: a null text is empty and has no spans; repeated rows are scanned alike and all returned; a text
of any length is scanned whole; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from provenir.llm._io import slices, table

SCOPE = 400
KINDS = ["assign", "access", "hex", "id", "secret", "endpoint"]
# The base patterns. Short runs fail whatever follows, so the length is part of the pattern where a
# run is of one class of characters.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ASSIGN_WORD = re.compile(r"(?i:passw|secret|token|api)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
# The method's weak candidates.
ID = re.compile(r"""(?i:client_?id|account_?id|key_?id|user_?name|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.-]{3,})""", re.ASCII)
ID_WORD = re.compile(r"(?i:_id|keyid|clientid|accountid|user_?name|login)", re.ASCII)
SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>|]{3,}")


def _random_looking(token: str) -> bool:
    return bool(re.search("[0-9]", token) and re.search("[a-z]", token) and re.search("[A-Z]", token) and len(set(token)) >= 12)


def _near(starts: np.ndarray, ends: np.ndarray, others: list[tuple[int, int]], scope: int) -> np.ndarray:
    """Which intervals have one of the others within scope of them. Intervals of a kind don't overlap."""
    if not others or not len(starts):
        return np.zeros(len(starts), bool)
    s, e = np.array(sorted(others)).T
    e = np.maximum.accumulate(e)
    k = np.searchsorted(s, ends + scope, side="right")  # those that begin early enough
    return (k > 0) & (e[np.maximum(k - 1, 0)] >= starts - scope)


def scan_text(text: str | None, scope: int = SCOPE) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """The base spans and the added ones, each (start, end, kind)."""
    text = text or ""
    base: list[tuple[int, int, str]] = []
    if ASSIGN_WORD.search(text):
        base += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        base += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    base += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    ids = [m.span() for m in ID.finditer(text)] if ID_WORD.search(text) else []
    ends = [m.span() for m in ENDPOINT.finditer(text)] if "://" in text else []
    firm = [x[:2] for x in base if x[2] != "access"]
    secrets: list[tuple[int, int]] = []
    held = [x[:2] for x in base if x[2] == "access"]
    if ids or ends or held:  # a weak secret alone is never reported
        taken = np.array(sorted(firm + held + ends), dtype=np.int64).reshape(-1, 2)
        begun, ended = taken[:, 0], np.maximum.accumulate(taken[:, 1])
        for m in SECRET.finditer(text):
            if _random_looking(m[0]):
                k = np.searchsorted(begun, m.end()) - 1
                if k < 0 or ended[k] <= m.start():
                    secrets.append(m.span())
    added = []
    for kind, own, others in (("id", ids, firm + secrets), ("secret", secrets, ids + held + ends), ("endpoint", ends, firm + secrets)):
        if own:
            s, e = np.array(own).T
            added += [(int(a), int(b), kind) for a, b, ok in zip(s, e, _near(s, e, others, scope)) if ok]
    return base, added


def _listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]))))


def scan_secrets(documents: DataFrame, scope: int = SCOPE) -> DataFrame:
    """documents(doc_id, text) -> doc_id, n_assign, n_access, n_hex, base_spans, spans, n_linked."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, texts in slices(batches):
            rows = []
            for base, added in (scan_text(t, scope) for t in texts):
                rows.append((*(sum(x[2] == k for x in base) for k in KINDS[:3]), _listed(base), _listed(base + added), len(added)))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()])]
            yield pa.RecordBatch.from_arrays([run.column("doc_id"), *columns], ["doc_id", "n_assign", "n_access", "n_hex", "base_spans", "spans", "n_linked"])

    out = "doc_id long, n_assign long, n_access long, n_hex long, base_spans string, spans string, n_linked long"
    return documents.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(scan, out)


def op8_credential_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    return found.selectExpr("doc_id", "n_assign", "n_access", "n_hex", "sha2(base_spans, 256) base_sha256", "spans", "n_linked")


QUERIES = {"op8_credential_linking": op8_credential_linking}
