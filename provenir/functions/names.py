"""Name folding and the small scalar rules."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters whose stroke does not decompose.
STROKES = ("łŁøØđĐħĦ", "lLoOdDhH")
# Titles that a spelling may go without.
HONORIFICS = ["sir", "lord", "lady", "dame", "dr", "rev", "reverend", "prof", "professor"]


@F.pandas_udf(StringType())  # a type by name would need a session at import
def _without_marks(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks; no built-in function does this."""
    return s.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if unicodedata.category(c) != "Mn"))


def name_fold(name: Column) -> Column:
    """The key under which spellings of a name meet: no strokes, marks or case, no leading "the", letters and digits only."""
    lower = F.lower(_without_marks(F.translate(F.trim(name), *STROKES)))
    return F.regexp_replace(F.regexp_replace(lower, r"^the\s+", ""), r"[^\p{L}\p{Nd}]", "")


def spellings(name: Column) -> Column:
    """The name, then without a number in brackets at its end, then without an honorific: distinct, in that order."""
    plain = F.trim(name)
    bare = F.trim(F.regexp_replace(plain, r"\s*\([0-9]+\)$", ""))
    bare = F.when(bare == "", plain).otherwise(bare)
    title = F.replace(F.lower(F.substring_index(bare, " ", 1)), F.lit("."), F.lit(""))
    rest = F.trim(F.regexp_replace(bare, "^[^ ]* ?", ""))
    return F.array_distinct(F.array(plain, bare, F.when(title.isin(HONORIFICS) & (rest != ""), rest).otherwise(bare)))


def day_of(time: Column, precision: Column) -> Column:
    """The date of a statement's time, if it is precise to the day."""
    text = F.substring(F.regexp_replace(time, r"^[+-]", ""), 1, 10)
    return F.when((precision >= 11) & ~F.contains(text, F.lit("-00")), F.try_to_date(text)).otherwise(F.lit(None).cast("date"))


def believable_label(label: Column, qid: Column) -> Column:
    return F.when((F.trim(label) != "") & (label != qid), label)


def rounded_percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0)).otherwise(F.floor((part * 200 + whole) / (whole * 2))).cast("long")


def retry_delay_ms(attempt: int, retry_after_s: float | None = None, base: int = 200, cap: int = 30_000) -> int:
    """How long to wait before a further attempt (from 0): what the server asks, or doubling, at most cap."""
    return min(cap, int(retry_after_s * 1000) if retry_after_s is not None else base << attempt)
