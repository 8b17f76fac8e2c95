"""Readers and writers of the small text formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.schema import EDGE_TYPES


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """value, ord: the lines of one hand-written file and their numbers from 0. Such a file is a row, so that no split of it
    can shift a number."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("ord", "value"))


def read_qids(spark: SparkSession, path: str) -> DataFrame:
    """qid, ord: of each line the first comma-separated field that is an id, each once at its first line. A list without any is refused."""
    fields = F.transform(F.split("value", ","), lambda f: F.replace(F.trim(f), F.lit('"'), F.lit("")))
    found = _numbered(spark, path).select(F.get(F.filter(fields, lambda f: f.rlike(r"^Q[0-9]+\z")), F.lit(0)).alias("qid"), "ord").where("qid is not null")
    found = found.groupBy("qid").agg(F.min("ord").alias("ord"))
    if found.isEmpty():
        raise ValueError(f"no id in {path}: expected one on a line, or a mapping file with a column of them")
    return found


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, "name string, kind string, status string").where("trim(name) <> ''")


def read_resolution(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, "name string, kind string, status string, qid string, label string, confidence string, reason string")


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    """artist, play_count, loved, favorited; yes-words are true, no-words and blanks false. Reading fails on any other flag and on
    a count that is no whole number."""
    raw = _csv(spark, path, "artist string, play_count string, loved string, favorited string")

    def flag(name: str) -> Column:
        word = F.lower(F.trim(F.coalesce(name, F.lit(""))))
        bad = F.raise_error(F.lit(f"{path} has a {name} value that is not true or false")).cast("boolean")
        return F.when(word.isin("1", "true", "yes"), True).when(word.isin("0", "false", "no", ""), False).otherwise(bad)

    text = F.trim(F.coalesce("play_count", F.lit("")))
    count = F.when(text.rlike(r"^[+-]?[0-9]{1,18}\z"), F.expr("try_cast(trim(play_count) as bigint)")).otherwise(F.raise_error(F.lit(f"{path} has a play_count that is not a whole number")).cast("bigint"))
    return raw.select(F.trim("artist").alias("artist"), count.alias("play_count"), flag("loved").alias("loved"), flag("favorited").alias("favorited"))


def read_claims(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Owner claims (from, to, type) and the rows that are no claim, with their line number. Nothing may be taken if
    there are any of these."""
    lines = _numbered(spark, path).select("value", (F.col("ord") + 1).alias("line")).where("trim(value) <> '' and not trim(value) like '#%' and trim(value) <> 'from,to,type'")
    parts = F.split("value", ",")
    rows = lines.select("line", "value", *(F.trim(F.get(parts, F.lit(k))).alias(n) for k, n in enumerate(("from_qid", "to_qid", "type_code"))), F.size(parts).alias("n"))
    known = F.col("type_code").isin([t[0] for t in EDGE_TYPES])
    good = (F.col("n") == 3) & F.col("from_qid").rlike(r"^Q[0-9]+\z") & F.col("to_qid").rlike(r"^Q[0-9]+\z") & known
    good = F.coalesce(good, F.lit(False))
    return rows.where(good).select("from_qid", "to_qid", "type_code"), rows.where(~good).select("line", "value")


def write_csv(df: DataFrame, path: str) -> None:
    """Quotes where a comma, quote or line feed asks for it; null is empty."""
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', nullValue="", emptyValue="")
