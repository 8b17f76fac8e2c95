"""Ratings, signals, interest and regard; the known list and what is never offered."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROMOTED = 4
SUPPRESSED = 2
NEUTRAL = 0.5


#: Which of two versions of a rating is the newer: a total order, so that no result depends on the order of arrival.
NEWER = ["updated_at", "seq", "rating", "note"]


def upsert_ratings(*versions: DataFrame) -> DataFrame:
    """versions(qid, rating, note, updated_at, seq) -> the newest of each qid; one without a note keeps the newest note there is.

    Ties on updated_at are settled by seq, the place in the log of changes, and then by the values themselves.
    """
    all_ = reduce(DataFrame.unionByName, versions)
    at = F.struct(*NEWER)
    last = all_.groupBy("qid").agg(F.max(at).alias("x"), F.max(F.when(F.col("note").isNotNull(), at)).alias("y"))
    return last.select("qid", "x.rating", F.col("y.note").alias("note"), "x.updated_at", "x.seq")


def carry_ratings(ratings: DataFrame, merges: DataFrame) -> DataFrame:
    """ratings once each local's rating has followed its merge(seq, local, canonical): it becomes the canonical's where that has none or an
    older one. The local's own row and its note stay where they are, and the canonical keeps its note. Of several locals the newest
    counts, of equally new ones that of the first merge; carrying again changes nothing."""
    carried = merges.select(F.col("local").alias("qid"), F.col("canonical").alias("_to"), (-F.col("seq")).alias("_first")).join(ratings, "qid")
    best = carried.groupBy("_to").agg(F.max(F.struct("updated_at", "_first", "rating", "seq")).alias("c"))
    own = ratings.join(best, F.col("qid") == F.col("_to"), "full")
    newer = F.col("c").isNotNull() & (F.col("updated_at").isNull() | (F.col("c.updated_at") > F.col("updated_at")))
    took = lambda n: F.when(newer, F.col(f"c.{n}")).otherwise(F.col(n)).alias(n)
    return own.select(F.coalesce("qid", "_to").alias("qid"), took("rating"), "note", took("updated_at"), took("seq"))


def note_affinity(ratings: DataFrame, qid: str, rating: int, note: str | None, at: Column, seq: int, nodes: DataFrame) -> DataFrame:
    """ratings with one more: of an entity that the graph has, from 1 to 5; a blank note is none."""
    if not 1 <= rating <= 5:
        raise ValueError(f"a rating is from 1 to 5, got {rating}")
    if nodes.where(F.col("qid") == qid).isEmpty():
        raise ValueError(f"unknown entity: {qid}")
    said = note.strip() if note and note.strip() else None
    new = ratings.sparkSession.range(1).select(F.lit(qid).alias("qid"), F.lit(rating).cast("int").alias("rating"), F.lit(said).cast("string").alias("note"), at.alias("updated_at"), F.lit(seq).cast("long").alias("seq"))
    return upsert_ratings(ratings, new)


def combine_signals(signals: DataFrame) -> DataFrame:
    """Signals of one (qid, source) added up: plays summed, flags or-ed, the latest observation."""
    return signals.groupBy("qid", "source").agg(
        F.sum("play_count").alias("play_count"), F.bool_or("loved").alias("loved"), F.bool_or("favorited").alias("favorited"), F.max("observed_at").alias("observed_at")
    )


def resolve_ratings(ratings: DataFrame, same_as: DataFrame) -> DataFrame:
    """Ratings under canonical ids: an id's own rating wins, then that of the local whose first merge came first."""
    first = same_as.groupBy("local").agg(F.min("seq").alias("prio"), F.max_by("canonical", "seq").alias("canonical"))
    placed = ratings.join(first, F.col("qid") == F.col("local"), "left")
    placed = placed.withColumns({"to": F.coalesce("canonical", "qid"), "prio": F.coalesce("prio", F.lit(-1))})
    return placed.groupBy("to").agg(F.min_by(F.struct("rating", "updated_at"), "prio").alias("x")).selectExpr("to qid", "x.rating rating", "x.updated_at updated_at")


def known_list(file: DataFrame, resolved: DataFrame) -> DataFrame:
    """qid, part, ord: the file's order, then ratings of PROMOTED or more that it lacks, by qid."""
    on_file = file.select("qid", F.lit(0).alias("part"), F.col("ord").cast("long").alias("ord"))
    more = resolved.where(F.col("rating") >= PROMOTED).join(file, "qid", "left_anti").select("qid", F.lit(1).alias("part"), F.lit(0).cast("long").alias("ord"))
    return on_file.unionByName(more)


def suppressed(resolved: DataFrame) -> DataFrame:
    return resolved.where(F.col("rating") <= SUPPRESSED).select("qid")


def not_offered(resolved: DataFrame, merges: DataFrame) -> DataFrame:
    return suppressed(resolved).union(merges.select("local")).distinct()


def interest(resolved: DataFrame, signals: DataFrame, merges: DataFrame) -> DataFrame:
    """qid, confidence, evidence. A rating beats every signal; the best signal counts. Nothing is inferred from signals that are
    neutral: such an id has no row, as one that was never heard."""
    level = F.when(F.coalesce("loved", F.lit(False)) | F.coalesce("favorited", F.lit(False)), 0.7).when(F.col("play_count") >= 25, 0.6).when(F.col("play_count") >= 5, 0.55).otherwise(NEUTRAL)
    heard = signals.join(merges, F.col("qid") == F.col("local"), "left").select(F.coalesce("canonical", "qid").alias("qid"), level.alias("level"))
    inferred = heard.groupBy("qid").agg(F.max("level").alias("confidence")).where(F.col("confidence") > NEUTRAL).join(resolved, "qid", "left_anti").select("qid", "confidence", F.lit("INFERRED").alias("evidence"))
    return resolved.select("qid", ((F.col("rating") - 1) / 4).alias("confidence"), F.lit("RATED").alias("evidence")).unionByName(inferred)


def regard_for_interest(interests: DataFrame) -> DataFrame:
    """qid, regard; an id without a row has regard 1."""
    return interests.select("qid", ((F.col("confidence") * 4 + 1) / 3).alias("regard"))


def regard_for_ratings(resolved: DataFrame) -> DataFrame:
    return resolved.select("qid", (F.col("rating") / 3).alias("regard"))
