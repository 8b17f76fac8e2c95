"""Populations drawn from the known list and the ratings: promotions, acts, names to hand out, entities to expand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.operators import graph, taste

LOCAL = "^Q00[0-9]+$"


def canonical_list(file: DataFrame, merges: DataFrame) -> DataFrame:
    """file(qid, ord) with merged locals as their canonicals, each id once at its first place."""
    placed = file.join(merges.toDF("_l", "_c"), F.col("qid") == F.col("_l"), "left")
    return placed.groupBy(F.coalesce("_c", "qid").alias("qid")).agg(F.min("ord").alias("ord"))


def canonical_seeds(expanded: DataFrame, merges: DataFrame) -> DataFrame:
    """Expanded ids as their canonicals."""
    return expanded.join(merges.toDF("_l", "_c"), F.col("qid") == F.col("_l"), "left").select(F.coalesce("_c", "qid").alias("qid")).distinct()


def promotions_off_list(file: DataFrame, resolved: DataFrame) -> DataFrame:
    """Promoted entities that the file doesn't name."""
    return taste.known_list(file, resolved).where("part = 1").select("qid")


def rated_since(resolved: DataFrame, since: Column) -> DataFrame:
    """Promotions rated at the instant or later."""
    return resolved.where((F.col("rating") >= 4) & (F.col("updated_at") >= since)).select("qid")


def rating_age(resolved: DataFrame, since: Column) -> DataFrame:
    """qid, is_new: whether the rating is of the instant or later. A rating without a time is an error."""
    known = F.when(F.col("updated_at").isNull(), F.raise_error(F.lit("a rating has no time"))).otherwise(F.col("updated_at") >= since)
    return resolved.select("qid", known.cast("boolean").alias("is_new"))


def never_expanded(population: DataFrame, nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """Members of population(qid) with a node, not local, that no fetch began from."""
    return population.select("qid").distinct().where(~F.col("qid").rlike(LOCAL)).join(nodes, "qid", "left_semi").join(seeds, "qid", "left_anti")


def second_hop(population: DataFrame, nodes: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Whom to expand beside the members that reach no other one."""
    return graph.to_expand_beside(nodes, edges, graph.isolated(nodes, edges, population.select("qid")), seeds)


def acts(surviving: DataFrame) -> DataFrame:
    """Ids whose last node claim says GROUP, or that perform something; merges aren't folded."""
    last = surviving.where("kind = 'NODE'").groupBy("qid").agg(F.max_by("node_kind", "seq").alias("k"))
    performers = surviving.where("kind = 'EDGE' and type_code = 'PERFORMED'").select("qid")
    return last.where("k = 'GROUP'").select("qid").union(performers).distinct()


def names_out(promotions: DataFrame, claimed: DataFrame) -> DataFrame:
    """name, qid, in_log by name and id: the last label claimed, else the id itself."""
    labels = claimed.groupBy(F.col("qid").alias("_q")).agg(F.max_by("label", "seq").alias("_label"))
    named = promotions.join(labels, F.col("qid") == F.col("_q"), "left")
    return named.select(F.coalesce("_label", "qid").alias("name"), "qid", F.col("_label").isNotNull().alias("in_log")).orderBy("name", "qid")
