"""Queries over folded nodes and edges: audit, time travel, corroboration, degrees, neighbourhoods, isolation."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.operators.fold import best_confidence, corroboration, is_hypothesis, valid_at
from provenir.sources.shared import compact, materialize

# Classes of institutions whose members are recognised, not colleagues (learned society, academy of sciences, labor
# union, hall of fame, professional association, scientific society, writers union).
RECOGNITION = ["Q955824", "Q414147", "Q178790", "Q1046088", "Q829080", "Q748019", "Q12057459"]
HUB_DEGREE = 10


def asserted_by(edges: DataFrame, source: str, since: Column) -> DataFrame:
    """Edges that one provenance of this source asserts at or after since."""
    return edges.where(F.exists("sources", lambda s: (s["source_id"] == source) & (s["asserted_at"] >= since)))


def edges_valid_at(edges: DataFrame, day: datetime.date) -> DataFrame:
    return edges.where(valid_at(F.lit(day)))


def corroborated(edges: DataFrame, n: int) -> DataFrame:
    """Edges with n distinct sources besides the owner; n = 0 gives all."""
    return edges.where(corroboration(F.col("sources")) >= n)


def hypotheses(edges: DataFrame) -> DataFrame:
    return edges.where(is_hypothesis(F.col("sources")))


def incident(edges: DataFrame, qid: str) -> DataFrame:
    return edges.where((F.col("from_qid") == qid) | (F.col("to_qid") == qid))


def neighbours_by_type(edges: DataFrame, qid: str) -> DataFrame:
    """type_code with the sorted other ends; both directions of a pair count."""
    other = F.when(F.col("from_qid") == qid, F.col("to_qid")).otherwise(F.col("from_qid"))
    return incident(edges, qid).groupBy("type_code").agg(F.array_sort(F.collect_list(other)).alias("neighbours"))


def half_edges(edges: DataFrame, at: DataFrame | None = None) -> DataFrame:
    """Each edge from both its ends: src, dst, type_code, backwards, confidence, guess; the last two only of edges with sources. A loop comes once.
    at(qid): the ids wanted as src, each once; edges of others are left out before anything is taken from their sources."""
    kept = lambda end: edges if at is None else edges.join(at.toDF("_at"), F.col(end) == F.col("_at"), "left_semi")
    said = [best_confidence(F.col("sources")).alias("confidence"), is_hypothesis(F.col("sources")).alias("guess")] if "sources" in edges.columns else []
    one = kept("from_qid").select(F.col("from_qid").alias("src"), F.col("to_qid").alias("dst"), "type_code", F.lit(False).alias("backwards"), *said)
    two = kept("to_qid").where("from_qid <> to_qid").select(F.col("to_qid").alias("src"), F.col("from_qid").alias("dst"), "type_code", F.lit(True).alias("backwards"), *said)
    return one.unionByName(two)


def degree_incident(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """qid, degree: incident edges, a loop once; zero for nodes without any."""
    n = half_edges(edges).groupBy(F.col("src").alias("_q")).agg(F.count("*").alias("_n"))
    return nodes.select("qid").join(n, F.col("qid") == F.col("_q"), "left").select("qid", F.coalesce("_n", F.lit(0)).alias("degree"))


def degree_endpoint(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """qid, degree: ends of edges, a loop twice."""
    ends = edges.select(F.explode(F.array("from_qid", "to_qid")).alias("_q")).groupBy("_q").agg(F.count("*").alias("_n"))
    return nodes.select("qid").join(ends, F.col("qid") == F.col("_q"), "left").select("qid", F.coalesce("_n", F.lit(0)).alias("degree"))


def hubs(nodes: DataFrame, degrees: DataFrame, recognition: list[str] = RECOGNITION, least: int = HUB_DEGREE) -> DataFrame:
    """Nodes that paths and recommendations discount: busy concepts, and institutions that recognise."""
    busy = (F.col("kind") == "CONCEPT") & (F.col("degree") >= least)
    known = F.arrays_overlap("instance_of", F.array(*map(F.lit, recognition)))
    return nodes.join(degrees, "qid").where(busy | F.coalesce(known, F.lit(False))).select("qid", "kind", "degree")


def neighbourhood(edges: DataFrame, start: str, depth: int) -> DataFrame:
    """Edges incident to nodes nearer than depth. Edges between two nodes at depth itself are left out."""
    spark = edges.sparkSession
    seen = frontier = spark.createDataFrame([(start,)], "qid string")
    for _ in range(depth - 1):
        reached = half_edges(edges, frontier).select(F.col("dst").alias("qid")).distinct()
        frontier = compact(reached.join(seen, "qid", "left_anti"))
        seen = seen.union(frontier)
    inner = compact(seen.distinct())
    near = edges.join(inner, F.col("from_qid") == F.col("qid"), "left_semi")
    return near.union(edges.join(inner, F.col("to_qid") == F.col("qid"), "left_semi").join(inner, F.col("from_qid") == F.col("qid"), "left_anti"))


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends in members(qid)."""
    return edges.join(members, F.col("from_qid") == F.col("qid"), "left_semi").join(members, F.col("to_qid") == F.col("qid"), "left_semi")


def isolated(nodes: DataFrame, edges: DataFrame, population: DataFrame) -> DataFrame:
    """Members of population(qid) with a node that reach no other member within two hops."""
    members = compact(population.join(nodes, "qid", "left_semi").select("qid").distinct())
    first = half_edges(edges, members).select("src", "dst").where("src <> dst").distinct()
    # A node next to two members joins them: the count of its members settles two hops without pairing them.
    side = first.groupBy(F.col("dst").alias("via")).agg(F.min("src").alias("low"), F.max("src").alias("high"))
    two = first.join(side, F.col("dst") == F.col("via")).where("low <> high").select("src")
    one = first.join(members, F.col("dst") == F.col("qid"), "left_semi").select("src")
    near = one.union(two).distinct()
    return members.join(near, F.col("qid") == F.col("src"), "left_anti")


def to_expand_beside(nodes: DataFrame, edges: DataFrame, lonely: DataFrame, expanded: DataFrame) -> DataFrame:
    """Neighbours of isolated members that are people or groups, not local, and never expanded."""
    beside = half_edges(edges, lonely).select(F.col("dst").alias("qid")).distinct()
    wanted = nodes.where("kind in ('PERSON', 'GROUP') and not qid rlike '^Q00[0-9]+$'").select("qid")
    return beside.join(wanted, "qid", "left_semi").join(expanded, "qid", "left_anti")


def view_edges(edges: DataFrame) -> DataFrame:
    """Edges as a graph view shows them."""
    ids = F.array_join(F.array_distinct(F.transform("sources", lambda s: s["source_id"])), "|")
    return edges.select("from_qid", "type_code", "to_qid", "valid_from", "valid_to", best_confidence(F.col("sources")).alias("confidence"), ids.alias("source_ids"), "first_seq")
