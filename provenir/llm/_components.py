"""Connected components by DataFrame operations: a distributed union-find of alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenir.llm._io import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "stars") -> DataFrame:
    """edges(a long, b long) -> id, component: the least id of its component, for every id of an edge but the least.

    Large and small star steps (each node links its neighbours to the least of them) alternate until the edges are stars: every
    id hangs below one node, and that node below none. Minima are aggregated before they are shuffled; the join of a node's
    edges to its minimum is one that adaptive execution splits for a node with very many of them. Each round is written to the
    shared folder as name, and the round before it is deleted.
    """
    now = scratch.write(edges.where("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct(), name)
    while _unfinished(now):
        both = now.unionByName(now.selectExpr("b a", "a b"))
        least = both.groupBy(F.col("a").alias("of")).agg(F.min("b").alias("low")).selectExpr("of", "least(of, low) low")
        large = both.where("b > a").join(least, F.col("a") == F.col("of")).selectExpr("b a", "low b").distinct()
        least = large.groupBy(F.col("a").alias("of")).agg(F.min("b").alias("low"))
        small = large.join(least, F.col("a") == F.col("of")).selectExpr("b x", "low").where("x <> low").selectExpr("x a", "low b")
        after = scratch.write(small.unionByName(least.selectExpr("of a", "low b")).distinct(), name)
        scratch.drop_but_last(name)
        now = after
    return now.selectExpr("a id", "b component")


def _unfinished(edges: DataFrame) -> bool:
    """Whether some id has two parents, or a parent that has one itself."""
    ends = edges.selectExpr("a id", "1 up").unionByName(edges.selectExpr("b id", "0 up"))
    ups = ends.groupBy("id").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    return not ups.where("up > 1 or up = 1 and least = 0").isEmpty()


def merged(joined: DataFrame, links: DataFrame, scratch: Scratch, name: str = "stars") -> DataFrame:
    """The components joined(id, component) after more links(a, b): only the links between components go through the union-find."""
    of = lambda side: joined.toDF(f"id_{side}", f"comp_{side}")
    placed = links.join(of("a"), F.col("a") == F.col("id_a"), "left").join(of("b"), F.col("b") == F.col("id_b"), "left")
    between = placed.selectExpr("coalesce(comp_a, a) a", "coalesce(comp_b, b) b").where("a <> b")
    roots = components(between, scratch, name).toDF("root", "top")
    moved = joined.join(roots, F.col("component") == F.col("root"), "left").selectExpr("id", "coalesce(top, component) component")
    return moved.unionByName(roots.selectExpr("root id", "top component"))
