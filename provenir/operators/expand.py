"""Expansion: what sources answer about an entity, joined in the sources' order and cut at a bound."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provenir.operators.fold import Fold
from provenir.schema import is_local
from provenir.sources.log_store import append, read_log
from provenir.sources.shared import materialize

if TYPE_CHECKING:
    from provenir.sources.spi import Adapters

#: A concept's neighbours are many and say little, so it gets at most these.
CONCEPT_CEILING = 25


def effective_bound(kind: Column, requested: int) -> Column:
    return F.when(kind == "CONCEPT", F.lit(min(requested, CONCEPT_CEILING))).otherwise(F.lit(requested))


def bounded(answers: DataFrame, nodes: DataFrame, requested: int) -> DataFrame:
    """answers(seed, adapter, seq, source_id, ...) of entities with a node, source after source, cut at the bound of their kind.

    Adds bound and place. The comparison with `requested` lets Spark cut each partition before the shuffle, so an entity with very
    many answers sends few of them.
    """
    kinds = nodes.select(F.col("qid").alias("_q"), effective_bound(F.col("kind"), requested).alias("bound"))
    order = [c for c in ("adapter", "seq", "qid", "to_qid", "type_code") if c in answers.columns]
    placed = answers.withColumn("place", F.row_number().over(Window.partitionBy("seed").orderBy(*order))).where(F.col("place") <= requested)
    return placed.join(kinds, F.col("seed") == F.col("_q")).where("place <= bound").drop("_q")


def summary(answers: DataFrame, nodes: DataFrame, requested: int) -> DataFrame:
    """seed, bound, offered, kept, cut: what each entity's expansion was offered and took, and whether the bound cut it."""
    offered = answers.groupBy("seed").agg(F.count("*").alias("offered"))
    kinds = nodes.select(F.col("qid").alias("_q"), effective_bound(F.col("kind"), requested).cast("long").alias("bound"))
    return offered.join(kinds, F.col("seed") == F.col("_q")).select("seed", "bound", "offered", F.least("offered", "bound").alias("kept"), (F.col("offered") > F.col("bound")).alias("cut"))


def tally(kept: DataFrame) -> DataFrame:
    """Rows and entities that each source's answers came to in a run."""
    each = kept.groupBy("source_id", "seed").agg(F.count("*").alias("_n"))
    return each.groupBy("source_id").agg(F.sum("_n").alias("kept"), F.count("*").alias("entities"))


def staged(graph_nodes: DataFrame, claims: DataFrame, held: DataFrame, facts: DataFrame) -> DataFrame:
    """The rows that an expansion appends, and those that it doesn't, each with a fate.

    claims(seed, from_qid, type_code, to_qid, source_id, source_ref, valid_from, valid_to, confidence, place) as adapters answer;
    held(from_qid, type_code, to_qid, source_id, source_ref) what the log states already; facts(qid, kind, label, instance_of) of entities that may be
    described. The fates: held (stated already, or by an earlier row of the run), no description (an end that neither the graph has nor
    facts tell of), kept; and described, for the entities that kept claims bring in, each once.
    """
    key = ["from_qid", "type_code", "to_qid", "source_id", "source_ref"]
    once = claims.groupBy(*key).agg(F.min_by(F.struct("seed", "place", "valid_from", "valid_to", "confidence"), F.struct("place", "seed")).alias("x"), F.count("*").alias("_n")).select(*key, "x.*", "_n")
    old = held.select(*(F.col(c).alias(f"_{c}") for c in key)).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
    marked = once.join(old, same, "left").withColumn("_held", F.col("_from_qid").isNotNull())
    told = facts.select("qid").union(graph_nodes.select("qid")).distinct()
    a, b = told.select(F.col("qid").alias("_a")), told.select(F.col("qid").alias("_b"))
    marked = marked.join(a, F.col("from_qid") == F.col("_a"), "left").join(b, F.col("to_qid") == F.col("_b"), "left")
    fate = F.when(F.col("_held"), "held").when(F.col("_a").isNull() | F.col("_b").isNull(), "no description").otherwise("kept")
    edges = materialize(marked.select(*key, "seed", "place", "valid_from", "valid_to", "confidence", fate.alias("fate"), (F.col("_n") - 1).alias("repeats")))
    new = edges.where("fate = 'kept'").select(F.explode(F.array("from_qid", "to_qid")).alias("qid"), "seed", "source_id", "place").join(graph_nodes.select("qid"), "qid", "left_anti")
    first = new.groupBy("qid").agg(F.min_by(F.struct("seed", "source_id", "place"), F.struct("place", "seed", "source_id")).alias("x")).select("qid", "x.*")
    told_of = facts.groupBy("qid").agg(F.min(F.struct("label", "kind", "instance_of")).alias("f"))
    nodes = first.join(told_of, "qid").select("qid", "seed", "source_id", "place", "f.kind", "f.label", "f.instance_of", F.lit("described").alias("fate"))
    return edges.unionByName(nodes, allowMissingColumns=True)


def reasons(stage: DataFrame) -> DataFrame:
    """source_id, fate, n: what became of what each source offered; repeats are claims made again within the run."""
    each = stage.groupBy("source_id", "fate").agg(F.count("*").alias("n"))
    again = stage.where("repeats > 0").groupBy("source_id").agg(F.sum("repeats").alias("n")).select("source_id", F.lit("repeated").alias("fate"), "n")
    return each.unionByName(again)


def log_rows(stage: DataFrame, at: Column) -> DataFrame:
    """The described entities, then the kept claims, as rows of the log with an order for numbering."""
    iso = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    null = lambda kind: F.lit(None).cast(kind)
    node = F.col("fate") == "described"
    rows = stage.where("fate in ('kept', 'described')")
    return rows.select(
        F.when(node, "NODE").otherwise("EDGE").alias("kind"), F.when(node, F.col("qid")).otherwise(F.col("from_qid")).alias("qid"), "to_qid", "type_code", F.col("kind").alias("node_kind"), "instance_of", "label", "valid_from", "valid_to",
        "source_id", "source_ref", at.alias("asserted_at"), iso.alias("asserted_at_iso"), F.when(node, 1.0).otherwise(F.col("confidence")).alias("confidence"), null("string").alias("reason"),
        F.when(node, 0).otherwise(1).alias("ord_kind"), "place", "seed",
    )


#: The order of an expansion's rows in the log: entities before claims that name them.
ORDER = ["ord_kind", "seed", "place", "qid", "to_qid", "type_code", "source_id", "source_ref"]


def expand_entities(spark: SparkSession, path: str, seeds: DataFrame, adapters: Adapters, facts: DataFrame, run: str, requested: int, at: Column) -> DataFrame:
    """Asks the adapters about seeds(qid), appends what is new to the log at path as one run, and returns the counts of reasons.

    Seeds without a node and local ones, which no source has, are left out and counted as refused. Everything is settled before the one commit; a run
    that is repeated finds it and adds nothing.
    """
    folded = Fold(read_log(spark, path), keep=True)
    nodes = folded.nodes
    asked = seeds.select("qid").distinct().join(nodes.select("qid", "kind"), "qid", "left").withColumn("fate", F.when(is_local(F.col("qid")), "local entity").when(F.col("kind").isNull(), "unknown entity"))
    claims = materialize(adapters.expand(asked.where("fate is null").select("qid", "kind"), requested))
    held = folded.surviving.where("kind in ('EDGE', 'OWNER_EDGE')").select(F.col("qid").alias("from_qid"), "type_code", "to_qid", "source_id", "source_ref")
    stage = materialize(staged(nodes, claims, held, facts))
    append(spark, path, log_rows(stage, at), run, ORDER)
    refused = asked.where("fate is not null").groupBy(F.lit("").alias("source_id"), "fate").agg(F.count("*").alias("n"))
    return reasons(stage).unionByName(refused)
