"""Write-path rules: gates before an append, minting, the effect of a retraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenir.functions.names import name_fold
from provenir.operators.fold import Fold, endpoints_missing, survivors
from provenir.sources.log_store import numbered
from provenir.sources.shared import compact, materialize


def refused_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """All rows of a batch(from_qid, type_code, to_qid) with an end that has no node; a batch is appended if there is none."""
    return endpoints_missing(edges, nodes)


def refused_claims(log: DataFrame, claims: DataFrame) -> DataFrame:
    """Owner rows (of the log's schema, with their seq) that can't stand on this log: merges of a local without a surviving
    claim, and edges with an end that nothing holds once the claims are in."""
    after = Fold(log.unionByName(claims))
    held = after.nodes.select(F.col("qid").alias("_q"))
    locals_ = after.claimed.select(F.col("qid").alias("_q")).distinct()
    merges = claims.where("kind = 'SAME_AS'").join(locals_, F.col("qid") == F.col("_q"), "left_anti").withColumn("why", F.lit("no such local"))
    edges = claims.where("kind = 'OWNER_EDGE'")
    ends = after.edge_claims.where("fate = 'kept'").join(edges.select(F.col("seq").alias("_s")), F.col("seq") == F.col("_s"), "left_semi")
    a = ends.join(held, F.col("f") == F.col("_q"), "left_anti")
    b = ends.join(held, F.col("t") == F.col("_q"), "left_anti")
    lost = a.unionByName(b).select(F.col("seq").alias("_s")).distinct()
    return merges.unionByName(edges.join(lost, F.col("seq") == F.col("_s"), "left_semi").withColumn("why", F.lit("an end has no node")))


def next_local(log: DataFrame) -> DataFrame:
    """One row: the number after the highest local id that the log ever named."""
    named = log.select(F.explode(F.array("qid", "to_qid")).alias("id")).where("id rlike '^Q00[0-9]+$'")
    return named.agg((F.coalesce(F.max(F.substring("id", 4, 30).cast("long")), F.lit(0)) + 1).alias("number"))


def mint(log: DataFrame, names: DataFrame) -> DataFrame:
    """names(name, kind, ord) -> local_qid, name, kind: one id for each folded name, by its first place in the batch, from the log's next
    free number on. Names without a letter or digit get none."""
    folded = names.withColumn("_f", name_fold(F.col("name"))).where("_f <> ''")
    first = folded.groupBy("_f").agg(F.min_by(F.struct("name", "kind", "ord"), "ord").alias("x")).select("x.*")
    placed = numbered(first, ["ord", "name"], next_local(log).head()["number"], "_n")
    return placed.select(F.concat(F.lit("Q00"), F.col("_n").cast("string")).alias("local_qid"), "name", "kind")


def retraction_effect(log: DataFrame, retractions: DataFrame, before: Fold | None = None) -> DataFrame:
    """One row: what stops being projected if these retractions are appended to the log, which `before` is the fold of, if there is one.

    Nothing is folded as a whole, neither before nor after. A node can be lost only if its id is retracted or stands by a merge alone. An edge can
    be lost only if a claim of it names a retracted id or a local whose merge changed, or folds to an id that was emptied or lost its node; of these
    edges it is asked which the claims that are left still make. The claims are sought by the ids they name, so that the log is filtered
    where it is made and only what is found is shuffled.
    """
    before, retractions = before or Fold(log, keep=True), materialize(retractions)
    after = Fold(log.unionByName(retractions), keep=True, about=before._about_superseded)  # merges that it supersedes were superseded before
    ids = lambda *tables: compact(reduce(DataFrame.unionByName, [t.toDF("qid") for t in tables]).distinct())
    lacks = lambda a, b: a.join(b.toDF("_b"), F.col(a.columns[0]) == F.col("_b"), "left_anti")
    cut = ids(retractions.select("qid"))
    also = log.where("kind in ('NODE', 'LOCAL')").join(cut.toDF("_id"), F.col("to_qid") == F.col("_id"), "left_semi").select("qid")
    asked = ids(cut, also, before.stand_ins.select("qid"), after.stand_ins.select("qid"))
    bare = compact(lacks(_held(before, asked), _held(after, asked)))
    nodes = bare.agg(F.count("*").alias("nodes_lost"))
    gone = compact(lacks(after.emptied, before.emptied))
    moved = before.merges.exceptAll(after.merges).unionByName(after.merges.exceptAll(before.merges)).select("local")
    folded = ids(bare, gone)
    locals_ = before.merges.join(folded, F.col("canonical") == F.col("qid"), "left_semi").select("local")
    claims = materialize(_naming(before, ids(cut, moved, folded, locals_)))
    was = before.folded_edges(before.emptied, survivors(claims, before.cuts)).where("fate = 'kept' and f is not null and t is not null").selectExpr("f from_qid", "type_code", "t to_qid")
    touched = materialize(was.distinct())
    ends = ids(touched.select("from_qid"), touched.select("to_qid"))
    missing = compact(lacks(ends, _held(before, ends)))
    at = lambda rows, ids, end, how: rows.join(ids.toDF("_id"), F.col(end) == F.col("_id"), how)
    keys = compact(at(at(touched, missing, "from_qid", "left_anti"), missing, "to_qid", "left_anti"))
    # What still makes them: claims of their own ends, and of locals that are merged into these.
    raw = keys.toDF("_q", "_c", "_t")
    for end in ("_q", "_t"):
        raw = raw.union(raw.join(after.merges, F.col(end) == F.col("canonical")).withColumn(end, F.col("local")).select("_q", "_c", "_t"))
    raw = compact(raw)
    same = (F.col("qid") == F.col("_q")) & F.col("type_code").eqNullSafe(F.col("_c")) & (F.col("to_qid") == F.col("_t"))
    left = after.folded_edges(after.emptied, survivors(before.said.join(raw, same, "left_semi"), after.cuts)).where("fate = 'kept'").selectExpr("f", "type_code _c", "t").distinct()
    left = compact(at(at(left, bare, "f", "left_anti"), bare, "t", "left_anti"))
    edges = keys.join(left, (F.col("from_qid") == F.col("f")) & F.col("type_code").eqNullSafe(F.col("_c")) & (F.col("to_qid") == F.col("t")), "left_anti").agg(F.count("*").alias("edges_lost"))
    emptied = gone.agg(F.count("*").alias("newly_emptied"))
    # Edges that lose an end because nothing holds the canonical any more, an edge between two of them once.
    near = [at(keys, gone, end, "left_semi") for end in ("from_qid", "to_qid")]
    stranded = near[0].unionByName(near[1]).distinct().agg(F.count("*").alias("edges_stranded"))
    j = lambda d: d.withColumn("j", F.lit(1))
    return j(nodes).join(j(edges), "j").join(j(emptied), "j").join(j(stranded), "j").drop("j")


def _naming(fold: Fold, ids: DataFrame) -> DataFrame:
    """Edge claims with an end among ids(qid), each once."""
    ids = ids.toDF("_id")
    a = fold.said.join(ids, F.col("qid") == F.col("_id"), "left_semi")
    return a.unionByName(fold.said.join(ids, F.col("to_qid") == F.col("_id"), "left_semi").join(ids, F.col("qid") == F.col("_id"), "left_anti"))


def _held(fold: Fold, ids: DataFrame) -> DataFrame:
    """Those of ids(qid) that have a node."""
    if "nodes" in fold.__dict__:
        return ids.join(fold.nodes.select("qid"), "qid", "left_semi")
    claims = fold.log.where("kind in ('NODE', 'LOCAL')").join(ids.toDF("_id"), F.col("qid") == F.col("_id"), "left_semi")
    own = survivors(claims, fold.cuts).select("qid")
    return materialize(own.unionByName(fold.stand_ins.select("qid").join(ids, "qid", "left_semi")).distinct())
