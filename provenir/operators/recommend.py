"""The recommender: a two-hop weighted sweep from the known list, four scorers, ranking, explanation, floor reading."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenir.operators.graph import RECOGNITION
from provenir.schema import SELF_STATED, directional, weight
from provenir.sources.shared import compact, materialize, sent

FLOOR = 5
LIMIT = 25
ROUTES = 3

SCORERS: dict[str, Callable[[Column], Column]] = {
    "raw": lambda degree: F.lit(1.0),
    "adamic_adar": lambda degree: F.ln(degree),
    "resource_allocation": lambda degree: degree.cast("double"),
    "lift": lambda degree: F.ln(degree),
}


def first_hop(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """seeds(qid, regard, and any columns more) -> seed, via, w1 and those columns: each pair once, with the best weight of its parallel edges."""
    more = [c for c in seeds.columns if c not in ("qid", "regard")]
    half = _half(edges).join(seeds, F.col("src") == F.col("qid")).repartition("dst")
    return half.groupBy(F.col("src").alias("seed"), F.col("dst").alias("via"), *more).agg((F.max("w") * F.max("regard")).alias("w1"))


def second_hop(edges: DataFrame, offered: DataFrame) -> DataFrame:
    """offered(qid, and any columns more) -> via, candidate, w2 and those columns: each pair once."""
    more = [c for c in offered.columns if c != "qid"]
    # Dealt by the via alone, so that neither the reduction nor a join to the vias after it shuffles the rows again.
    half = _half(edges).join(offered, F.col("dst") == F.col("qid")).repartition("src")
    return half.groupBy(F.col("src").alias("via"), F.col("dst").alias("candidate"), *more).agg(F.max(F.col("w") * F.col("as_from")).alias("w2"))


def _half(edges: DataFrame) -> DataFrame:
    ends = edges.select("from_qid", "to_qid", "type_code")
    out = ends.select(F.col("from_qid").alias("src"), F.col("to_qid").alias("dst"), weight(F.col("type_code")).alias("w"), F.lit(1.0).alias("as_from"))
    into = ends.select(
        F.col("to_qid").alias("src"), F.col("from_qid").alias("dst"), weight(F.col("type_code")).alias("w"), F.when(directional(F.col("type_code")), SELF_STATED).otherwise(1.0).alias("as_from")
    )
    return out.unionByName(into).where("src <> dst")


def seeds_of(nodes: DataFrame, known: DataFrame, regard: DataFrame) -> DataFrame:
    """qid, regard of known ids with a node; an id without a regard has 1."""
    return known.select("qid").distinct().join(nodes.select("qid"), "qid", "left_semi").join(regard, "qid", "left").select("qid", F.coalesce("regard", F.lit(1.0)).alias("regard"))


def vias_of(degrees: DataFrame, hub_ids: DataFrame) -> DataFrame:
    """via, via_degree of the nodes that evidence may pass."""
    return degrees.join(hub_ids.select("qid"), "qid", "left_anti").select(F.col("qid").alias("via"), F.col("degree").alias("via_degree"))


def offered_of(nodes: DataFrame, degrees: DataFrame, known: DataFrame, withheld: DataFrame) -> DataFrame:
    """qid, degree of people and groups that may be offered."""
    explored = nodes.where(F.col("kind").isin("PERSON", "GROUP") & ~F.coalesce(F.arrays_overlap("instance_of", F.array(*map(F.lit, RECOGNITION))), F.lit(False)))
    return explored.select("qid").join(known.select("qid"), "qid", "left_anti").join(withheld.toDF("qid"), "qid", "left_anti").join(degrees, "qid")


@dataclass
class Sweep:
    """All ways from a known seed over a via to a candidate, without a row for each: a via with many seeds and many candidates stands for the
    product of their numbers. What is summed over all seeds of a via is the same for each of its candidates, so it is taken once.

    seeds: qid, regard. one: seed, via, w1; no table, as only its sums are kept. vias: via, via_degree, n_seeds, w1 (sum over its seeds). candidates: candidate, degree, ways, weight (the sum of
    w1 * w2), intermediates, and a column for each scorer (before its division by the candidate's own degree). Those below a floor are in it.
    """

    edges: DataFrame
    seeds: DataFrame
    vias: DataFrame
    candidates: DataFrame

    @property
    def one(self) -> DataFrame:
        return first_hop(self.edges, self.seeds)

    def scored(self, scorer: str, floor: int = FLOOR) -> DataFrame:
        """candidate, degree, score, intermediates."""
        score = F.col(scorer) / F.col("degree") if scorer == "lift" else F.col(scorer)
        return self.candidates.where(F.col("degree") >= floor).select("candidate", "degree", score.alias("score"), "intermediates")

    def evidence(self, head: DataFrame) -> DataFrame:
        """candidate, seed, via, via_degree, w1, w2: one row for each way to the candidates of a head(candidate), which are few."""
        near = compact(second_hop(self.edges, compact(head.select(F.col("candidate").alias("qid")))))
        two = compact(self.vias.select("via", "via_degree").join(near, "via"))
        # Edges are sought by these vias before they are reduced, so that the other ways of the seeds are neither made nor shuffled.
        ids = sent(two.select("via").distinct())
        ends = [self.edges.join(ids, F.col(end) == F.col("via"), "left_semi") for end in ("from_qid", "to_qid")]
        one = first_hop(ends[0].unionByName(ends[1].join(ids, F.col("from_qid") == F.col("via"), "left_anti")), self.seeds)
        return two.join(one, "via").select("candidate", "seed", "via", "via_degree", "w1", "w2")

    def ranked(self, scorer: str, floor: int = FLOOR, limit: int = LIMIT) -> DataFrame:
        """The head: rank, candidate, degree, score, intermediates, known_reached. Only of its candidates are the seeds counted one by one."""
        head = compact(rank(self.scored(scorer, floor), limit))
        reached = self.evidence(head).groupBy("candidate").agg(F.count_distinct("seed").alias("known_reached"))
        return head.join(reached, "candidate")


def sweep(nodes: DataFrame, edges: DataFrame, degrees: DataFrame, hub_ids: DataFrame, known: DataFrame, withheld: DataFrame, regard: DataFrame) -> Sweep:
    """Edges of the first hop are those of known seeds, and of the second those between a via that the first hop reached and an id that may be
    offered; parallel ones are reduced to their best weight. All joins are equi-joins on ids, and none makes more rows than there are edges."""
    seeds = compact(seeds_of(nodes, known, regard))
    totals = first_hop(edges, seeds).groupBy("via").agg(F.count("*").alias("n_seeds"), F.sum("w1").alias("w1"))
    vias = materialize(vias_of(degrees, hub_ids).join(totals, "via"))
    two = second_hop(edges, compact(offered_of(nodes, degrees, known, withheld)))
    share = F.col("w1") * F.col("w2")
    scores = [F.sum(share / f(F.col("via_degree"))).alias(n) for n, f in SCORERS.items()]
    candidates = two.join(vias, "via").groupBy("candidate", "degree").agg(F.sum("n_seeds").alias("ways"), F.sum(share).alias("weight"), F.count("*").alias("intermediates"), *scores)
    return Sweep(edges, seeds, vias, materialize(candidates))


def rank(scored: DataFrame, limit: int = LIMIT) -> DataFrame:
    order = [F.round("score", 9).desc(), F.col("candidate").asc()]
    return scored.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def explain(evidence: DataFrame, head: DataFrame, reachers: int = ROUTES) -> DataFrame:
    """For each candidate of the ranked head: its strongest seeds by summed weight, and the best via of each."""
    own = evidence.join(F.broadcast(head.select("candidate")), "candidate", "left_semi").withColumn("w", F.col("w1") * F.col("w2"))
    best = F.max_by("via", F.struct(F.col("w") / F.col("via_degree"), F.col("via")))
    by_seed = own.groupBy("candidate", "seed").agg(F.sum("w").alias("reach"), best.alias("best_via"))
    w = Window.partitionBy("candidate").orderBy(F.round("reach", 9).desc(), F.col("seed").asc())
    return by_seed.withColumn("k", F.row_number().over(w)).where(F.col("k") <= reachers)


def floor_reading(swept: Sweep, scorer: str, floor: int = FLOOR, limit: int = LIMIT) -> DataFrame:
    """One row: the pool and its upper-median degree, the head's, how many of it stand on the floor, who is held out."""
    head = rank(swept.scored(scorer, floor), limit)
    middle = lambda c: F.get(F.sort_array(F.collect_list(c)), (F.count(c) / 2).cast("int"))
    people = swept.candidates.select("candidate", "degree")
    # The upper median by counts of degrees: the distinct degrees are few, the candidates may be many.
    steps = people.where(F.col("degree") >= floor).groupBy("degree").agg(F.count("*").alias("n"))
    run = steps.withColumn("upto", F.sum("n").over(Window.orderBy("degree"))).withColumn("total", F.sum("n").over(Window.partitionBy()))
    pool = run.where("upto > total div 2").agg(F.min("degree").alias("pool_median"), F.max("total").alias("pool"))
    held = people.where(F.col("degree") < floor).agg(F.count("*").alias("held_out"), F.count_if(F.col("degree") == 1).alias("held_out_at_one"))
    top = head.agg(middle("degree").alias("head_median"), F.count_if(F.col("degree") == floor).alias("on_floor"), F.count_if(F.col("intermediates") == F.col("degree")).alias("every_edge_counted"))
    return pool.withColumn("j", F.lit(1)).join(held.withColumn("j", F.lit(1)), "j").join(top.withColumn("j", F.lit(1)), "j").drop("j")
