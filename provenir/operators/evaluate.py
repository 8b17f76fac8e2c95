"""The hold-out grid and the rating deck."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenir.operators import population, recommend, taste
from provenir.sources.shared import compact, materialize

FOLDS = 5
FLOORS = [2, 5, 8, 12]
EVERY = 5


def folds(resolved: DataFrame, eligible: DataFrame) -> DataFrame:
    """qid, rating, fold: well-rated ids that can be offered, dealt in turn by qid as a string.

    The order over all of them is taken in ranges: each counts its rows, and a row's place is its range's start and its rank there.
    """
    rated = resolved.where(F.col("rating") >= taste.PROMOTED).join(eligible.select("qid"), "qid", "left_semi").select("qid", "rating")
    part = F.substring("qid", 1, 7)
    inner = rated.withColumn("part", part).withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("qid")) - 1)
    sizes = rated.groupBy(part.alias("p")).agg(F.count("*").alias("n"))
    starts = sizes.select("p", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("start"))
    return inner.join(starts, F.col("part") == F.col("p")).select("qid", "rating", ((F.col("start") + F.col("k")) % FOLDS).cast("int").alias("fold"))


def grid(nodes: DataFrame, edges: DataFrame, degrees: DataFrame, hub_ids: DataFrame, file: DataFrame, resolved: DataFrame, merges: DataFrame, limit: int = recommend.LIMIT, since: Column | None = None) -> DataFrame:
    """scorer, floor -> pool, held_in_pool, hits, hit_rank_sum, negatives_offered, negative_rank_sum, summed over the folds.

    With since, also what of held_in_pool and hits was rated before it (old_*) and at it or later (new_*).

    All folds come from one sweep. A held-out id is known in all folds but its own, and a candidate in its own alone; what a via sums over
    its seeds is therefore summed for each fold without that fold's ids. Held-out ids aren't on the file, so nobody else's standing or
    regard depends on the fold.
    """
    eligible = nodes.where("kind in ('PERSON', 'GROUP')").join(file, "qid", "left_anti")
    held = folds(resolved, eligible)
    age = population.rating_age(resolved, since) if since is not None else resolved.select("qid", F.lit(None).cast("boolean").alias("is_new"))
    held = compact(held.join(age, "qid").select(F.col("qid").alias("held"), "is_new", "fold"))
    known = taste.known_list(file, resolved)
    seeds = recommend.seeds_of(nodes, known, taste.regard_for_ratings(resolved)).join(held.select("held", "fold"), F.col("qid") == F.col("held"), "left").drop("held")
    one = recommend.first_hop(edges, compact(seeds))
    numbers = range(FOLDS)
    there = lambda k: F.col("fold").isNull() | (F.col("fold") != k)
    totals = one.groupBy("via").agg(*(F.sum(F.when(there(k), F.col("w1"))).alias(f"w1_{k}") for k in numbers))
    vias = materialize(recommend.vias_of(degrees, hub_ids).join(totals, "via"))
    always = known.select("qid").join(held.select("held"), F.col("qid") == F.col("held"), "left_anti")
    offered = recommend.offered_of(nodes, degrees, always, merges.select("local")).join(held, F.col("qid") == F.col("held"), "left")
    two = recommend.second_hop(edges, compact(offered)).join(vias, "via")
    here = lambda k: F.col(f"w1_{k}").isNotNull() & (F.col("fold").isNull() | (F.col("fold") == k))
    sums = [F.sum(F.when(here(k), F.col(f"w1_{k}") * F.col("w2") / f(F.col("via_degree")))).alias(f"{n}_{k}") for k in numbers for n, f in recommend.SCORERS.items()]
    negatives = resolved.where(F.col("rating") <= taste.SUPPRESSED).select(F.col("qid").alias("neg"))
    marked = two.groupBy("candidate", "degree", "held", "is_new").agg(*sums).join(negatives, F.col("candidate") == F.col("neg"), "left")
    # A via without a seed in a fold has no sum there; a candidate has none in folds where it is known, or which no seed leads to.
    by_fold = F.array(*(F.struct(F.lit(k).alias("fold"), *(F.col(f"{n}_{k}").alias(n) for n in recommend.SCORERS)) for k in numbers))
    rows = marked.select("candidate", "degree", "held", "is_new", "neg", F.inline(by_fold)).where("raw is not null")
    rows = materialize(rows)
    scores = F.array(*(F.struct(F.lit(n).alias("scorer"), (F.col(n) / F.col("degree") if n == "lift" else F.col(n)).alias("score")) for n in recommend.SCORERS))
    everyone = rows.select("fold", "candidate", "degree", "held", "is_new", "neg", F.inline(scores))
    everyone = everyone.select("*", F.explode(F.array(*map(F.lit, FLOORS))).alias("floor")).where("degree >= floor")
    by = ["fold", "scorer", "floor"]
    order = Window.partitionBy(*by).orderBy(F.round("score", 9).desc(), F.col("candidate"))
    top = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    halves = lambda what: [] if since is None else [F.count_if(~F.col("is_new")).alias(f"old_{what}"), F.count_if("is_new").alias(f"new_{what}")]
    shipped = everyone.where("neg is null")
    pool = shipped.groupBy("scorer", "floor").agg(F.count("*").alias("pool"), F.count("held").alias("held_in_pool"), *halves("in_pool"))
    hits = top(shipped).groupBy("scorer", "floor").agg(F.count("held").alias("hits"), F.coalesce(F.sum(F.when(F.col("held").isNotNull(), F.col("rank"))), F.lit(0)).alias("hit_rank_sum"), *halves("hits"))
    bad = top(everyone).groupBy("scorer", "floor").agg(F.count("neg").alias("negatives_offered"), F.coalesce(F.sum(F.when(F.col("neg").isNotNull(), F.col("rank"))), F.lit(0)).alias("negative_rank_sum"))
    return bad.join(pool, ["scorer", "floor"], "left").join(hits, ["scorer", "floor"], "left").fillna(0)


def deck(known: DataFrame, candidates: DataFrame, rated: DataFrame, degrees: DataFrame, limit: int = 200) -> DataFrame:
    """slot, qid, source: unrated known ids by degree, every EVERY-th card a candidate; what is left over follows.

    A deck shows its first `limit` cards.
    """
    order = [F.col("degree").desc(), F.col("qid").asc()]
    mine = known.select("qid").distinct().join(rated.select("qid"), "qid", "left_anti").join(degrees, "qid").orderBy(*order).limit(limit)
    theirs = candidates.select(F.col("candidate").alias("qid"), "rank").join(rated.select("qid"), "qid", "left_anti").orderBy("rank").limit(limit)
    k = mine.withColumn("k", F.row_number().over(Window.orderBy(*order))).withColumn("total", F.count("*").over(Window.partitionBy()))
    c = theirs.withColumn("k", F.row_number().over(Window.orderBy("rank"))).withColumn("total", F.count("*").over(Window.partitionBy()))
    step = EVERY - 1
    a = k.select("qid", F.lit("known").alias("source"), (F.col("k") + F.floor((F.col("k") - 1) / step)).alias("at"))
    b = c.select("qid", F.lit("candidate").alias("source"), (F.col("k") * EVERY).alias("at"))
    return a.unionByName(b).select(F.row_number().over(Window.orderBy("at", "source", "qid")).alias("slot"), "qid", "source").where(F.col("slot") <= limit)


def revision_deck(known: DataFrame, resolved: DataFrame, degrees: DataFrame, rating: int) -> DataFrame:
    """Ids on the known list or suppressed whose rating is the one asked for, by degree."""
    can = known.select("qid").union(taste.suppressed(resolved)).distinct()
    return resolved.where(F.col("rating") == rating).join(can, "qid", "left_semi").join(degrees, "qid").select("qid", "rating", "degree")
