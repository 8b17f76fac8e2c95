"""Censuses: counts and quantiles over nodes, edges, claims, taste and the known list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenir.operators.fold import corroboration
from provenir.operators.graph import half_edges
from provenir.schema import NODE_KINDS


def _rounded_percent(part: str, whole: str) -> str:
    return f"case when {whole} = 0 then 0 else (200 * {part} + {whole}) div (2 * {whole}) end"


def _side_by_side(*rows: DataFrame) -> DataFrame:
    """Tables of one row as one row."""
    out = rows[0].withColumn("_j", F.lit(1))
    for one in rows[1:]:
        out = out.join(one.withColumn("_j", F.lit(1)), "_j")
    return out.drop("_j")


def nodes_by_kind(nodes: DataFrame) -> DataFrame:
    """Every kind, with zero where there is none."""
    kinds = nodes.sparkSession.createDataFrame([(k,) for k in NODE_KINDS], "kind string")
    counts = nodes.groupBy(F.col("kind").alias("_k")).agg(F.count("*").alias("_n"))
    return kinds.join(counts, F.col("kind") == F.col("_k"), "left").select("kind", F.coalesce("_n", F.lit(0)).alias("n"))


def edges_by_type(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type_code").agg(F.count("*").alias("n"))


def edges_by_source(edges: DataFrame) -> DataFrame:
    """Edges that each source asserts, once an edge."""
    each = edges.select(F.explode(F.array_distinct(F.transform("sources", lambda s: s["source_id"]))).alias("source_id"))
    return each.groupBy("source_id").agg(F.count("*").alias("n"))


def edges_by_corroboration(edges: DataFrame) -> DataFrame:
    return edges.groupBy(corroboration(F.col("sources")).cast("long").alias("corroboration")).agg(F.count("*").alias("n"))


def degree_quantiles(nodes: DataFrame, degrees: DataFrame, floor: int = 5) -> DataFrame:
    """Nearest-rank quantiles of degree overall (kind null) and by kind; those at the floor or under, with a rounded percentage."""
    both = nodes.select("qid", "kind").join(degrees, "qid")
    out = both.rollup("kind").agg(
        *(F.expr(f"cast(percentile_disc({p}) within group (order by degree) as bigint)").alias(n) for n, p in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))),
        F.max("degree").alias("top"),
        F.count("*").alias("n"),
        F.count_if(F.col("degree") <= floor).alias("low"),
    )
    return out.withColumn("low_percent", F.expr(_rounded_percent("low", "n")))


def bridge(nodes: DataFrame, edges: DataFrame, source: str = "musicbrainz") -> DataFrame:
    """One row: nodes on an edge of the source, and those of them with classes."""
    ends = edges.where(F.exists("sources", lambda s: s["source_id"] == source)).select(F.explode(F.array("from_qid", "to_qid")).alias("q")).distinct()
    return nodes.join(ends, F.col("qid") == F.col("q"), "left_semi").agg(F.count("*").alias("touched"), F.count_if(F.size("instance_of") > 0).alias("classed"))


def concept_classes(nodes: DataFrame, top: int = 10) -> DataFrame:
    """The classes that most concepts have."""
    each = nodes.where("kind = 'CONCEPT'").select(F.explode(F.array_distinct("instance_of")).alias("class"))
    return each.groupBy("class").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("class")).limit(top)


def concept_totals(nodes: DataFrame) -> DataFrame:
    """One row: concepts, those without a class, and the classes that concepts have."""
    concepts = nodes.where("kind = 'CONCEPT'")
    counts = concepts.agg(F.count("*").alias("concepts"), F.count_if(F.size("instance_of") == 0).alias("no_class"))
    classes = concepts.select(F.explode("instance_of").alias("_c")).agg(F.count_distinct("_c").alias("classes"))
    return _side_by_side(counts, classes)


def edge_totals(edges: DataFrame, edge_claims: DataFrame, dangling: DataFrame) -> DataFrame:
    """One row: edges, merged edges that lack an end's node, and merged edges withdrawn with an emptied end."""
    withdrawn = edge_claims.where("fate = 'withdrawn'").groupBy("f", "type_code", "t").agg(F.lit(1)).agg(F.count("*").alias("withdrawn"))
    return _side_by_side(edges.agg(F.count("*").alias("total")), dangling.agg(F.count("*").alias("dangling")), withdrawn)


def taste(ratings: DataFrame, stand_ins: DataFrame, retracted: DataFrame) -> DataFrame:
    """Ratings 1 to 5 with zeros: how many, and how many on a local id, a stand-in, a retracted id."""
    scale = ratings.sparkSession.range(1, 6).selectExpr("cast(id as int) rating")
    a, b = stand_ins.selectExpr("qid _a").distinct(), retracted.selectExpr("qid _b").distinct()
    placed = ratings.join(a, F.col("qid") == F.col("_a"), "left").join(b, F.col("qid") == F.col("_b"), "left")
    counts = placed.groupBy(F.col("rating").alias("_r")).agg(
        F.count("*").alias("n"), F.count_if(F.col("qid").rlike("^Q00[0-9]+$")).alias("on_local"), F.count("_a").alias("on_stand_in"), F.count("_b").alias("on_retracted")
    )
    return scale.join(counts, F.col("rating") == F.col("_r"), "left").drop("_r").fillna(0)


def claims(log: DataFrame, fold) -> DataFrame:
    """One row of counts about the log's claims, retractions and merges."""
    gone = F.col("kind") == "RETRACT"
    rows = log.agg(F.count("*").alias("claims"), F.count_if(gone).alias("retractions"), F.count_distinct(F.when(gone, F.col("qid"))).alias("entities_retracted"))
    kept = fold.surviving.agg(F.count("*").alias("surviving"), F.count_if(F.col("kind") == "LOCAL").alias("minted"))
    named = fold.folded_edges(fold.emptied, fold._about_superseded).where("fate = 'kept'").select(F.explode(F.array("qid", "to_qid")).alias("_r")).distinct()
    referenced = fold.same_as.where("not last").join(named, F.col("canonical") == F.col("_r"), "left_semi").agg(F.count("*").alias("superseded_referenced"))
    ends = half_edges(fold.edges, fold.stand_ins.select("qid")).select(F.col("src").alias("_e")).distinct()
    edgeless = fold.stand_ins.join(ends, F.col("qid") == F.col("_e"), "left_anti").agg(F.count("*").alias("stand_ins_edgeless"))
    merges = fold.same_as.agg(F.count_if("last").alias("merges_standing"), F.count_if(~F.col("last")).alias("merges_superseded"))
    stand = fold.stand_ins.agg(F.count("*").alias("stand_ins"))
    fate = fold.edge_claims.agg(F.count_if(F.col("fate") == "withdrawn").alias("withdrawn"), F.count_if(F.col("fate") == "loop").alias("loops"))
    out = _side_by_side(rows, kept, merges, referenced, stand, edgeless, fate)
    return out.withColumn("rows_retracted", F.col("claims") - F.col("surviving") - F.col("retractions")).drop("surviving")


def known(nodes: DataFrame, known_ids: DataFrame, expanded: DataFrame, lonely: DataFrame) -> DataFrame:
    """One row about a known list: named, in the graph, local, never expanded, isolated."""
    a, b, c = nodes.selectExpr("qid _a"), expanded.selectExpr("qid _b").distinct(), lonely.selectExpr("qid _c").distinct()
    placed = known_ids.select("qid").distinct().join(a, F.col("qid") == F.col("_a"), "left").join(b, F.col("qid") == F.col("_b"), "left").join(c, F.col("qid") == F.col("_c"), "left")
    local, here = F.col("qid").rlike("^Q00[0-9]+$"), F.col("_a").isNotNull()
    return placed.agg(
        F.count("*").alias("named"), F.count("_a").alias("in_graph"), F.count_if(here & local).alias("local"), F.count_if(here & ~local & F.col("_b").isNull()).alias("never_expanded"), F.count("_c").alias("isolated")
    )


def known_by_kind(nodes: DataFrame, members: DataFrame, seeds: DataFrame) -> DataFrame:
    """kind, in_graph, never_expanded of members(qid), every kind with zeros."""
    kinds = nodes.sparkSession.createDataFrame([(k,) for k in NODE_KINDS], "kind string")
    placed = members.select("qid").distinct().join(nodes.selectExpr("qid", "kind _k"), "qid").join(seeds.selectExpr("qid _s").distinct(), F.col("qid") == F.col("_s"), "left")
    fresh = ~F.col("qid").rlike("^Q00[0-9]+$") & F.col("_s").isNull()
    counts = placed.groupBy("_k").agg(F.count("*").alias("in_graph"), F.count_if(fresh).alias("never_expanded"))
    return kinds.join(counts, F.col("kind") == F.col("_k"), "left").drop("_k").fillna(0)


def known_isolation(nodes: DataFrame, edges: DataFrame, lonely: DataFrame, seeds: DataFrame) -> DataFrame:
    """One row: isolated members with somebody beside them to expand, those with nobody, and whom there is to expand in all."""
    wanted = nodes.where("kind in ('PERSON', 'GROUP') and not qid rlike '^Q00[0-9]+$'").select("qid").join(seeds, "qid", "left_anti")
    beside = half_edges(edges, lonely).join(wanted, F.col("dst") == F.col("qid"), "left_semi").select("src", "dst").distinct()
    counts = beside.agg(F.count_distinct("src").alias("with_someone"), F.count_distinct("dst").alias("to_expand"))
    return _side_by_side(counts, lonely.agg(F.count("*").alias("_n"))).select("with_someone", (F.col("_n") - F.col("with_someone")).alias("with_no_one"), "to_expand")


def expanded_seeds(log: DataFrame) -> DataFrame:
    """qid of entities whose statements were fetched, read from source references: a reverse reference ends in
    the seed, a statement reference begins with it."""
    ref = F.col("source_ref")
    seed = F.when(ref.rlike("^wdqs:.*:Q[0-9]+$"), F.substring_index(ref, ":", -1)).when(ref.rlike(r"^[Qq][0-9]+\$"), F.upper(F.substring_index(ref, "$", 1)))
    return log.where("kind = 'EDGE'").select(seed.alias("qid")).where("qid is not null").distinct()
