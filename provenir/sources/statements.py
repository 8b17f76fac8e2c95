"""Statements of an encyclopedia's JSON and of a music catalogue's, as assertions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenir.functions.names import day_of
from provenir.schema import EDGE_TYPES

ENTITY = "labels map<string, struct<value: string>>, claims map<string, array<struct<id: string, rank: string, mainsnak: struct<snaktype: string, datavalue: struct<value: struct<id: string>>>, references: array<struct<snaks: map<string, array<struct<property: string>>>>>, qualifiers: map<string, array<struct<datavalue: struct<value: struct<time: string, precision: int>>>>>>>>"
# Properties of a reference that only says where a statement was copied from.
NOT_A_REFERENCE = ["P143", "P4656"]
# A catalogue's relation types as edge types.
RELATIONS = {"member of band": "MEMBER_OF"}


def _vocabulary(df: DataFrame) -> DataFrame:
    rows = [(t[1], t[0], t[2] == "inverted", t[2] == "fallbackOnly") for t in EDGE_TYPES if t[1]]
    return F.broadcast(df.sparkSession.createDataFrame(rows, "property string, type_code string, inverted boolean, fallback boolean"))


def _sourced(references: Column) -> Column:
    return F.exists(F.coalesce(references, F.array()), lambda r: F.exists(F.map_keys(r["snaks"]), lambda p: ~p.isin(NOT_A_REFERENCE)))


def statements_to_edges(entities: DataFrame, fallback: bool = False) -> DataFrame:
    """entities(qid, json) -> from_qid, type_code, to_qid, valid_from, valid_to, confidence, source_ref; see stated_edges."""
    return stated_edges(entities, fallback).drop("seed")


def stated_edges(entities: DataFrame, fallback: bool = False) -> DataFrame:
    """entities(qid, json) -> seed (the entity whose statement it is), from_qid, type_code, to_qid, valid_from, valid_to, confidence, source_ref.

    Statements without a value, deprecated, or of an unknown property are dropped; dates of an interval that ends before it begins go.
    """
    parsed = entities.select("qid", F.from_json("json", ENTITY).alias("e"))
    each = parsed.select("qid", F.explode("e.claims").alias("property", "list")).select("qid", "property", F.explode("list").alias("s"))
    each = each.where("s.mainsnak.snaktype = 'value' and coalesce(s.rank, '') <> 'deprecated'").withColumn("object", F.col("s.mainsnak.datavalue.value.id"))
    each = each.where(F.col("object").rlike(r"^Q[0-9]+\z")).join(_vocabulary(entities), "property")
    if not fallback:
        each = each.where("not fallback")
    time = lambda p: F.get(F.try_element_at("s.qualifiers", F.lit(p)), F.lit(0))["datavalue"]["value"]
    begin, end = (day_of(time(p)["time"], time(p)["precision"]) for p in ("P580", "P582"))
    ends = each.withColumns({"b": begin, "x": end}).withColumn("ok", F.coalesce(F.col("x") >= F.col("b"), F.lit(True)))
    return ends.select(
        F.col("qid").alias("seed"),
        F.when(F.col("inverted"), F.col("object")).otherwise(F.col("qid")).alias("from_qid"),
        "type_code",
        F.when(F.col("inverted"), F.col("qid")).otherwise(F.col("object")).alias("to_qid"),
        F.when(F.col("ok"), F.col("b")).alias("valid_from"),
        F.when(F.col("ok"), F.col("x")).alias("valid_to"),
        F.when(_sourced(F.col("s.references")), 1.0).otherwise(0.8).alias("confidence"),
        F.coalesce("s.id", F.concat_ws("$", "qid", "property", "object")).alias("source_ref"),
    )


def reverse_rows_to_edges(rows: DataFrame) -> DataFrame:
    """rows(seed, property, other) of a reverse lookup -> edges towards the seed; an entity's statements about itself are skipped."""
    known = rows.where("seed <> other").join(_vocabulary(rows), "property")
    ref = F.concat(F.lit("wdqs:"), "other", F.lit(":"), "property", F.lit(":"), "seed")
    a, b = F.when(F.col("inverted"), F.col("seed")).otherwise(F.col("other")), F.when(F.col("inverted"), F.col("other")).otherwise(F.col("seed"))
    return known.select(a.alias("from_qid"), "type_code", b.alias("to_qid"), F.lit(0.8).alias("confidence"), ref.alias("source_ref")).distinct()


def top_reverse_rows(rows: DataFrame, most: int) -> DataFrame:
    """rows(seed, property, other, sitelinks) of a reverse lookup, with what others are kept apart -> seed, property, other, sitelinks, cut.

    Of each seed's distinct statements the best known others come first. One more than the bound is taken, so that being cut is
    seen and not guessed: cut says that the extra one was there too. Statements of an entity about itself and of properties without an edge
    type, or of one used only where no lookup answers, take part in the first choice and then go, as they do in what a service answers.
    Every task takes its own best before they meet, so a seed with very many others sends few; labels and classes are joined to what is
    left, and not to all.
    """
    if most <= 0:
        raise ValueError(f"the bound must be positive, got {most}")
    usable = [t[1] for t in EDGE_TYPES if t[1] and t[2] != "fallbackOnly"]
    per = Window.partitionBy("seed").orderBy(F.desc("sitelinks"), "other", "property")
    each = rows.groupBy("seed", "property", "other").agg(F.max("sitelinks").alias("sitelinks"))
    first = each.withColumn("_k", F.row_number().over(per)).where(F.col("_k") <= most + 1).drop("_k")
    good = first.where((F.col("seed") != F.col("other")) & F.col("property").isin(usable) & F.col("other").rlike(r"^Q[0-9]+\z"))
    placed = good.withColumns({"_k": F.row_number().over(per), "cut": F.count("*").over(Window.partitionBy("seed")) > most})
    return placed.where(F.col("_k") <= most).drop("_k")


def relations_to_edges(relations: DataFrame, bridge: DataFrame) -> DataFrame:
    """relations(seed_qid, seed_mbid, type, direction, begin, end, mbid), bridge(mbid, qid) -> edges.

    Of several entities with one catalogue id the least counts; forward goes from the seed.
    """
    one = bridge.groupBy(F.col("mbid").alias("_m")).agg(F.min("qid").alias("other"))
    code = F.lit(None).cast("string")
    for name, edge_type in RELATIONS.items():
        code = F.when(F.col("type") == name, F.lit(edge_type)).otherwise(code)
    valid = F.col("mbid").rlike(r"^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}\z") & F.col("direction").isin("forward", "backward")
    known = relations.withColumn("type_code", code).where(valid & F.col("type_code").isNotNull()).join(one, F.col("mbid") == F.col("_m"))
    ahead = F.col("direction") == "forward"
    date = lambda c: F.when(F.col(c).rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.try_to_date(F.col(c)))
    ref = F.concat(F.lit("artist/"), "seed_mbid", F.lit("#"), "type", F.lit(":"), "mbid")
    return known.select(
        F.when(ahead, F.col("seed_qid")).otherwise(F.col("other")).alias("from_qid"), "type_code", F.when(ahead, F.col("other")).otherwise(F.col("seed_qid")).alias("to_qid"),
        date("begin").alias("valid_from"), date("end").alias("valid_to"), F.lit(0.8).alias("confidence"), ref.alias("source_ref"),
    )
