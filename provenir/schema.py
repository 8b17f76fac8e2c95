"""The log's schema and the closed vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("qid", T.StringType()),
        T.StructField("to_qid", T.StringType()),
        T.StructField("type_code", T.StringType()),
        T.StructField("node_kind", T.StringType()),
        T.StructField("instance_of", T.ArrayType(T.StringType())),
        T.StructField("label", T.StringType()),
        T.StructField("valid_from", T.DateType()),
        T.StructField("valid_to", T.DateType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("source_ref", T.StringType()),
        T.StructField("asserted_at", T.TimestampType()),
        T.StructField("asserted_at_iso", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("reason", T.StringType()),
    ]
)
LOG_KINDS = ["NODE", "EDGE", "RETRACT", "LOCAL", "OWNER_EDGE", "SAME_AS"]
NODE_KINDS = ["PERSON", "WORK", "GROUP", "EVENT", "PLACE", "CONCEPT"]

# Edge types with their property, constructor, symmetry, weight and whether esteem has a direction.
EDGE_TYPES = [
    ("MEMBER_OF", "P463", "direct", False, 0.5, False),
    ("HAS_PART", "P527", "fallbackOnly", False, 0.5, False),
    ("PERFORMED", "P175", "inverted", False, 0.5, False),
    ("AUTHORED", "P50", "inverted", False, 0.5, False),
    ("DIRECTED", "P57", "inverted", False, 0.5, False),
    ("WROTE_SCREENPLAY_FOR", "P58", "inverted", False, 0.5, False),
    ("COMPOSED_FOR", "P86", "inverted", False, 0.5, False),
    ("ACTED_IN", "P161", "inverted", False, 0.5, False),
    ("BASED_ON", "P144", "direct", False, 0.5, True),
    ("PART_OF", "P361", "direct", False, 0.5, False),
    ("RECEIVED_AWARD", "P166", "direct", False, 0.2, False),
    ("ABOUT", "P921", "direct", False, 0.1, False),
    ("INFLUENCED_BY", "P737", "direct", False, 1.0, True),
    ("COLLABORATED_WITH", None, "derived", True, 0.5, False),
    ("SIMILAR_TO", None, "derived", True, 0.5, False),
]
DEFAULT_WEIGHT = 0.5
SELF_STATED = 0.2
OWNER = "owner"
HYPOTHESIS_PREFIX = "llm:"


def edge_types(spark: SparkSession) -> DataFrame:
    """Fifteen rows; broadcast where joined."""
    return spark.createDataFrame(EDGE_TYPES, "type_code string, property string, constructor string, symmetric boolean, weight double, directional boolean")


def weight(type_code: Column) -> Column:
    out = F.lit(DEFAULT_WEIGHT)
    for code, _, _, _, w, _ in EDGE_TYPES:
        if w != DEFAULT_WEIGHT:
            out = F.when(type_code == code, w).otherwise(out)
    return out


def directional(type_code: Column) -> Column:
    return type_code.isin([t[0] for t in EDGE_TYPES if t[5]])


def looks_like_a_qid(c: Column) -> Column:
    return c.rlike(r"^Q[0-9]+\z")


def is_allocatable(c: Column) -> Column:
    return c.rlike(r"^Q[1-9][0-9]{0,9}\z")


def is_canonical_side(c: Column) -> Column:
    return c.rlike(r"^Q[1-9][0-9]*\z")


def is_local(c: Column) -> Column:
    return c.rlike(r"^Q00[0-9]+\z")
