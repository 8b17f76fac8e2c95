"""An assertion log derived from the star-schema tables.

Sequence numbers are integer arithmetic over the rows' own keys, in a block of BLOCK for each kind of row, so no order over
all rows is ever computed. The statements below run in Spark SQL as they stand.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
BLOCK = 1_000_000_000_000_000


def _id(prefix: str, key: str) -> str:
    return f"concat('{prefix}', lpad(cast({key} as string), 8, '0'))"


C, S, P, N, R, O = _id("Q1", "c_custkey"), _id("Q2", "s_suppkey"), _id("Q3", "p_partkey"), _id("Q4", "n_nationkey"), _id("Q5", "r_regionkey"), _id("Q6", "o_orderkey")  # noqa: E741
BRAND = "concat('Q7', lpad(replace(p_brand, 'Brand#', ''), 8, '0'))"
SEGMENT = "concat('Q8', lpad(cast(ascii(c_mktsegment) as string), 8, '0'))"
LOCAL = "concat('Q009', lpad(cast(s_suppkey as string), 6, '0'))"
LINE_SEQ = "(l_orderkey * 8 + l_linenumber) * 4096 + (l_partkey * 31 + l_suppkey * 17 + ascii(l_returnflag) * 7 + month(l_shipdate) * 5 + day(l_shipdate)) % 4096"


def _rows(block: int, seq: str, kind: str, source: str, **columns: str) -> str:
    blank = dict(
        qid="cast(null as string)", to_qid="cast(null as string)", type_code="cast(null as string)", node_kind="cast(null as string)", instance_of="cast(null as string)", label="cast(null as string)",
        valid_from="cast(null as date)", valid_to="cast(null as date)", source_id="'wikidata'", source_ref="cast(null as string)", asserted_at="timestamp '2026-08-01 09:00:00'", confidence="1.0", reason="cast(null as string)",
    )
    said = blank | columns
    return f"select {block} * {BLOCK} + {seq} as seq, '{kind}' as kind, " + ", ".join(f"{v} as {k}" for k, v in said.items()) + f" from {source}"


STATEMENTS = [
    _rows(1, "r_regionkey", "NODE", "region", qid=R, node_kind="'PLACE'", label="r_name", instance_of="'Q82794'"),
    _rows(1, "100000 + n_nationkey", "NODE", "nation", qid=N, node_kind="'PLACE'", label="n_name", instance_of="'Q6256'"),
    _rows(2, "c_custkey", "NODE", "customer", qid=C, node_kind="'PERSON'", label="c_name", instance_of="'Q5'"),
    _rows(3, "s_suppkey", "NODE", "supplier", qid=S, node_kind="'GROUP'", label="s_name", instance_of="'Q215380 Q43229'"),
    _rows(4, "p_partkey", "NODE", "part", qid=P, node_kind="'WORK'", label="p_name", instance_of="'Q482994'"),
    _rows(5, "o_orderkey", "NODE", "orders", qid=O, node_kind="'EVENT'", label="concat('Order ', cast(o_orderkey as string))"),
    _rows(6, "cast(replace(p_brand, 'Brand#', '') as bigint)", "NODE", "(select distinct p_brand from part) b", qid=BRAND, node_kind="'CONCEPT'", label="p_brand", instance_of="'Q431289 Q955824'"),
    _rows(6, "100000 + ascii(c_mktsegment)", "NODE", "(select distinct c_mktsegment from customer) g", qid=SEGMENT, node_kind="'CONCEPT'", label="c_mktsegment"),
    _rows(10, "n_nationkey", "EDGE", "nation", qid=N, to_qid=_id("Q5", "n_regionkey"), type_code="'PART_OF'"),
    _rows(11, "c_custkey", "EDGE", "customer", qid=C, to_qid=_id("Q4", "c_nationkey"), type_code="'MEMBER_OF'"),
    _rows(12, "s_suppkey", "EDGE", "supplier", qid=S, to_qid=_id("Q4", "s_nationkey"), type_code="'MEMBER_OF'"),
    _rows(13, "p_partkey", "EDGE", "part", qid=P, to_qid=BRAND, type_code="'PART_OF'"),
    _rows(14, "c_custkey", "EDGE", "customer", qid=C, to_qid=SEGMENT, type_code="'RECEIVED_AWARD'"),
    _rows(15, "o_orderkey", "EDGE", "orders", qid=_id("Q1", "o_custkey"), to_qid=O, type_code="'AUTHORED'", asserted_at="o_orderdate", source_ref="case when o_custkey % 7 <> 0 then concat('wdqs:Q1:P50:', " + _id("Q1", "o_custkey") + ") end"),  # some were never expanded
    _rows(
        16, LINE_SEQ, "EDGE", "lineitem", qid=_id("Q2", "l_suppkey"), to_qid=_id("Q3", "l_partkey"), type_code="'PERFORMED'", valid_from="cast(l_shipdate as date)",
        source_id="case l_returnflag when 'A' then 'wikidata' when 'N' then 'musicbrainz' else 'llm:x' end", confidence="case l_returnflag when 'A' then 1.0 when 'N' then 0.8 else 0.3 end",
        source_ref="concat(cast(l_orderkey as string), ':', cast(l_linenumber as string))", asserted_at="l_shipdate",
    ),
    _rows(17, "min(" + LINE_SEQ + ")", "EDGE", "lineitem group by l_orderkey, l_partkey", qid=_id("Q6", "l_orderkey"), to_qid=_id("Q3", "l_partkey"), type_code="'ABOUT'"),
    _rows(
        18, "min(" + LINE_SEQ + ")", "EDGE", "orders join lineitem on l_orderkey = o_orderkey where l_linenumber = 1 group by o_custkey, l_suppkey", qid=_id("Q1", "o_custkey"), to_qid=_id("Q2", "l_suppkey"),
        type_code="'INFLUENCED_BY'", source_id="'musicbrainz'", confidence="0.8",
    ),
    _rows(30, "s_suppkey", "LOCAL", "supplier where s_suppkey % 10 in (3, 4)", qid=LOCAL, node_kind="'GROUP'", label="concat('Local ', s_name)", source_id="'owner'"),
    # Locals that end in 3 are the supplier; those in 4 are an entity without a node of its own.
    _rows(31, "s_suppkey", "SAME_AS", "supplier where s_suppkey % 10 = 3", qid=LOCAL, to_qid=S, source_id="'owner'"),
    _rows(31, "500000000 + s_suppkey", "SAME_AS", "supplier where s_suppkey % 10 = 4", qid=LOCAL, to_qid=_id("Q19", "s_suppkey"), source_id="'owner'"),
    _rows(32, "c_custkey", "OWNER_EDGE", "customer where c_custkey % 50 = 7", qid=C, to_qid="concat('Q009', lpad(cast((c_custkey div 50) % 10 * 10 + 3 + c_custkey % 2 as string), 6, '0'))", type_code="'INFLUENCED_BY'", source_id="'owner'", asserted_at="timestamp '2026-08-30 12:00:00'"),
    _rows(33, "c_custkey", "OWNER_EDGE", "customer where c_custkey % 60 = 9", qid=C, to_qid=_id("Q19", "(c_custkey div 60) % 10 * 10 + 4"), type_code="'SIMILAR_TO'", source_id="'owner'", asserted_at="timestamp '2026-08-30 12:00:00'"),
    _rows(40, "c_custkey", "RETRACT", "customer where c_custkey % 97 = 0", qid=C, reason="'wrong person'", source_id="'(retraction)'"),
    _rows(41, "s_suppkey", "RETRACT", "supplier where s_suppkey % 40 = 14", qid=LOCAL, reason="'minted twice'", source_id="'(retraction)'"),
    _rows(42, "s_suppkey", "SAME_AS", "supplier where s_suppkey % 40 = 24", qid=LOCAL, to_qid=_id("Q18", "s_suppkey"), source_id="'owner'"),
    _rows(50, "c_custkey", "NODE", "customer where c_custkey % 194 = 0", qid=C, node_kind="'PERSON'", label="concat(c_name, ' again')", instance_of="'Q5'"),
    _rows(
        51, LINE_SEQ, "OWNER_EDGE", "lineitem where l_linenumber = 7", qid=_id("Q2", "l_suppkey"), to_qid=_id("Q3", "l_partkey"), type_code="'PERFORMED'", source_id="'owner'", asserted_at="timestamp '2026-08-30 12:00:00'"
    ),
    # Ends without a node.
    _rows(52, "c_custkey", "OWNER_EDGE", "customer where c_custkey % 70 = 11", qid=C, to_qid=_id("Q17", "c_custkey"), type_code="'SIMILAR_TO'", source_id="'owner'", asserted_at="timestamp '2026-08-30 12:00:00'"),
]
LOG_SQL = "\nunion all\n".join(STATEMENTS)

RATINGS_SQL = f"select {C} as qid, cast(1 + c_custkey % 5 as int) as rating, cast(null as string) as note, cast('2026-01-01 00:00:00' as timestamp) as updated_at from customer where c_custkey % 3 = 0 union all select {S}, cast(1 + s_suppkey % 5 as int), 'private', cast('2026-06-01 00:00:00' as timestamp) from supplier where s_suppkey % 2 = 1 union all select {LOCAL}, cast(1 + (s_suppkey div 10) % 5 as int), cast(null as string), cast('2026-07-01 00:00:00' as timestamp) from supplier where s_suppkey % 20 in (3, 4)"
KNOWN_SQL = f"select {C} as qid, c_custkey as ord from customer where c_custkey % 20 = 0"
SIGNALS_SQL = f"select {_id('Q1', 'user_id')} as qid, 'library' as source, count(*) as play_count, max(case when value > 90 then 1 else 0 end) = 1 as loved, max(case when event_type = 'purchase' then 1 else 0 end) = 1 as favorited, max(ts) as observed_at from events group by user_id"


def _views(spark: SparkSession, sf_dir: str, statement: str) -> DataFrame:
    """The statement over the tables below sf_dir, without naming views in the session."""
    import re

    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b{t}\b", statement)}
    text = re.sub(r"\b(from|join)\s+(" + "|".join(frames) + r")\b", r"\1 {\2} \2", statement)
    return spark.sql(text, **frames)


def log(spark: SparkSession, sf_dir: str, blocks: Callable[[int], bool] | None = None) -> DataFrame:
    """blocks: which blocks of sequence numbers are asked for, so that rows of others aren't made first and then left."""
    asked = [s for s in STATEMENTS if blocks is None or blocks(int(s.split()[1]))]
    raw = _views(spark, sf_dir, "\nunion all\n".join(asked))
    return raw.withColumns(
        {
            "instance_of": F.when(F.coalesce("instance_of", F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split("instance_of", " ")),
            "asserted_at_iso": F.date_format("asserted_at", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
            "confidence": F.col("confidence").cast("double"),
        }
    )


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _views(spark, sf_dir, RATINGS_SQL)


def known_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _views(spark, sf_dir, KNOWN_SQL)


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _views(spark, sf_dir, SIGNALS_SQL)
