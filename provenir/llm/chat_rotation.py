"""Chat formatting: multi-party perspective rotation, in DataFrame functions only.

Each participant of a conversation gets a rendering of it in which that speaker is the assistant,
every other speaker is a named user, and the loss mask covers the speaker's own turns alone.

A rendering comes in parts of TURNS_A_PART turn numbers (turn div TURNS_A_PART), so no task gathers a whole
conversation however long it is; all but the longest dialogues have one part. Turns of a conversation are
gathered once; its list of participants is a small separate aggregate that is joined on, and a conversation
with very many parts is a skewed join that adaptive execution splits.

Defined results: a null turn sorts after the numbered ones and goes to part -1; a null role is the speaker
"unknown"; a null text is empty; rows of the same turn go by role, then text; repeated rows are rendered as
often as they occur; rows of the role "system" are rendered as such everywhere and have no perspective of their
own, so a conversation of system rows alone gives no row; rows without conv_id form one conversation of
their own. Control markers inside texts and names are defused. Other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.llm._io import table

TURNS_A_PART = 128


def _rendered(m: Column, perspective: Column) -> Column:
    head = (
        F.when(m["speaker"] == "system", F.lit("system"))
        .when(m["speaker"] == perspective, F.lit("assistant"))
        .otherwise(F.concat(F.lit("user name="), F.regexp_replace(m["speaker"], "[^A-Za-z0-9_-]", "_")))
    )
    return F.concat(F.lit("<|im_start|>"), head, F.lit("\n"), m["text"], F.lit("<|im_end|>\n"))


def rotate_perspectives(conversations: DataFrame, turns_a_part: int = TURNS_A_PART) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> conv_id, perspective, part, n_turns, n_trained, text, loss_spans.

    loss_spans lists start:end (code points of text, end exclusive) of what the loss covers: the words and
    the end marker of the perspective's own turns.
    """
    turns = conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("speaker"),
        F.replace(F.coalesce("text", F.lit("")), F.lit("<|im_"), F.lit("<| im_")).alias("text"),
    )
    parts = (
        turns.withColumn("part", F.coalesce(F.floor(F.col("turn") / turns_a_part), F.lit(-1)).cast("long"))
        .groupBy("conv_id", "part")
        .agg(F.sort_array(F.collect_list(F.struct(F.col("turn").isNull().alias("late"), "turn", "speaker", "text"))).alias("messages"))
    )
    people = turns.where("speaker <> 'system'").select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()
    both = parts.join(people, F.col("conv_id").eqNullSafe(F.col("of")))
    own = lambda m: m["speaker"] == F.col("perspective")
    pieces = both.select(
        "conv_id",
        "perspective",
        "part",
        F.transform("messages", lambda m: F.struct(own(m).alias("own"), _rendered(m, F.col("perspective")).alias("text"))).alias("pieces"),
    )
    head = len("<|im_start|>assistant\n")
    walked = F.aggregate(
        "pieces",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans")),
        lambda a, p: F.struct(
            (a["at"] + F.length(p["text"])).alias("at"),
            F.when(p["own"], F.array_append(a["spans"], F.concat((a["at"] + head).cast("string"), F.lit(":"), (a["at"] + F.length(p["text"]) - 1).cast("string"))))
            .otherwise(a["spans"])
            .alias("spans"),
        ),
        lambda a: F.array_join(a["spans"], ","),
    )
    return pieces.select(
        "conv_id",
        "perspective",
        "part",
        F.size("pieces").cast("long").alias("n_turns"),
        F.size(F.filter("pieces", lambda p: p["own"])).cast("long").alias("n_trained"),
        F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("text"),
        walked.alias("loss_spans"),
    )


def op1_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(table(spark, sf_dir, "conversations"))


QUERIES = {"op1_perspective_rotation": op1_perspective_rotation}

ORACLE = {
    "op1_perspective_rotation": f"""
with turns as (
  select conv_id, turn, coalesce(role, 'unknown') speaker, replace(coalesce(text, ''), '<|im_', '<| im_') body,
         coalesce(cast(floor(turn / {TURNS_A_PART}) as bigint), -1) part
  from conversations),
people as (select distinct conv_id, speaker perspective from turns where speaker <> 'system'),
pieces as (
  select t.conv_id, p.perspective, t.part, t.turn, t.speaker, t.body, t.speaker = p.perspective own,
         '<|im_start|>' || case when t.speaker = 'system' then 'system' when t.speaker = p.perspective then 'assistant'
           else 'user name=' || regexp_replace(t.speaker, '[^A-Za-z0-9_-]', '_', 'g') end || chr(10) || t.body || '<|im_end|>' || chr(10) piece
  from turns t join people p on t.conv_id is not distinct from p.conv_id),
placed as (
  select *, row_number() over w k, sum(length(piece)) over w upto
  from pieces window w as (partition by conv_id, perspective, part order by turn nulls last, speaker, body rows unbounded preceding))
select conv_id, perspective, part, count(*) n_turns, count(*) filter (where own) n_trained,
       string_agg(piece, '' order by k) as "text",
       coalesce(string_agg(cast(upto - length(piece) + 22 as bigint)::varchar || ':' || cast(upto - 1 as bigint)::varchar, ',' order by k) filter (where own), '') loss_spans
from placed group by conv_id, perspective, part"""
}
