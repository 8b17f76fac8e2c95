"""The corpus pipeline: quality, line dedup, near-duplicate join, decontamination, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. run() writes each stage's
result to the shared folder and reads it again, so a lost executor costs a re-read of that table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.llm._io import Scratch, table
from provenir.llm.byte_bpe import encode, read_ranks
from provenir.llm.decontaminate import drop_contaminated
from provenir.llm.line_dedup import dedup_lines
from provenir.llm.ngram_join import keep_representatives
from provenir.llm.quality_ordinal import keep_good

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the rated ones among them, doesn't reject."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that another line stands for, with n_chars to match. A document of which nothing is left goes."""
    columns = docs.columns
    left = dedup_lines(docs).where("n_removed = 0 or trim(text) <> ''")
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones."""
    return keep_representatives(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of what they decode to."""
    ranks = read_ranks(public_tokenizers.path(VOCABULARY))
    return encode(docs, ranks, public_tokenizers.PATTERN, digests=True)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminated", decontaminated), ("tokens", tokens)]

#: Trained models and tokenizers aren't expressible in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
