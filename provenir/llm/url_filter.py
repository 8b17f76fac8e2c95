"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the rest.

The trees are Spark ML's, trained on labelled URLs: those that a rule decides, and those whose host holds a word
of SEED_WORDS (block). Training reads at most SAMPLE distinct labelled URLs, the first by hash, which is the
documented bound; features, suffix counts and verdicts cover every row.

Defined results: a null url, or one without "://", has an empty host and path, fits no rule and is judged by the
trees on an empty text; with no labelled URL, or only one class of them, there are no trees and such
rows get the only class known, else "allow". Repeated rows are judged alike and all are returned; other columns of
the input are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.llm._io import Scratch, table

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
SEED_WORDS = ["spam", "pills", "casino", "viagra", "porn", "warez"]
SAMPLE = 20_000
FEATURES = ["f_length", "f_host_length", "f_path_length", "f_depth", "f_labels", "f_hyphens", "f_digit_ratio", "f_host_digit_ratio", "f_entropy", "f_params", "f_query_length", "f_suffix_log_n", "f_suffix_rate", "f_site_log_n", "f_site_rate"]


def _split(df: DataFrame) -> DataFrame:
    url = F.coalesce("url", F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(coalesce(url, ''), instr(coalesce(url, ''), '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return df.withColumns({"host": lower, "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), "url": url})


def _fits(rule: str) -> Column:
    host, _, path = rule.partition("/")
    return ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit("/" + path))


def _ruled(df: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    rule = ruling = F.lit(None).cast("string")
    for verdict, r in sorted(rules, key=lambda x: (len(x[1]), x[1])):  # the longest is asked first
        rule, ruling = F.when(_fits(r), F.lit(r)).otherwise(rule), F.when(_fits(r), F.lit(verdict)).otherwise(ruling)
    return df.withColumns({"rule": rule, "ruling": ruling})


def _lexical(df: DataFrame) -> DataFrame:
    n = lambda c: F.length(c).cast("double")
    strip = lambda c, pattern: n(F.regexp_replace(c, pattern, ""))
    query = F.when(F.instr("url", "?") > 0, F.regexp_extract("url", r"\?([^#]*)", 1)).otherwise(F.lit(""))
    counts = F.transform(F.array_distinct(F.split("url", "")), lambda c: (F.length("url") - F.length(F.replace(F.col("url"), c, F.lit("")))).cast("double"))
    spread = F.aggregate(F.filter(counts, lambda c: c > 0), F.lit(0.0), lambda a, c: a + c * F.log2(c))
    labels = F.split("host", r"\.")
    return _keyed(df).withColumns(
        {
            "f_length": n("url"),
            "f_host_length": n("host"),
            "f_path_length": n("path"),
            "f_depth": n("path") - strip("path", "/"),
            "f_labels": F.size(labels).cast("double"),
            "f_hyphens": n("host") - strip("host", "-"),
            "f_digit_ratio": (n("url") - strip("url", "[0-9]")) / F.greatest(n("url"), F.lit(1.0)),
            "f_host_digit_ratio": (n("host") - strip("host", "[0-9]")) / F.greatest(n("host"), F.lit(1.0)),
            "f_entropy": F.when(F.length("url") > 0, F.log2(n("url")) - spread / n("url")).otherwise(0.0),
            "f_params": F.when(F.length(query) > 0, F.size(F.split(query, "&")).cast("double")).otherwise(0.0),
            "f_query_length": n(query),
        }
    )


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumns({"suffix": F.substring_index("host", ".", -1), "site": F.substring_index("host", ".", -3)})


def _rates(pages: DataFrame, key: str, name: str) -> DataFrame:
    """Smoothed block rate (of the labelled ones) and count of a suffix over all rows of pages."""
    return pages.groupBy(F.col(key).alias(f"{name}_key")).agg(
        F.log1p(F.count("*")).alias(f"f_{name}_log_n"), ((F.coalesce(F.sum("label"), F.lit(0.0)) + 1.0) / (F.count("label") + 2.0)).alias(f"f_{name}_rate")
    )


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, seed_words: list[str] = SEED_WORDS, sample: int = SAMPLE) -> DataFrame:
    """pages(page_id, url) -> page_id, host, path, rule, verdict, block_score."""
    spark = pages.sparkSession
    ruled = _ruled(_split(pages.select("page_id", "url")), rules)
    seeded = F.col("host").rlike("|".join(seed_words)) if seed_words else F.lit(False)
    known = F.when(F.col("ruling") == "block", 1.0).when(F.col("ruling") == "allow", 0.0).when(seeded, 1.0)
    labelled = ruled.withColumn("label", known)
    distinct = labelled.select("url", "host", "path", "label").where("label is not null").distinct()
    scratch = Scratch(spark)
    # At most `sample` rows: the bound of what is trained on.
    train = scratch.write(_lexical(distinct.orderBy(F.xxhash64("url"), "url", "label").limit(sample)), "labelled")
    classes = [r[0] for r in train.select("label").distinct().collect()]
    if len(classes) < 2:
        only = F.lit("block" if classes == [1.0] else "allow")
        return ruled.select("page_id", "host", "path", "rule", F.coalesce("ruling", only).alias("verdict"), F.lit(None).cast("double").alias("block_score"))
    keyed = _keyed(labelled)
    suffixes, sites = (scratch.write(_rates(keyed, k, k), k) for k in ("suffix", "site"))

    def featured(df: DataFrame) -> DataFrame:
        df = df.join(suffixes, df["suffix"] == suffixes["suffix_key"], "left").join(sites, df["site"] == sites["site_key"], "left")
        df = df.fillna(0.0, ["f_suffix_log_n", "f_site_log_n"]).fillna(0.5, ["f_suffix_rate", "f_site_rate"])
        return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df)

    trees = GBTClassifier(labelCol="label", featuresCol="features", maxIter=12, maxDepth=4, stepSize=0.2, maxBins=32, subsamplingRate=1.0, seed=11)
    model = trees.fit(featured(train).select("label", "features").coalesce(4))
    scored = model.transform(featured(_lexical(ruled))).withColumn("block_score", vector_to_array("probability")[1])
    method = F.when(F.col("block_score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruling", method).alias("verdict"), "block_score")


def op2_url_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


QUERIES = {"op2_url_boosted_trees": op2_url_boosted_trees}
