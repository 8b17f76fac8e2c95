"""Resolving names to entities, and importing listening signals by name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenir.functions.names import name_fold, spellings
from provenir.sources.shared import materialize

MARGIN = 2
SHORTEST_ALIAS = 3


def name_groups(names: DataFrame) -> DataFrame:
    """names(name, ord) -> folded, name (the first spelling), n."""
    folded = names.withColumn("folded", name_fold(F.col("name"))).where("folded <> ''")
    return folded.groupBy("folded").agg(F.min_by("name", "ord").alias("name"), F.count("*").alias("n"))


def adjudicate(names: DataFrame, candidates: DataFrame, written: Column | None = None) -> DataFrame:
    """names(name), candidates(name, pos, qid, label, aliases, fits, sitelinks) -> name, status, qid, reason. written: what to compare of
    the name, if not all of it.

    Of the candidates whose label or alias has the name's folded key and that fit what is expected, those by label come before
    those by alias, and the best known must have over MARGIN times the sitelinks of the next.
    """
    key = name_fold(F.col("name") if written is None else written)
    by_alias = (F.length("key") >= SHORTEST_ALIAS) & F.coalesce(F.array_contains("folded_aliases", F.col("key")), F.lit(False))
    aliases = candidates.select("name", "pos", F.explode_outer("aliases").alias("alias")).withColumn("fa", name_fold(F.col("alias")))
    aliases = aliases.groupBy(F.col("name").alias("_n"), F.col("pos").alias("_p")).agg(F.collect_set("fa").alias("folded_aliases"))
    marked = candidates.join(aliases, (F.col("name") == F.col("_n")) & (F.col("pos") == F.col("_p"))).withColumns({"key": key, "fl": name_fold(F.col("label"))})
    marked = marked.withColumn("match", F.when(F.col("fl") == F.col("key"), 2).when(by_alias, 1).otherwise(0)).drop("_n", "_p")
    per = Window.partitionBy("name")
    fit = (F.col("match") > 0) & F.col("fits")
    best = marked.withColumn("best_match", F.max(F.when(fit, F.col("match"))).over(per)).withColumn("in_play", fit & (F.col("match") == F.col("best_match")))
    order = per.orderBy(F.col("in_play").desc(), F.when(F.col("in_play"), F.col("sitelinks")).desc_nulls_last(), (F.col("match") > 0).desc(), F.col("pos"))
    placed = best.withColumns({"k": F.row_number().over(order), "next": F.lead(F.when(F.col("in_play"), F.col("sitelinks"))).over(order)}).where("k = 1")
    clear = F.col("next").isNull() | (F.col("sitelinks") > F.col("next") * MARGIN)
    status = F.when(F.col("in_play") & clear, "ACCEPTED").otherwise("REVIEW")
    reason = F.when(F.col("in_play") & clear, "clear").when(F.col("in_play"), "thin margin").when(F.col("match") > 0, "does not fit").otherwise("no name matches")
    found = placed.select(F.col("name").alias("_name"), status.alias("status"), "qid", reason.alias("reason"))
    out = names.select("name").distinct().join(found, F.col("name") == F.col("_name"), "left").drop("_name")
    return out.withColumns({"status": F.coalesce("status", F.lit("UNRESOLVED")), "reason": F.coalesce("reason", F.lit("no candidates"))})


def fits(facts: DataFrame, expected: DataFrame) -> DataFrame:
    """facts(kind, instance_of, occupations, expects) with fits, by expected(expects, kinds, classes, occupations): the kind is among the kinds;
    a class is among the classes, if any are asked for; and a person has one of the occupations, if any are asked for. A name without an
    expectation fits nothing."""
    e = expected.select(F.col("expects").alias("_e"), F.col("kinds").alias("_k"), F.col("classes").alias("_c"), F.col("occupations").alias("_o"))
    asked = lambda want, have: (F.size(want) == 0) | F.coalesce(F.arrays_overlap(want, have), F.lit(False))
    good = F.array_contains("_k", F.col("kind")) & asked("_c", "instance_of") & ((F.col("kind") != "PERSON") | asked("_o", "occupations"))
    return facts.join(e, F.col("expects") == F.col("_e"), "left").withColumn("fits", F.coalesce(good, F.lit(False))).drop("_e", "_k", "_c", "_o")


PASSES = 3  # a name has at most so many spellings


def _strength(status: Column) -> Column:
    return F.when(status == "ACCEPTED", 2).when(status == "REVIEW", 1).otherwise(0)


def resolve_seeds(seeds: DataFrame, hits: DataFrame, facts: DataFrame, expected: DataFrame, candidates: int = 5) -> DataFrame:
    """seeds(name, expects, ord) -> key, name, n, status, qid, reason, pass.

    Names are grouped by their folded key, the first writing of each standing for it. hits(spelling, pos, qid) is what searches answer,
    facts(qid, label, aliases, kind, instance_of, occupations, sitelinks) what is known of those found. The first pass asks for the name
    as written, later ones for its other spellings; each asks only for groups that no earlier pass accepted (an anti-join). The
    strongest decision stays, of equally strong ones the earlier.
    """
    keyed = seeds.withColumn("key", name_fold(F.col("name"))).where("key <> ''")
    groups = keyed.groupBy("key").agg(F.min_by(F.struct("name", "expects"), "ord").alias("x"), F.count("*").alias("n")).select("key", "x.name", "x.expects", "n")
    groups = materialize(groups.withColumn("spellings", spellings(F.col("name"))))
    near, rounds, open_ = hits.where(F.col("pos") < candidates), [], groups
    for k in range(PASSES):
        asking = open_.where(F.size("spellings") > k).select("key", "expects", F.get("spellings", F.lit(k)).alias("spelling"))
        found = asking.join(near, "spelling").join(facts, "qid")
        offered = fits(found, expected).select(F.col("key").alias("_key"), F.col("spelling").alias("name"), "pos", "qid", "label", "aliases", "fits", "sitelinks")
        # A key stands for its spelling here, since two groups may share one.
        told = adjudicate(asking.select(F.concat_ws("\t", "key", "spelling").alias("name")), offered.withColumn("name", F.concat_ws("\t", "_key", "name")), F.regexp_replace("name", "^[^\t]*\t", ""))
        told = materialize(told.select(F.substring_index("name", "\t", 1).alias("key"), "status", "qid", "reason", F.lit(k).alias("pass")))
        rounds.append(told)
        open_ = open_.where(F.size("spellings") > k + 1).join(told.where("status = 'ACCEPTED'"), "key", "left_anti")
        if open_.isEmpty():
            break
    all_ = reduce(DataFrame.unionByName, rounds)
    best = all_.groupBy("key").agg(F.max_by(F.struct("status", "qid", "reason", "pass"), F.struct(_strength(F.col("status")), -F.col("pass"))).alias("d"))
    return groups.join(best, "key").select("key", "name", "n", "d.status", "d.qid", "d.reason", "d.pass")


def resolve_in_chunks(seeds: DataFrame, hits: DataFrame, facts: DataFrame, expected: DataFrame, path: str, chunks: int) -> DataFrame:
    """resolve_seeds, a chunk of the keys after the other, each written below path; chunks that are there are not done again."""
    spark = seeds.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    number = F.pmod(F.xxhash64(name_fold(F.col("name"))), F.lit(chunks))
    for k in range(chunks):
        done = fs_path(f"{path}/chunk={k}/_SUCCESS")
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            resolve_seeds(seeds.where(number == k), hits, facts, expected).write.mode("overwrite").parquet(f"{path}/chunk={k}")
    return spark.read.parquet(path).drop("chunk")


def import_signals(rows: DataFrame, resolution: DataFrame) -> DataFrame:
    """rows(artist, play_count, loved, favorited), resolution(name, qid, status, ord) -> artist rows with qid and outcome.

    The first usable answer under the folded name counts; a name with answers of which none is usable is in review.
    """
    usable = F.col("status").isin("ACCEPTED", "MINTED") & F.col("qid").isNotNull()
    answers = resolution.withColumn("_key", name_fold(F.col("name"))).groupBy("_key").agg(F.min_by("qid", F.when(usable, F.col("ord"))).alias("_qid"), F.count("*").alias("_n"))
    joined = rows.withColumn("_k", name_fold(F.col("artist"))).join(answers, F.col("_k") == F.col("_key"), "left")
    outcome = F.when(F.col("_qid").isNotNull(), "resolved").when(F.col("_n") > 0, "in_review").otherwise("unanswered")
    return joined.select(*rows.columns, F.col("_qid").alias("qid"), outcome.alias("outcome"))
