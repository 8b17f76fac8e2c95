"""Reports as ordered lines of text, made from aggregates.

A report is a table ord, line; sorted by ord its lines are the text. Widths are aggregated and joined, so all lines
come from one plan; only small tables (counts, the ranked head) are turned into lines. Counters of a run are taken as
observations in the pass that does its work, and not by further jobs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from provenir.functions.names import rounded_percent
from provenir.schema import is_local
from provenir.sources.shared import materialize

GAP = "  "


def _ord(*parts: str):
    return F.concat_ws(".", *(F.lpad(F.col(p).cast("string"), 12, "0") for p in parts))


def aligned(rows: DataFrame) -> DataFrame:
    """rows(part, place, label, n) -> ord, line: labels padded on the right and counts on the left to one width each. A row without a count
    heads its part, after an empty line."""
    wide = rows.where("n is not null").agg(F.max(F.length("label")).alias("_w"), F.max(F.length(F.col("n").cast("string"))).alias("_c")).withColumn("_j", F.lit(1))
    both = rows.withColumn("_j", F.lit(1)).join(F.broadcast(wide), "_j")
    line = F.concat(F.expr("rpad(label, _w, ' ')"), F.lit(GAP), F.expr("lpad(cast(n as string), _c, ' ')"))
    lines = both.select("part", "place", F.explode(F.when(F.col("n").isNull(), F.array(F.lit(""), F.col("label"))).otherwise(F.array(line))).alias("line"), F.col("n").isNull().alias("head"))
    at = F.concat(_ord("part", "place"), F.when(F.col("head") & (F.col("line") != ""), ".1").otherwise(".0"))
    return lines.select(at.alias("ord"), "line")


def _section(spark: SparkSession, part: int, title: str) -> DataFrame:
    return spark.range(1).select(F.lit(part).alias("part"), F.lit(0).cast("long").alias("place"), F.lit(title).alias("label"), F.lit(None).cast("long").alias("n"))


def _named(counts: DataFrame, part: int, base: int, name: str, prefix: str = "") -> DataFrame:
    """A line for each name, in the order of names."""
    from pyspark.sql import Window

    place = F.lit(base) + F.row_number().over(Window.orderBy(name))  # names are few
    return counts.select(F.lit(part).alias("part"), place.cast("long").alias("place"), F.concat(F.lit(prefix), F.col(name).cast("string")).alias("label"), F.col("n").cast("long").alias("n"))


def _facts(one: DataFrame, part: int, base: int, names: dict[str, str]) -> DataFrame:
    """A line for each column of a table of one row."""
    each = F.array(*(F.struct(F.lit(base + k).cast("long").alias("place"), F.lit(label).alias("label"), F.col(c).cast("long").alias("n")) for k, (c, label) in enumerate(names.items())))
    return one.select(F.explode(each).alias("x")).select(F.lit(part).alias("part"), "x.*")


def census_report(kinds: DataFrame, totals: DataFrame, sources: DataFrame, types: DataFrame, corroborated: DataFrame, claims: DataFrame) -> DataFrame:
    """Lines of the censuses: kinds(kind, n), totals (one row: total, dangling, withdrawn), sources(source_id, n), types(type_code, n),
    corroborated(corroboration, n), claims (one row)."""
    spark = kinds.sparkSession
    parts = [
        _section(spark, 1, "nodes"), _facts(kinds.agg(F.sum("n").alias("n")), 1, 1, {"n": "total"}), _named(kinds, 1, 1, "kind"),
        _section(spark, 2, "edges"), _facts(totals, 2, 1, {"total": "total", "dangling": "dangling", "withdrawn": "withdrawn"}),
        _named(sources, 2, 1000, "source_id", "stated by "), _named(types, 2, 2000, "type_code", "of type "), _named(corroborated, 2, 3000, "corroboration", "corroborated by "),
        _section(spark, 3, "claims"),
        _facts(claims, 3, 1, {
            "claims": "rows of the log", "retractions": "retractions", "rows_retracted": "rows they removed", "entities_retracted": "entities they name", "minted": "local entities minted", "merges_standing": "merges standing",
            "merges_superseded": "merges superseded", "superseded_referenced": "superseded, named by an edge", "stand_ins": "stand-ins", "stand_ins_edgeless": "stand-ins without an edge",
        }),
    ]
    return aligned(reduce(DataFrame.unionByName, parts))


def watch_known(known: DataFrame, nodes: DataFrame) -> tuple[DataFrame, Observation]:
    """The ids of the list that the graph has, and an observation of found and missing ids that whatever reads them fills."""
    seen = Observation("known")
    held = nodes.select(F.col("qid").alias("_q"))
    marked = known.select("qid").distinct().join(held, F.col("qid") == F.col("_q"), "left")
    marked = marked.observe(seen, F.count_if(F.col("_q").isNotNull()).alias("found"), F.count_if(F.col("_q").isNull()).alias("missing"))
    return marked.where("_q is not null").select("qid"), seen


def recommendation_report(nodes: DataFrame, head: DataFrame, routes: DataFrame, pool: int, found: int, missing: int, scorer: str, floor: int) -> DataFrame:
    """Lines of a ranked head(rank, candidate, degree, score, known_reached, intermediates) with its routes(candidate, k, seed, best_via)."""
    spark = head.sparkSession
    head = materialize(head)
    n = head.count()
    lost = f" ({missing} of the list not in the graph)" if missing else ""
    top = [f"{n} of {pool} candidates, from {found} known entities{lost}", f"scored by {scorer}; at least {floor} edges"] + ["nothing found"] * (not n)
    first = spark.createDataFrame([(f"{0:012d}.{k:012d}", f"# {line}") for k, line in enumerate(top)], "ord string, line string")
    called = nodes.select(F.col("qid").alias("candidate"), "label", "kind")
    titles = head.join(called, "candidate").select("rank", "candidate", F.concat(_ord("rank"), F.lit(".0")).alias("ord"), F.format_string("%3d. %.4f  %s (%s), %s: %d edges, %d known over %d between", "rank", "score", "label", "candidate", "kind", "degree", "known_reached", "intermediates").alias("line"))
    a, b = nodes.select(F.col("qid").alias("seed"), F.col("label").alias("_s")), nodes.select(F.col("qid").alias("best_via"), F.col("label").alias("_v"))
    ways = routes.join(head.select("candidate", "rank"), "candidate").join(a, "seed", "left").join(b, "best_via", "left")
    ways = ways.select(F.concat(_ord("rank"), F.lit(".1."), _ord("k")).alias("ord"), F.concat(F.lit("      from "), F.coalesce("_s", "seed"), F.lit(" ("), "seed", F.lit(") over "), F.coalesce("_v", "best_via"), F.lit(" ("), "best_via", F.lit(")")).alias("line"))
    return first.unionByName(titles.select("ord", "line")).unionByName(ways)


def _lines(spark: SparkSession, lines: list[str]) -> DataFrame:
    return spark.createDataFrame([(f"{k:012d}", line) for k, line in enumerate(lines)], "ord string, line string")


def seed_summary(seeds: DataFrame, resolved: DataFrame, skipped: int = 0) -> DataFrame:
    """Lines about a run of resolve_seeds, whose result is read once."""
    read, told = Observation("seeds"), Observation("resolved")
    is_ = lambda s: F.count_if(F.col("status") == s).alias(s)
    seeds.observe(read, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
    resolved.observe(told, F.count(F.lit(1)).alias("groups"), is_("ACCEPTED"), is_("REVIEW"), is_("UNRESOLVED")).write.format("noop").mode("overwrite").save()
    t, spark = told.get, seeds.sparkSession
    share = spark.range(1).select(*(F.when(F.lit(t["groups"]) > 0, F.concat(F.lit(" ("), rounded_percent(F.lit(t[s]), F.lit(t["groups"])).cast("string"), F.lit("%)"))).otherwise("").alias(s) for s in ("ACCEPTED", "REVIEW", "UNRESOLVED"))).head()
    return _lines(spark, [
        f"rows: {read.get['rows']}, names after folding: {t['groups'] + skipped}", f"answered by an earlier run: {skipped}", f"resolved in this run: {t['groups']}",
        f"  accepted:   {t['ACCEPTED']}{share['ACCEPTED']}", f"  to review:  {t['REVIEW']}{share['REVIEW']}", f"  not found:  {t['UNRESOLVED']}{share['UNRESOLVED']}",
    ])


def signals_summary(imported: DataFrame) -> DataFrame:
    """Lines about import_signals' result: what became of the rows, and how many entities got a signal."""
    seen = Observation("signals")
    own = is_local(F.col("qid"))
    done = F.col("outcome") == "resolved"
    kept = materialize(
        imported.observe(
            seen, F.count(F.lit(1)).alias("rows"), F.count_if(done & ~own).alias("resolved"), F.count_if(done & own).alias("minted"), F.count_if(F.col("outcome") == "in_review").alias("review"), F.count_if(F.col("outcome") == "unanswered").alias("none")
        ).select("qid")
    )
    s, entities = seen.get, kept.where("qid is not null").distinct().count()
    return _lines(imported.sparkSession, [f"{s['rows']} rows", f"{s['resolved']} resolved", f"{s['minted']} resolved to local entities", f"{s['review']} left for review", f"{s['none']} not answered", f"{entities} entities with a signal"])


def expansion_report(counts: DataFrame) -> DataFrame:
    """Lines about an expansion's reasons(source_id, fate, n)."""
    rows = counts.select(F.lit(1).alias("part"), F.concat(F.when(F.col("source_id") == "", "seeds").otherwise(F.col("source_id")), F.lit(": "), "fate").alias("label"), F.col("n").cast("long").alias("n"))
    return aligned(_section(counts.sparkSession, 1, "expansion").unionByName(_named(rows, 1, 0, "label")))


def evaluation_report(grid: DataFrame) -> DataFrame:
    """A line for each setting of evaluate.grid: hits, those of new ratings, the mean rank of hits, and disliked ones offered."""
    tenths = F.expr("(20 * hit_rank_sum + hits) div (2 * hits)")  # halves go up, in whole numbers
    mean = F.when(F.col("hits") > 0, F.concat(F.expr("(20 * hit_rank_sum + hits) div (2 * hits) div 10").cast("string"), F.lit("."), (tenths % 10).cast("string"))).otherwise("-")
    line = F.format_string("%-20s floor %2d: %d of %d held out hit (%d new), mean rank %s, %d disliked offered", "scorer", "floor", "hits", "held_in_pool", "new_hits", mean, "negatives_offered")
    return grid.select(F.concat_ws(".", "scorer", F.lpad(F.col("floor").cast("string"), 12, "0")).alias("ord"), line.alias("line"))
