"""The engine's named queries over the derived log, and their SQL counterparts."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provenir.facade import Graph
from provenir.functions.kinds import rederive
from provenir.functions.names import name_fold
from provenir.operators import census, evaluate, expand, export, fold, graph, paths, population, recommend, reports, resolve, taste, writes
from provenir.plans import oracle
from provenir.sources import derived_log, entities, log_store, spi, statements
from provenir.sources.shared import compact, materialize, shared_folder
from provenir.streaming.incremental import GraphState
from provenir.streaming.ratings import RatingState

CUSTOMER, SUPPLIER, PART, SECOND = "Q100000001", "Q200000001", "Q300000001", "Q200000002"
DAY = datetime.date(2000, 1, 1)
SINCE = "2000-01-01"


class World:
    """What queries over one set of tables share."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        # 27 selections: what asks for some kinds of rows makes no others.
        self.log = derived_log.log(spark, sf_dir)
        self.fold = fold.Fold(self.log, keep=True, derived=True)
        self.file = derived_log.known_file(spark, sf_dir)

    nodes = property(lambda self: self.fold.nodes)
    edges = property(lambda self: self.fold.edges)
    links = property(lambda self: self.fold.links)

    @cached_property
    def degrees(self) -> DataFrame:
        return materialize(graph.degree_incident(self.nodes, self.links))

    @cached_property
    def hubs(self) -> DataFrame:
        return compact(graph.hubs(self.nodes, self.degrees))

    @cached_property
    def resolved(self) -> DataFrame:
        return taste.resolve_ratings(derived_log.ratings(self.spark, self.sf_dir), self.fold.same_as)

    @property
    def known(self) -> DataFrame:
        return taste.known_list(self.file, self.resolved)

    @property
    def interest(self) -> DataFrame:
        return taste.interest(self.resolved, taste.combine_signals(derived_log.signals(self.spark, self.sf_dir)), self.fold.merges)

    @cached_property
    def swept(self) -> recommend.Sweep:
        withheld = taste.not_offered(self.resolved, self.fold.merges)
        return recommend.sweep(self.nodes, self.links, self.degrees, self.hubs, self.known, withheld, taste.regard_for_interest(self.interest))

    @cached_property
    def state(self) -> GraphState:
        """The log applied in three batches: what sources said first; merges, what the owner said, and sources' rows that come late; retractions
        and what came after them."""
        state = GraphState(self.spark, f"{shared_folder(self.spark)}/provenir-state-{uuid.uuid4().hex}")
        block = F.floor(F.col("seq") / derived_log.BLOCK)
        late = (block == 16) & (F.col("seq") % 64 == 5) | (block == 2) & (F.col("seq") % 10 == 3)
        number = F.when(block >= 40, 2).when((block >= 30) | late, 1).otherwise(0)
        for k, blocks in enumerate((lambda b: b < 30, lambda b: b in (2, 16) or 30 <= b < 40, lambda b: b >= 40)):
            state.apply(derived_log.log(self.spark, self.sf_dir, blocks).where(number == k), k)
        return state

    @property
    def expanded(self) -> DataFrame:
        return census.expanded_seeds(self.log)

    @cached_property
    def lonely(self) -> DataFrame:
        return compact(graph.isolated(self.nodes, self.links, self.file.select("qid")))


def _file_population(w: World) -> DataFrame:
    return population.canonical_list(w.file, w.fold.merges)


def _seeds(w: World) -> DataFrame:
    return population.canonical_seeds(w.expanded, w.fold.merges)


def _known_by_kind(w: World) -> DataFrame:
    """The known list as its file has it, and with promotions."""
    each = {"file": _file_population(w), "with promotions": taste.known_list(_file_population(w), w.resolved)}
    parts = [census.known_by_kind(w.nodes, members, _seeds(w)).withColumn("population", F.lit(name)) for name, members in each.items()]
    return parts[0].unionByName(parts[1])


def _kinds(w: World) -> DataFrame:
    """Parts with classes of several kinds, in an order that says nothing."""
    part = w.spark.read.parquet(f"{w.sf_dir}/part.parquet")
    classes = "filter(array(case when p_partkey % 11 = 0 then 'Q515' end, 'Q999', case when p_partkey % 7 = 0 then 'Q132241' end, case when p_partkey % 5 = 0 then 'Q215380' end, case when p_partkey % 3 = 0 then 'Q482994' end, case when p_partkey % 8 = 0 then 'Q5' end), c -> c is not null)"
    rows = part.selectExpr("p_partkey", f"case when p_partkey % 13 = 0 then cast(array() as array<string>) else {classes} end classes")
    return rows.select("p_partkey", rederive(F.lit("PLACE"), F.col("classes")).alias("kind"))


def _entity_facts(w: World) -> DataFrame:
    """Suppliers as entities in JSON: labels of either language or none, aliases twice over, missing ones, occupations, sitelinks."""
    supplier = w.spark.read.parquet(f"{w.sf_dir}/supplier.parquet")
    made = supplier.selectExpr(
        "concat('Q2', lpad(cast(s_suppkey as string), 8, '0')) qid",
        """concat('{', case when s_suppkey % 10 = 9 then '"missing":"",' else '' end, '"labels":{', case s_suppkey % 4 when 0 then '' when 1 then concat('"mul":{"value":"', s_name, '"}') else concat('"mul":{"value":"other"},"en":{"value":"', s_name, '"}') end,
        '},"descriptions":{"en":{"value":"no. ', s_suppkey, '"}},"aliases":{"mul":[{"value":"both"},{"value":"m', s_suppkey, '"}],"en":[{"value":"both"},{"value":" "},{"value":"both"}]},"sitelinks":{"enwiki":{"title":"x"}', case when s_suppkey % 3 = 0 then ',"dewiki":{}' else '' end,
        '},"claims":{"P31":[{"mainsnak":{"datavalue":{"value":{"id":"', case when s_suppkey % 2 = 0 then 'Q215380' else 'Q5' end, '"}}}},{"mainsnak":{"snaktype":"novalue"}}],"P106":[{"mainsnak":{"datavalue":{"value":{"id":"Q639669"}}}}],"P213":[{"mainsnak":{"datavalue":{"value":"0000"}}}]}}') json""",
    )
    return entities.entity_facts(made).withColumns({c: F.array_join(c, "|") for c in ("aliases", "instance_of", "occupations")}).withColumn("sitelinks", F.col("sitelinks").cast("long"))


def _entity_search(w: World) -> DataFrame:
    """Parts by brand as answers of a search: hits without a label go, and at most 50 are read."""
    part = w.spark.read.parquet(f"{w.sf_dir}/part.parquet")
    hit = "concat('{\"id\":\"Q', p_partkey, '\",', case when p_partkey % 4 = 0 then '' else concat('\"label\":\"', p_name, '\",') end, '\"description\":\"', p_type, '\"}')"
    first = part.withColumn("_k", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))).where("_k <= 50")  # what a search answers
    answers = first.groupBy(F.col("p_brand").alias("query")).agg(F.sort_array(F.collect_list(F.struct("p_partkey", F.expr(hit).alias("h")))).alias("hits"))
    answers = answers.select("query", F.concat(F.lit('{"search":['), F.array_join(F.col("hits.h"), ","), F.lit("]}")).alias("json"))
    return entities.search_hits(answers, 70).select("query", F.col("pos").cast("long").alias("pos"), "qid", "label", "description", "kind")


def _answers(w: World) -> DataFrame:
    """Both ends of the claimed edges as entities asked about, their claims as what the sources answer."""
    adapter = F.when(F.col("source_id") == "wikidata", 0).when(F.col("source_id") == "musicbrainz", 1).otherwise(2)
    claims = w.fold.surviving.where("kind = 'EDGE'").select("seq", "qid", "to_qid", "type_code", "source_id", adapter.alias("adapter"))
    return claims.withColumn("seed", F.explode(F.array("qid", "to_qid")))


REQUESTED = 40


def _edge_rows(edges: DataFrame) -> DataFrame:
    return edges.select("from_qid", "type_code", "to_qid", F.size("sources").cast("long").alias("n_sources"), fold.corroboration(F.col("sources")).cast("long").alias("corroboration"), fold.best_confidence(F.col("sources")).alias("best"), "valid_from", "valid_to")


def _recommended(scorer: str) -> Callable[[World], DataFrame]:
    def run(w: World) -> DataFrame:
        return w.swept.ranked(scorer).select("rank", "candidate", "degree", F.round("score", 6).alias("score"), "known_reached", "intermediates")

    return run


def _explained(w: World) -> DataFrame:
    head = compact(recommend.rank(w.swept.scored("resource_allocation")))
    return recommend.explain(w.swept.evidence(head), head).select("candidate", "seed", "k", F.round("reach", 6).alias("reach"), "best_via")


def _paths(hops: int, limit: int | None = None, ends: tuple[str, str] = (CUSTOMER, SUPPLIER)) -> Callable[[World], DataFrame]:
    def run(w: World) -> DataFrame:
        found = paths.simple_paths(w.edges, w.hubs, *ends, hops).withColumn("length", F.col("length").cast("long")).withColumn("hubs", F.col("hubs").cast("long"))
        return paths.ranked(found, limit) if limit else found

    return run


def _deck(w: World) -> DataFrame:
    top = recommend.rank(w.swept.scored("resource_allocation"))
    return evaluate.deck(w.known, top, w.resolved, w.degrees)


def _part_names(w: World) -> DataFrame:
    return w.spark.read.parquet(f"{w.sf_dir}/part.parquet").selectExpr("concat('The ', p_name) name", "cast(p_partkey as long) ord")


def _adjudicated(w: World) -> DataFrame:
    """Part types as names, parts as candidates with retail prices as their fame."""
    part = w.spark.read.parquet(f"{w.sf_dir}/part.parquet")
    names = part.selectExpr("p_name name").distinct()
    candidates = part.selectExpr("p_name name", "cast(p_partkey as long) pos", "concat('Q3', lpad(cast(p_partkey as string), 8, '0')) qid", "case when p_partkey % 3 = 0 then upper(p_name) else p_brand end label", "array(case when p_partkey % 3 = 1 then p_name else p_type end) aliases", "p_size > 10 fits", "cast(floor(p_retailprice * p_size) as long) sitelinks")
    return resolve.adjudicate(names, candidates)


def _signals_resolved(w: World) -> DataFrame:
    rows = w.spark.read.parquet(f"{w.sf_dir}/events.parquet").groupBy("user_id").agg(F.count("*").alias("play_count"))
    rows = rows.select(F.format_string("The Customer #%09d", F.col("user_id")).alias("artist"), "play_count", F.lit(False).alias("loved"), F.lit(False).alias("favorited"))
    answers = w.spark.read.parquet(f"{w.sf_dir}/customer.parquet").selectExpr("c_name name", "case when c_custkey % 7 <> 0 then concat('Q1', lpad(cast(c_custkey as string), 8, '0')) end qid", "case when c_custkey % 5 = 0 then 'REVIEW' else 'ACCEPTED' end status", "cast(c_custkey as long) ord")
    return resolve.import_signals(rows, answers.where("ord % 11 <> 0")).select("artist", "play_count", "qid", "outcome")


def _statements(w: World) -> DataFrame:
    """Suppliers' nations as statements in JSON, read back as edges."""
    supplier = w.spark.read.parquet(f"{w.sf_dir}/supplier.parquet")
    made = supplier.selectExpr(
        "concat('Q2', lpad(cast(s_suppkey as string), 8, '0')) qid",
        """concat('{"claims":{"P463":[{"id":"s', s_suppkey, '","rank":"', case when s_suppkey % 9 = 0 then 'deprecated' else 'normal' end, '","mainsnak":{"snaktype":"value","datavalue":{"value":{"id":"Q4', lpad(cast(s_nationkey as string), 8, '0'), '"}}},"references":[{"snaks":{"', case when s_suppkey % 2 = 0 then 'P143' else 'P248' end, '":[]}}],"qualifiers":{"P580":[{"datavalue":{"value":{"time":"+19', 10 + s_suppkey % 90, '-05-01T00:00:00Z","precision":', 10 + s_suppkey % 2, '}}}]}}],"P175":[{"rank":"normal","mainsnak":{"snaktype":"value","datavalue":{"value":{"id":"Q1"}}}}],"P999":[]}}') json""",
    )
    return statements.statements_to_edges(made)


def _grid(w: World) -> DataFrame:
    return evaluate.grid(w.nodes, w.links, w.degrees, w.hubs, w.file, w.resolved, w.fold.merges, since=F.to_timestamp(F.lit("2026-06-01")))


def _reverse_top(w: World) -> DataFrame:
    """What points at parts and orders, the best known three of each, with labels."""
    prop = F.when(F.col("type_code") == "PERFORMED", "P175").when(F.col("type_code") == "AUTHORED", "P50")
    rows = w.log.where("kind = 'EDGE' and type_code in ('PERFORMED', 'AUTHORED')").select(F.col("to_qid").alias("seed"), prop.alias("property"), F.col("qid").alias("other"), (F.substring("qid", 3, 20).cast("long") * 37 % 101).alias("sitelinks"))
    top = statements.top_reverse_rows(rows, 3)
    return top.join(w.nodes.select(F.col("qid").alias("other"), "label"), "other", "left").select("seed", "property", "other", "sitelinks", "cut", "label")


def _statement_file(w: World, rows: DataFrame, prop: str) -> DataFrame:
    """rows(qid, object, rank) as a file of statements, read by the data source."""
    folder = f"{shared_folder(w.spark)}/provenir-statements-{uuid.uuid4().hex}"
    line = F.concat(F.lit('{"id":"'), "qid", F.lit(f'","claims":{{"{prop}":[{{"rank":"'), "rank", F.lit('","mainsnak":{"snaktype":"value","datavalue":{"value":{"id":"'), "object", F.lit('"}}}}]}}'))
    rows.select(line).write.text(folder)
    return spi.read_statement_files(w.spark, folder)


def _sources_expanded(w: World) -> DataFrame:
    """One claim for each supplier and some customers: the first source knows suppliers alone, the second both."""
    ids = "concat('Q2', lpad(cast(s_suppkey as string), 8, '0')) qid", "concat('Q4', lpad(cast(s_nationkey as string), 8, '0')) object"
    supplier = w.spark.read.parquet(f"{w.sf_dir}/supplier.parquet")
    customer = w.spark.read.parquet(f"{w.sf_dir}/customer.parquet").where("c_custkey % 50 = 0")
    people = customer.selectExpr("concat('Q1', lpad(cast(c_custkey as string), 8, '0')) qid", "concat('Q4', lpad(cast(c_nationkey as string), 8, '0')) object", "'normal' rank")
    first = supplier.selectExpr(*ids, "case when s_suppkey % 9 = 0 then 'deprecated' else 'normal' end rank").unionByName(people)
    second = supplier.where("s_suppkey % 3 = 0").selectExpr(*ids, "'normal' rank").unionByName(people)
    adapters = spi.Adapters(spi.StatementAdapter("wikidata", _statement_file(w, first, "P463"), kinds=("GROUP",)), spi.StatementAdapter("musicbrainz", _statement_file(w, second, "P361")))
    kept = adapters.expand(w.nodes.where("kind in ('GROUP', 'PERSON')").select("qid", "kind"), 1)
    return kept.select("seed", "source_id", "type_code", "to_qid", F.col("place").cast("long").alias("place"))


def _ratings(w: World) -> DataFrame:
    """The ratings as versions: place 0 in the log of changes."""
    return derived_log.ratings(w.spark, w.sf_dir).withColumn("seq", F.lit(0).cast("long"))


def _ratings_upserted(w: World) -> DataFrame:
    """Orders change their customers' ratings, some at one time; three batches, the newest not last."""
    state = RatingState(w.spark, f"{shared_folder(w.spark)}/provenir-ratings-{uuid.uuid4().hex}")
    orders = w.spark.read.parquet(f"{w.sf_dir}/orders.parquet")
    changes = orders.selectExpr("concat('Q1', lpad(cast(o_custkey as string), 8, '0')) qid", "cast(1 + o_orderkey % 5 as int) rating", "case when o_orderkey % 3 = 0 then concat('note ', o_orderkey) end note", "cast(date_trunc('year', o_orderdate) as timestamp) updated_at", "cast(o_orderkey as long) seq")
    for k, part in enumerate((changes.where("seq % 3 = 1"), _ratings(w).where("qid like 'Q1%'"), changes.where("seq % 3 <> 1"))):
        state.apply(part, k)
    return state.current().select("qid", "rating", "note", "updated_at")


def _seeds_resolved(w: World) -> DataFrame:
    """Customers' names in several writings, found by the plain one alone."""
    c = w.spark.read.parquet(f"{w.sf_dir}/customer.parquet")
    seeds = c.selectExpr("case c_custkey % 4 when 0 then c_name when 1 then concat('Dr. ', c_name) when 2 then concat(c_name, ' (3)') else concat('Sir ', c_name) end name", "'musician' expects", "cast(c_custkey as long) ord")
    own, other = (f"concat('Q{d}', lpad(cast(c_custkey as string), 8, '0'))" for d in (1, 9))
    answers = c.where("c_custkey % 5 <> 0")
    hits = answers.selectExpr("c_name spelling", "cast(0 as long) pos", f"{own} qid").unionByName(answers.where("c_custkey % 7 = 0").selectExpr("c_name spelling", "cast(1 as long) pos", f"{other} qid"))
    about = "c_name label", "array('x') aliases", "case when c_custkey % 11 = 0 then 'WORK' else 'PERSON' end kind", "array('Q5') instance_of", "array('Q1', case when c_custkey % 13 = 0 then 'Q2' else 'Q639669' end) occupations"
    facts = c.selectExpr(f"{own} qid", *about, "cast(10 as long) sitelinks").unionByName(c.selectExpr(f"{other} qid", *about, "cast(8 as long) sitelinks"))
    expected = w.spark.sql("select 'musician' expects, array('PERSON', 'GROUP') kinds, cast(array() as array<string>) classes, array('Q639669') occupations")
    return resolve.resolve_seeds(seeds, hits, facts, expected).select("key", "name", "n", "status", "qid", "reason", F.col("pass").cast("long").alias("pass"))


def _expansion_appended(w: World) -> DataFrame:
    """Suppliers expanded into a copy of the log: their nations once more, which it states already, parts, and brands that nothing tells of."""
    path = f"{shared_folder(w.spark)}/provenir-log-{uuid.uuid4().hex}"
    w.log.write.parquet(f"{path}/run=0")
    supplier = w.spark.read.parquet(f"{w.sf_dir}/supplier.parquet").where("s_suppkey % 10 <> 3")
    id_ = "concat('Q2', lpad(cast(s_suppkey as string), 8, '0')) qid"
    own = supplier.selectExpr(id_, "concat('Q3', lpad(cast(1 + s_suppkey % 7 as string), 8, '0')) object", "'normal' rank")
    new = supplier.selectExpr(id_, "concat('Q6600', cast(s_suppkey % 6 as string)) object", "'normal' rank")
    facts = w.spark.range(4).selectExpr("concat('Q6600', id) qid", "'GROUP' kind", "concat('New ', id) label", "array('Q215380') instance_of")
    adapters = spi.Adapters(spi.StatementAdapter("wikidata", _statement_file(w, own, "P361")), spi.StatementAdapter("musicbrainz", _statement_file(w, new, "P463")))
    seeds = supplier.selectExpr(id_).union(w.spark.sql("select 'Q404' union all select 'Q009000003'"))
    at = F.to_timestamp(F.lit("2026-09-01 00:00:00"))
    told = [expand.expand_entities(w.spark, path, seeds, adapters, facts, "1", 5, at).withColumn("time", F.lit(k)) for k in (1, 2)]
    added = log_store.read_log(w.spark, path).where(F.col("asserted_at") == at).groupBy("kind").agg(F.count("*").alias("n"))
    return told[0].unionByName(told[1]).unionByName(added.select(F.lit("log").alias("source_id"), F.col("kind").alias("fate"), "n", F.lit(0).alias("time"))).withColumn("time", F.col("time").cast("long"))


def _report_census(w: World) -> DataFrame:
    totals = census.edge_totals(w.edges, w.fold.edge_claims, w.fold.dangling)
    return reports.census_report(census.nodes_by_kind(w.nodes), totals, census.edges_by_source(w.edges), census.edges_by_type(w.edges), census.edges_by_corroboration(w.edges), census.claims(w.log, w.fold))


def _report_recommendations(w: World) -> DataFrame:
    known, seen = reports.watch_known(w.known, w.nodes)
    materialize(known)  # the pass that reads the list
    top = compact(w.swept.ranked("resource_allocation"))
    pool = w.swept.scored("resource_allocation").count()
    return reports.recommendation_report(w.nodes, top, recommend.explain(w.swept.evidence(top), top), pool, seen.get["found"], seen.get["missing"], "resource_allocation", recommend.FLOOR)


def _graph(w: World) -> Graph:
    return Graph(w.nodes, w.edges, w.hubs, w.resolved.withColumns({"note": F.lit(None).cast("string"), "seq": F.lit(0).cast("long")}))


def _find_paths(w: World) -> DataFrame:
    found = _graph(w).find_paths(SUPPLIER, PART, 4).drop("hops")
    return found.withColumns({"length": F.col("length").cast("long"), "hubs": F.col("hubs").cast("long")})


def _retraction_effect(w: World) -> DataFrame:
    some = w.log.where("kind in ('NODE', 'LOCAL') and qid in ('Q200000001', 'Q009000004')").withColumns({"kind": F.lit("RETRACT"), "seq": F.lit(90 * derived_log.BLOCK), "reason": F.lit("gone")})
    return writes.retraction_effect(w.log, some, w.fold)


def _streamed(w: World) -> DataFrame:
    from provenir.streaming.events import windowed_counts

    return windowed_counts(w.spark.read.parquet(f"{w.sf_dir}/events.parquet"))


WORLD: dict[str, Callable[[World], DataFrame]] = {
    "log_by_kind": lambda w: w.log.groupBy("kind").agg(F.count("*").alias("n")),
    "nodes_fold": lambda w: w.nodes.select("qid", "kind", "label", F.array_join("instance_of", " ").alias("classes")),
    "edges_fold": lambda w: _edge_rows(w.edges),
    "retraction_survivors": lambda w: w.fold.surviving.groupBy("kind").agg(F.count("*").alias("n")),
    "merge_map": lambda w: w.fold.merges,
    "stand_ins": lambda w: w.fold.stand_ins.select("qid", "kind", "label"),
    "emptied_canonicals": lambda w: w.fold.emptied,
    "withdrawn_edges": lambda w: w.fold.edge_claims.where("fate <> 'kept'").select("qid", "to_qid", "type_code", "f", "t", "fate"),
    "endpoints_missing": lambda w: w.fold.dangling.select("from_qid", "type_code", "to_qid", F.array_join("missing", ",").alias("missing")),
    "audit_source_since": lambda w: _edge_rows(graph.asserted_by(w.edges, "musicbrainz", F.to_timestamp(F.lit(SINCE)))),
    "valid_at": lambda w: _edge_rows(graph.edges_valid_at(w.fold.edges_of(PART), DAY)),
    **{f"corroborated_{n}": (lambda n: lambda w: graph.corroborated(w.edges, n).groupBy("type_code").agg(F.count("*").alias("n")))(n) for n in range(4)},
    "hypotheses": lambda w: _edge_rows(w.fold.guesses),
    "incident_edges": lambda w: _edge_rows(w.fold.edges_of(SUPPLIER)),
    "neighbours_by_type": lambda w: graph.neighbours_by_type(w.fold.edges_of(SUPPLIER), SUPPLIER).select("type_code", F.array_join("neighbours", " ").alias("neighbours")),
    "degree_incident": lambda w: w.degrees,
    "degree_endpoint": lambda w: graph.degree_endpoint(w.nodes, w.links),
    "hubs": lambda w: w.hubs,
    "paths_2hop": _paths(2, ends=(SUPPLIER, SECOND)),
    "paths_3hop": _paths(3),
    "paths_ranked_top50": _paths(3, 50),
    "find_paths": _find_paths,
    "path_hops": lambda w: _graph(w).path_hops(SUPPLIER, PART, 3).withColumn("place", F.col("place").cast("long")),
    "entity_view": lambda w: _graph(w).get_entity(SUPPLIER),
    "ratings_carried": lambda w: taste.carry_ratings(_ratings(w), w.fold.same_as.where("last")).select("qid", "rating", "note", "updated_at"),
    "ratings_upserted": _ratings_upserted,
    "seeds_resolved": _seeds_resolved,
    "expansion_appended": _expansion_appended,
    "report_census": _report_census,
    "report_recommendations": _report_recommendations,
    "report_signals": lambda w: reports.signals_summary(_signals_resolved(w)),
    "report_evaluation": lambda w: reports.evaluation_report(_grid(w)),
    "refold_nodes": lambda w: w.state.nodes().select("qid", "kind", "label", F.array_join("instance_of", " ").alias("classes")),
    "refold_edges": lambda w: _edge_rows(w.state.edges()),
    "reverse_top": _reverse_top,
    "sources_expanded": _sources_expanded,
    "neighbourhood_depth2": lambda w: graph.neighbourhood(w.links, CUSTOMER, 2).select("from_qid", "type_code", "to_qid"),
    "induced_subgraph": lambda w: graph.induced(w.links, w.known.select("qid")).select("from_qid", "type_code", "to_qid"),
    "isolated_members": lambda w: w.lonely,
    "to_expand_beside": lambda w: graph.to_expand_beside(w.nodes, w.links, w.lonely, w.expanded),
    "expanded_seeds": lambda w: w.expanded,
    "view_edges": lambda w: graph.view_edges(w.edges).drop("first_seq"),
    "census_nodes": lambda w: census.nodes_by_kind(w.nodes),
    "census_edges_by_type": lambda w: census.edges_by_type(w.links),
    "census_edges_by_source": lambda w: census.edges_by_source(w.edges),
    "census_edges_by_corroboration": lambda w: census.edges_by_corroboration(w.edges),
    "census_degree": lambda w: census.degree_quantiles(w.nodes, graph.degree_endpoint(w.nodes, w.links)),
    "census_bridge": lambda w: census.bridge(w.nodes, w.edges),
    "census_concept_classes": lambda w: census.concept_classes(w.nodes),
    "census_taste": lambda w: census.taste(derived_log.ratings(w.spark, w.sf_dir), w.fold.stand_ins, w.log.where("kind = 'RETRACT'").select("qid")),
    "census_claims": lambda w: census.claims(w.log, w.fold),
    "census_known": lambda w: census.known(w.nodes, w.known, w.expanded, w.lonely),
    "census_concept_totals": lambda w: census.concept_totals(w.nodes),
    "census_edge_totals": lambda w: census.edge_totals(w.edges, w.fold.edge_claims, w.fold.dangling),
    "census_known_by_kind": _known_by_kind,
    "census_known_isolation": lambda w: census.known_isolation(w.nodes, w.links, w.lonely, _seeds(w)),
    "kinds_derived": _kinds,
    "entity_facts": _entity_facts,
    "entity_search": _entity_search,
    "acts": lambda w: population.acts(w.fold.surviving),
    "promotions_off_list": lambda w: population.promotions_off_list(_file_population(w), w.resolved),
    "names_out": lambda w: population.names_out(population.promotions_off_list(_file_population(w), w.resolved).join(population.acts(w.fold.surviving), "qid", "left_semi"), w.fold.claimed),
    "rated_since": lambda w: population.rated_since(w.resolved, F.to_timestamp(F.lit("2026-06-01"))),
    "rating_age": lambda w: population.rating_age(w.resolved, F.to_timestamp(F.lit("2026-06-01"))),
    "to_expand_known": lambda w: population.never_expanded(_file_population(w), w.nodes, _seeds(w)),
    "to_expand_promoted": lambda w: population.never_expanded(population.promotions_off_list(_file_population(w), w.resolved), w.nodes, _seeds(w)),
    "expansion_summary": lambda w: expand.summary(_answers(w), w.nodes, REQUESTED),
    "expansion_tally": lambda w: expand.tally(expand.bounded(_answers(w), w.nodes, REQUESTED)),
    "ratings_resolved": lambda w: w.resolved.select("qid", "rating"),
    "known_promoted": lambda w: w.known.select("qid", "part"),
    "suppressed": lambda w: taste.suppressed(w.resolved),
    "not_offered": lambda w: taste.not_offered(w.resolved, w.fold.merges).toDF("qid"),
    "signals_combined": lambda w: taste.combine_signals(derived_log.signals(w.spark, w.sf_dir)).select("qid", "source", "play_count", "loved", "favorited"),
    "interest": lambda w: w.interest,
    "regard": lambda w: taste.regard_for_interest(w.interest).select("qid", F.round("regard", 6).alias("regard")),
    "ratings_listing": lambda w: w.resolved.join(w.nodes.select("qid", "label"), "qid", "left").select("qid", "rating", F.coalesce("label", F.lit("(not in the graph)")).alias("label")),
    "sweep_evidence": lambda w: w.swept.candidates.where(F.col("degree") >= recommend.FLOOR).select("candidate", "ways", F.round("weight", 6).alias("weight")),
    "rec_raw": _recommended("raw"),
    "rec_adamic_adar": _recommended("adamic_adar"),
    "rec_resource_allocation": _recommended("resource_allocation"),
    "rec_lift": _recommended("lift"),
    "rec_explained": _explained,
    "floor_reading": lambda w: recommend.floor_reading(w.swept, "resource_allocation"),
    "eval_holdout": lambda w: evaluate.folds(w.resolved, w.nodes.where("kind in ('PERSON', 'GROUP')").join(w.file, "qid", "left_anti")),
    "deck_fresh": _deck,
    "deck_revision": lambda w: evaluate.revision_deck(w.known, w.resolved, w.degrees, 5),
    "events_windowed": _streamed,
    "name_fold": lambda w: w.spark.read.parquet(f"{w.sf_dir}/customer.parquet").select("c_custkey", name_fold(F.concat(F.lit(" The "), "c_name")).alias("folded")),
    "name_groups": lambda w: resolve.name_groups(_part_names(w)),
    "adjudicate": _adjudicated,
    "signals_resolved": _signals_resolved,
    "statements_to_edges": _statements,
    "export_graphml_lines": lambda w: export.graphml_lines(w.nodes, graph.view_edges(w.edges)),
    "export_dot_lines": lambda w: export.dot_lines(w.nodes, graph.view_edges(w.edges)),
    "minted": lambda w: writes.mint(w.log, _part_names(w).withColumn("kind", F.lit("WORK"))),
    "next_local": lambda w: writes.next_local(w.log),
    "retraction_effect": _retraction_effect,
    "eval_grid": _grid,
}


_worlds: dict[tuple, World] = {}


def _files(spark: SparkSession, sf_dir: str) -> tuple:
    """Sizes and times of the tables' files, so that changed tables are folded anew."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf_dir)
    listed = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in listed))


def world(spark: SparkSession, sf_dir: str) -> World:
    """One for each session and set of tables, so the log is folded once for all queries."""
    key = spark.sparkContext.applicationId, sf_dir, _files(spark, sf_dir)
    if key not in _worlds:
        _worlds[key] = World(spark, sf_dir)
    return _worlds[key]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda f: lambda spark, sf_dir: f(world(spark, sf_dir)))(f) for name, f in WORLD.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in oracle.queries().items() if name in WORLD}
