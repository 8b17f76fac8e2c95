"""Folding the log into nodes and edges: retractions, merges, stand-ins, emptied entities.

Every positional rule compares the column seq; nothing depends on the order rows are stored in. The tables about merges
(SAME_AS rows and what follows from them) are small next to the log; they are joined, never collected.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenir.functions.kinds import rederive
from provenir.schema import HYPOTHESIS_PREFIX, OWNER
from provenir.sources.shared import compact, materialize

EDGE_KINDS = ["EDGE", "OWNER_EDGE"]
EDGE_KEY = ["from_qid", "type_code", "to_qid"]
CLAIMS_A_TASK = 500_000
#: What folding and merging edge claims reads of a row.
CLAIM = ["seq", "kind", "qid", "to_qid", "type_code", "valid_from", "valid_to", "source_id", "source_ref", "asserted_at", "confidence"]


def cuts(log: DataFrame) -> DataFrame:
    """qid, cut: the place of each id's last retraction."""
    return log.where("kind = 'RETRACT'").groupBy("qid").agg(F.max("seq").alias("cut"))


def survivors(log: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """Rows that no later retraction of an id they name reaches. Retractions themselves never survive. last: cuts(log), if it is a table."""
    last = cuts(log) if last is None else last
    one, two = last.select(F.col("qid").alias("_a"), F.col("cut").alias("_x")), last.select(F.col("qid").alias("_b"), F.col("cut").alias("_y"))
    rows = log.where("kind <> 'RETRACT'").join(one, F.col("qid") == F.col("_a"), "left").join(two, F.col("to_qid") == F.col("_b"), "left")
    return rows.where("seq >= greatest(coalesce(_x, -1), coalesce(_y, -1))").select(log.columns)


@dataclass
class Fold:
    """What a log folds to. Rows of `log` are of provenir.schema.LOG.

    The log is folded once: with keep, nodes and edges are written to the shared folder when first asked for, and all queries read them.
    So are retractions, merges and what follows from them, which are broadcast while they are few; the surviving rows are the log's,
    filtered by these whenever they are read, and not a second copy of it.

    derived: the log is no table but a union of selections by kind. What asks for nodes or merges alone then makes no rows of edges, and the
    edge claims are written once, as far as the fold reads them, when the edges are first asked for.

    about: a table of edge claims in which all about superseded merges are, if there is one.
    """

    log: DataFrame
    keep: bool = False
    derived: bool = False
    about: DataFrame | None = None

    def _kept(self, df: DataFrame) -> DataFrame:
        return self._table(df) if self.keep else df

    def _table(self, df: DataFrame) -> DataFrame:
        return materialize(df)

    def _few(self, df: DataFrame) -> DataFrame:
        return compact(df) if self.keep else df

    @cached_property
    def cuts(self) -> DataFrame:
        return self._few(cuts(self.log))

    @cached_property
    def surviving(self) -> DataFrame:
        return survivors(self.log, self.cuts)

    @cached_property
    def _stored(self) -> DataFrame:
        rows = self.log.where(F.col("kind").isin(EDGE_KINDS)).select(CLAIM)
        return self._table(rows) if self.keep and self.derived else rows

    @property
    def said(self) -> DataFrame:
        """Edge claims, from their table if there is one."""
        return self.__dict__.get("_stored", self.log.where(F.col("kind").isin(EDGE_KINDS)).select(CLAIM))

    @cached_property
    def same_as(self) -> DataFrame:
        """Surviving merges, with whether they are the last of their local."""
        rows = self.surviving.where("kind = 'SAME_AS'").selectExpr("seq", "qid local", "to_qid canonical")
        last = rows.groupBy(F.col("local").alias("_l")).agg(F.max("seq").alias("_s"))
        return self._few(rows.join(last, F.col("local") == F.col("_l")).select("seq", "local", "canonical", (F.col("seq") == F.col("_s")).alias("last")))

    @cached_property
    def merges(self) -> DataFrame:
        """local -> canonical: the last surviving merge of each local; looked up once, never followed further."""
        return self.same_as.where("last").select("local", "canonical")

    def folded_edges(self, emptied: DataFrame, claims: DataFrame | None = None) -> DataFrame:
        """Surviving edge claims with from_qid and to folded, and what became of each: kept, withdrawn or loop."""
        claims = survivors(self.said, self.cuts) if claims is None else claims
        a, b = self.merges.toDF("_la", "_ca"), self.merges.toDF("_lb", "_cb")
        ends = claims.join(a, F.col("qid") == F.col("_la"), "left").join(b, F.col("to_qid") == F.col("_lb"), "left")
        ends = ends.withColumns({"f": F.coalesce("_ca", "qid"), "t": F.coalesce("_cb", "to_qid")})
        x, y = emptied.toDF("_ea"), emptied.toDF("_eb")
        ends = ends.join(x, F.col("f") == F.col("_ea"), "left").join(y, F.col("t") == F.col("_eb"), "left")
        fate = F.when(F.col("_ea").isNotNull() | F.col("_eb").isNotNull(), "withdrawn").when(F.expr("f = t and (f <> qid or t <> to_qid)"), "loop").otherwise("kept")
        return ends.withColumn("fate", fate).select(*claims.columns, "f", "t", "fate")

    @cached_property
    def claimed(self) -> DataFrame:
        """Surviving node claims (NODE and LOCAL); the kind of one that states classes follows from them."""
        kind = F.when(F.col("kind") == "NODE", rederive(F.col("node_kind"), F.col("instance_of"))).otherwise(F.col("node_kind"))
        return self.surviving.where("kind in ('NODE', 'LOCAL')").withColumn("node_kind", kind)

    @cached_property
    def _about_superseded(self) -> DataFrame:
        """Edge claims that name the canonical of a superseded merge: what decides whether that merge still stands."""
        if self.about is not None:
            return survivors(self.about, self.cuts)
        ids = self._few(self.same_as.where("not last").select(F.col("canonical").alias("_id")).distinct())
        # The ids are sought before anything else is asked of the claims, so that what makes the rows of a derived log is asked for these alone.
        a = self.said.join(ids, F.col("qid") == F.col("_id"), "left_semi")
        b = self.said.join(ids, F.col("to_qid") == F.col("_id"), "left_semi").join(ids, F.col("qid") == F.col("_id"), "left_anti")
        return self._kept(survivors(a.unionByName(b), self.cuts))

    @cached_property
    def _local_claims(self) -> DataFrame:
        """Surviving node claims of merged locals, and of canonicals."""
        ids = self.same_as.select(F.explode(F.array("local", "canonical")).alias("_id"))
        ids = self._few(ids.union(self.log.where("kind = 'SAME_AS'").select("to_qid")).distinct())
        return self._kept(self.claimed.join(ids, F.col("qid") == F.col("_id"), "left_semi"))

    def _stand_ins(self, emptied: DataFrame) -> DataFrame:
        kept = self.folded_edges(emptied, self._about_superseded).where("fate = 'kept'")
        named = kept.selectExpr("qid r").union(kept.selectExpr("to_qid r")).distinct()
        standing = self.same_as.join(named, F.col("canonical") == F.col("r"), "left").where("last or r is not null")
        locals_ = self._local_claims.selectExpr("qid l", "seq claim_seq", "node_kind", "label")
        as_of = standing.join(locals_, F.expr("local = l and claim_seq < seq")).groupBy("seq", "local", "canonical").agg(F.max_by(F.struct("node_kind", "label"), "claim_seq").alias("was"))
        first = as_of.groupBy("canonical").agg(F.min_by(F.struct("seq", "was"), "seq").alias("x"))
        made = first.selectExpr("canonical qid", "x.was.node_kind kind", "x.was.label label", "x.seq seq")
        return made.join(self._local_claims.select("qid").distinct(), "qid", "left_anti").join(emptied.toDF("qid"), "qid", "left_anti")

    def _reached(self) -> DataFrame:
        """Canonical ids of merges whose local was retracted later."""
        cut = self.cuts.toDF("_q", "_cut")
        return self.log.where("kind = 'SAME_AS'").join(cut, F.expr("qid = _q and _cut > seq")).selectExpr("to_qid qid").distinct()

    @cached_property
    def emptied(self) -> DataFrame:
        """Canonical ids whose local was retracted after the merge and that nothing holds: a fixed point from none.

        Only ids of merges are concerned. The set grows from round to round, since what is emptied withdraws edges that may
        have held others; where no edge names the canonical of a superseded merge, the first round is the last.
        """
        reached = self._table(self._reached().join(self._local_claims.select("qid").distinct(), "qid", "left_anti"))
        if reached.isEmpty():
            return reached
        round_ = lambda now: self._table(reached.join(self._stand_ins(now).select("qid"), "qid", "left_anti"))
        now = round_(reached.limit(0))
        if now.isEmpty() or self._about_superseded.isEmpty():
            return self._few(now)
        while True:
            after = round_(now)
            if after.join(now, "qid", "left_anti").isEmpty():
                return self._few(now)
            now = after

    @cached_property
    def stand_ins(self) -> DataFrame:
        """qid, kind, label, seq of entities that exist by a merge alone."""
        return self._few(self._stand_ins(self.emptied))

    @cached_property
    def nodes(self) -> DataFrame:
        """qid, kind, label, instance_of: the last surviving claim of each id, and stand-ins."""
        last = self.claimed.groupBy("qid").agg(F.max_by(F.struct("node_kind", "label", "instance_of"), "seq").alias("n"))
        own = last.selectExpr("qid", "n.node_kind kind", "n.label label", "n.instance_of instance_of")
        return self._kept(own.unionByName(self.stand_ins.select("qid", "kind", "label", F.array().cast("array<string>").alias("instance_of"))))

    @property
    def edge_claims(self) -> DataFrame:
        return self.folded_edges(self.emptied)

    @cached_property
    def edges(self) -> DataFrame:
        """Edges of the graph: claims of one (from_qid, type_code, to_qid) merged, both ends with a node.

        valid_from and valid_to are each the first that any claim states; of equal (source_id, source_ref) the first counts.
        """
        parts = self._parts(self._stored)
        return self._kept(merge_claims(self._held(self.edge_claims.where("fate = 'kept'"), self.missing), parts))

    @cached_property
    def pairs(self) -> DataFrame:
        """f, type_code, t of kept claims, each once. All of an f are in one file, so that what counts by it has little to shuffle; claims
        are dealt by it before equal ones are dropped, as one shuffle then does for both."""
        return self._kept(self.edge_claims.where("fate = 'kept'").select("f", "type_code", "t").repartition("f").distinct().sortWithinPartitions("f"))

    @property
    def links(self) -> DataFrame:
        """from_qid, type_code, to_qid of the edges. While the edges aren't there, nothing of their sources is shuffled or written for it."""
        if "edges" in self.__dict__:
            return self.edges.select(EDGE_KEY)
        return self._held(self.pairs, self.missing).toDF(*EDGE_KEY)

    def edges_of(self, qid: str) -> DataFrame:
        """Edges incident to qid. While the edges aren't there, only the claims about it are merged."""
        if "edges" in self.__dict__:
            return self.edges.where((F.col("from_qid") == qid) | (F.col("to_qid") == qid))
        about = self._table(self.edge_claims.where((F.col("fate") == "kept") & ((F.col("f") == qid) | (F.col("t") == qid))))
        return merge_claims(self._held(about, self._lacking(about)))

    @property
    def guesses(self) -> DataFrame:
        """Edges that hypotheses alone assert. While the edges aren't there, only claims of hypotheses are merged, and of the others' only the
        keys are shuffled, where their types (few, as the vocabulary is closed) are types of hypotheses."""
        if "edges" in self.__dict__:
            return self.edges.where(is_hypothesis(F.col("sources")))
        kept, guess = self.edge_claims.where("fate = 'kept'"), F.coalesce(F.startswith("source_id", F.lit(HYPOTHESIS_PREFIX)), F.lit(False))
        about = self._table(kept.where(guess))
        types = [r["type_code"] for r in about.select("type_code").distinct().collect()]
        named = F.col("type_code").isin([t for t in types if t is not None]) | (F.col("type_code").isNull() if None in types else F.lit(False))
        told = kept.where(~guess & named).select(F.col("f").alias("_f"), F.col("type_code").alias("_c"), F.col("t").alias("_t"))
        alone = about.join(told, F.expr("f = _f and t = _t and type_code <=> _c"), "left_anti")
        return merge_claims(self._held(alone, self._lacking(about)))

    @cached_property
    def missing(self) -> DataFrame:
        """qid of ends of kept claims that have no node. Only ids are shuffled to find them; the claims are then filtered by these few."""
        return self._lacking(self.__dict__.get("pairs", self.edge_claims.where("fate = 'kept'")))

    def _lacking(self, claims: DataFrame) -> DataFrame:
        named = claims.select(F.explode(F.array("f", "t")).alias("qid")).distinct()
        return self._few(named.join(self.nodes.select("qid"), "qid", "left_anti"))

    def _held(self, claims: DataFrame, missing: DataFrame) -> DataFrame:
        """Claims with a node at both ends f and t."""
        a, b = missing.toDF("_ma"), missing.toDF("_mb")
        whole = claims.where("f is not null and t is not null")
        return whole.join(a, F.col("f") == F.col("_ma"), "left_anti").join(b, F.col("t") == F.col("_mb"), "left_anti")

    @cached_property
    def dangling(self) -> DataFrame:
        """Merged edges with an end that has no node, and which: as endpoints_missing of all merged edges, of which only these are merged."""
        a, b = self.missing.toDF("_ma"), self.missing.toDF("_mb")
        marked = self.edge_claims.where("fate = 'kept'").join(a, F.col("f") == F.col("_ma"), "left").join(b, F.col("t") == F.col("_mb"), "left")
        lost = merge_claims(marked.where("f is null or t is null or _ma is not null or _mb is not null").drop("_ma", "_mb"))
        return endpoints_missing(lost, self.nodes)

    def _parts(self, claims: DataFrame) -> int | None:
        """Tasks in which a large log's claims are merged, so that none sorts more than fits it."""
        usual = int(self.log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        wanted = claims.count() // CLAIMS_A_TASK if self.keep else 0
        return wanted if wanted > usual else None


def merge_claims(claims: DataFrame, parts: int | None = None) -> DataFrame:
    """Claims with folded ends f and t -> edges with sources in log order: of equal (source_id, source_ref) the first, so that
    repeated claims are aggregated before an edge's sources are gathered. Both aggregates are taken where one shuffle puts an edge's claims, and
    only of claims whose key's hash another one has: most edges are of one claim, which is its edge as it stands."""
    key = [F.col("f"), F.col("type_code"), F.col("t")]
    claims = claims.select(F.xxhash64(*key).alias("_h"), *key, "source_id", "source_ref", "seq", "asserted_at", "confidence", "valid_from", "valid_to")
    claims = claims.repartition(parts, "_h") if parts else claims.repartition("_h")
    shared = claims.groupBy(F.col("_h").alias("_s")).agg(F.count("*").alias("_n")).where("_n > 1").select("_s").hint("shuffle_hash")
    alone = claims.join(shared, F.col("_h") == F.col("_s"), "left_anti")
    source = F.struct("seq", "source_id", "source_ref", "asserted_at", "confidence")
    alone = alone.select(F.col("f").alias("from_qid"), "type_code", F.col("t").alias("to_qid"), "valid_from", "valid_to", F.col("seq").alias("first_seq"), F.array(source).alias("sources"))
    return alone.unionByName(_gathered(claims.join(shared, F.col("_h") == F.col("_s"), "left_semi")))


def _gathered(claims: DataFrame) -> DataFrame:
    """Only numbers are aggregated for each source, so that claims needn't be sorted by their five keys. Rows are sorted by the hash of the key
    first, as the ids of one kind begin alike."""
    first = lambda c: F.min_by(c, "seq").alias(c)
    stated = lambda c: F.when(F.col(c).isNotNull(), F.col("seq"))
    said = claims.groupBy("_h", F.col("f").alias("from_qid"), "type_code", F.col("t").alias("to_qid"), "source_id", "source_ref").agg(
        F.min("seq").alias("_seq"), first("asserted_at"), first("confidence"), *(x for c in ("valid_from", "valid_to") for x in (F.min_by(c, stated(c)).alias(c), F.min(stated(c)).alias(f"_{c}")))
    )
    source = F.struct(F.col("_seq").alias("seq"), "source_id", "source_ref", "asserted_at", "confidence")
    merged = said.groupBy("_h", "from_qid", "type_code", "to_qid").agg(
        F.min_by("valid_from", "_valid_from").alias("valid_from"), F.min_by("valid_to", "_valid_to").alias("valid_to"), F.min("_seq").alias("first_seq"), F.array_sort(F.collect_list(source)).alias("sources")
    )
    return merged.drop("_h")


def endpoints_held(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    held = nodes.select("qid")
    return edges.join(held, F.col("from_qid") == F.col("qid"), "left_semi").join(held, F.col("to_qid") == F.col("qid"), "left_semi")


def endpoints_missing(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that the ingest gate refuses, each with the ends that have no node."""
    a, b = nodes.selectExpr("qid _a"), nodes.selectExpr("qid _b")
    both = edges.join(a, F.col("from_qid") == F.col("_a"), "left").join(b, F.col("to_qid") == F.col("_b"), "left").where("_a is null or _b is null")
    return both.withColumn("missing", F.array_compact(F.array(F.when(F.col("_a").isNull(), F.col("from_qid")), F.when(F.col("_b").isNull(), F.col("to_qid"))))).drop("_a", "_b")


def corroboration(sources: Column) -> Column:
    """Distinct sources other than the owner."""
    return F.size(F.array_distinct(F.transform(F.filter(sources, lambda s: s["source_id"] != OWNER), lambda s: s["source_id"])))


def best_confidence(sources: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(sources, lambda s: s["confidence"])), F.lit(0.0))


def is_hypothesis(sources: Column) -> Column:
    return (F.size(sources) > 0) & F.forall(sources, lambda s: F.startswith(s["source_id"], F.lit(HYPOTHESIS_PREFIX)))


def valid_at(day: Column) -> Column:
    return (F.col("valid_from").isNull() | (F.col("valid_from") <= day)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= day))
