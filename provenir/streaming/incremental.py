"""The folded graph kept up to date: a batch of log rows recomputes the ids and edges that it bears on, and nothing else.

State lies in the shared folder. The log's rows are kept by the ids they name: node claims by their id, edge claims by the end they come
from, and merges and retractions, which are few, as they are. The views (nodes, edges, emptied ids) are tables of changes. At its other end
an edge claim or an edge has a row that says no more than where it is. The first batch is folded as it is.

What a batch bears on:

* ids of its node claims, retractions and merges, and ids of its edges that any merge ever named: with all ids that merges connect to these;
* canonical ids with a superseded or retracted merge next to such ids, since what holds them may be an edge that now is withdrawn;
* edges that a claim makes now or made before, if it is the batch's own, names a retracted id or a local that is merged elsewhere than before,
  or folds to an id that got or lost its node or is emptied or no longer. An id that merely is merged with another keeps its own edges as they are.

A retraction reaches backwards over rows of any earlier batch, as all rule positions come from seq and never from arrival, so rows may
also arrive late. A batch that is delivered again finds the state before it and writes the same files.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from provenir.operators.fold import EDGE_KINDS, Fold, endpoints_held, merge_claims, survivors
from provenir.schema import LOG
from provenir.sources.shared import SMALL, compact, materialize, sent
from provenir.streaming.state import Keyed, Table, bucket_numbers, bucket_of

NODES = T.StructType([T.StructField(n, t) for n, t in (("qid", T.StringType()), ("kind", T.StringType()), ("label", T.StringType()), ("instance_of", T.ArrayType(T.StringType())))])
SOURCE = T.StructType([T.StructField(n, t) for n, t in (("seq", T.LongType()), ("source_id", T.StringType()), ("source_ref", T.StringType()), ("asserted_at", T.TimestampType()), ("confidence", T.DoubleType()))])
EDGES = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("from_qid", "type_code", "to_qid")]
    + [T.StructField("valid_from", T.DateType()), T.StructField("valid_to", T.DateType()), T.StructField("first_seq", T.LongType()), T.StructField("sources", T.ArrayType(SOURCE))]
)
KEY = ["from_qid", "type_code", "to_qid"]
EMPTIED = T.StructType([T.StructField("qid", T.StringType()), T.StructField("state", T.StringType())])
RAW = ["qid", "type_code", "to_qid"]
TWIN = ["seq", *RAW]  # what a claim's row at its other end says
LINKS = T.StructType(LOG.fields + [T.StructField("twin", T.BooleanType())])


class PartialFold(Fold):
    """A fold of the rows about some ids (inside), given which ids elsewhere are emptied."""

    def __init__(self, log: DataFrame, inside: DataFrame, emptied_outside: DataFrame):
        super().__init__(log, keep=True)
        self.inside, self.emptied_outside = inside, emptied_outside

    def _stand_ins(self, emptied: DataFrame) -> DataFrame:
        return super()._stand_ins(emptied.unionByName(self.emptied_outside)).join(self.inside, "qid", "left_semi")

    def _reached(self) -> DataFrame:
        return super()._reached().join(self.inside, "qid", "left_semi")


def _among(rows: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """The rows whose columns (an end, a type that may be null, an end) are a row of keys. Many keys are still fewer than rows: they are what is hashed."""
    k = keys.toDF("_k0", "_k1", "_k2")
    k = k if keys.count() <= SMALL else k.hint("shuffle_hash")
    a, code, b = (F.col(c) for c in columns)
    return rows.join(k, (a == F.col("_k0")) & code.eqNullSafe(F.col("_k1")) & (b == F.col("_k2")), "left_semi")


class GraphState:
    """nodes() and edges() of all rows applied so far equal those of a fold of these rows together."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.claims = Table(spark, f"{path}/claims", LOG)
        self.links = Table(spark, f"{path}/links", LINKS)
        self.identity = Table(spark, f"{path}/identity", LOG)
        self._nodes = Keyed(spark, f"{path}/nodes", NODES, ["qid"])
        self._edges = Keyed(spark, f"{path}/edges", T.StructType(EDGES.fields + [T.StructField("at", T.StringType())]), ["at", *KEY], nullable=("type_code",))
        self._emptied = Keyed(spark, f"{path}/emptied", EMPTIED, ["qid"])

    def nodes(self, upto: int | None = None) -> DataFrame:
        return self._nodes.current(upto)

    def edges(self, upto: int | None = None) -> DataFrame:
        """Each edge is kept at from_qid; its row at to_qid only names it."""
        return self._edges.current(upto, where="at = from_qid").drop("at")

    def emptied(self, upto: int | None = None) -> DataFrame:
        return self._emptied.current(upto).select("qid")

    def log(self, upto: int | None = None) -> DataFrame:
        parts = [d.select(LOG.names) for d in (self.claims.read(upto), self.links.read(upto).where("not twin"), self.identity.read(upto))]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    def _keep(self, rows: DataFrame, batch: int) -> DataFrame:
        """Writes a batch's rows, and gives them as they are kept."""
        self.claims.write(rows.where("kind in ('NODE', 'LOCAL')"), batch, bucket_of("qid"))
        self.identity.write(rows.where("kind in ('SAME_AS', 'RETRACT')"), batch, F.lit(0))
        self.links.write(rows.where(F.col("kind").isin(EDGE_KINDS)).withColumn("twin", F.lit(False)), batch, bucket_of("qid"))
        said = [c if c in TWIN else F.lit(None).cast(LOG[c].dataType).alias(c) for c in LOG.names]
        twins = self.links.of(batch).where("not twin and qid <> to_qid").select(*said, F.lit(True).alias("twin"))
        self.links.write(twins, batch, bucket_of("to_qid"), mode="append")
        parts = [d.select(LOG.names) for d in (self.claims.of(batch), self.links.of(batch).where("not twin"), self.identity.of(batch))]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    def _links_naming(self, ids: DataFrame, upto: int) -> DataFrame:
        """Edge claims with an end among ids(qid), each once."""
        near = compact(ids.select(F.col("qid").alias("_at")))
        buckets = bucket_numbers(near, "_at")
        rows = self.links.read(upto, buckets)
        own = rows.where("not twin").join(near, F.col("qid") == F.col("_at"), "left_semi").select(LOG.names)
        # A claim between two of the ids is found where it comes from.
        far = rows.where("twin").join(near, F.col("to_qid") == F.col("_at"), "left_semi").join(near, F.col("qid") == F.col("_at"), "left_anti")
        far = compact(far.select("qid", "to_qid", "seq"))
        there = self.links.read(upto, bucket_numbers(far, "qid")).where("not twin").join(far, ["qid", "to_qid", "seq"], "left_semi")
        return own.unionByName(there.select(LOG.names))

    def _raw_keys(self, ids: DataFrame, upto: int) -> DataFrame:
        """qid, type_code, to_qid of edge claims with an end among ids(qid), from where they are named."""
        near = sent(ids).select(F.col("qid").alias("_at"))
        buckets = bucket_numbers(near, "_at")
        rows = self.links.read(upto, buckets)
        own, far = (rows.where(kind).join(near, F.col(end) == F.col("_at"), "left_semi").select(RAW) for kind, end in (("not twin", "qid"), ("twin", "to_qid")))
        return own.unionByName(far)

    def _connected(self, ids: DataFrame, both: DataFrame) -> DataFrame:
        """ids with all that merges connect to them. Merges are few and chains of them short."""
        new = ids
        while True:
            new = materialize(both.join(new, "qid", "left_semi").select(F.col("to_qid").alias("qid")).distinct().join(ids, "qid", "left_anti"))
            if new.isEmpty():
                return ids
            ids = materialize(ids.union(new))

    def _reach(self, rows: DataFrame, identity: DataFrame, batch: int) -> tuple[DataFrame, DataFrame]:
        """Ids whose node may change, and those of them that merges name."""
        named = lambda d: d.select(F.explode(F.array("qid", "to_qid")).alias("qid")).where("qid is not null")
        merges = identity.where("kind = 'SAME_AS'").select("qid", "to_qid")
        direct = named(rows.where(~F.col("kind").isin(EDGE_KINDS)))
        if merges.isEmpty():
            return materialize(direct.distinct()), direct.limit(0)
        both = materialize(merges.union(merges.select("to_qid", "qid")).distinct())
        ever = both.select("qid").distinct()
        ends = named(rows.where(F.col("kind").isin(EDGE_KINDS))).join(ever, "qid", "left_semi")
        ids = self._connected(materialize(direct.union(ends).distinct()), both)
        cut = identity.where("kind = 'RETRACT'").select("qid")
        again = merges.groupBy("qid").agg(F.count("*").alias("n")).where("n > 1").select("qid")
        shaky = merges.join(again.union(cut), "qid", "left_semi").select(F.col("to_qid").alias("qid"))
        shaky = materialize(shaky.union(ever.join(cut, "qid", "left_semi")).distinct())
        new = materialize(ids.join(ever, "qid", "left_semi"))
        while not (shaky.isEmpty() or new.isEmpty()):
            beside = named(self._raw_keys(new, batch)).join(shaky, "qid", "left_semi").join(ids, "qid", "left_anti").distinct()
            beside = materialize(beside)
            if beside.isEmpty():
                break
            more = self._connected(beside, both)
            new = materialize(more.join(ids, "qid", "left_anti"))
            ids = materialize(ids.union(new))
        return ids, ids.join(ever, "qid", "left_semi")

    def apply(self, rows: DataFrame, batch: int) -> None:
        first = all(t.read(batch - 1).isEmpty() for t in (self.claims, self.links, self.identity))
        rows = self._keep(rows.select(LOG.names), batch)
        if first:
            return self._begin(rows, batch)
        identity = materialize(self.identity.read(batch).select(LOG.names))
        ids, merged = self._reach(rows, identity, batch)
        ids = sent(ids)
        inside = bucket_numbers(ids, "qid")
        claims = self.claims.read(batch, inside).join(ids, "qid", "left_semi").select(LOG.names)
        outside = materialize(self.emptied(batch - 1).join(ids, "qid", "left_anti"))
        # Of edge claims a fold of nodes asks for those alone that name the canonical of a superseded merge.
        merges = identity.where("kind = 'SAME_AS'")
        again = merges.groupBy("qid").agg(F.count("*").alias("n")).where("n > 1").select("qid")
        superseded = merged.join(merges.join(again, "qid", "left_semi").select(F.col("to_qid").alias("qid")), "qid", "left_semi")
        part = PartialFold(materialize(claims.unionByName(identity).unionByName(self._links_naming(superseded, batch))), ids, outside)
        nodes, before = part.nodes, materialize(self._nodes.current(batch - 1, inside, ids))
        was = materialize(self._emptied.current(batch - 1).join(ids, "qid", "left_semi"))
        either = lambda a, b: a.join(b, a.columns, "left_anti").union(b.join(a, a.columns, "left_anti"))
        changed = materialize(either(nodes.select("qid"), before.select("qid")).union(either(part.emptied.select("qid"), was.select("qid"))).distinct())

        now, then = part.merges, Fold(self.identity.read(batch - 1).select(LOG.names), keep=True).merges
        moved = now.exceptAll(then).union(then.exceptAll(now)).select(F.col("local").alias("qid"))
        held = now.union(then).join(changed, F.col("canonical") == F.col("qid"), "left_semi").select(F.col("local").alias("qid"))
        about = materialize(changed.union(moved).union(held).union(rows.where("kind = 'RETRACT'").select("qid")).distinct())
        raw = materialize(self._raw_keys(about, batch).union(rows.where(F.col("kind").isin(EDGE_KINDS)).select(RAW)).distinct())
        keys = compact(self._folded(raw, now).union(self._folded(raw, then)).distinct())
        edges = self._edges_of(keys, part, nodes, outside, batch)

        self._nodes.change(before, nodes, batch, bucket_of("qid"))
        self._emptied.change(was, part.emptied.select("qid", F.lit("emptied").alias("state")), batch, F.lit(0))
        self._change_edges(keys, edges, batch)

    def _begin(self, rows: DataFrame, batch: int) -> None:
        """Nothing was there before: the rows' own fold is the state."""
        whole = Fold(rows, keep=True)
        self._nodes.add(whole.nodes, batch, bucket_of("qid"))
        self._emptied.add(whole.emptied.select("qid", F.lit("emptied").alias("state")), batch, F.lit(0))
        self._place(merge_claims(whole._held(whole.edge_claims.where("fate = 'kept'"), whole.missing)).withColumn("gone", F.lit(False)), batch)

    def _folded(self, raw: DataFrame, merges: DataFrame) -> DataFrame:
        """The keys of the edges that claims of raw keys make, were all their ends held."""
        a, b = merges.toDF("_la", "_ca"), merges.toDF("_lb", "_cb")
        ends = raw.where("qid is not null and to_qid is not null").join(a, F.col("qid") == F.col("_la"), "left").join(b, F.col("to_qid") == F.col("_lb"), "left")
        return ends.select(F.coalesce("_ca", "qid").alias("from_qid"), "type_code", F.coalesce("_cb", "to_qid").alias("to_qid"))

    def _edges_of(self, keys: DataFrame, part: PartialFold, nodes: DataFrame, outside: DataFrame, batch: int) -> DataFrame:
        """The edges of keys as they are now, from all their claims: those of the keys and of locals that are merged into their ends."""
        raw = keys.toDF(*RAW)
        for end in ("qid", "to_qid"):
            one = part.merges.toDF("_l", "_c")
            raw = raw.union(raw.join(one, F.col(end) == F.col("_c")).withColumn(end, F.col("_l")).select(RAW))
        raw = compact(raw)
        links = survivors(_among(self.links.read(batch, bucket_numbers(raw, "qid")).where("not twin"), raw, RAW).select(LOG.names), part.cuts)
        kept = part.folded_edges(part.emptied.unionByName(outside), links).where("fate = 'kept'")
        kept = materialize(merge_claims(_among(kept, keys, ["f", "type_code", "t"])))
        ends = kept.select(F.explode(F.array("from_qid", "to_qid")).alias("qid")).distinct().join(part.inside, "qid", "left_anti")
        ends = compact(ends)
        there = self._nodes.current(batch - 1, bucket_numbers(ends, "qid"), ends).select("qid")
        return endpoints_held(kept, compact(there.union(nodes.select("qid"))))

    def _change_edges(self, keys: DataFrame, edges: DataFrame, batch: int) -> None:
        """keys: of all edges that may be other than before. edges: those of them that are there."""
        near = _among(self._edges.read(batch - 1, bucket_numbers(keys, "from_qid")).where("at = from_qid"), keys, KEY)
        old = self._edges.newest(near)
        values = [f.name for f in EDGES.fields if f.name not in KEY]
        a, b = (d.select(*KEY, F.struct(*values).alias(n)) for d, n in ((old, "_old"), (edges, "_new")))
        b = b.toDF("_from", "_type", "_to", "_new")
        both = a.join(b, (F.col("from_qid") == F.col("_from")) & F.col("type_code").eqNullSafe(F.col("_type")) & (F.col("to_qid") == F.col("_to")), "full").where(~F.col("_old").eqNullSafe(F.col("_new")))
        lost = F.col("_new").isNull()
        key = [F.when(lost, F.col(k)).otherwise(F.col(n)).alias(k) for k, n in zip(KEY, ("_from", "_type", "_to"))]
        self._place(both.select(*key, *(F.col(f"_new.{v}").alias(v) for v in values), lost.alias("gone")), batch)

    def _place(self, rows: DataFrame, batch: int) -> None:
        """Writes changed edges where they come from, and then their names at the other end."""
        self._edges.write(rows.withColumn("at", F.col("from_qid")), batch, bucket_of("at"))
        said = [c if c in (*KEY, "gone") else F.lit(None).cast(EDGES[c].dataType).alias(c) for c in (*EDGES.names, "gone")]
        names = self._edges.of(batch).where("from_qid <> to_qid").select(*said, F.col("to_qid").alias("at"))
        self._edges.write(names, batch, bucket_of("at"), mode="append")


def maintain(stream: DataFrame, state: GraphState, checkpoint: str, **trigger) -> StreamingQuery:
    """Applies arriving log rows batch by batch."""
    # A batch's rows are read several times, and need be the same each time.
    writer = stream.writeStream.foreachBatch(lambda rows, batch: state.apply(materialize(rows), batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
