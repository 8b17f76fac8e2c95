"""Keyed state below a shared folder that grows by batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenir.sources.shared import SMALL, compact

BUCKETS = 64
PLACE = [T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())]


def bucket_of(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def bucket_numbers(ids: DataFrame, column: str) -> list[int]:
    """The buckets in which ids may lie: at most BUCKETS numbers."""
    return [r[0] for r in ids.select(bucket_of(column)).distinct().collect()]


class Table:
    """Rows of schema, written once a batch into a folder of that batch, by bucket.

    A batch that is written again replaces what it wrote before, so an attempt that failed leaves nothing behind. A reader that asks for
    some buckets reads no other files. Reads before a batch don't see it or later ones.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path = spark, path
        self.schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])

    def write(self, rows: DataFrame, batch: int, bucket: Column, mode: str = "overwrite") -> None:
        placed = rows.select(*self.schema.names).withColumn("bucket", bucket)
        # Rebalancing makes files of the advised size: a bucket with very many rows is split, small ones share a task.
        placed.hint("rebalance", "bucket").write.mode(mode).option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/batch={batch}")

    def _exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def read(self, upto: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """Rows of batches up to upto, with batch and bucket."""
        full = T.StructType(self.schema.fields + PLACE)
        if not self._exists():
            return self.spark.createDataFrame([], full)
        rows = self.spark.read.schema(full).parquet(self.path)
        rows = rows if upto is None else rows.where(F.col("batch") <= upto)
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))

    def of(self, batch: int) -> DataFrame:
        """The rows of one batch."""
        return self.read(batch).where(F.col("batch") == batch)

    def first(self) -> int | None:
        """The first batch, by the names of its folder."""
        if not self._exists():
            return None
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        names = [f.getPath().getName() for f in path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)]
        return min((int(n[6:]) for n in names if n.startswith("batch=")), default=None)


class Keyed(Table):
    """A table whose last row for each key counts. A row marked gone takes its key away."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], nullable: tuple[str, ...] = ()):
        super().__init__(spark, path, T.StructType(schema.fields + [T.StructField("gone", T.BooleanType())]))
        self.nullable = nullable
        self.keys, self.values = keys, [f.name for f in schema.fields if f.name not in keys]

    def current(self, upto: int | None = None, buckets: list[int] | None = None, only: DataFrame | None = None, where: str = "true") -> DataFrame:
        """only: keys (of the same column names, or the first of them) to restrict to before rows are grouped; where: likewise.

        A batch has a key once. So of the first one, mostly the largest, the rows count whose keys no later batch has, and only later rows are grouped."""
        rows, first = self.read(upto, buckets).where(where), self.first()
        if only is not None:
            return self.newest(rows.join(only, only.columns, "left_semi"))
        own, later = rows.where(F.col("batch") == first), compact(rows.where(F.col("batch") > first).drop("bucket"))
        names = [f"_k{i}" for i in range(len(self.keys))]
        again = later.select(self.keys).distinct().toDF(*names)
        again = F.broadcast(again) if later.count() <= SMALL else again.hint("shuffle_hash")
        same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(n)) if k in self.nullable else F.col(k) == F.col(n) for k, n in zip(self.keys, names)))
        return own.where("not gone").join(again, same, "left_anti").select(*self.keys, *self.values).unionByName(self.newest(later))

    def newest(self, rows: DataFrame) -> DataFrame:
        """The last row of each key, unless it takes the key away."""
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct("gone", *self.values), "batch").alias("_x"))
        return last.where(~F.col("_x.gone")).select(*self.keys, *(F.col(f"_x.{v}").alias(v) for v in self.values))

    def add(self, rows: DataFrame, batch: int, bucket: Column) -> None:
        """Writes rows of keys that have none yet."""
        self.write(rows.withColumn("gone", F.lit(False)), batch, bucket)

    def change(self, before: DataFrame, after: DataFrame, batch: int, bucket: Column) -> None:
        """Writes what differs between the rows of some keys as they were and as they are now."""
        a, b = (d.select(*self.keys, F.struct(*self.values).alias(n)) for d, n in ((before, "_old"), (after, "_new")))
        both = a.join(b, self.keys, "full").where(~F.col("_old").eqNullSafe(F.col("_new")))
        rows = both.select(*self.keys, *(F.col(f"_new.{v}").alias(v) for v in self.values), F.col("_new").isNull().alias("gone"))
        self.write(rows, batch, bucket)
