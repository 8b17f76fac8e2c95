"""Tables, shared scratch space and batches of text."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Intermediate tables, written as Parquet below the folder in spark.checkpoint.dir.

    Every executor can read that folder, so a lost executor costs a re-read and not the result.
    Where the setting is missing, a local session gets a folder of its own; a cluster is refused.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="provenir-")
            spark.conf.set("spark.checkpoint.dir", root)
        self.root = f"{root.rstrip('/')}/provenir-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        # Spark deletes shuffle files once the driver's collector finds that no plan needs them.
        self.spark._jvm.System.gc()
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _delete(self, paths: list[str]) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in paths:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)

    def drop(self, *names: str) -> None:
        """Deletes tables that no later step reads."""
        for name in names:
            self._delete(self.paths.pop(name, []))

    def drop_but_last(self, name: str) -> None:
        self._delete(self.paths[name][:-1])
        del self.paths[name][:-1]


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", size: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Splits Arrow batches into runs of rows of about so many bytes, so that arrays made from them stay small,
    and gives each run's texts. A single longer text makes a run of its own. Nulls count as empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        part = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // size
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            run = batch.slice(a, b - a)
            yield run, [t or "" for t in run.column(column).to_pylist()]
