"""Results written once to the shared folder and read by many queries."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of at most this many rows are sent to all tasks where they are joined with large ones.
SMALL = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local session without one gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="provenir-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """df as a table: its lineage is cut, and a lost executor costs a re-read."""
    path = f"{shared_folder(df.sparkSession)}/provenir-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def compact(df: DataFrame) -> DataFrame:
    """df as a table that is broadcast where it is joined, if it is small by its count: estimates of what a filter or an aggregate of a
    large table leaves are of that table's size, and the other side would be shuffled. A table that isn't small is joined as any other."""
    return sent(materialize(df))


def sent(table: DataFrame) -> DataFrame:
    """A table that is there already, likewise."""
    return F.broadcast(table) if table.count() <= SMALL else table
