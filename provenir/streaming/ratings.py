"""Ratings kept up to date: the newest of each entity, however its changes arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from provenir.operators.taste import upsert_ratings
from provenir.sources.shared import materialize
from provenir.streaming.state import Keyed, bucket_numbers, bucket_of

RATINGS = T.StructType([T.StructField("qid", T.StringType()), T.StructField("rating", T.IntegerType()), T.StructField("note", T.StringType()), T.StructField("updated_at", T.TimestampType()), T.StructField("seq", T.LongType())])


class RatingState(Keyed):
    """A batch reads and writes the entities it names. Since the newer of two versions is a matter of the versions alone, batches may come in
    any order, and come again."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, RATINGS, ["qid"])

    def apply(self, changes: DataFrame, batch: int) -> None:
        changes = materialize(changes.select(RATINGS.names))
        ids = changes.select("qid").distinct()
        before = self.current(batch - 1, bucket_numbers(ids, "qid"), ids)
        self.change(before, upsert_ratings(before, changes), batch, bucket_of("qid"))
