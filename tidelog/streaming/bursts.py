"""Bursts over loads that arrive one after the other: counts and first rows are carried from batch to batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import cleaning
from tidelog.sources import snapshot

_KEYS = ["bucket", "user_id", "item_id", "behavior_type"]


class BurstLog:
    """A clean log that grows by batches, with the number of rows and the first position of every burst key.

    Rows, counts and the number of the last batch are published together as a version of ``snapshot``: a
    batch that is delivered again, or whose driver died, counts once. A key that becomes a burst only by a later
    batch is collapsed with its earlier rows, since no row is dropped before the log is read. Each batch costs
    its own rows and the counts, not the log. ``position`` must be unique and grow as ``cleaning`` asks for.
    """

    def __init__(self, spark: SparkSession, root: str, threshold: int, bucket: str = "hour", position: str = "event_id"):
        self.spark, self.root, self.threshold, self.bucket, self.position = spark, root, threshold, bucket, position

    def fold(self, batch: DataFrame, batch_id: int) -> None:
        """Add a batch; for ``foreachBatch``."""
        found = snapshot.manifest(self.spark, self.root)
        if found and found["notes"]["batch"] >= batch_id:
            return
        own = batch.groupBy(F.date_trunc(self.bucket, "time").alias("bucket"), *_KEYS[1:])
        counts = own.agg(F.count("*").alias("group_rows"), F.min(self.position).alias("first_position"))
        if found:
            both = counts.unionByName(self.counts())
            counts = both.groupBy(*_KEYS).agg(F.sum("group_rows").alias("group_rows"), F.min("first_position").alias("first_position"))
        snapshot.publish_snapshot({f"rows-{batch_id}": batch, "counts": counts}, self.root, notes={"batch": batch_id})

    def counts(self) -> DataFrame:
        """Rows and first position of every key so far."""
        return snapshot.read(self.spark, self.root, "counts")

    def rows(self) -> DataFrame:
        """All rows so far, bursts included."""
        found = snapshot.manifest(self.spark, self.root)
        if not found:
            raise ValueError(f"{self.root} has no batch yet")
        return self.spark.read.parquet(*(f"{self.root}/{path}" for name, path in sorted(found["tables"].items()) if name.startswith("rows-")))

    def bursts(self) -> DataFrame:
        return self.counts().where(F.col("group_rows") >= self.threshold)

    def collapsed(self) -> DataFrame:
        """The log with each burst reduced to its first row, as ``cleaning.collapse_bursts`` over all rows gives it."""
        return cleaning.without_bursts(self.rows(), self.bursts(), self.bucket, self.position)

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """Fold in all that a stream has at hand, batch by batch."""
        query = stream.writeStream.foreachBatch(self.fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
