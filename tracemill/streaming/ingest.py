"""Structured Streaming ingestion: raw events into an events table, with rebuilds of the shards that a batch touches.

Exact deduplication of unbounded ids has no watermark, so each micro-batch is
matched with the table instead of a state store: the table is the state. An
event's identity hashes its time, so a repeat can only lie in its own hour
shard, and of the table only the shards that a batch touches are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracemill.operators import events as ev
from tracemill.operators import snapshots
from tracemill.schemas import EVENT_COLUMNS
from tracemill.scratch import materialize

#: Shards of a micro-batch that may be broadcast, so that others' partitions are not read.
BROADCAST_SHARDS = 100_000


class EventTable:
    """Accepted events as Parquet, partitioned by hour shard and micro-batch.

    A replayed micro-batch overwrites its own partitions, so each batch counts
    once however often it is run.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def frame(self, before_batch: int | None = None) -> DataFrame:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.spark._jsc.sc().hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], EVENT_COLUMNS)
        rows = self.spark.read.schema(EVENT_COLUMNS + ", batch_id long").parquet(self.path)
        return (rows if before_batch is None else rows.where(F.col("batch_id") < before_batch)).drop("batch_id")

    def ingest(self, raw: DataFrame, batch_id: int) -> DataFrame:
        """Identify a batch, drop what earlier batches hold, append the rest; the shards that it touched."""
        pointers = materialize(ev.pointers(ev.with_identities(raw)), "pointers")
        shards = snapshots.affected_shards(pointers)
        held = self.frame(batch_id)
        held = held.join(F.broadcast(shards) if shards.count() <= BROADCAST_SHARDS else shards, "shard_path", "left_semi").select(*held.columns)
        new = ev.accepted(pointers, held).withColumn("batch_id", F.lit(batch_id))
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", "shard_path").parquet(self.path)
        return snapshots.affected_shards(self.spark.read.schema(EVENT_COLUMNS + ", batch_id long").parquet(self.path).where(F.col("batch_id") == batch_id))


def rebuild(table: EventTable, shards: DataFrame, snapshot_path: str) -> None:
    """Write the snapshots of these shards again; other shards' files stay."""
    touched = table.frame().join(shards, "shard_path", "left_semi").select(*(c.split()[0] for c in EVENT_COLUMNS.split(", ")))
    snapshots.write(snapshots.build(touched), snapshot_path)


def start(raw: DataFrame, table: EventTable, checkpoint: str, snapshot_path: str | None = None) -> StreamingQuery:
    """Run a stream of RAW_COLUMNS rows into the table; late rows land in their own hour's shard with the next local ids."""

    def each(batch: DataFrame, batch_id: int) -> None:
        shards = table.ingest(batch, batch_id)
        if snapshot_path:
            rebuild(table, shards, snapshot_path)

    return raw.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly_counts(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events an hour and kind of a stream, with a watermark for what comes late."""
    return events.withWatermark("observed_at", late).groupBy(F.window("observed_at", "1 hour"), "value_kind").agg(F.count(F.lit(1)).alias("n"))
