"""Size measures of indexes and shards, and advice on sharding."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Thresholds:
    events: int = 100_000
    index_entries: int = 1_000_000
    snapshot_entries: int = 1_000_000


def measure_events(events: DataFrame, postings: DataFrame) -> DataFrame:
    """One row: events, keys of four indexes, and entries of all but the event CID index."""
    keys = [F.count_if(F.col("index") == i).alias(f"{i}_keys") for i in ("time", "actor", "channel", "root")]
    lengths = postings.where("index <> 'event_cid'").groupBy("index", "key").agg(F.count(F.lit(1)).alias("n"))
    sizes = lengths.agg(*keys, F.coalesce(F.sum("n"), F.lit(0)).alias("total_index_entries"))
    return events.agg(F.count(F.lit(1)).alias("events")).crossJoin(sizes)  # one row each


def measure_shards(tokens: DataFrame, events: DataFrame) -> DataFrame:
    """shard_path, events, posting_keys, posting_entries, max_posting_length."""
    lengths = tokens.groupBy("shard_path", "token").agg(F.count(F.lit(1)).alias("n"))
    measured = lengths.groupBy("shard_path").agg(F.count(F.lit(1)).alias("posting_keys"), F.sum("n").alias("posting_entries"), F.max("n").alias("max_posting_length"))
    sizes = events.groupBy("shard_path").agg(F.count(F.lit(1)).alias("events"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return sizes.join(measured, "shard_path", "left").select("shard_path", "events", *map(zero, ("posting_keys", "posting_entries", "max_posting_length")))


def recommend(event_measure: DataFrame, shard_measure: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """shard_path, recommended, reasons in order; a measure must be over its limit."""
    both = shard_measure.select("shard_path", "posting_entries").crossJoin(F.broadcast(event_measure.select(F.col("events").alias("n"), "total_index_entries")))  # the right side is one row
    tests = (("event-count", F.col("n") > limits.events), ("index-entry-count", F.col("total_index_entries") > limits.index_entries), ("snapshot-posting-entry-count", F.col("posting_entries") > limits.snapshot_entries))
    reasons = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in tests)))
    return both.select("shard_path", (F.size(reasons) > 0).alias("recommended"), reasons.alias("reasons"))
