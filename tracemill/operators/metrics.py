"""Throughput of submitted batches, and comparison with an earlier run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Measures that are compared with a baseline.
COMPARED = ("canonical_added_s", "finality_s", "first_inclusion_s", "total_cost_sum", "cost_per_event", "canonical_block_count")


def workload_metrics(batches: DataFrame) -> DataFrame:
    """One row a label of (label, batch_id, events, submitted_at, included_at, finalized_at, block, cost) rows, a row for each block that holds a batch.

    Times are seconds since the label's first submission; a batch counts as
    included at its first block and as final at its first final one. A label
    with batches that are not yet final has null in the measures of finality.
    """
    first = F.min("submitted_at")
    each = batches.groupBy("label", "batch_id").agg(F.max("events").alias("events"), first.alias("submitted_at"), F.min("included_at").alias("included_at"), F.min("finalized_at").alias("finalized_at"))
    blocks = batches.where("finalized_at is not null").groupBy("label", "block").agg(F.max("cost").alias("cost")).groupBy("label").agg(F.count(F.lit(1)).alias("canonical_block_count"), F.sum("cost").alias("total_cost_sum"))
    seconds = lambda c: (F.unix_micros(c) - F.unix_micros(F.min("submitted_at"))) / 1_000_000
    whole = lambda c, value: F.when(F.count(c) == F.count(F.lit(1)), value)
    out = each.groupBy("label").agg(
        F.sum("events").alias("events"),
        F.count(F.lit(1)).alias("batches"),
        F.count("included_at").alias("included_batches"),
        F.count("finalized_at").alias("finalized_batches"),
        seconds(F.min("included_at")).alias("first_inclusion_s"),
        whole("included_at", seconds(F.max("included_at"))).alias("canonical_added_s"),
        whole("finalized_at", seconds(F.max("finalized_at"))).alias("finality_s"),
    ).join(blocks, "label", "left")
    rate = lambda n, d: F.when(d != 0, n / d)
    return out.select(
        "*",
        (F.col("finality_s") - F.col("canonical_added_s")).alias("canonical_added_to_finality_s"),
        rate(F.col("events"), F.col("canonical_added_s")).alias("events_per_s_to_canonical_added"),
        rate(F.col("events"), F.col("finality_s")).alias("events_per_s_to_finality"),
        rate(F.col("total_cost_sum"), F.col("batches")).alias("cost_avg"),
        rate(F.col("total_cost_sum"), F.col("events")).alias("cost_per_event"),
    )


def compare_to_baseline(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """label, measure, previous, current, delta, ratio of labels that both have; a null current or a null or zero previous gives no row."""
    def long(df: DataFrame, value: str) -> DataFrame:
        pairs = F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias(value)) for c in COMPARED))
        return df.select("label", F.explode(pairs).alias("m")).select("label", "m.*")

    both = long(current, "current").join(long(baseline, "previous"), ["label", "measure"]).where("current is not null and previous <> 0")
    return both.select("label", "measure", "previous", "current", (F.col("current") - F.col("previous")).alias("delta"), (F.col("current") / F.col("previous")).alias("ratio"))
