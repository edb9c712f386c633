"""Posting lists as sorted gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the format.
ENCODING, SCHEMA = "sorted-delta-v1", "delta-postings-v0.1"


def delta_encode(ids: Column) -> Column:
    """Sorted distinct values as the first and then the gaps."""
    s = F.array_sort(F.array_distinct(ids))
    shifted = F.concat(F.array(F.lit(0).cast("long")), F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))))
    return F.when(F.size(s) == 0, s).otherwise(F.zip_with(s, shifted, lambda a, b: a - b))


def delta_decode(gaps: Column) -> Column:
    """Running sums."""
    empty = F.array().cast("array<long>")
    return F.aggregate(gaps, empty, lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("long")) + x)))


def compress_postings(tokens: DataFrame) -> DataFrame:
    """shard_path, token, encoding, gaps from (shard_path, token, local_id)."""
    return tokens.groupBy("shard_path", "token").agg(F.collect_set("local_id").alias("ids")).select("shard_path", "token", F.lit(ENCODING).alias("encoding"), delta_encode(F.col("ids")).alias("gaps"))


def compact_snapshot(tokens: DataFrame, snapshot_cids: DataFrame) -> DataFrame:
    """Compressed postings with schema and source_snapshot_cid, from (shard_path, token, local_id) and (shard_path, snapshot_cid)."""
    named = snapshot_cids.select("shard_path", F.col("snapshot_cid").alias("source_snapshot_cid"))
    return compress_postings(tokens).join(named, "shard_path", "left").select("shard_path", "source_snapshot_cid", F.lit(SCHEMA).alias("schema"), "encoding", "token", "gaps")


def decompress_postings(compressed: DataFrame) -> DataFrame:
    """shard_path, token, local_id; another encoding raises an error. Sums run by window over long rows, so a long list needs no array."""
    from pyspark.sql import Window

    checked = F.when(F.col("encoding") == ENCODING, F.col("gaps")).otherwise(F.raise_error(F.concat(F.lit("unsupported postings encoding: "), F.coalesce("encoding", F.lit("null")))))
    each = compressed.select("shard_path", "token", F.posexplode(checked).alias("pos", "gap"))
    return each.select("shard_path", "token", F.sum("gap").over(Window.partitionBy("shard_path", "token").orderBy("pos")).alias("local_id"))
