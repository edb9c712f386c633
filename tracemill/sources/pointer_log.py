"""Pointer logs: JSON lines of event pointers, deduplicated, with counts of what was dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """seq, line of text files; seq grows with file and place and isn't dense. Lines end at LF, CR or both."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("seq"), F.col("value").alias("line"))


def checksum(spark: SparkSession, path: str) -> str:
    """SHA-256 of one log file's bytes."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("d")).first().d


def parsed(lines: DataFrame) -> DataFrame:
    """seq, line, fate ('blank', 'bad', 'no-id', 'pointer'), event_id."""
    doc = F.try_parse_json("line")
    is_text = F.to_json(F.try_variant_get(doc, "$.eventId", "variant")).startswith('"')
    event_id = F.when(is_text, F.try_variant_get(doc, "$.eventId", "string"))
    fate = F.when(F.trim("line") == "", "blank").when(doc.isNull(), "bad").when(event_id.isNull(), "no-id").otherwise("pointer")
    return lines.select("seq", "line", fate.alias("fate"), event_id.alias("event_id"))


def unique_pointers(lines: DataFrame) -> DataFrame:
    """seq, event_id, line of the first line of each event; a document without a text eventId raises an error."""
    rows = parsed(lines)
    id_ = F.when(F.col("fate") == "no-id", F.raise_error(F.concat(F.lit("pointer log line has no string eventId: "), F.col("line")))).otherwise(F.col("event_id"))
    good = rows.where("fate in ('pointer', 'no-id')").select("seq", id_.alias("event_id"), "line")
    return good.groupBy("event_id").agg(F.min_by(F.struct("seq", "line"), "seq").alias("r")).select("r.seq", "event_id", "r.line")


def log_stats(lines: DataFrame) -> DataFrame:
    """One row: line_count, unique_event_count, duplicate_event_ids, bad_json_lines."""
    pointer = F.col("fate") == "pointer"
    counted = parsed(lines).agg(F.count(F.lit(1)).alias("line_count"), F.count_distinct(F.when(pointer, F.col("event_id"))).alias("unique_event_count"), F.count_if(pointer).alias("pointers"), F.count_if(F.col("fate") == "bad").alias("bad_json_lines"))
    return counted.select("line_count", "unique_event_count", (F.col("pointers") - F.col("unique_event_count")).alias("duplicate_event_ids"), "bad_json_lines")
