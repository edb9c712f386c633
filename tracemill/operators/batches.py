"""Batch anchors over an ordered pointer log: slices, manifests, Merkle roots, ranges and common shards."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.identity import CID_PREFIX, ascii_json, sha256_hex
from tracemill.scratch import materialize, ship_package

NO_SHARD = "/stored-events"
ANCHOR_INDEXES = ("batch_id", "shard_path", "event_manifest_cid", "postings_manifest_cid", "merkle_root")
ANCHOR_COLUMNS = "batch long, batch_id string, event_count long, event_manifest_cid string, postings_manifest_cid string, merkle_root string, first_event_id string, last_event_id string"


def merkle_root(leaves: Iterable[bytes]) -> str:
    """SHA-256 tree root; an odd level repeats its last node, no leaves hash as nothing."""
    level = [hashlib.sha256(x).digest() for x in leaves]
    while len(level) > 1:
        pairs = zip(level[::2], level[1::2] + level[-1:] * (len(level) % 2), strict=True)
        level = [hashlib.sha256(a + b).digest() for a, b in pairs]
    return level[0].hex() if level else hashlib.sha256(b"").hexdigest()


def numbered(rows: DataFrame, order: str = "seq") -> DataFrame:
    """Adds row_no, 0, 1, ... in the order of a unique column, without gathering rows in one task.

    Rows are dealt by range and numbered within their range; only the ranges'
    sizes, one number each, reach the driver.
    """
    dealt = materialize(rows.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = {r["__part"]: r["count"] for r in dealt.groupBy("__part").count().collect()}
    before, total = {}, 0
    for part in sorted(sizes):
        before[part], total = total, total + sizes[part]
    base = F.create_map(*(F.lit(x).cast("long") for kv in before.items() for x in kv)) if before else F.create_map(F.lit(0).cast("long"), F.lit(0).cast("long"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(order))
    return dealt.withColumn("row_no", base[F.col("__part").cast("long")] + place - 1).drop("__part")


def split(rows: DataFrame, size: int, order: str = "seq") -> DataFrame:
    """Adds batch: slices of ``size`` rows in order."""
    return numbered(rows, order).withColumn("batch", F.floor(F.col("row_no") / size).cast("long"))


def hour_ranges(batched: DataFrame) -> DataFrame:
    """batch, min_observed_at, max_observed_at: from the first hour's start to the last hour's end; 'unknown' without times."""
    hour = F.date_trunc("hour", F.col("observed_at"))
    fmt = lambda c, f: F.coalesce(F.date_format(c, f), F.lit("unknown"))
    return batched.groupBy("batch").agg(F.min(hour).alias("lo"), F.max(hour).alias("hi")).select("batch", fmt("lo", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("min_observed_at"), fmt("hi", "yyyy-MM-dd'T'HH:'59:59Z'").alias("max_observed_at"))


def common_shards(batched: DataFrame, by: str = "batch") -> DataFrame:
    """``by``, shard_path: the deepest time key that all events of a group share at its depth and above."""
    depth = 4
    ends = [x for d in range(1, depth + 1) for x in (F.min(F.try_element_at("time_keys", F.lit(d))).alias(f"lo{d}"), F.max(F.try_element_at("time_keys", F.lit(d))).alias(f"hi{d}"), F.min(F.size("time_keys")).alias(f"n{d}"))]
    found = batched.groupBy(by).agg(*ends)
    shard = F.lit(NO_SHARD)
    agreed = F.lit(True)
    for d in range(1, depth + 1):
        agreed = agreed & (F.col(f"lo{d}") == F.col(f"hi{d}")) & (F.col(f"n{d}") >= d)
        shard = F.when(F.coalesce(agreed, F.lit(False)), F.col(f"lo{d}")).otherwise(shard)
    return found.select(by, shard.alias("shard_path"))


def postings_manifest(events: list[dict]) -> dict:
    """Six indexes of pointer documents, keys sorted, ids in order, repeats kept."""
    single = {"kind": "valueKind", "root": "rootEventId"}
    lists = {"time": "timePrefixKeys", "actor": "actorPrefixKeys", "channel": "channelPrefixKeys", "parent": "parentEventIds"}
    made: dict[str, dict[str, list[str]]] = {name: {} for name in sorted([*single, *lists])}
    for event in events:
        own = str(event.get("eventId"))
        for name, source in single.items():
            made[name].setdefault(str(event.get(source, own if name == "root" else None)), []).append(own)
        for name, source in lists.items():
            for key in event.get(source) or []:
                made[name].setdefault(str(key), []).append(own)
    return made


def anchors(batched: DataFrame, run_id: str, source_sha256: str) -> DataFrame:
    """One anchor a batch (ANCHOR_COLUMNS with shard_path and the hour range), from rows with batch, row_no and ``pointer`` (JSON).

    A batch is one group by its definition, ``size`` rows; its manifest hashes
    need all of them in order.
    """
    ship_package(batched.sparkSession)

    def anchor(key: tuple, table: pa.Table) -> pa.Table:
        number = key[0].as_py()
        events = [json.loads(p) for p in table.sort_by("row_no").column("pointer").to_pylist()]
        name = f"batch:{run_id}:{number:04d}"
        shared = {"batchId": name, "sourcePointerLogSha256": source_sha256}
        listed = shared | {"schema": "percept-event-pointer-batch-manifest-v0.1", "eventIds": [e["eventId"] for e in events], "eventCids": [e["eventCid"] for e in events]}
        posted = shared | {"schema": "percept-event-postings-manifest-v0.1", "postings": postings_manifest(events)}
        hashed = lambda doc: CID_PREFIX + sha256_hex(ascii_json(doc).encode())
        row = (number, name, len(events), hashed(listed), hashed(posted), "sha256-merkle:" + merkle_root(ascii_json(e).encode() for e in events), events[0]["eventId"], events[-1]["eventId"])
        return pa.table({c.split()[0]: pa.array([v]) for c, v in zip(ANCHOR_COLUMNS.split(", "), row, strict=True)})

    made = batched.select("batch", "row_no", "pointer").groupBy("batch").applyInArrow(anchor, ANCHOR_COLUMNS)
    return made.join(common_shards(batched), "batch").join(hour_ranges(batched), "batch")


def anchor_lookup(anchor_rows: DataFrame, by: str, key: str) -> DataFrame:
    """batch_id of anchors by batch_id, shard_path, event_manifest_cid, postings_manifest_cid or merkle_root."""
    if by not in ANCHOR_INDEXES:
        raise ValueError(f"anchors have no index {by}")
    return anchor_rows.where(F.col(by) == key).select("batch_id")


def pointer_documents(events: DataFrame) -> DataFrame:
    """Events with ``pointer``: the JSON document of their index row."""
    from tracemill.functions.identity import sorted_json

    doc = sorted_json(
        kind=F.lit("event-pointer"), schema=F.lit("event-pointer-v0.1"), eventId=F.col("event_id"), eventCid=F.col("event_cid"), payloadCid=F.col("payload_cid"), timePath=F.col("time_path"), timePrefixKeys=F.col("time_keys"), actorPath=F.col("actor_path"),
        actorPrefixKeys=F.col("actor_keys"), channelPath=F.col("channel_path"), channelPrefixKeys=F.col("channel_keys"), valueKind=F.col("value_kind"), parentEventIds=F.col("parent_event_ids"), rootEventId=F.col("root_event_id"), inputEventIds=F.col("input_event_ids"), outputArtifactIds=F.col("output_artifact_ids"),
    )
    return events.withColumn("pointer", doc)


def top_counts(rows: DataFrame, value: str, n: int = 20) -> DataFrame:
    """value, n of the most frequent values; of equals the first seen goes first."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))
    return counted.orderBy(F.desc("n"), "first_seq").limit(n)


def root_event_count(events: DataFrame) -> DataFrame:
    """One row: root_event_count."""
    return events.select("root_event_id").distinct().agg(F.count(F.lit(1)).alias("root_event_count"))


def anchors_by(anchor_rows: DataFrame, by: str) -> DataFrame:
    """key, batch_id of all anchors under one of their indexes: shard_path, event_manifest_cid, postings_manifest_cid or merkle_root."""
    if by not in ANCHOR_INDEXES:
        raise ValueError(f"anchors have no index {by}")
    return anchor_rows.select(F.lit(by).alias("index"), F.col(by).alias("key"), "batch_id")


def summary(events: DataFrame) -> DataFrame:
    """what ('kind', 'session', 'hour', 'actor'), value, n, first_seq: the twenty most frequent of each."""
    columns = {"kind": F.col("value_kind"), "session": F.try_element_at("channel_path", F.lit(2)), "hour": F.try_element_at("time_keys", F.lit(-1)), "actor": F.try_element_at("actor_keys", F.lit(-1))}
    out = None
    for what, column in columns.items():
        part = top_counts(events.select("seq", column.alias("v")), "v").select(F.lit(what).alias("what"), "value", "n", "first_seq")
        out = part if out is None else out.unionByName(part)
    return out
