"""Append-only facts: every event and batch anchor under plain names, repeats kept, for readers that know the names.

Names are ``<namespace>:<kind>:<key>``; whoever publishes them chooses the
namespace. Nothing is deduplicated here, as that is the writer's business.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of names.
EVENT, EVENT_CID, POSTING = "RSpaceEvent", "RSpaceEventCid", "RSpacePosting"
BATCH, BY_SHARD, BY_EVENTS, BY_POSTINGS, BY_ROOT = "RSpaceBatch", "RSpaceBatchByShard", "RSpaceBatchByEventManifest", "RSpaceBatchByPostingsManifest", "RSpaceBatchByMerkleRoot"


def name(namespace: str, *parts: Column | str) -> Column:
    return F.concat_ws(":", F.lit(namespace), *(F.lit(p) if isinstance(p, str) else p for p in parts))


def event_facts(events: DataFrame, namespace: str) -> DataFrame:
    """name, value of every event (index rows): its own names and a posting for each key of seven indexes."""
    one = {"kind": F.col("value_kind"), "root": F.coalesce("root_event_id", "event_id"), "payload": F.col("payload_cid")}
    many = {"time": "time_keys", "actor": "actor_keys", "channel": "channel_keys", "parent": "parent_event_ids"}
    fact = lambda n, v: F.struct(n.alias("name"), v.alias("value"))
    id_ = F.col("event_id")
    own = [fact(name(namespace, EVENT, id_), F.col("event_cid")), fact(name(namespace, EVENT_CID, F.col("event_cid")), id_)]
    single = [fact(name(namespace, POSTING, index, key), id_) for index, key in one.items()]

    def postings_of(index: str, column: str) -> Column:
        return F.transform(F.coalesce(F.col(column), F.array().cast("array<string>")), lambda k: fact(name(namespace, POSTING, index, k), id_))

    lists = [postings_of(index, c) for index, c in many.items()]
    return events.select(F.explode(F.concat(F.array(*own, *single), *lists)).alias("f")).select("f.name", "f.value")


def anchor_facts(anchors: DataFrame, namespace: str) -> DataFrame:
    """name, value of every batch anchor: itself, and its id under its shard, manifests and Merkle root."""
    keys = ((BY_SHARD, "shard_path"), (BY_EVENTS, "event_manifest_cid"), (BY_POSTINGS, "postings_manifest_cid"), (BY_ROOT, "merkle_root"))
    facts = [F.struct(name(namespace, BATCH, F.col("batch_id")).alias("name"), F.col("event_manifest_cid").alias("value"))]
    facts += [F.struct(name(namespace, kind, F.col(c)).alias("name"), F.col("batch_id").alias("value")) for kind, c in keys]
    return anchors.select(F.explode(F.array(*facts)).alias("f")).select("f.name", "f.value")


def put_batch(anchors: DataFrame, events: DataFrame, namespace: str, *, details: bool) -> tuple[DataFrame, DataFrame]:
    """(facts, acks): the anchors' facts, with those of their events only where ``details`` says so, and an answer a batch."""
    facts = anchor_facts(anchors, namespace)
    storage = "batch-anchor-and-detailed-rspace-facts" if details else "batch-anchor-and-da-manifests"
    acks = anchors.select("batch_id", "event_count", F.lit(storage).alias("storage"), F.lit(details).alias("event_facts"), F.lit("off-chain").alias("dedupe"))
    return (facts.unionByName(event_facts(events, namespace)) if details else facts), acks


def name_hints(asked: DataFrame, namespace: str) -> DataFrame:
    """batch_id, event_id and the names under which a reader finds them, for a table of both."""
    of = lambda *parts: name(namespace, *parts)
    return asked.select(
        "batch_id",
        "event_id",
        of(BATCH, F.col("batch_id")).alias("batch"),
        of(BY_SHARD, "<shardPath>").alias("shard"),
        of(BY_EVENTS, "<eventManifestCid>").alias("batch_by_event_manifest"),
        of(BY_POSTINGS, "<postingsManifestCid>").alias("batch_by_postings_manifest"),
        of(BY_ROOT, "<merkleRoot>").alias("batch_by_merkle_root"),
        of(EVENT, F.col("event_id")).alias("event"),
        of(EVENT_CID, "<eventCid>").alias("event_by_cid"),
        of(POSTING, "<index>", "<key>").alias("posting"),
    )
