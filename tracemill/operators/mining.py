"""Support counting for candidate patterns over snapshots: sequences, itemsets, parent-child motifs.

Each miner returns frames: one row of support per shard, and occurrences. With
a snapshot of all shards every shard is mined at once, in parallel.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import identity
from tracemill.functions.paths import day_key
from tracemill.operators.snapshots import Snapshot
from tracemill.scratch import materialize


@dataclass(frozen=True)
class Mined:
    """core: the pattern document; support: one row a shard that reaches min_support; occurrences: shard_path, root_event_id, event_ids."""

    core: dict
    support: DataFrame
    occurrences: DataFrame


def support_for_tokens(snapshot: Snapshot, tokens: list[str]) -> DataFrame:
    """shard_path, local_id, event_id, root_event_id of events that carry every token; none for no tokens."""
    wanted = list(dict.fromkeys(tokens))
    hits = snapshot.tokens.where(F.col("token").isin(wanted)).groupBy("shard_path", "local_id").agg(F.count_distinct("token").alias("n")).where(F.col("n") == len(wanted)) if wanted else snapshot.tokens.where("false").select("shard_path", "local_id")
    return hits.select("shard_path", "local_id").join(snapshot.events, ["shard_path", "local_id"])


def support_bitmaps(snapshot: Snapshot, tokens: list[str]) -> DataFrame:
    """shard_path, n: the same count by bitmaps, for dense shards; bitmaps of 32768 local ids are combined bucket by bucket."""
    wanted = list(dict.fromkeys(tokens))
    made = snapshot.tokens.where(F.col("token").isin(wanted)).groupBy("shard_path", "token", F.bitmap_bucket_number("local_id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("local_id")).alias("bits"))
    met = made.groupBy("shard_path", "bucket").agg(F.count(F.lit(1)).alias("tokens"), F.bitmap_and_agg("bits").alias("bits")).where(F.col("tokens") == len(wanted))
    return met.groupBy("shard_path").agg(F.sum(F.bitmap_count("bits")).alias("n"))


def support_vector(prefix: list[Column] | None = None) -> list[Column]:
    """Aggregates over matched event rows; the source and extractor counts are constants of this vector."""
    return [
        F.count_distinct("event_id").alias("event_support"), F.count_distinct("actor_key").alias("actor_support"), F.count_distinct("channel_key").alias("channel_support"),
        F.count_distinct(day_key(F.col("time_path"))).alias("day_support"), F.lit(1).cast("long").alias("source_support"), F.lit(0).cast("long").alias("extractor_run_support"), *(prefix or []),
    ]


def _vector_of(snapshot: Snapshot, occurrences: DataFrame) -> DataFrame:
    """The support vector per shard over the events of occurrences."""
    each = occurrences.select("shard_path", F.explode("event_ids").alias("event_id"))
    return each.join(snapshot.events, ["shard_path", "event_id"]).groupBy("shard_path").agg(*support_vector())


def match_in_order(kinds: list[str], seconds: int | None = None) -> Column:
    """Of an array of (local_id, event_id, kind, at) structs: the ids of the earliest subsequence with these kinds, or null.

    ``seconds`` (off by default, as the constraint is otherwise only recorded)
    also asks that the match spans no more.
    """
    empty = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("ids"), F.lit(None).cast("timestamp").alias("first"), F.lit(None).cast("timestamp").alias("last"))
    wanted = F.array(*map(F.lit, kinds))

    def step(acc: Column, e: Column) -> Column:
        hit = (acc["n"] < len(kinds)) & (F.get(wanted, acc["n"]) == e["kind"])
        new = F.struct((acc["n"] + 1).alias("n"), F.concat(acc["ids"], F.array(e["event_id"])).alias("ids"), F.coalesce(acc["first"], e["at"]).alias("first"), e["at"].alias("last"))
        return F.when(hit, new).otherwise(acc)

    found = F.aggregate("trace", empty, step)
    whole = found["n"] == len(kinds)
    if seconds is not None:
        whole = whole & (F.unix_micros(found["last"]) - F.unix_micros(found["first"]) <= seconds * 1_000_000)
    return F.when(whole, found["ids"])


def mine_sequence(snapshot: Snapshot, kinds: list[str], *, min_support: int = 1, max_window_seconds: int = 30, enforce_window: bool = False) -> Mined:
    """At most one occurrence per root trace: the earliest subsequence in ingest order, gaps allowed. An empty sequence matches nothing.

    Only events of the wanted kinds are gathered, so a trace's array holds candidates alone.
    """
    core = {"kind": "pattern", "schema": "pattern-core-v0.1", "patternType": "sequence", "body": [{"eventKind": k} for k in kinds], "constraints": {"sameRootTrace": True, "maxWindowSeconds": max_window_seconds}}
    rows = snapshot.events.where(F.col("value_kind").isin(kinds) if kinds else F.lit(False))
    traces = rows.groupBy("shard_path", "root_event_id").agg(F.array_sort(F.collect_list(F.struct("local_id", "event_id", F.col("value_kind").alias("kind"), F.col("observed_at").alias("at")))).alias("trace"))
    ids = match_in_order(kinds, max_window_seconds if enforce_window else None) if kinds else F.lit(None).cast("array<string>")
    found = traces.select("shard_path", "root_event_id", ids.alias("event_ids")).where("event_ids is not null")
    counts = found.groupBy("shard_path").agg(F.count_distinct("root_event_id").alias("root_trace_support"), F.count(F.lit(1)).alias("occurrence_support")).where(F.col("occurrence_support") >= min_support)
    return Mined(core, _vector_of(snapshot, found).join(counts, "shard_path"), found.join(counts.select("shard_path"), "shard_path", "left_semi"))


def mine_itemset(snapshot: Snapshot, tokens: list[str], *, min_support: int = 1) -> Mined:
    """Events with every token; one occurrence per root trace, its events in order. Its occurrence count counts events."""
    core = {"kind": "pattern", "schema": "pattern-core-v0.1", "patternType": "itemset", "body": [{"postingToken": t} for t in tokens], "constraints": {"supportStrategy": "set-intersection"}}
    hits = support_for_tokens(snapshot, tokens)
    n = F.count(F.lit(1))
    support = hits.groupBy("shard_path").agg(*support_vector([n.alias("itemset_support"), n.alias("occurrence_support"), F.count_distinct("root_event_id").alias("root_trace_support")])).where(F.col("itemset_support") >= min_support)
    found = hits.groupBy("shard_path", "root_event_id").agg(F.array_sort(F.collect_list(F.struct("local_id", "event_id"))).alias("e")).select("shard_path", "root_event_id", F.transform("e", lambda x: x["event_id"]).alias("event_ids"))
    return Mined(core, support, found.join(support.select("shard_path"), "shard_path", "left_semi"))


def motif_edges(snapshot: Snapshot, parent_kind: str, child_kind: str) -> DataFrame:
    """shard_path, parent, child, seq, pos, root_event_id (the parent's) of edges inside a shard with these kinds; repeated edges stay."""
    ev = snapshot.events
    p = ev.where(F.col("value_kind") == parent_kind).select("shard_path", F.col("event_id").alias("parent"), "root_event_id")
    c = ev.where(F.col("value_kind") == child_kind).select("shard_path", F.col("event_id").alias("child"))
    return snapshot.edges.join(p, ["shard_path", "parent"]).join(c, ["shard_path", "child"])


def mine_parent_child_motif(snapshot: Snapshot, parent_kind: str, child_kind: str, *, min_support: int = 1) -> Mined:
    core = {"kind": "pattern", "schema": "pattern-core-v0.1", "patternType": "graph-motif", "body": [{"edge": "parent-child", "parentEventKind": parent_kind, "childEventKind": child_kind}], "constraints": {"edgeType": "parentEventId"}}
    edges = motif_edges(snapshot, parent_kind, child_kind)
    n = F.count(F.lit(1))
    counts = edges.groupBy("shard_path").agg(n.alias("edge_support"), n.alias("occurrence_support"), F.count_distinct("root_event_id").alias("root_trace_support")).where(F.col("edge_support") >= min_support)
    found = edges.select("shard_path", "root_event_id", F.array("parent", "child").alias("event_ids"), "seq", "pos")
    return Mined(core, _vector_of(snapshot, found).join(counts, "shard_path"), found.join(counts.select("shard_path"), "shard_path", "left_semi"))


def attached_claims(snapshot: Snapshot, occurrences: DataFrame) -> DataFrame:
    """Occurrences with claim_occurrence_ids: those of their events, in participation order, then in the order written."""
    key = ["shard_path", "root_event_id", "event_ids"]
    occurrences = materialize(occurrences, "occurrences")  # read twice
    each = occurrences.select(*key, F.posexplode("event_ids").alias("place", "event_id")).join(snapshot.claims, "event_id")
    lists = each.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("place", "seq", "occurrence_id"))).alias("o"))
    return occurrences.join(lists, key, "left").withColumn("claim_occurrence_ids", F.coalesce(F.transform("o", lambda x: x["occurrence_id"]), F.array().cast("array<string>"))).drop("o")


def pattern_id(mined: Mined) -> str:
    return identity.content_id("pattern", mined.core)


def occurrence_rows(snapshot: Snapshot, mined: Mined, run_id: str) -> DataFrame:
    """family, id, cid, body of pattern-occurrence artifacts: ids by native JSON and sha2."""
    none = F.array().cast("array<string>")
    body = identity.sorted_json(kind=F.lit("pattern-occurrence"), schema=F.lit("pattern-occurrence-v0.1"), patternId=F.lit(pattern_id(mined)), rootEventId=F.col("root_event_id"), participatingEventIds=F.col("event_ids"), participatingRunIds=none, participatingClaimOccurrenceIds=F.col("claim_occurrence_ids"), minedBy=F.lit(run_id))
    rows = attached_claims(snapshot, mined.occurrences).withColumn("body", body)
    return rows.select("shard_path", "root_event_id", "event_ids", "claim_occurrence_ids", F.lit("pattern-occurrence").alias("family"), identity.content_id_column("pattern-occ", F.col("body")).alias("id"), identity.cid_column(F.col("body")).alias("cid"), "body")
