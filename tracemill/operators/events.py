"""Ingestion: identities, conflict rules and root resolution for batches of events."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions import identity, paths
from tracemill.operators.components import components
from tracemill.scratch import discard, materialize, ship_package

# The provenance that the identity of an event without one hashes.
UNKNOWN_PROVENANCE = {"source": "unknown", "observedBy": "omega-claw", "ingestionPipeline": "event-trace-v0"}
RAW_COLUMNS = "seq long, payload string, observed_at string, actor_path array<string>, channel_path array<string>, value_kind string, content_type string, preview string, provenance string, parent_event_ids array<string>, root_event_id string, input_event_ids array<string>, output_artifact_ids array<string>"
IDENTITY_COLUMNS = "payload_json string, payload_cid string, envelope string, event_id string, event_cid string, iso string"


def event_envelope(payload_cid: str, raw: dict) -> dict:
    """The envelope document that an event's identity hashes."""
    value = {"kind": raw["value_kind"], "contentType": raw.get("content_type") or "application/json", "payloadCid": payload_cid}
    if raw.get("preview") is not None:
        value["preview"] = raw["preview"]
    lists = {name: list(raw.get(column) or []) for name, column in (("parentEventIds", "parent_event_ids"), ("inputEventIds", "input_event_ids"), ("outputArtifactIds", "output_artifact_ids"))}
    return {
        "kind": "event-trace",
        "schema": "event-trace-v0.1",
        "time": paths.parse_time(raw["observed_at"]),
        "actorPath": list(raw["actor_path"]),
        "channelPath": list(raw["channel_path"]),
        "value": value,
        "provenance": raw.get("provenance") or UNKNOWN_PROVENANCE,
        "causal": lists | {"rootEventId": raw.get("root_event_id")},
    }


def identify(raw: dict) -> dict:
    """Payload and envelope texts with their identities for one raw event (payload and provenance as objects)."""
    payload = identity.canonical_json(raw["payload"])
    payload_cid = identity.cid(payload.encode())
    document = event_envelope(payload_cid, raw)
    envelope = identity.canonical_json(document)
    digest = identity.sha256_hex(envelope.encode())
    return {"payload_json": payload, "payload_cid": payload_cid, "envelope": envelope, "event_id": f"event:{digest}", "event_cid": identity.CID_PREFIX + digest, "iso": document["time"]["iso"]}


def with_identities(raw: DataFrame) -> DataFrame:
    """Adds payload_json, payload_cid, envelope, event_id, event_cid and iso to rows of RAW_COLUMNS.

    Open JSON decides the identity, so this is the one place where rows pass
    through Python, in Arrow batches.
    """
    ship_package(raw.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                row["payload"] = json.loads(row["payload"])
                row["provenance"] = json.loads(row["provenance"]) if row["provenance"] else None
                made.append(identify(row))
            names = [c.split()[0] for c in IDENTITY_COLUMNS.split(", ")]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([m[n] for m in made], pa.string()) for n in names)], [*batch.schema.names, *names])

    return raw.mapInArrow(run, f"{RAW_COLUMNS}, {IDENTITY_COLUMNS}")


def pointers(identified: DataFrame) -> DataFrame:
    """Index rows (schemas.EVENT_COLUMNS) of identified events: prefix keys, time keys, root."""
    ts = F.to_timestamp("iso")
    lists = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    return identified.select(
        "seq", "event_id", "event_cid", "payload_cid", ts.alias("observed_at"), paths.time_path(ts).alias("time_path"), paths.time_keys(ts).alias("time_keys"),
        "actor_path", paths.prefix_keys(F.col("actor_path")).alias("actor_keys"), "channel_path", paths.prefix_keys(F.col("channel_path")).alias("channel_keys"), "value_kind",
        lists("parent_event_ids").alias("parent_event_ids"), F.coalesce(F.nullif(F.col("root_event_id"), F.lit("")), F.col("event_id")).alias("root_event_id"),
        lists("input_event_ids").alias("input_event_ids"), lists("output_artifact_ids").alias("output_artifact_ids"), paths.hour_shard(ts).alias("shard_path"),
    )


def irc_events(messages: DataFrame) -> DataFrame:
    """RAW_COLUMNS of chat messages (seq, server, room, nick, message, raw, observed_at)."""
    texts = {"kind": F.lit("raw-payload"), "schema": F.lit("raw-irc-v0.1"), "transport": F.lit("irc"), "observedAt": F.col("observed_at")} | {c: F.col(c) for c in ("server", "room", "nick", "message", "raw")}
    none = F.array().cast("array<string>")
    return messages.select(
        "seq", identity.sorted_json(**texts).alias("payload"), "observed_at",
        F.array(F.lit("irc"), F.col("server"), F.lit("user"), F.col("nick")).alias("actor_path"), F.array(F.lit("irc"), F.col("server"), F.lit("channel"), F.col("room")).alias("channel_path"),
        F.lit("message").alias("value_kind"), F.lit("application/json").alias("content_type"), F.substring("message", 1, 160).alias("preview"),
        F.lit(identity.canonical_json(UNKNOWN_PROVENANCE | {"source": "irc"})).alias("provenance"),
        none.alias("parent_event_ids"), F.lit(None).cast("string").alias("root_event_id"), none.alias("input_event_ids"), none.alias("output_artifact_ids"),
    )


def conflict_acks(batch: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """The batch's rows with ack: 'accepted', 'duplicate-event-id' or 'duplicate-event-cid', in seq order, first write wins.

    Distinct (id, CID) pairs are judged at their first row. One id with many
    CIDs, or one CID with many ids, accepts its first pair; that is an
    aggregate. Only where ids and CIDs are tied both ways are the pairs of a
    connected tie folded in order, because a row rejected for its CID doesn't
    reserve its id. ``held`` are rows accepted before; they come first.
    """
    rows = batch.withColumn("__late", F.lit(True))
    if held is not None:
        rows = rows.unionByName(held.select(batch.columns).withColumn("__late", F.lit(False)))
    pairs = rows.groupBy("event_id", "event_cid").agg(F.min(F.struct(F.col("__late").alias("late"), F.col("seq").alias("seq"))).alias("at"))
    per_id = pairs.groupBy("event_id").agg(F.count(F.lit(1)).alias("cids"), F.min("at").alias("id_at"))
    per_cid = pairs.groupBy("event_cid").agg(F.count(F.lit(1)).alias("ids"), F.min("at").alias("cid_at"))
    known = materialize(pairs.join(per_id, "event_id").join(per_cid, "event_cid"), "conflicts")
    widest_id = known.groupBy("event_id").agg(F.max("ids").alias("most_ids"))
    widest_cid = known.groupBy("event_cid").agg(F.max("cids").alias("most_cids"))
    known = known.join(widest_id, "event_id").join(widest_cid, "event_cid")
    by_cid, by_id = F.col("most_cids") == 1, F.col("most_ids") == 1
    fate = F.when(by_cid, F.when(F.col("at") == F.col("cid_at"), "accepted").otherwise("duplicate-event-cid")).when(by_id, F.when(F.col("at") == F.col("id_at"), "accepted").otherwise("duplicate-event-id"))
    judged = materialize(known.select("event_id", "event_cid", "at", fate.alias("fate")), "judged")
    tied = judged.where("fate is null")
    fates = judged.where("fate is not null")
    if not tied.isEmpty():
        fates = fates.unionByName(_fold_ties(tied))
    own = fates.where("fate = 'accepted'").select("event_id", F.col("at").alias("own_at"))
    joined = rows.where("__late").join(fates, ["event_id", "event_cid"]).join(own, "event_id", "left")
    here = F.struct(F.col("__late").alias("late"), F.col("seq").alias("seq"))
    ack = F.when(here == F.col("at"), F.col("fate")).when(F.col("own_at") < here, F.lit("duplicate-event-id")).otherwise(F.lit("duplicate-event-cid"))
    return joined.select(*batch.columns, ack.alias("ack"))


def _fold_ties(tied: DataFrame) -> DataFrame:
    """event_id, event_cid, at, fate of pairs that are tied both ways, each connected tie folded in order."""
    ship_package(tied.sparkSession)
    node = lambda mark, c: F.concat(F.lit(mark), F.col(c))
    roots = components(tied.select(node("i", "event_id").alias("a"), node("c", "event_cid").alias("b")))
    dealt = tied.select("event_id", "event_cid", F.col("at.late").alias("late"), F.col("at.seq").alias("seq"), node("i", "event_id").alias("id")).join(roots, "id")

    def fold(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("late", "seq", "event_id", "event_cid")])
        ids: set[str] = set()
        cids: set[str] = set()
        fate = []
        for id_, cid_ in zip(table.column("event_id").to_pylist(), table.column("event_cid").to_pylist(), strict=True):
            fate.append("duplicate-event-id" if id_ in ids else "duplicate-event-cid" if cid_ in cids else "accepted")
            if fate[-1] == "accepted":
                ids.add(id_)
                cids.add(cid_)
        return table.select(["event_id", "event_cid", "late", "seq"]).append_column("fate", pa.array(fate, pa.string()))

    folded = dealt.groupBy("root").applyInArrow(fold, "event_id string, event_cid string, late boolean, seq long, fate string")
    return folded.select("event_id", "event_cid", F.struct("late", "seq").alias("at"), "fate")


def accepted(batch: DataFrame, held: DataFrame | None = None) -> DataFrame:
    return conflict_acks(batch, held).where("ack = 'accepted'").drop("ack")


def resolve_roots(events: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """root_event_id of events that name none: the root of their first parent, or themselves without a known parent.

    Chains inside the batch are followed by pointer jumping: each round joins
    every event with its current ancestor's ancestor, so a chain of n events
    takes log2(n) rounds.
    """
    parent = F.try_element_at("parent_event_ids", F.lit(1))
    given = F.nullif(F.col("root_event_id"), F.lit(""))
    here = events.select("event_id", parent.alias("up"), given.alias("root"))
    if known is not None:
        old = known.select(F.col("event_id").alias("up"), F.col("root_event_id").alias("known_root"))
        here = here.join(old, "up", "left").select("event_id", "up", F.coalesce("root", "known_root").alias("root"))
    # an event with a root of its own, or whose parent isn't in the batch, ends its chain
    ids = events.select(F.col("event_id").alias("up"), F.lit(True).alias("inside"))
    now = here.join(ids, "up", "left").select("event_id", F.when(F.col("root").isNull() & F.col("inside"), F.col("up")).alias("up"), F.when(F.col("root").isNotNull(), F.col("root")).when(F.col("inside").isNull(), F.col("event_id")).alias("root"))
    now = materialize(now, "roots")
    rounds = now.count().bit_length() + 1
    while not now.where("root is null").isEmpty():
        if rounds == 0:
            raise ValueError("a cycle of parents has no root")
        rounds -= 1
        far = now.select(F.col("event_id").alias("up"), F.col("up").alias("up2"), F.col("root").alias("root2"))
        after = materialize(now.join(far, "up", "left").select("event_id", F.when(F.col("root").isNull(), F.col("up2")).alias("up"), F.coalesce("root", "root2").alias("root")), "roots")
        discard(now)
        now = after
    return events.drop("root_event_id").join(now.select("event_id", F.col("root").alias("root_event_id")), "event_id").select(events.columns)


def parent_edges(events: DataFrame) -> DataFrame:
    """parent, child, seq, pos: repeated parents stay."""
    return events.select("seq", F.col("event_id").alias("child"), F.posexplode("parent_event_ids").alias("pos", "parent")).select("parent", "child", "seq", "pos")
