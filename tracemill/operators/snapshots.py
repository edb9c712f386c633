"""Hour shards: dense local ids, posting tokens, edges and their manifest.

A snapshot is a set of frames over one shard or, with ``shard=None``, over all
shards at once, partitioned by shard_path. Mining reads these frames and
never payloads.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import identity
from tracemill.functions.paths import leaf_key
from tracemill.operators import artifacts as art
from tracemill.operators.events import parent_edges
from tracemill.schemas import EVENT_COLUMNS
from tracemill.scratch import materialize


@dataclass(frozen=True)
class Snapshot:
    """events: with local_id, actor_key, channel_key; tokens(shard_path, token, local_id); edges(shard_path, parent, child, seq, pos);
    claims(event_id, occurrence_id, claim_id, seq) and features likewise. ``placed``, where artifacts were given: the occurrences of both
    with the places of their events, as ``_placed`` makes them."""

    shard: str | None
    events: DataFrame
    tokens: DataFrame
    edges: DataFrame
    claims: DataFrame
    features: DataFrame
    placed: DataFrame | None = None


def affected_shards(events: DataFrame) -> DataFrame:
    return events.select("shard_path").distinct()


#: Rows of the largest shard up to which a shard is numbered in one task, rows of a part of a larger one, and its parts at most.
SHARD_ROWS, PART_ROWS, SHARD_PARTS = 100_000, 1 << 14, 200


def with_local_ids(events: DataFrame) -> DataFrame:
    """Adds local_id: 1, 2, ... by seq in each shard.

    Where a shard has more than SHARD_ROWS rows, shards are cut into parts at
    approximate quantiles of seq. Parts are numbered within them, so a shard of
    any size spreads over tasks; the rows of earlier parts, a count each, say
    where a part goes on. Columns that nobody asks for are not computed for it.
    """
    rows = F.count(F.lit(1)).alias("n")
    largest = events.groupBy("shard_path").agg(rows).agg(F.max("n").alias("n")).first().n or 0
    if largest <= SHARD_ROWS:
        return events.withColumn("local_id", F.row_number().over(Window.partitionBy("shard_path").orderBy("seq")).cast("long"))
    n = min(SHARD_PARTS, -(-largest // PART_ROWS))
    quantiles = F.percentile_approx("seq", [k / n for k in range(1, n)] or [0.5])
    cuts = materialize(events.groupBy(F.col("shard_path").alias("__shard")).agg(F.array_distinct(quantiles).alias("__cuts")), "cuts")
    parted = lambda df: df.join(cuts, F.col("shard_path").eqNullSafe(F.col("__shard")), "left").withColumn("__part", F.size(F.filter("__cuts", lambda c: c <= F.col("seq")))).drop("__shard", "__cuts")
    sizes = parted(events.select("shard_path", "seq")).groupBy("shard_path", "__part").agg(rows)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard_path").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = materialize(sizes.select(F.col("shard_path").alias("__shard"), F.col("__part").alias("__range"), before.alias("__before")), "begins")
    place = F.row_number().over(Window.partitionBy("shard_path", "__part").orderBy("seq"))
    placed = parted(events).withColumn("__place", place).join(begins, F.col("shard_path").eqNullSafe(F.col("__shard")) & (F.col("__part") == F.col("__range")))
    return placed.select(*events.columns, (F.col("__before") + F.col("__place")).cast("long").alias("local_id"))


def _occurrences(artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(family, event_id, occurrence_id, node, seq of claim and feature occurrences; feature_id, feature_type), both stored.

    Stored before they are joined: a join asks for an id that is not null, and
    so would have every pointer built and parsed once more.
    """
    family = F.col("family")
    node = F.when(family == "claim-occurrence", art.field("claimId")).otherwise(art.field("featureId"))
    found = artifacts.where(family.isin("claim-occurrence", "feature-occurrence")).select("family", art.field("sourceEventId").alias("event_id"), F.col("id").alias("occurrence_id"), node.alias("node"), "seq")
    types = artifacts.where(family == "feature").select(F.col("id").alias("feature_id"), art.field("featureType").alias("feature_type")).distinct()  # a feature is written once for each document that has it
    with ThreadPoolExecutor(1) as pool:
        drawn = pool.submit(materialize, types, "types")
        return materialize(found, "occurrences"), drawn.result()


def _placed(occurrences: DataFrame, ids: DataFrame) -> DataFrame:
    """Occurrences with shard_path and local_id, a row for each place of their event; nth and nth_here count its places, in all and in the shard."""
    places = Window.partitionBy("event_id").orderBy("shard_path", "local_id")
    here = Window.partitionBy("event_id", "shard_path").orderBy("local_id")
    seen = ids.select("event_id", "shard_path", "local_id").repartition("event_id").withColumn("nth", F.row_number().over(places)).withColumn("nth_here", F.row_number().over(here))
    return occurrences.join(seen.hint("merge"), "event_id")


def _named(events: DataFrame) -> DataFrame:
    """The events of a snapshot: numbered, with the keys of their paths."""
    return with_local_ids(events).withColumn("actor_key", leaf_key(F.col("actor_keys"))).withColumn("channel_key", leaf_key(F.col("channel_keys")))


def _snapshot(shard: str | None, events: DataFrame, ev: DataFrame, ids: DataFrame, drawn: tuple[DataFrame, DataFrame] | None) -> Snapshot:
    """The snapshot of events, the same named, ``ids`` (some columns of those, where they are cheap to read again) and what ``_occurrences`` draws."""
    named = F.array(F.concat(F.lit("event.kind:"), "value_kind"), F.concat(F.lit("actor:"), "actor_key"), F.concat(F.lit("channel:"), "channel_key"), F.concat(F.lit("root:"), "root_event_id"))
    tokens = ids.select("shard_path", F.explode(F.array_distinct(named)).alias("token"), "local_id")
    edges = parent_edges(events).join(ids.select(F.col("event_id").alias("child"), "shard_path"), "child").select("shard_path", "parent", "child", "seq", "pos")
    if drawn is None:
        none = ev.sparkSession.createDataFrame([], "event_id string, occurrence_id string, claim_id string, seq long")
        return Snapshot(shard, ev, tokens, edges, none, none.withColumnRenamed("claim_id", "feature_id"))
    occurrences, types = drawn
    placed = materialize(_placed(occurrences, ids), "placed")
    said, seen = (placed.where(F.col("family") == f) for f in ("claim-occurrence", "feature-occurrence"))
    written = said.select("shard_path", F.explode(F.array(F.concat(F.lit("claim:"), "node"), F.lit("artifact.kind:claim-occurrence"))).alias("token"), "local_id")
    both = F.array_compact(F.array(F.concat(F.lit("feature:"), "node"), F.concat(F.lit("feature.type:"), "feature_type")))
    typed = seen.join(types, F.col("node") == F.col("feature_id"), "left")
    written = _dealt(written.unionByName(typed.select("shard_path", F.explode(both).alias("token"), "local_id"))).distinct().drop("part")
    once = lambda rows, name: rows.where("nth = 1").select("event_id", "occurrence_id", F.col("node").alias(name), "seq")
    return Snapshot(shard, ev, tokens.unionByName(written), edges, once(said, "claim_id"), once(seen, "feature_id"), placed)


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of a shard and a part of its local ids in one task, for which nothing is sampled."""
    return rows.withColumn("part", F.floor((F.col("local_id") - 1) / PART_ROWS)).repartition("shard_path", "part")


def build(events: DataFrame, artifacts: DataFrame | None = None, shard: str | None = None) -> Snapshot:
    """The snapshot of a shard (any time prefix: its events are those with that time key), or of every hour shard."""
    if shard is not None:
        events = events.where(F.array_contains("time_keys", shard)).withColumn("shard_path", F.lit(shard))
    ev = _named(events)
    ids = ev.select("event_id", "shard_path", "local_id", "value_kind", "actor_key", "channel_key", "root_event_id")
    if artifacts is None:
        return _snapshot(shard, events, ev, ids, None)
    return _snapshot(shard, events, ev, materialize(ids, "ids"), _occurrences(artifacts))  # several parts read the ids


def posting_lists(snapshot: Snapshot) -> DataFrame:
    """shard_path, token, n, local_ids (ascending)."""
    drawn = snapshot.tokens.groupBy("shard_path", "token").agg(F.array_sort(F.collect_list("local_id")).alias("local_ids"))
    return drawn.select("shard_path", "token", F.size("local_ids").cast("long").alias("n"), "local_ids")


def events_by_root(snapshot: Snapshot) -> DataFrame:
    """shard_path, root_event_id, event_ids in order."""
    drawn = snapshot.events.groupBy("shard_path", "root_event_id").agg(F.array_sort(F.collect_list(F.struct("local_id", "event_id"))).alias("e"))
    return drawn.select("shard_path", "root_event_id", F.transform("e", lambda x: x["event_id"]).alias("event_ids"))


#: Columns of the parts of a stored snapshot.
LAYOUTS = {
    "events": f"{EVENT_COLUMNS.removesuffix(', shard_path string')}, local_id long, actor_key string, channel_key string, shard_path string",
    "tokens": "token string, local_id long, shard_path string",
    "edges": "parent string, child string, seq long, pos int, shard_path string",
    "claims": "event_id string, occurrence_id string, claim_id string, seq long, shard_path string",
    "features": "event_id string, occurrence_id string, feature_id string, seq long, shard_path string",
}


def _part(rows: DataFrame, name: str, path: str, mode: str = "overwrite") -> None:
    """Store one part of a snapshot; to overwrite replaces only the shards present."""
    named = rows.select(*(c.split()[0] for c in LAYOUTS[name].split(", ")))
    named.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("shard_path").parquet(f"{path}/{name}")


def _parts(snapshot: Snapshot) -> dict[str, DataFrame]:
    """What is stored besides the events. Tokens lie as their events were numbered, so a small shard is written by few tasks; the others are dealt anew."""
    if snapshot.placed is None:
        places = snapshot.events.select("event_id", "shard_path", "local_id")
        claims, features = snapshot.claims.join(places, "event_id"), snapshot.features.join(places, "event_id")
    else:
        here = snapshot.placed.where("nth_here = 1")
        claims = here.where("family = 'claim-occurrence'").withColumnRenamed("node", "claim_id")
        features = here.where("family = 'feature-occurrence'").withColumnRenamed("node", "feature_id")
    return {"tokens": snapshot.tokens, "claims": _dealt(claims), "features": _dealt(features), "edges": snapshot.edges.repartitionByRange("shard_path", "seq")}


def write(snapshot: Snapshot, path: str) -> None:
    """All parts as Parquet, partitioned by shard, replacing only the shards present. A large shard is written by several tasks."""
    parts = {"events": snapshot.events} | _parts(snapshot)
    with ThreadPoolExecutor(len(parts)) as pool:  # one part's last tasks leave cores to the next
        list(pool.map(lambda name: _part(parts[name], name, path), parts))


def store(events: DataFrame, artifacts: DataFrame, path: str) -> None:
    """Build and write the snapshot of every hour shard to a path that holds none yet.

    The events are read once and stored as they are numbered, each part of a
    shard by its task, while the occurrences are drawn; all else is made of
    the stored events.
    """
    ev = _named(events)
    with ThreadPoolExecutor(4) as pool:
        put = pool.submit(_part, ev, "events", path, "errorifexists")  # the longest, so first
        drawn = _occurrences(artifacts)
        put.result()
        held = _held(ev.sparkSession, path, "events")
        parts = _parts(_snapshot(None, held, held, held, drawn))
        list(pool.map(lambda name: _part(parts[name], name, path), parts))


def _held(spark, path: str, name: str) -> DataFrame:
    return spark.read.schema(LAYOUTS[name]).parquet(f"{path}/{name}")


def read(spark, path: str, shard: str | None = None) -> Snapshot:
    """A written snapshot with its claims and features; a shard reads its own partition alone."""
    pick = lambda df: df if shard is None else df.where(F.col("shard_path") == shard)
    parts = {n: pick(_held(spark, path, n)) for n in LAYOUTS}
    return Snapshot(shard, parts["events"], parts["tokens"], parts["edges"], parts["claims"].drop("shard_path"), parts["features"].drop("shard_path"))


def components(snapshot: Snapshot) -> dict:
    """The six component documents of one shard: its size is the shard's, so only for a shard that a driver can hold."""
    if snapshot.shard is None:
        raise ValueError("components belong to one shard")
    rows = snapshot.events.orderBy("local_id").collect()
    by_root: dict[str, list[str]] = {}
    columns: dict[str, dict] = {}
    for r in rows:
        by_root.setdefault(r.root_event_id, []).append(r.event_id)
        columns[r.event_id] = {
            "localId": r.local_id, "eventId": r.event_id, "eventCid": r.event_cid, "payloadCid": r.payload_cid, "eventKind": r.value_kind, "actorKey": r.actor_key, "channelKey": r.channel_key,
            "rootEventId": r.root_event_id, "timePath": list(r.time_path), "inputEventIds": list(r.input_event_ids), "outputArtifactIds": list(r.output_artifact_ids),
        }
    listed = lambda frame: {r.event_id: [] for r in rows} | {e: [o for _, o in sorted(v)] for e, v in _grouped(frame).items()}
    return {
        "eventDictionary": {"kind": "event-dictionary", "schema": "event-dictionary-v0.1", "eventIdToLocalId": {r.event_id: r.local_id for r in rows}, "localIdToEventId": {str(r.local_id): r.event_id for r in rows}},
        "eventColumns": {"eventIds": [r.event_id for r in rows], "events": columns, "eventsByRoot": by_root},
        "postings": {r.token: list(r.local_ids) for r in posting_lists(snapshot).collect()},
        "provenanceEdges": {"kind": "provenance-edges", "schema": "provenance-edges-v0.1", "parentEdges": [{"parentEventId": e.parent, "childEventId": e.child} for e in snapshot.edges.orderBy("seq", "pos").collect()]},
        "claimOccurrences": listed(snapshot.claims),
        "featureOccurrences": listed(snapshot.features),
    }


def _grouped(frame: DataFrame) -> dict[str, list[tuple[int, str]]]:
    out: dict[str, list[tuple[int, str]]] = {}
    for r in frame.collect():
        out.setdefault(r.event_id, []).append((r.seq, r.occurrence_id))
    return out


def manifest(shard: str, parts: dict) -> dict:
    """The manifest document that a snapshot's CID hashes."""
    cids = {f"{name}Cid": identity.cid(identity.canonical_json(part).encode()) for name, part in parts.items()}
    return {"kind": "mining-snapshot", "schema": "mining-snapshot-v0.1", "shardPath": shard, "sourceContract": "reference-event-trace-index", "sourceQuery": {"type": "timePrefix", "prefixKey": shard}, "rawPayloadsScanned": False} | cids
