"""Queries over patterns, reasoning, look-ups, stored snapshots, facts, metrics, privacy and objects, each beside its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import deltas, identity
from tracemill.operators import artifacts as art
from tracemill.operators import batches, facts, metrics, mining, privacy, snapshots
from tracemill.operators import postings as px
from tracemill.registry import D, E, P, query
from tracemill.scratch import materialize, scratch_path
from tracemill.sources import objects, tables

_CID = "'cidv0-local-sha256:' || sha256("

#: Patterns of event kinds with their runs and occurrences, in SQL.
MINED = E + f""", kinds AS (
    SELECT kind, min(seq) AS seq, {_CID}'shard of ' || kind) AS snapshot, CASE WHEN length(kind) % 2 = 0 THEN 'sequence' ELSE 'itemset' END AS type FROM e GROUP BY kind
), runs AS (SELECT *, 'run:' || sha256('{{"completedAt":"t","config":{{}},"inputEventIds":[],"inputSnapshotCids":["' || snapshot || '"],"kind":"run","outputArtifactIds":[],"runType":"pattern-mining","schema":"run-v0.1","startedAt":"t","status":"success","tool":{{"name":"m"}}}}') AS run_id FROM kinds
), patterns AS (SELECT *, 'pattern:' || sha256('{{"body":[{{"eventKind":"' || kind || '"}}],"constraints":{{}},"kind":"pattern","patternType":"' || type || '","schema":"pattern-core-v0.1"}}') AS pattern_id FROM runs
), occ AS (SELECT e.seq, p.pattern_id, p.run_id, e.root, 'pattern-occ:' || sha256('{{"kind":"pattern-occurrence","minedBy":"' || run_id || '","participatingClaimOccurrenceIds":[],"participatingEventIds":["' || e.event_id || '"],"participatingRunIds":[],"patternId":"' || pattern_id || '","rootEventId":"' || e.root || '","schema":"pattern-occurrence-v0.1"}}') AS id
    FROM e JOIN patterns p USING (kind))"""

#: Reasoning over conversations, in SQL.
REASONED = """turns AS (
    SELECT conv_id, turn, conv_id * 1000 + turn AS seq, 'claim:' || conv_id AS claim_id, 'ccid:' || conv_id AS claim_cid, 'run:' || (conv_id % 7) AS run_id FROM conversations WHERE role = 'assistant'
), inputs AS (
    SELECT claim_id, min(seq) AS seq, sha256('{"claimCid":"' || claim_cid || '","claimId":"' || claim_id || '","kind":"reasoning-input","schema":"nal-plr-input-v0.1"}') AS digest FROM turns GROUP BY claim_id, claim_cid
), outputs AS (
    SELECT t.*, 'reasoning-input:' || digest AS input_id, 'reasoning-output:' || sha256('{"beliefStateId":"belief-state:' || seq || '","claimId":"' || claim_id || '","evidenceOccurrenceIds":[],"inputCid":"cidv0-local-sha256:' || digest || '","inputId":"reasoning-input:' || digest || '","kind":"reasoning-output","reasoningRunId":"' || run_id
        || '","revisionPolicy":"last","schema":"reasoning-output-v0.1","truthValue":{"confidence":0.5,"frequency":1}}') AS id FROM turns t JOIN (SELECT claim_id, digest FROM inputs) USING (claim_id)
), histories AS (
    SELECT claim_id, min(seq) AS seq, list(id ORDER BY seq) AS outputs, 'belief-revision-history:' || sha256('{"claimId":"' || claim_id || '","kind":"belief-revision-history","revisionPolicy":"last","schema":"belief-revision-history-v0.1","states":[' || string_agg('{"outputId":"' || id || '"}', ',' ORDER BY seq) || ']}') AS id FROM outputs GROUP BY claim_id)"""


def mined_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mining run and a pattern for each event kind, and an occurrence for each event."""
    events = tables.events(spark, sf_dir).select("seq", "event_id", F.col("root_event_id").alias("rootEventId"), F.col("value_kind").alias("kind"))
    kind, none = F.col("kind"), F.array().cast("array<string>")
    named = F.array(identity.cid_column(F.concat(F.lit("shard of "), kind))).alias("inputSnapshotCids")
    kinds = events.groupBy("kind").agg(F.min("seq").alias("seq")).select("seq", "kind", named, F.when(F.length("kind") % 2 == 0, "sequence").otherwise("itemset").alias("patternType"))
    at = {"startedAt": F.lit("t"), "completedAt": F.lit("t"), "status": F.lit("success"), "tool": F.lit('{"name": "m"}'), "config": F.lit("{}"), "inputEventIds": none, "outputArtifactIds": none}
    runs = art.with_role_keys(kinds.withColumns(at | {"runType": F.lit("pattern-mining"), "actorKey": F.concat(F.lit("miner/"), kind)}))
    runs = art.rows_of("run", runs)
    by_kind = kinds.join(runs.select("seq", F.col("id").alias("minedBy")), "seq")
    core = F.concat(F.lit('{"body":[{"eventKind":"'), kind, F.lit('"}],"constraints":{},"kind":"pattern","patternType":"'), F.col("patternType"), F.lit('","schema":"pattern-core-v0.1"}'))
    patterns = by_kind.withColumns({"core": core, "minerKey": F.concat(F.lit("miner/"), kind), "supportVector": F.lit('{"eventSupport":1}')})
    made = materialize(art.rows_of("pattern", patterns).unionByName(runs), "patterns")
    known = by_kind.join(made.where("family = 'pattern'").select("seq", F.col("id").alias("patternId")), "seq").select("kind", "minedBy", "patternId")
    found = events.join(known, "kind").withColumns({"participatingEventIds": F.array("event_id"), "participatingRunIds": none, "participatingClaimOccurrenceIds": none})
    return made.unionByName(art.rows_of("pattern-occurrence", found))


def reasoned_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An input and a revision history for each conversation, an output for each of its assistant's turns, and a run for each seventh."""
    turns = tables.table(spark, sf_dir, "conversations").where("role = 'assistant'")
    conv, none = F.col("conv_id").cast("string"), F.array().cast("array<string>")
    turns = turns.select((F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("seq"), F.concat(F.lit("claim:"), conv).alias("claimId"), F.concat(F.lit("ccid:"), conv).alias("claimCid"), F.concat(F.lit("run:"), (F.col("conv_id") % 7).cast("string")).alias("reasoningRunId"))
    core = F.concat(F.lit('{"claimCid":"'), "claimCid", F.lit('","claimId":"'), "claimId", F.lit('","kind":"reasoning-input","schema":"nal-plr-input-v0.1"}'))
    given = turns.groupBy("claimId", "claimCid").agg(F.min("seq").alias("seq")).withColumns({"core": core, "evidenceOccurrenceIds": none, "supportVector": F.lit("{}"), "derivedFromPatterns": none})
    inputs = materialize(art.rows_of("reasoning-input", given), "inputs")
    known = inputs.select(art.field("claimId").alias("claimId"), F.col("id").alias("inputId"), F.col("cid").alias("inputCid"))
    answers = turns.join(known, "claimId").withColumns({"beliefStateId": F.concat(F.lit("belief-state:"), F.col("seq").cast("string")), "evidenceOccurrenceIds": none, "revisionPolicy": F.lit("last"), "truthValue": F.lit('{"frequency": 1, "confidence": 0.5}')})
    outputs = materialize(art.rows_of("reasoning-output", answers), "outputs")
    listed = outputs.groupBy(art.field("claimId").alias("claimId")).agg(F.min("seq").alias("first"), F.array_sort(F.collect_list(F.struct("seq", "id"))).alias("o"))
    told = listed.select(F.col("first").alias("seq"), "claimId", F.lit("last").alias("revisionPolicy"), F.transform("o", lambda x: x["id"]).alias("outputIds"), F.to_json(F.transform("o", lambda x: F.struct(x["id"].alias("outputId")))).alias("states"))
    return inputs.unionByName(outputs).unionByName(art.rows_of("belief-revision-history", told))


# reverse indexes

@query(f"""WITH {MINED}
    SELECT 'patterns_by_type' AS index, type AS key, pattern_id AS id, seq FROM patterns UNION ALL SELECT 'patterns_by_input_snapshot', snapshot, pattern_id, seq FROM patterns UNION ALL SELECT 'patterns_by_miner', 'miner/' || kind, pattern_id, seq FROM patterns
    UNION ALL SELECT 'runs_by_miner', 'miner/' || kind, run_id, seq FROM runs UNION ALL SELECT 'occurrences_by_pattern', pattern_id, id, seq FROM occ UNION ALL SELECT 'occurrences_by_pattern_root', root, id, seq FROM occ
    UNION ALL SELECT 'outputs_by_run', run_id, id, seq FROM occ UNION ALL SELECT 'runs_by_output_artifact', id, run_id, seq FROM occ""")
def pattern_indexes(spark, sf_dir):
    """Patterns by type, snapshot and miner; occurrences by pattern, root and run; runs by miner and output."""
    return px.derived_postings(mined_artifacts(spark, sf_dir)).select("index", "key", "id", "seq")


@query(f"""WITH {REASONED}
    SELECT 'outputs_by_claim' AS index, claim_id AS key, id, seq FROM outputs UNION ALL SELECT 'outputs_by_input', input_id, id, seq FROM outputs UNION ALL SELECT 'outputs_by_reasoning_run', run_id, id, seq FROM outputs
    UNION ALL SELECT 'outputs_by_run', run_id, id, seq FROM outputs UNION ALL SELECT 'runs_by_output_artifact', id, run_id, seq FROM outputs
    UNION ALL SELECT 'histories_by_claim', claim_id, id, seq FROM histories UNION ALL SELECT 'histories_by_output', unnest(outputs), id, seq FROM histories""")
def reasoning_indexes(spark, sf_dir):
    """Outputs by claim, input and run, histories by claim and output."""
    return px.derived_postings(reasoned_artifacts(spark, sf_dir)).select("index", "key", "id", "seq")


@query(f"""WITH {REASONED} SELECT claim_id AS key, len(outputs) AS n, array_to_string(outputs, ',') AS ids FROM histories""")
def reasoning_outputs_in_order(spark, sf_dir):
    postings = px.derived_postings(reasoned_artifacts(spark, sf_dir)).where("index = 'outputs_by_claim'")
    return px.ordered_lists(postings).select("key", "n", F.array_join("ids", ",").alias("ids"))


@query(f"""WITH {E}, r AS (SELECT 'reasoner/' || user_id AS key, 'run:' || sha256('{{"completedAt":"t","config":{{"a":1,"b":0.25}},"inputEventIds":["' || 'event:' || event_id || '"],"inputSnapshotCids":[],"kind":"run","outputArtifactIds":["out:' || event_id || '"],"runType":"reasoning","schema":"run-v0.1","startedAt":"t","status":"success","tool":{{"name":"x"}}}}') AS id, event_id FROM events)
    SELECT 'runs_by_reasoner' AS index, key, id, event_id AS seq FROM r UNION ALL SELECT 'runs_by_input_event', 'event:' || event_id, id, event_id FROM r
    UNION ALL SELECT 'runs_by_output_artifact', 'out:' || event_id, id, event_id FROM r UNION ALL SELECT 'outputs_by_run', id, 'out:' || event_id, event_id FROM r""")
def recorded_runs(spark, sf_dir):
    """Runs as they are recorded: role keys from the run type, open JSON spelt canonically, and their indexes."""
    rows = tables.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.lit("reasoning").alias("runType"), F.concat(F.lit("reasoner/"), F.col("user_id").cast("string")).alias("actorKey"), F.array(F.concat(F.lit("event:"), F.col("event_id").cast("string"))).alias("inputEventIds"))
    rows = rows.withColumns({"inputSnapshotCids": F.array().cast("array<string>"), "outputArtifactIds": F.array(F.concat(F.lit("out:"), F.col("seq").cast("string"))), "tool": F.lit('{"name":"x"}'), "config": F.lit('{"b": 2.5e-1, "a": 1}'), "startedAt": F.lit("t"), "completedAt": F.lit("t"), "status": F.lit("success")})
    return px.derived_postings(art.rows_of("run", art.with_role_keys(rows))).select("index", "key", "id", "seq")


@query(f"""WITH {D} SELECT DISTINCT 'feature-occ:' || sha256('{{"confidence":0.5,"evidence":{{"at":[' || seq || ',0.1]}},"extractionRunId":"r","featureCid":"c","featureId":"f","kind":"feature-occurrence","schema":"feature-occurrence-v0.1","sourceEventId":"' || event_id || '"}}') AS id,
    'claim-occ:' || sha256('{{"claimCid":"c","claimId":"k","confidence":0.75,"evidence":{{"at":[' || seq || ',0.1]}},"extractionRunId":"r","kind":"claim-occurrence","polarity":"' || polarity || '","provenance":{{}},"schema":"claim-occurrence-v0.1","sourceEventCid":"e","sourceEventId":"' || event_id || '","sourcePayloadCid":"p"}}') AS claim_id,
    'claim-cluster:' || sha256('{{"confidence":1.0,"kind":"claim-cluster","members":["' || event_id || '","k"],"method":{{"m":"x"}},"relation":"near","schema":"claim-cluster-v0.1"}}') AS cluster_id, seq FROM f""")
def occurrence_identities(spark, sf_dir):
    """Identities of claim and feature occurrences and clusters with floats and open JSON, written by rows."""
    docs = tables.labelled(spark, sf_dir)
    event = F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))
    shared = {"sourceEventId": event, "extractionRunId": F.lit("r"), "evidence": F.concat(F.lit('{"at": ['), F.col("doc_id").cast("string"), F.lit(", 1e-1]}"))}
    base = docs.select(F.col("doc_id").alias("seq"), "doc_id", F.when(F.col("toxic") == 1, "denied").otherwise("asserted").alias("polarity"))
    of = lambda family, fields: art.rows_of(family, base.withColumns(fields)).select("seq", "id")
    seen = of("feature-occurrence", shared | {"featureId": F.lit("f"), "featureCid": F.lit("c"), "confidence": F.lit(0.5)})
    said = of("claim-occurrence", shared | {"claimId": F.lit("k"), "claimCid": F.lit("c"), "confidence": F.lit(0.75), "provenance": F.lit("{}"), "sourceEventCid": F.lit("e"), "sourcePayloadCid": F.lit("p")})
    near = of("claim-cluster", {"relation": F.lit("near"), "members": F.array(event, F.lit("k")), "method": F.lit('{"m":"x"}'), "confidence": F.lit(1.0)})
    return seen.join(said.withColumnRenamed("id", "claim_id"), "seq").join(near.withColumnRenamed("id", "cluster_id"), "seq")


# look-ups by id

@query(f"""WITH {MINED}, {REASONED}, ids AS (
    SELECT 'run' AS family, run_id AS id FROM runs UNION SELECT 'pattern', pattern_id FROM patterns UNION SELECT 'pattern-occurrence', id FROM occ
    UNION SELECT 'reasoning-input', 'reasoning-input:' || digest FROM inputs UNION SELECT 'reasoning-output', id FROM outputs UNION SELECT 'belief-revision-history', id FROM histories)
    SELECT family, id, true AS found, 'cidv0-local-sha256:' || split_part(id, ':', 2) AS cid FROM ids UNION ALL SELECT DISTINCT family, 'none:1', false, '' FROM ids""")
def artifact_lookups(spark, sf_dir):
    """Every artifact of six families by its id, and an id that no family holds."""
    held = mined_artifacts(spark, sf_dir).unionByName(reasoned_artifacts(spark, sf_dir))
    wanted = held.select("family", "id").unionByName(held.select("family", F.lit("none:1").alias("id")))
    return art.get_many(held, wanted).select("family", "id", "found", F.coalesce("cid", F.lit("")).alias("cid"))


@query(f"""WITH {D}, ids AS (SELECT 'run' AS family, run_id AS id FROM f UNION SELECT 'claim', claim_id FROM f UNION SELECT 'claim-occurrence', occurrence_id FROM f UNION SELECT 'feature', feature_id FROM f UNION SELECT 'feature-occurrence', feature_occurrence_id FROM f)
    SELECT family, id, true AS found FROM ids UNION ALL SELECT 'claim-cluster', 'none:1', false""")
def extracted_lookups(spark, sf_dir):
    """Every run, claim, feature and occurrence of extraction by its id, and an unknown cluster."""
    held = tables.artifacts(spark, sf_dir)
    wanted = held.select("family", "id").unionByName(spark.range(1).select(F.lit("claim-cluster").alias("family"), F.lit("none:1").alias("id")))
    return art.get_many(held, wanted).select("family", "id", "found")


@query(f"""WITH {E} SELECT event_id, true AS found, payload_cid FROM e WHERE seq % 3 = 0 UNION ALL SELECT 'event:none', false, ''""")
def event_lookups(spark, sf_dir):
    events = tables.events(spark, sf_dir)
    wanted = events.where("seq % 3 = 0").select("event_id").unionByName(spark.range(1).select(F.lit("event:none").alias("event_id")))
    return px.get_many_events(events, wanted).select("event_id", "found", F.coalesce("payload_cid", F.lit("")).alias("payload_cid"))


# snapshots with claims and features

SNAPSHOT = D + """, l AS (SELECT doc_id AS seq, row_number() OVER (ORDER BY doc_id) AS local_id FROM documents)"""


@query(f"""WITH {SNAPSHOT}, k AS (SELECT DISTINCT local_id, unnest(['claim:' || claim_id, 'artifact.kind:claim-occurrence', 'feature:' || feature_id, 'feature.type:topic']) AS token FROM f JOIN l USING (seq))
    SELECT token, count(*) AS n, min(local_id) AS least, max(local_id) AS most, CAST(sum(local_id) AS BIGINT) AS total FROM k GROUP BY token""")
def snapshot_artifact_tokens(spark, sf_dir):
    """Postings of claims, features and their kinds in the shard of all documents."""
    snap = snapshots.build(tables.document_events(spark, sf_dir), tables.artifacts(spark, sf_dir))
    rows = snap.tokens.where("token like 'claim:%' or token like 'artifact.kind:%' or token like 'feature%'")
    return rows.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("local_id").alias("least"), F.max("local_id").alias("most"), F.sum("local_id").alias("total"))


def _stored(spark: SparkSession, sf_dir: str) -> snapshots.Snapshot:
    """The documents' snapshot, written and read again."""
    path = scratch_path(spark, "snapshot")
    snapshots.store(tables.document_events(spark, sf_dir), tables.artifacts(spark, sf_dir), path)
    return snapshots.read(spark, path)


@query(f"""WITH {D} SELECT event_id AS root_event_id, event_id AS event_ids, occurrence_id AS claim_occurrence_ids FROM f WHERE lang = 'en'""")
def stored_snapshot_claims(spark, sf_dir):
    """An itemset mined from a stored snapshot: its occurrences with the claim occurrences of their events."""
    snap = _stored(spark, sf_dir)
    mined = mining.mine_itemset(snap, ["artifact.kind:claim-occurrence", "actor:/corpus/en"])
    rows = mining.attached_claims(snap, mined.occurrences)
    return rows.select("root_event_id", F.array_join("event_ids", ",").alias("event_ids"), F.array_join("claim_occurrence_ids", ",").alias("claim_occurrence_ids"))


@query(f"""WITH {D} SELECT 'claim' AS kind, event_id, occurrence_id, claim_id AS node, seq FROM f UNION ALL SELECT 'feature', event_id, feature_occurrence_id, feature_id, seq FROM f""")
def stored_snapshot_components(spark, sf_dir):
    """The claim and feature occurrences of events as a stored snapshot holds them."""
    snap = _stored(spark, sf_dir)
    claims = snap.claims.select(F.lit("claim").alias("kind"), "event_id", "occurrence_id", F.col("claim_id").alias("node"), "seq")
    return claims.unionByName(snap.features.select(F.lit("feature").alias("kind"), "event_id", "occurrence_id", F.col("feature_id").alias("node"), "seq"))


@query(f"""WITH {SNAPSHOT}, k AS (SELECT local_id, 'actor:/corpus/' || lang AS token FROM documents JOIN l ON doc_id = seq WHERE lang IS NOT NULL), g AS (SELECT token, local_id - coalesce(lag(local_id) OVER (PARTITION BY token ORDER BY local_id), 0) AS gap, local_id FROM k)
    SELECT '/2024/01/01/00' AS shard_path, {_CID}'/2024/01/01/00') AS source_snapshot_cid, 'delta-postings-v0.1' AS schema, 'sorted-delta-v1' AS encoding, token, sha256(string_agg(CAST(gap AS VARCHAR), ',' ORDER BY local_id)) AS gaps FROM g GROUP BY token""")
def compacted_snapshot(spark, sf_dir):
    """Compacted postings that name the snapshot they come from; gaps shown by their hash."""
    snap = snapshots.build(tables.document_events(spark, sf_dir))
    named = snap.events.select("shard_path").distinct().withColumn("snapshot_cid", identity.cid_column(F.col("shard_path")))
    packed = deltas.compact_snapshot(snap.tokens.where("token like 'actor:/corpus/%'"), named)
    return packed.withColumn("gaps", F.sha2(F.array_join(F.col("gaps").cast("array<string>"), ","), 256))


# facts

@query(f"""WITH {P} SELECT 'ns:RSpacePosting:' || index || ':' || key AS name, id AS value FROM q WHERE index <> 'event_cid' UNION ALL SELECT 'ns:RSpaceEvent:' || event_id, event_cid FROM e UNION ALL SELECT 'ns:RSpaceEventCid:' || event_cid, event_id FROM e""")
def event_facts(spark, sf_dir):
    return facts.event_facts(tables.events(spark, sf_dir), "ns")


@query("""SELECT 'b' || (event_id % 9) AS batch_id, 'event:' || event_id AS event_id, 'ns:RSpaceBatch:b' || (event_id % 9) AS batch, 'ns:RSpaceBatchByShard:<shardPath>' AS shard, 'ns:RSpaceBatchByEventManifest:<eventManifestCid>' AS batch_by_event_manifest,
    'ns:RSpaceBatchByPostingsManifest:<postingsManifestCid>' AS batch_by_postings_manifest, 'ns:RSpaceBatchByMerkleRoot:<merkleRoot>' AS batch_by_merkle_root, 'ns:RSpaceEvent:event:' || event_id AS event, 'ns:RSpaceEventCid:<eventCid>' AS event_by_cid, 'ns:RSpacePosting:<index>:<key>' AS posting FROM events""")
def name_hints(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "events").select(F.concat(F.lit("b"), (F.col("event_id") % 9).cast("string")).alias("batch_id"), F.concat(F.lit("event:"), F.col("event_id").cast("string")).alias("event_id"))
    return facts.name_hints(rows, "ns")


@query(f"""WITH {E}, r AS (SELECT *, (row_number() OVER (ORDER BY seq) - 1) // 250 AS batch FROM e), b AS (SELECT 'batch:test:' || lpad(CAST(batch AS VARCHAR), 4, '0') AS batch_id, count(*) AS event_count FROM r GROUP BY batch)
    SELECT batch_id, event_count, 'batch-anchor-and-detailed-rspace-facts' AS storage, true AS event_facts, 'off-chain' AS dedupe, (SELECT count(*) * 16 FROM e) - (SELECT count(*) FROM e WHERE parent IS NULL) + (SELECT count(*) * 5 FROM b) AS n_facts FROM b""")
def batch_event_facts(spark, sf_dir):
    """Answers of batches put with the facts of their events, and how many facts that makes."""
    events = tables.events(spark, sf_dir)
    anchors = batches.anchors(batches.split(batches.pointer_documents(events), 250), "test", "log")
    made, acks = facts.put_batch(anchors, events, "ns", details=True)
    return acks.crossJoin(made.agg(F.count(F.lit(1)).alias("n_facts")))  # one row on the right


# metrics

LOG = """log AS (SELECT event_type AS label, user_id AS batch_id, event_id % 40 AS events, ts AS submitted_at, CASE WHEN user_id % 10 <> 3 THEN ts + INTERVAL (event_id % 50) SECOND END AS included_at, CASE WHEN user_id % 10 <> 3 AND event_type <> 'view' THEN ts + INTERVAL (60 + event_id % 90) SECOND END AS finalized_at, event_id % 100 AS block, event_id % 7 AS cost FROM events),
    each AS (SELECT label, batch_id, max(events) AS events, min(submitted_at) AS submitted_at, min(included_at) AS included_at, min(finalized_at) AS finalized_at FROM log GROUP BY ALL),
    blocks AS (SELECT label, count(*) AS canonical_block_count, sum(cost) AS total_cost_sum FROM (SELECT label, block, max(cost) AS cost FROM log WHERE finalized_at IS NOT NULL GROUP BY ALL) GROUP BY label),
    metrics AS (SELECT label, CAST(sum(events) AS BIGINT) AS events, count(*) AS batches, count(included_at) AS included_batches, count(finalized_at) AS finalized_batches,
        (epoch_us(min(included_at)) - epoch_us(min(submitted_at))) / 1000000 AS first_inclusion_s, CASE WHEN count(included_at) = count(*) THEN (epoch_us(max(included_at)) - epoch_us(min(submitted_at))) / 1000000 END AS canonical_added_s,
        CASE WHEN count(finalized_at) = count(*) THEN (epoch_us(max(finalized_at)) - epoch_us(min(submitted_at))) / 1000000 END AS finality_s FROM each GROUP BY label)"""


def _run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a log of submitted batches: some never included, one label never final."""
    ts, id_, user = F.col("ts").cast("timestamp"), F.col("event_id"), F.col("user_id")
    later = lambda s: F.timestamp_micros(F.unix_micros(ts) + s * 1_000_000)
    seen = user % 10 != 3
    return tables.table(spark, sf_dir, "events").select(F.col("event_type").alias("label"), user.alias("batch_id"), (id_ % 40).alias("events"), ts.alias("submitted_at"), F.when(seen, later(id_ % 50)).alias("included_at"), F.when(seen & (F.col("event_type") != "view"), later(60 + id_ % 90)).alias("finalized_at"), (id_ % 100).alias("block"), (id_ % 7).alias("cost"))


@query(f"""WITH {LOG} SELECT m.label, events, batches, included_batches, finalized_batches, round(first_inclusion_s, 3) AS first_inclusion_s, round(canonical_added_s, 3) AS canonical_added_s, round(finality_s, 3) AS finality_s, coalesce(canonical_block_count, 0) AS canonical_block_count, CAST(coalesce(total_cost_sum, 0) AS BIGINT) AS total_cost_sum,
    round(finality_s - canonical_added_s, 3) AS canonical_added_to_finality_s, round(total_cost_sum / batches, 6) AS cost_avg, round(total_cost_sum / events, 6) AS cost_per_event FROM metrics m LEFT JOIN blocks USING (label)""")
def workload_metrics(spark, sf_dir):
    rows = metrics.workload_metrics(_run_log(spark, sf_dir))
    places = {"first_inclusion_s": 3, "canonical_added_s": 3, "finality_s": 3, "canonical_added_to_finality_s": 3, "cost_avg": 6, "cost_per_event": 6}
    return rows.select("label", "events", "batches", "included_batches", "finalized_batches", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("canonical_block_count", "total_cost_sum")), *(F.round(c, n).alias(c) for c, n in places.items()))


@query(f"""WITH {LOG}, now AS (SELECT label, total_cost_sum, canonical_block_count FROM blocks), was AS (SELECT label, total_cost_sum * 2 AS total_cost_sum, canonical_block_count - canonical_block_count AS canonical_block_count FROM blocks)
    SELECT label, 'total_cost_sum' AS measure, CAST(was.total_cost_sum AS DOUBLE) AS previous, CAST(now.total_cost_sum AS DOUBLE) AS current, CAST(now.total_cost_sum - was.total_cost_sum AS DOUBLE) AS delta, 0.5::DOUBLE AS ratio FROM now JOIN was USING (label) WHERE was.total_cost_sum <> 0""")
def baseline_comparison(spark, sf_dir):
    """Costs against a baseline of twice the cost; a baseline of nothing compares with nothing."""
    now = metrics.workload_metrics(_run_log(spark, sf_dir)).select("label", "total_cost_sum", "canonical_block_count", *(F.lit(None).cast("double").alias(c) for c in metrics.COMPARED if c not in ("total_cost_sum", "canonical_block_count")))
    was = now.withColumn("total_cost_sum", F.col("total_cost_sum") * 2).withColumn("canonical_block_count", F.lit(0).cast("long"))
    return metrics.compare_to_baseline(now, was)


# privacy

PRIVACY = """v AS (SELECT event_id AS seq, event_type, CASE event_id % 4 WHEN 0 THEN '{"k":1}' WHEN 1 THEN '{"privacy":"public"}' WHEN 2 THEN '{"privacy":"secret"}' ELSE '{"privacy":"odd"}' END AS payload,
    CASE event_id % 4 WHEN 2 THEN 'secret' WHEN 3 THEN 'odd' ELSE 'public' END AS level, CASE event_id % 4 WHEN 2 THEN 'private-level' WHEN 3 THEN 'unknown-level' ELSE 'public-level' END AS reason FROM events)"""


def _private_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_ = F.col("event_id")
    payload = F.element_at(F.array(F.lit('{"k":1}'), F.lit('{"privacy":"public"}'), F.lit('{"privacy":"secret"}'), F.lit('{"privacy":"odd"}')), (id_ % 4 + 1).cast("int"))
    provenance = F.when(id_ % 3 == 0, F.lit('{"source":"s","privacy":{"old":true}}'))
    return tables.table(spark, sf_dir, "events").select(id_.alias("seq"), payload.alias("payload"), provenance.alias("provenance"), F.array(F.lit("app"), F.col("event_type")).alias("actor_path"), F.array(F.lit("x"), F.lit("y")).alias("channel_path"))


_DECIDED = """CASE WHEN seq % 3 = 0 THEN '{"source":"s","privacy":' ELSE '{"privacy":' END || '{"level":"' || level || '","pathMode":"MODE","publicIndexAllowed":' || CASE WHEN reason = 'public-level' THEN 'true' ELSE 'false' END || ',"reason":"' || reason || '"}}'"""


@query(f"WITH {PRIVACY} SELECT seq, true AS shown, {_DECIDED.replace('MODE', 'plain')} AS told FROM v WHERE reason = 'public-level' UNION ALL SELECT seq, false, reason FROM v WHERE reason <> 'public-level'")
def public_events(spark, sf_dir):
    """What a public index takes, with the decision in its provenance, and what it rejects, with the reason."""
    shown, rejected = privacy.public_events(_private_rows(spark, sf_dir))
    return shown.select("seq", F.lit(True).alias("shown"), F.col("provenance").alias("told")).unionByName(rejected.select("seq", F.lit(False).alias("shown"), F.col("reason").alias("told")))


@query(f"WITH {PRIVACY} SELECT seq, 'hash-sha256:' || sha256('grain' || chr(0) || 'app') || '/' || 'hash-sha256:' || sha256('grain' || chr(0) || event_type) AS actor, 'hash-sha256:' || sha256('grain' || chr(0) || 'x') || '/hash-sha256:' || sha256('grain' || chr(0) || 'y') AS channel, {_DECIDED.replace('MODE', 'hashed')} AS told FROM v")
def hashed_path_events(spark, sf_dir):
    """All events under hashed paths, private ones too, with the decision in their provenance."""
    rows = privacy.hashed_path_events(_private_rows(spark, sf_dir), privacy.PublicIndexPolicy(salt="grain"))
    return rows.select("seq", F.array_join("actor_path", "/").alias("actor"), F.array_join("channel_path", "/").alias("channel"), F.col("provenance").alias("told"))


# objects

@query(f"""SELECT {_CID}props) AS cid, true AS found, 'dag-json' AS codec, CAST(octet_length(encode(props)) AS BIGINT) AS size, props AS text FROM events GROUP BY props UNION ALL SELECT 'cidv0-local-sha256:' || repeat('0', 64), false, '', -1, ''""")
def object_lookups(spark, sf_dir):
    """Objects put twice into a Parquet store, then got by their CIDs with bytes checked, and one that it does not hold."""
    data = tables.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.lit("dag-json").alias("codec"), F.col("props").cast("binary").alias("data"))
    store = objects.ParquetObjects(spark, scratch_path(spark, "store"))
    store.put_rows(data)
    store.put_rows(data.withColumn("codec", F.lit("raw")))
    wanted = data.select(identity.cid_column(F.col("data")).alias("cid")).unionByName(spark.range(1).select(F.lit(identity.CID_PREFIX + "0" * 64).alias("cid")))
    return objects.lookup(store.frame(), wanted).select("cid", "found", F.coalesce("codec", F.lit("")).alias("codec"), F.coalesce("size", F.lit(-1)).alias("size"), F.coalesce(F.decode("data", "UTF-8"), F.lit("")).alias("text"))
