"""The library's own queries over the test tables, each beside its SQL twin.

``QUERIES`` maps a name to a function of (spark, sf_dir); ``ORACLE_SQL`` holds
DuckDB SQL for those that SQL can express. Both sides read whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.functions import deltas, identity, paths
from tracemill.operators import artifacts as art
from tracemill.operators import batches, mining, privacy, reasoning, scaling, snapshots
from tracemill.operators import events as ev
from tracemill.operators import postings as px
from tracemill.registry import LOCAL, MONTH, MONTH_TOKENS, ORACLE_SQL, QUERIES, TOKENS, D, E, P, query
from tracemill.scratch import materialize, scratch_path
from tracemill.sources import objects, pointer_log, tables
from tracemill.streaming import ingest

def joined(ids: str = "ids") -> F.Column:
    return F.array_join(ids, ",").alias("ids")


def _postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px.event_postings(tables.events(spark, sf_dir))


def _lists(spark: SparkSession, sf_dir: str, *indexes: str) -> DataFrame:
    return px.ordered_lists(px.event_postings(tables.events(spark, sf_dir), indexes)).select("index", "key", "n", joined())


def lists_sql(with_: str, rows: str, *indexes: str) -> str:
    return f"WITH {with_} SELECT index, key, count(*) AS n, string_agg(id, ',' ORDER BY seq) AS ids FROM {rows} WHERE index IN ({', '.join(repr(i) for i in indexes)}) GROUP BY index, key"


# functions

@query("""SELECT DISTINCT props AS segment, url_encode(props) AS encoded, '/' || url_encode(props) || '/a%20b%2A~' AS path_key FROM events""")
def encode_segment(spark, sf_dir):
    props = tables.table(spark, sf_dir, "events").select(F.col("props").alias("segment")).distinct()
    return props.select("segment", paths.encode_segment(F.col("segment")).alias("encoded"), paths.path_key(F.array("segment", F.lit("a b*~"))).alias("path_key"))


@query("""SELECT DISTINCT props AS payload, 'cidv0-local-sha256:' || sha256(props) AS cid, 'payload:' || sha256(props) AS content_id, sha256(props) AS digest FROM events""")
def content_identity(spark, sf_dir):
    props = tables.table(spark, sf_dir, "events").select(F.col("props").alias("payload")).distinct()
    cid = identity.cid_column(F.col("payload"))
    return props.select("payload", cid.alias("cid"), identity.content_id_column("payload", F.col("payload")).alias("content_id"), identity.digest_from_cid(cid).alias("digest"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS iso, strftime(ts, '/%Y') || strftime(ts, '/%Y/%m') || strftime(ts, '/%Y/%m/%d') || strftime(ts, '/%Y/%m/%d/%H') AS keys,
    CAST(year(ts) AS VARCHAR) || '-' || month(ts) || '-' || day(ts) AS day FROM events WHERE strftime(ts, '%f') <> '000000'""")
def time_keys(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    rows = tables.table(spark, sf_dir, "events").where(F.date_format(ts, "SSSSSS") != "000000")
    return rows.select("event_id", paths.utc_iso(ts).alias("iso"), F.array_join(paths.time_keys(ts), "").alias("keys"), paths.day_key(paths.time_path(ts)).alias("day"))


@query("""SELECT event_id, 'hash-sha256:' || sha256('test-salt' || chr(0) || 'app') || '/' || 'hash-sha256:' || sha256('test-salt' || chr(0) || event_type) AS hashed FROM events""")
def hashed_paths(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "events")
    return rows.select("event_id", F.array_join(paths.hashed_path(F.array(F.lit("app"), F.col("event_type")), "test-salt"), "/").alias("hashed"))


# event indexes

@query(lists_sql(P, "q", "actor", "channel"))
def path_prefix_postings(spark, sf_dir):
    return _lists(spark, sf_dir, "actor", "channel")


@query(lists_sql(P, "q", "time"))
def time_prefix_postings(spark, sf_dir):
    return _lists(spark, sf_dir, "time")


@query(lists_sql(P, "q", "kind", "payload"))
def kind_and_payload_index(spark, sf_dir):
    return _lists(spark, sf_dir, "kind", "payload")


@query(lists_sql(P, "q", "parent"))
def parent_children(spark, sf_dir):
    return _lists(spark, sf_dir, "parent")


@query(lists_sql(P, "q", "root"))
def root_traces(spark, sf_dir):
    return _lists(spark, sf_dir, "root")


@query(f"WITH {P} SELECT id, seq FROM q WHERE index = 'event_cid' AND key = 'cidv0-local-sha256:' || sha256('event:17')")
def by_event_cid(spark, sf_dir):
    return px.lookup(_postings(spark, sf_dir), "event_cid", identity.cid(b"event:17")).select("id", "seq")


@query(f"WITH {E} SELECT event_id, event_cid, payload_cid, kind AS value_kind, root AS root_event_id, actor_key, channel_key, shard_path FROM e WHERE event_id = 'event:17'")
def get_event(spark, sf_dir):
    row = tables.events(spark, sf_dir).where(F.col("event_id") == "event:17")
    return row.select("event_id", "event_cid", "payload_cid", "value_kind", "root_event_id", paths.leaf_key(F.col("actor_keys")).alias("actor_key"), paths.leaf_key(F.col("channel_keys")).alias("channel_key"), "shard_path")


@query(f"WITH {P}, w AS (SELECT unnest(['/app/user/3', '/app/user/5', '/nobody']) AS key) SELECT w.key, coalesce(string_agg(id, ',' ORDER BY seq), '') AS ids FROM w LEFT JOIN q ON q.key = w.key AND q.index = 'actor' GROUP BY w.key")
def lookup_many_actors(spark, sf_dir):
    keys = spark.createDataFrame([("/app/user/3",), ("/app/user/5",), ("/nobody",)], "key string")
    return px.lookup_many(_postings(spark, sf_dir), "actor", keys).select("key", joined())


@query(f"WITH {P} SELECT (SELECT count(*) FROM e) AS events, " + ", ".join(f"(SELECT count(DISTINCT key) FROM q WHERE index = '{i}') AS {i}_keys" for i in px.EVENT_INDEXES))
def event_state_stats(spark, sf_dir):
    events = tables.events(spark, sf_dir)
    return px.event_state_stats(events, px.event_postings(events))


@query(f"""WITH {E}, x AS (SELECT id, seq FROM (SELECT event_id AS id, seq FROM e WHERE starts_with(shard_path, '/2024/01/0') AND actor_key = '/app/user/7' AND channel_key = '/app/events/click')) SELECT id, seq FROM x WHERE id IN (SELECT event_id FROM e WHERE shard_path[1:11] = '/2024/01/05')""")
def prefix_intersection(spark, sf_dir):
    return px.all_of(_postings(spark, sf_dir), [("time", "/2024/01/05"), ("actor", "/app/user/7"), ("channel", "/app/events/click")])


@query(f"""WITH {E}, all_rows AS (
    SELECT seq, event_id, event_cid FROM e UNION ALL SELECT seq + 10000000, event_id, event_cid FROM e WHERE seq % 10 = 0 UNION ALL SELECT seq + 20000000, 'clash:' || seq, event_cid FROM e WHERE seq % 15 = 0)
    SELECT seq, event_id, CASE WHEN seq < 10000000 THEN 'accepted' WHEN seq < 20000000 THEN 'duplicate-event-id' ELSE 'duplicate-event-cid' END AS ack FROM all_rows""")
def conflict_acks(spark, sf_dir):
    rows = tables.events(spark, sf_dir).select("seq", "event_id", "event_cid")
    replay = rows.where("seq % 10 = 0").withColumn("seq", F.col("seq") + 10_000_000)
    clash = rows.where("seq % 15 = 0").select((F.col("seq") + 20_000_000).alias("seq"), F.concat(F.lit("clash:"), F.col("seq").cast("string")).alias("event_id"), "event_cid")
    return ev.conflict_acks(rows.unionByName(replay).unionByName(clash)).select("seq", "event_id", "ack")


@query(f"WITH {E} SELECT event_id, root AS root_event_id FROM e")
def root_resolution(spark, sf_dir):
    rows = tables.events(spark, sf_dir).withColumn("root_event_id", F.lit(None).cast("string"))
    return ev.resolve_roots(rows).select("event_id", "root_event_id")


# snapshots

@query(f"WITH {LOCAL} SELECT shard_path, event_id, local_id FROM s")
def hour_snapshot_dictionary(spark, sf_dir):
    return snapshots.build(tables.events(spark, sf_dir)).events.select("shard_path", "event_id", "local_id")


@query(f"WITH {TOKENS} SELECT shard_path, token, count(*) AS n, string_agg(CAST(local_id AS VARCHAR), ',' ORDER BY local_id) AS ids FROM k GROUP BY shard_path, token")
def snapshot_postings(spark, sf_dir):
    return snapshots.posting_lists(snapshots.build(tables.events(spark, sf_dir))).select("shard_path", "token", "n", F.array_join(F.col("local_ids").cast("array<string>"), ",").alias("ids"))


@query(f"WITH {LOCAL} SELECT shard_path, root AS root_event_id, string_agg(event_id, ',' ORDER BY local_id) AS ids FROM s GROUP BY shard_path, root")
def snapshot_events_by_root(spark, sf_dir):
    return snapshots.events_by_root(snapshots.build(tables.events(spark, sf_dir))).select("shard_path", "root_event_id", F.array_join("event_ids", ",").alias("ids"))


@query(f"WITH {TOKENS}, l AS (SELECT shard_path, token, count(*) AS n FROM k GROUP BY ALL), z AS (SELECT shard_path, count(*) AS events FROM s GROUP BY shard_path) SELECT shard_path, events, count(*) AS posting_keys, CAST(sum(n) AS BIGINT) AS posting_entries, max(n) AS max_posting_length FROM l JOIN z USING (shard_path) GROUP BY shard_path, events")
def snapshot_sizes(spark, sf_dir):
    snap = snapshots.build(tables.events(spark, sf_dir))
    return scaling.measure_shards(snap.tokens, snap.events)


@query(f"WITH {P} SELECT (SELECT count(*) FROM e) AS events, " + ", ".join(f"(SELECT count(DISTINCT key) FROM q WHERE index = '{i}') AS {i}_keys" for i in ("time", "actor", "channel", "root")) + ", (SELECT count(*) FROM q WHERE index <> 'event_cid') - (SELECT 0) AS total_index_entries")
def event_index_sizes(spark, sf_dir):
    events = tables.events(spark, sf_dir)
    return scaling.measure_events(events, px.event_postings(events))


@query(f"WITH {TOKENS}, n AS (SELECT shard_path, count(*) AS n FROM k GROUP BY shard_path), t AS (SELECT count(*) AS events FROM e) SELECT shard_path, events > 5000 OR n > 60 AS recommended, concat_ws(',', CASE WHEN events > 5000 THEN 'event-count' END, CASE WHEN n > 60 THEN 'snapshot-posting-entry-count' END) AS reasons FROM n, t")
def sharding_advice(spark, sf_dir):
    events = tables.events(spark, sf_dir)
    snap = snapshots.build(events)
    advice = scaling.recommend(scaling.measure_events(events, px.event_postings(events)), scaling.measure_shards(snap.tokens, snap.events), scaling.Thresholds(5000, 1_000_000_000, 60))
    return advice.select("shard_path", "recommended", F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH {TOKENS}, g AS (SELECT shard_path, token, local_id, local_id - coalesce(lag(local_id) OVER (PARTITION BY shard_path, token ORDER BY local_id), 0) AS gap FROM k) SELECT shard_path, token, 'sorted-delta-v1' AS encoding, string_agg(CAST(gap AS VARCHAR), ',' ORDER BY local_id) AS gaps FROM g GROUP BY shard_path, token")
def delta_postings(spark, sf_dir):
    packed = deltas.compress_postings(snapshots.build(tables.events(spark, sf_dir)).tokens)
    return packed.select("shard_path", "token", "encoding", F.array_join(F.col("gaps").cast("array<string>"), ",").alias("gaps"))


@query(f"WITH {TOKENS} SELECT shard_path, token, local_id FROM k")
def delta_round_trip(spark, sf_dir):
    return deltas.decompress_postings(deltas.compress_postings(snapshots.build(tables.events(spark, sf_dir)).tokens))


@query(f"WITH {LOCAL} SELECT DISTINCT shard_path FROM s WHERE seq % 97 = 0")
def affected_shards(spark, sf_dir):
    return snapshots.affected_shards(tables.events(spark, sf_dir).where("seq % 97 = 0"))


# miners

#: Two tokens that neither implies the other, one of them twice.
ITEMS = ["event.kind:click", "actor:/app/user/7", "event.kind:click"]
HITS_SQL = MONTH_TOKENS + """, h AS (SELECT shard_path, local_id FROM k WHERE token IN ('event.kind:click', 'actor:/app/user/7') GROUP BY ALL HAVING count(DISTINCT token) = 2), hit AS (SELECT s.* FROM s JOIN h USING (shard_path, local_id))"""


def _month(spark: SparkSession, sf_dir: str) -> snapshots.Snapshot:
    return snapshots.build(tables.events(spark, sf_dir), shard="/2024/01")


VECTOR_SQL = "count(DISTINCT event_id) AS event_support, count(DISTINCT actor_key) AS actor_support, count(DISTINCT channel_key) AS channel_support, count(DISTINCT day) AS day_support, CAST(1 AS BIGINT) AS source_support, CAST(0 AS BIGINT) AS extractor_run_support"
SEQUENCE_SQL = LOCAL + """, v AS (SELECT shard_path, root, min(local_id) AS a FROM s WHERE kind = 'view' GROUP BY ALL), w AS (
    SELECT v.shard_path, v.root, a, min(local_id) AS b FROM v JOIN s ON s.shard_path = v.shard_path AND s.root = v.root AND kind = 'click' AND local_id > a GROUP BY ALL), m AS (
    SELECT w.shard_path, w.root, x.event_id AS first_id, y.event_id AS second_id FROM w JOIN s x ON x.shard_path = w.shard_path AND x.local_id = a JOIN s y ON y.shard_path = w.shard_path AND y.local_id = b)"""
EDGES_SQL = LOCAL + """, m AS (SELECT c.shard_path, p.root, p.event_id AS parent, c.event_id AS child FROM s c JOIN s p ON c.parent = p.event_id AND c.shard_path = p.shard_path WHERE p.kind = 'view' AND c.kind = 'click')"""


@query(f"WITH {HITS_SQL} SELECT shard_path, local_id, event_id FROM hit")
def token_intersection(spark, sf_dir):
    return mining.support_for_tokens(_month(spark, sf_dir), ITEMS).select("shard_path", "local_id", "event_id")


@query(f"WITH {HITS_SQL} SELECT shard_path, count(*) AS n FROM hit GROUP BY shard_path")
def token_intersection_bitmaps(spark, sf_dir):
    return mining.support_bitmaps(_month(spark, sf_dir), ITEMS)


@query(f"WITH {HITS_SQL} SELECT shard_path, {VECTOR_SQL}, count(*) AS itemset_support, count(*) AS occurrence_support, count(DISTINCT root) AS root_trace_support FROM hit GROUP BY shard_path HAVING count(*) >= 3")
def itemset_support(spark, sf_dir):
    return mining.mine_itemset(_month(spark, sf_dir), ITEMS, min_support=3).support


@query(f"WITH {HITS_SQL} SELECT shard_path, root AS root_event_id, string_agg(event_id, ',' ORDER BY local_id) AS ids FROM hit GROUP BY ALL")
def itemset_occurrences(spark, sf_dir):
    return mining.mine_itemset(_month(spark, sf_dir), ITEMS, min_support=3).occurrences.select("shard_path", "root_event_id", F.array_join("event_ids", ",").alias("ids"))


@query(f"WITH {SEQUENCE_SQL} SELECT shard_path, root AS root_event_id, first_id || ',' || second_id AS ids FROM m")
def sequence_occurrences(spark, sf_dir):
    return mining.mine_sequence(snapshots.build(tables.events(spark, sf_dir)), ["view", "click"]).occurrences.select("shard_path", "root_event_id", F.array_join("event_ids", ",").alias("ids"))


@query(f"WITH {SEQUENCE_SQL}, u AS (SELECT shard_path, unnest([first_id, second_id]) AS event_id FROM m), n AS (SELECT shard_path, count(DISTINCT root) AS root_trace_support, count(*) AS occurrence_support FROM m GROUP BY shard_path) SELECT u.shard_path, {VECTOR_SQL}, root_trace_support, occurrence_support FROM u JOIN s USING (shard_path, event_id) JOIN n USING (shard_path) GROUP BY u.shard_path, root_trace_support, occurrence_support")
def sequence_support(spark, sf_dir):
    return mining.mine_sequence(snapshots.build(tables.events(spark, sf_dir)), ["view", "click"]).support


@query(f"WITH {EDGES_SQL} SELECT shard_path, root AS root_event_id, parent || ',' || child AS ids FROM m")
def motif_occurrences(spark, sf_dir):
    return mining.mine_parent_child_motif(snapshots.build(tables.events(spark, sf_dir)), "view", "click").occurrences.select("shard_path", "root_event_id", F.array_join("event_ids", ",").alias("ids"))


@query(f"WITH {EDGES_SQL}, u AS (SELECT shard_path, unnest([parent, child]) AS event_id FROM m), n AS (SELECT shard_path, count(*) AS edge_support, count(*) AS occurrence_support, count(DISTINCT root) AS root_trace_support FROM m GROUP BY shard_path) SELECT u.shard_path, {VECTOR_SQL}, edge_support, occurrence_support, root_trace_support FROM u JOIN s USING (shard_path, event_id) JOIN n USING (shard_path) GROUP BY ALL")
def motif_support(spark, sf_dir):
    return mining.mine_parent_child_motif(snapshots.build(tables.events(spark, sf_dir)), "view", "click").support


@query(f"""WITH {SEQUENCE_SQL} SELECT root AS root_event_id, 'pattern-occ:' || sha256('{{"kind":"pattern-occurrence","minedBy":"run:test","participatingClaimOccurrenceIds":[],"participatingEventIds":["' || first_id || '","' || second_id || '"],"participatingRunIds":[],"patternId":"pattern:' || sha256('{{"body":[{{"eventKind":"view"}},{{"eventKind":"click"}}],"constraints":{{"maxWindowSeconds":30,"sameRootTrace":true}},"kind":"pattern","patternType":"sequence","schema":"pattern-core-v0.1"}}') || '","rootEventId":"' || root || '","schema":"pattern-occurrence-v0.1"}}') AS id FROM m""")
def pattern_occurrence_ids(spark, sf_dir):
    snap = snapshots.build(tables.events(spark, sf_dir))
    return mining.occurrence_rows(snap, mining.mine_sequence(snap, ["view", "click"]), "run:test").select("root_event_id", "id")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases of one day, by hour: their support vectors from the postings alone."""
    events = tables.events(spark, sf_dir)
    hits = px.all_of(px.event_postings(events, ("kind", "time")), [("kind", "purchase"), ("time", "/2024/01/05")]).select(F.col("id").alias("event_id"))
    rows = events.join(hits, "event_id", "left_semi").withColumn("actor_key", paths.leaf_key(F.col("actor_keys"))).withColumn("channel_key", paths.leaf_key(F.col("channel_keys")))
    return rows.groupBy("shard_path").agg(*mining.support_vector())


@query(f"WITH {E} SELECT shard_path, {VECTOR_SQL} FROM e WHERE kind = 'purchase' AND starts_with(shard_path, '/2024/01/05') GROUP BY shard_path")
def purchases_by_hour(spark, sf_dir):
    return flagship(spark, sf_dir)


@query(f"""WITH {EDGES_SQL}, a AS (SELECT DISTINCT root FROM e WHERE channel_key = '/app/events/purchase') SELECT 'pattern:motif' AS pattern_id, count(*) AS occurrences, count(DISTINCT m.root) AS roots FROM m WHERE m.root IN (SELECT root FROM a) HAVING count(*) > 0""")
def patterns_touching_channel(spark, sf_dir):
    """Prefix key to events, to their root traces, to pattern occurrences, to patterns."""
    events = tables.events(spark, sf_dir)
    found = px.lookup(px.event_postings(events, ("channel",)), "channel", "/app/events/purchase").select(F.col("id").alias("event_id"))
    roots = events.join(found, "event_id", "left_semi").select("root_event_id").distinct()
    occurrences = mining.mine_parent_child_motif(snapshots.build(events), "view", "click").occurrences.withColumn("pattern_id", F.lit("pattern:motif"))
    return occurrences.join(roots, "root_event_id", "left_semi").groupBy("pattern_id").agg(F.count(F.lit(1)).alias("occurrences"), F.count_distinct("root_event_id").alias("roots"))


# derived artifacts

DERIVED_SQL = D + """, a AS (
    SELECT 'runs_by_input_event' AS index, event_id AS key, run_id AS id, seq FROM f UNION ALL SELECT 'runs_by_extractor', 'extractor/' || lang, run_id, seq FROM f
    UNION ALL SELECT 'outputs_by_run', run_id, occurrence_id, seq FROM f UNION ALL SELECT 'outputs_by_run', run_id, feature_occurrence_id, seq FROM f
    UNION ALL SELECT 'runs_by_output_artifact', occurrence_id, run_id, seq FROM f UNION ALL SELECT 'runs_by_output_artifact', feature_occurrence_id, run_id, seq FROM f
    UNION ALL SELECT 'claims_by_subject', 'subject:' || sha256(subject), claim_id, seq FROM f UNION ALL SELECT 'claims_by_predicate', 'predicate:' || sha256('{"name":"quality"}'), claim_id, seq FROM f
    UNION ALL SELECT 'claims_by_object', 'object:' || sha256(object), claim_id, seq FROM f UNION ALL SELECT 'occurrences_by_claim', claim_id, occurrence_id, seq FROM f
    UNION ALL SELECT 'claim_occurrences_by_event', event_id, occurrence_id, seq FROM f UNION ALL SELECT 'features_by_type', 'topic', feature_id, seq FROM f
    UNION ALL SELECT 'occurrences_by_feature', feature_id, feature_occurrence_id, seq FROM f UNION ALL SELECT 'feature_occurrences_by_event', event_id, feature_occurrence_id, seq FROM f)"""
FIRST_RUNS = "(SELECT run_id, min(seq) AS seq FROM f GROUP BY run_id)"


def _derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px.derived_postings(art.first_writes(tables.artifacts(spark, sf_dir)))


@query(f"WITH {DERIVED_SQL}, b AS (SELECT index, key, id, min(seq) AS seq FROM a WHERE NOT (index = 'runs_by_input_event' AND (key, id) NOT IN (SELECT 'doc:' || seq, run_id FROM {FIRST_RUNS})) GROUP BY ALL) SELECT index, key, count(*) AS n, string_agg(id, ',' ORDER BY seq, id) AS ids FROM b GROUP BY index, key")
def derived_indexes(spark, sf_dir):
    """All reverse indexes of first-written artifacts, their lists in the order written."""
    return px.ordered_lists(_derived(spark, sf_dir)).select("index", "key", "n", joined())


@query(f"WITH {DERIVED_SQL}, b AS (SELECT * FROM a WHERE NOT (index = 'runs_by_input_event' AND (key, id) NOT IN (SELECT 'doc:' || seq, run_id FROM {FIRST_RUNS}))), g AS (SELECT index, key, count(DISTINCT id) AS n FROM b GROUP BY index, key) SELECT index, count(*) AS keys, CAST(sum(n) AS BIGINT) AS entries, max(n) AS longest FROM g GROUP BY index")
def derived_index_sizes(spark, sf_dir):
    return px.index_stats(_derived(spark, sf_dir))


@query(f"WITH {D} SELECT count(DISTINCT run_id) AS run_rows, count(DISTINCT claim_id) AS claim_rows, count(DISTINCT occurrence_id) AS claim_occurrence_rows, CAST(0 AS BIGINT) AS claim_cluster_rows, count(DISTINCT feature_id) AS feature_rows, count(DISTINCT feature_occurrence_id) AS feature_occurrence_rows, CAST(0 AS BIGINT) AS pattern_rows, CAST(0 AS BIGINT) AS pattern_occurrence_rows, CAST(0 AS BIGINT) AS reasoning_input_rows, CAST(0 AS BIGINT) AS reasoning_output_rows, CAST(0 AS BIGINT) AS belief_revision_history_rows FROM f")
def derived_state_stats(spark, sf_dir):
    return px.derived_state_stats(tables.artifacts(spark, sf_dir))


@query(f"WITH {D}, r AS (SELECT 'claim' AS family, claim_id AS id, seq FROM f UNION ALL SELECT 'run', run_id, seq FROM f) SELECT family, id, seq, seq > min(seq) OVER (PARTITION BY family, id) AS duplicate FROM r")
def artifact_put_acks(spark, sf_dir):
    return art.put_acks(tables.artifacts(spark, sf_dir).where("family in ('claim', 'run')")).select("family", "id", "seq", "duplicate")


@query(f"WITH {D} SELECT claim_id, string_agg(occurrence_id, ',' ORDER BY seq) FILTER (polarity = 'asserted') AS positive, string_agg(occurrence_id, ',' ORDER BY seq) FILTER (polarity = 'denied') AS negative FROM f GROUP BY claim_id")
def evidence_partition(spark, sf_dir):
    lists = reasoning.evidence_lists(reasoning.claim_evidence(tables.artifacts(spark, sf_dir)))
    text = lambda c: F.when(F.size(c) > 0, F.array_join(c, ",")).alias(c)
    return lists.select("claim_id", text("positive"), text("negative"))


@query(f"WITH {D} SELECT claim_id, count(*) AS occurrence_support, count(DISTINCT event_id) AS event_support, count(DISTINCT lang) AS actor_support, count(DISTINCT source) AS channel_support, CAST(1 AS BIGINT) AS day_support, count(DISTINCT event_id) AS source_support, count(DISTINCT run_id) AS extractor_run_support FROM f GROUP BY claim_id")
def reasoning_support(spark, sf_dir):
    return reasoning.support_vectors(reasoning.claim_evidence(tables.artifacts(spark, sf_dir)), tables.document_events(spark, sf_dir))


@query(f"WITH {D} SELECT claim_id, occurrence_id, event_id, 'cidv0-local-sha256:' || sha256(coalesce(text, '')) AS payload_cid FROM f JOIN documents ON f.seq = documents.doc_id")
def claim_to_payload(spark, sf_dir):
    """Claim to occurrences, to their source events, to payloads."""
    evidence = reasoning.claim_evidence(tables.artifacts(spark, sf_dir)).select("claim_id", "occurrence_id", F.col("source_event_id").alias("event_id"))
    return evidence.join(tables.document_events(spark, sf_dir).select("event_id", "payload_cid"), "event_id").select("claim_id", "occurrence_id", "event_id", "payload_cid")


@query(f"WITH {D} SELECT event_id AS missing FROM f WHERE seq % 2 = 1")
def occurrences_without_source(spark, sf_dir):
    occurrences = reasoning.claim_evidence(tables.artifacts(spark, sf_dir)).select("occurrence_id", "source_event_id")
    _, missing = art.occurrences_with_sources(occurrences, tables.document_events(spark, sf_dir).where("seq % 2 = 0"))
    return missing.select(F.col("source_event_id").alias("missing"))


@query(f"WITH {D}, k AS (SELECT subject, array_agg(DISTINCT claim_id ORDER BY claim_id) AS members FROM f GROUP BY subject) SELECT claim_id AS key, 'cluster:' || subject AS id FROM (SELECT subject, unnest(members) AS claim_id FROM k)")
def cluster_membership(spark, sf_dir):
    claims = art.first_writes(tables.artifacts(spark, sf_dir).where("family = 'claim'")).select("id", F.get_json_object("body", "$.subject").alias("subject"), "seq")
    clusters = claims.groupBy("subject").agg(F.array_sort(F.collect_set("id")).alias("members"), F.min("seq").alias("seq"))
    pointer = identity.sorted_json(members=F.col("members"))
    rows = clusters.select("seq", F.lit("claim-cluster").alias("family"), F.concat(F.lit("cluster:"), "subject").alias("id"), F.lit("").alias("cid"), F.lit("").alias("body"), pointer.alias("pointer"))
    return px.derived_postings(rows).where("index = 'clusters_by_claim'").select("key", "id")


@query("""SELECT 'claim:' || conv_id AS claim_id, 'evidence-weighted' AS revision_policy, count(*) AS n_states, string_agg(conv_id || ':' || turn, ',' ORDER BY turn) AS output_ids FROM conversations WHERE role = 'assistant' GROUP BY conv_id""")
def belief_histories(spark, sf_dir):
    turns = tables.table(spark, sf_dir, "conversations").where("role = 'assistant'")
    outputs = turns.select(F.concat(F.lit("claim:"), F.col("conv_id").cast("string")).alias("claim_id"), F.lit("evidence-weighted").alias("revision_policy"), F.col("turn").alias("seq"), F.concat_ws(":", "conv_id", "turn").alias("output_id"))
    return reasoning.belief_histories(outputs).select("claim_id", "revision_policy", "n_states", F.array_join("output_ids", ",").alias("output_ids"))


# batches and logs

@query(f"WITH {E}, r AS (SELECT *, (row_number() OVER (ORDER BY seq) - 1) // 250 AS batch FROM e) SELECT batch, count(*) AS n, strftime(date_trunc('hour', min(ts)), '%Y-%m-%dT%H:%M:%SZ') AS min_observed_at, strftime(max(ts), '%Y-%m-%dT%H:59:59Z') AS max_observed_at FROM r GROUP BY batch")
def batch_ranges(spark, sf_dir):
    rows = batches.split(tables.events(spark, sf_dir), 250)
    return rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).join(batches.hour_ranges(rows), "batch")


@query(f"""WITH {E}, r AS (SELECT *, (row_number() OVER (ORDER BY seq) - 1) // 250 AS batch FROM e), g AS (SELECT batch, min(shard_path) AS lo, max(shard_path) AS hi FROM r GROUP BY batch)
    SELECT batch, CASE WHEN lo = hi THEN lo WHEN lo[1:11] = hi[1:11] THEN lo[1:11] WHEN lo[1:8] = hi[1:8] THEN lo[1:8] WHEN lo[1:5] = hi[1:5] THEN lo[1:5] ELSE '/stored-events' END AS shard_path FROM g""")
def common_time_shards(spark, sf_dir):
    return batches.common_shards(batches.split(tables.events(spark, sf_dir), 250))


@query(f"""WITH {E}, r AS (SELECT *, (row_number() OVER (ORDER BY seq) - 1) // 250 AS batch FROM e) SELECT 'batch:test:' || lpad(CAST(batch AS VARCHAR), 4, '0') AS batch_id, count(*) AS event_count,
    'cidv0-local-sha256:' || sha256('{{"batchId":"batch:test:' || lpad(CAST(batch AS VARCHAR), 4, '0') || '","eventCids":["' || string_agg(event_cid, '","' ORDER BY seq) || '"],"eventIds":["' || string_agg(event_id, '","' ORDER BY seq) || '"],"schema":"percept-event-pointer-batch-manifest-v0.1","sourcePointerLogSha256":"log"}}') AS event_manifest_cid,
    min_by(event_id, seq) AS first_event_id, max_by(event_id, seq) AS last_event_id FROM r GROUP BY batch""")
def batch_manifests(spark, sf_dir):
    rows = batches.split(batches.pointer_documents(tables.events(spark, sf_dir)), 250)
    return batches.anchors(rows, "test", "log").select("batch_id", "event_count", "event_manifest_cid", "first_event_id", "last_event_id")


POINTER_SQL = E + """, x AS (SELECT seq, event_id, event_cid, payload_cid, kind, root, parent, shard_path, ts, '/app/user/' || split_part(actor_key, '/', 4) AS actor_key, channel_key, split_part(actor_key, '/', 4) AS u, (row_number() OVER (ORDER BY seq) - 1) // 250 AS batch FROM e), d AS (
    SELECT *, '{"actorPath":["app","user","' || u || '"],"actorPrefixKeys":["/app","/app/user","' || actor_key || '"],"channelPath":["app","events","' || kind || '"],"channelPrefixKeys":["/app","/app/events","' || channel_key || '"],"eventCid":"' || event_cid || '","eventId":"' || event_id
        || '","inputEventIds":[],"kind":"event-pointer","outputArtifactIds":[],"parentEventIds":[' || coalesce('"' || parent || '"', '') || '],"payloadCid":"' || payload_cid || '","rootEventId":"' || root || '","schema":"event-pointer-v0.1","timePath":[' || year(ts) || ',' || month(ts) || ',' || day(ts) || ',' || hour(ts)
        || '],"timePrefixKeys":["' || shard_path[1:5] || '","' || shard_path[1:8] || '","' || shard_path[1:11] || '","' || shard_path || '"],"valueKind":"' || kind || '"}' AS pointer, 'batch:test:' || lpad(CAST(batch AS VARCHAR), 4, '0') AS batch_id FROM x)"""
ANCHOR_SQL = "RECURSIVE " + POINTER_SQL + """, tree(batch, hashes) AS (
    SELECT batch, list(sha256(pointer) ORDER BY seq) FROM d GROUP BY batch
    UNION ALL
    SELECT batch, list_transform(range(1, len(hashes) + 1, 2), lambda i: sha256(unhex(hashes[i]) || unhex(hashes[least(i + 1, len(hashes))]))) FROM tree WHERE len(hashes) > 1
), merkle AS (SELECT batch, hashes[1] AS root FROM tree WHERE len(hashes) = 1
), p AS (
    SELECT batch, seq, event_id, unnest(['time','time','time','time','actor','actor','actor','channel','channel','channel','kind','parent','root']) AS index,
        unnest([shard_path[1:5], shard_path[1:8], shard_path[1:11], shard_path, '/app', '/app/user', actor_key, '/app', '/app/events', channel_key, kind, parent, root]) AS key FROM d
), lists AS (SELECT batch, index, key, '"' || key || '":[' || string_agg('"' || event_id || '"', ',' ORDER BY seq) || ']' AS entry FROM p WHERE key IS NOT NULL GROUP BY batch, index, key
), names AS (SELECT DISTINCT batch, unnest(['actor','channel','kind','parent','root','time']) AS index FROM d
), indexes AS (SELECT n.batch, string_agg(part, ',' ORDER BY n.index) AS postings FROM (SELECT n.batch, n.index, '"' || n.index || '":{' || coalesce(string_agg(entry, ',' ORDER BY key), '') || '}' AS part FROM names n LEFT JOIN lists l ON l.batch = n.batch AND l.index = n.index GROUP BY n.batch, n.index) n GROUP BY n.batch
), g AS (SELECT batch, batch_id, count(*) AS event_count, min(shard_path) AS lo, max(shard_path) AS hi, string_agg(event_cid, '","' ORDER BY seq) AS cids, string_agg(event_id, '","' ORDER BY seq) AS ids, min_by(event_id, seq) AS first_event_id, max_by(event_id, seq) AS last_event_id, min(ts) AS t0, max(ts) AS t1 FROM d GROUP BY ALL
), anchor AS (
    SELECT g.batch, batch_id, event_count, 'cidv0-local-sha256:' || sha256('{"batchId":"' || batch_id || '","eventCids":["' || cids || '"],"eventIds":["' || ids || '"],"schema":"percept-event-pointer-batch-manifest-v0.1","sourcePointerLogSha256":"log"}') AS event_manifest_cid,
        'cidv0-local-sha256:' || sha256('{"batchId":"' || batch_id || '","postings":{' || postings || '},"schema":"percept-event-postings-manifest-v0.1","sourcePointerLogSha256":"log"}') AS postings_manifest_cid,
        'sha256-merkle:' || root AS merkle_root, first_event_id, last_event_id,
        CASE WHEN lo = hi THEN lo WHEN lo[1:11] = hi[1:11] THEN lo[1:11] WHEN lo[1:8] = hi[1:8] THEN lo[1:8] WHEN lo[1:5] = hi[1:5] THEN lo[1:5] ELSE '/stored-events' END AS shard_path,
        strftime(date_trunc('hour', t0), '%Y-%m-%dT%H:%M:%SZ') AS min_observed_at, strftime(t1, '%Y-%m-%dT%H:59:59Z') AS max_observed_at
    FROM g JOIN merkle USING (batch) JOIN indexes USING (batch))"""


def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.anchors(batches.split(batches.pointer_documents(tables.events(spark, sf_dir)), 250), "test", "log")


@query(f"WITH {ANCHOR_SQL} SELECT * FROM anchor")
def batch_anchors(spark, sf_dir):
    """Whole anchors with Merkle roots and both manifests."""
    return _anchors(spark, sf_dir)


@query(f"WITH {ANCHOR_SQL} SELECT unnest(['batch_id', 'shard_path', 'event_manifest_cid', 'postings_manifest_cid', 'merkle_root']) AS index, unnest([batch_id, shard_path, event_manifest_cid, postings_manifest_cid, merkle_root]) AS key, batch_id FROM anchor")
def batch_lookups(spark, sf_dir):
    """Every anchor under each of its five indexes."""
    held = materialize(_anchors(spark, sf_dir), "anchors")
    out = None
    for by in batches.ANCHOR_INDEXES:
        part = batches.anchors_by(held, by)
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {E} SELECT count(DISTINCT root) AS root_event_count FROM e")
def root_event_count(spark, sf_dir):
    return batches.root_event_count(tables.events(spark, sf_dir))


TOP_SQL = ", ".join(f"{n} AS (SELECT '{n}' AS what, {c} AS value, count(*) AS n, min(seq) AS first_seq FROM e GROUP BY {c} ORDER BY n DESC, first_seq LIMIT 20)" for n, c in (("kind", "kind"), ("session", "'events'"), ("hour", "shard_path"), ("actor", "actor_key")))


@query(f"WITH {E}, {TOP_SQL} SELECT * FROM kind UNION ALL SELECT * FROM session UNION ALL SELECT * FROM hour UNION ALL SELECT * FROM actor")
def top_summary(spark, sf_dir):
    return batches.summary(tables.events(spark, sf_dir))


def _log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a pointer log with repeats, bad lines and blanks."""
    rows = tables.table(spark, sf_dir, "events").select("event_id")
    line = lambda c: F.concat(F.lit('{"eventId":"event:'), c.cast("string"), F.lit('"}'))
    good = rows.select(F.col("event_id").alias("seq"), line(F.col("event_id")).alias("line"))
    again = rows.where("event_id % 7 = 0").select((F.col("event_id") + 10_000_000).alias("seq"), line(F.col("event_id")).alias("line"))
    bad = rows.where("event_id % 11 = 0").select((F.col("event_id") + 20_000_000).alias("seq"), F.lit('{"eventId":').alias("line"))
    blank = rows.where("event_id % 13 = 0").select((F.col("event_id") + 30_000_000).alias("seq"), F.lit("  ").alias("line"))
    return good.unionByName(again).unionByName(bad).unionByName(blank)


@query("""SELECT count(*) + count(*) FILTER (event_id % 7 = 0) + count(*) FILTER (event_id % 11 = 0) + count(*) FILTER (event_id % 13 = 0) AS line_count, count(*) AS unique_event_count, count(*) FILTER (event_id % 7 = 0) AS duplicate_event_ids, count(*) FILTER (event_id % 11 = 0) AS bad_json_lines FROM events""")
def pointer_log_stats(spark, sf_dir):
    return pointer_log.log_stats(_log_lines(spark, sf_dir))


@query("""SELECT event_id AS seq, 'event:' || event_id AS event_id FROM events""")
def unique_pointers(spark, sf_dir):
    return pointer_log.unique_pointers(_log_lines(spark, sf_dir)).select("seq", "event_id")


@query("""SELECT 'cidv0-local-sha256:' || sha256(props) AS cid, 'dag-json' AS codec, CAST(octet_length(encode(props)) AS BIGINT) AS size, 'sha256:' || sha256(props) AS digest, min(event_id) AS seq FROM events GROUP BY props""")
def object_manifests(spark, sf_dir):
    data = tables.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.lit("dag-json").alias("codec"), F.col("props").cast("binary").alias("data"))
    return objects.new_objects(objects.object_rows(data)).select("cid", "codec", "size", "digest", "seq")


@query("""SELECT DISTINCT 'cidv0-local-sha256:' || sha256(props) AS cid, NOT contains(props, '7') AS cid_ok, NOT contains(props, '7') AS digest_ok, NOT contains(props, '7') AS size_ok, NOT contains(props, '7') AS ok FROM events""")
def object_audit(spark, sf_dir):
    """Objects whose bytes were overwritten are found by the audit."""
    data = tables.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.lit("raw").alias("codec"), F.col("props").cast("binary").alias("data"))
    held = objects.new_objects(objects.object_rows(data))
    return objects.audit(held.withColumn("data", F.when(F.decode("data", "UTF-8").contains("7"), F.lit("overwritten by other bytes").cast("binary")).otherwise(F.col("data"))))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'public' WHEN 1 THEN 'public' WHEN 2 THEN 'secret' WHEN 3 THEN 'None' ELSE 'odd' END AS level, event_id % 5 < 2 AS allowed, CASE event_id % 5 WHEN 0 THEN 'public-level' WHEN 1 THEN 'public-level' WHEN 2 THEN 'private-level' ELSE 'unknown-level' END AS reason FROM events""")
def privacy_decisions(spark, sf_dir):
    payload = F.element_at(F.array(F.lit('{"k":1}'), F.lit('{"privacy":"public"}'), F.lit('{"privacy":"secret"}'), F.lit('{"privacy":null}'), F.lit('{"privacy":"odd"}')), (F.col("event_id") % 5 + 1).cast("int"))
    rows = tables.table(spark, sf_dir, "events").select("event_id", privacy.classify(privacy.privacy_level(payload)).alias("d"))
    return rows.select("event_id", "d.level", "d.allowed", "d.reason")


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as raw chat messages."""
    turns = tables.table(spark, sf_dir, "conversations")
    order = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    hour = F.lpad((F.col("turn") % 24).cast("string"), 2, "0")
    rows = turns.select((F.col("conv_id") * 1000 + order).alias("seq"), F.lit("libera").alias("server"), F.concat(F.lit("#"), F.col("conv_id").cast("string")).alias("room"), F.col("role").alias("nick"), F.coalesce("text", F.lit("")).alias("message"), F.concat(F.lit(":"), "role").alias("raw"), F.concat(F.lit("2024-01-02T"), hour, F.lit(":00:00Z")).alias("observed_at"))
    return ev.irc_events(rows)


MESSAGE_SQL = r"""m AS (
    SELECT conv_id * 1000 + row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS seq, CAST(conv_id AS VARCHAR) AS room, role, coalesce(text, '') AS message, turn % 24 AS h, '2024-01-02T' || lpad(CAST(turn % 24 AS VARCHAR), 2, '0') || ':00:00Z' AS iso FROM conversations
), j AS (SELECT *, CAST(to_json(message) AS VARCHAR) AS quoted, CAST(to_json(message[1:160]) AS VARCHAR) AS short FROM m
), y AS (SELECT *, 'cidv0-local-sha256:' || sha256('{"kind":"raw-payload","message":' || quoted || ',"nick":"' || role || '","observedAt":"' || iso || '","raw":":' || role || '","room":"#' || room || '","schema":"raw-irc-v0.1","server":"libera","transport":"irc"}') AS payload_cid FROM j
), z AS (SELECT *, sha256('{"actorPath":["irc","libera","user","' || role || '"],"causal":{"inputEventIds":[],"outputArtifactIds":[],"parentEventIds":[],"rootEventId":null},"channelPath":["irc","libera","channel","#' || room || '"],"kind":"event-trace","provenance":{"ingestionPipeline":"event-trace-v0","observedBy":"' || observer || '","source":"irc"},"schema":"event-trace-v0.1","time":{"day":2,"hour":' || h
        || ',"iso":"' || iso || '","minute":0,"month":1,"second":0,"year":2024},"value":{"contentType":"application/json","kind":"message","payloadCid":"' || payload_cid || '","preview":' || short || '}}') AS digest FROM y, observers
), first AS (SELECT digest, min(seq) AS seq FROM z GROUP BY digest)"""


@query("WITH observers AS (SELECT '" + ev.UNKNOWN_PROVENANCE["observedBy"] + "' AS observer), " + MESSAGE_SQL + """
    SELECT z.seq, 'event:' || digest AS event_id, 'cidv0-local-sha256:' || digest AS event_cid, payload_cid, '/irc,/irc/libera,/irc/libera/user,/irc/libera/user/' || role AS actor_keys,
        '/irc,/irc/libera,/irc/libera/channel,/irc/libera/channel/%23' || room AS channel_keys, 'message' AS value_kind, 'event:' || digest AS root_event_id, '/2024/01/02/' || lpad(CAST(h AS VARCHAR), 2, '0') AS shard_path FROM z JOIN first USING (digest, seq)""")
def ingested_messages(spark, sf_dir):
    """Conversation turns as chat messages, ingested: identities, prefix keys, conflicts."""
    rows = ev.accepted(ev.pointers(ev.with_identities(_messages(spark, sf_dir))))
    return rows.select("seq", "event_id", "event_cid", "payload_cid", F.array_join("actor_keys", ",").alias("actor_keys"), F.array_join("channel_keys", ",").alias("channel_keys"), "value_kind", "root_event_id", "shard_path")


@query("""SELECT '/2024/01/02/' || lpad(CAST(turn % 24 AS VARCHAR), 2, '0') AS shard_path, count(DISTINCT (conv_id, role, coalesce(text, ''))) AS n FROM conversations GROUP BY shard_path""")
def streamed_messages(spark, sf_dir):
    """The same messages through a stream into a table: events an hour shard holds."""
    raw = scratch_path(spark, "stream")
    _messages(spark, sf_dir).write.parquet(f"{raw}/in")
    table = ingest.EventTable(spark, f"{raw}/events")
    stream = spark.readStream.schema(ev.RAW_COLUMNS).option("maxFilesPerTrigger", 1000).parquet(f"{raw}/in")
    ingest.start(stream, table, f"{raw}/checkpoint").awaitTermination()
    return table.frame().groupBy("shard_path").agg(F.count(F.lit(1)).alias("n"))


from tracemill import artifact_queries  # noqa: E402, F401  the rest of the list
