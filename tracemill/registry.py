"""The list of the library's queries, each beside its SQL twin, and SQL that several twins share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: The events table as index rows, in SQL.
E = """e AS (
    SELECT event_id AS seq, 'event:' || event_id AS event_id, ts, 'cidv0-local-sha256:' || sha256('event:' || event_id) AS event_cid,
        'cidv0-local-sha256:' || sha256(props) AS payload_cid, '/app/user/' || user_id AS actor_key, '/app/events/' || event_type AS channel_key,
        event_type AS kind, strftime(ts, '/%Y/%m/%d/%H') AS shard_path, strftime(ts, '%Y-%m-%d') AS day,
        'event:' || first_value(event_id) OVER t AS root, 'event:' || lag(event_id) OVER t AS parent
    FROM events WINDOW t AS (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id))"""
LOCAL = E + ", s AS (SELECT *, row_number() OVER (PARTITION BY shard_path ORDER BY seq) AS local_id FROM e)"
TOKENS = LOCAL + """, k AS (
    SELECT shard_path, local_id, unnest(['event.kind:' || kind, 'actor:' || actor_key, 'channel:' || channel_key, 'root:' || root]) AS token FROM s)"""
#: Postings of the eight event indexes, in SQL.
P = E + """, p AS (
    SELECT unnest(['time','time','time','time','actor','actor','actor','channel','channel','channel','kind','parent','root','payload','event_cid']) AS index,
        unnest([shard_path[1:5], shard_path[1:8], shard_path[1:11], shard_path, '/app', '/app/user', actor_key, '/app', '/app/events', channel_key, kind, parent, root, payload_cid, event_cid]) AS key,
        event_id AS id, seq FROM e), q AS (SELECT * FROM p WHERE key IS NOT NULL)"""
#: Labelled documents as derived artifacts, in SQL.
D = """d AS (
    SELECT doc_id AS seq, 'doc:' || doc_id AS event_id, lang, source, quality, toxic, 'run:' || sha256(lang) AS run_id,
        '{"source":"' || source || '"}' AS subject, '{"quality":' || quality || '}' AS object, CASE WHEN toxic = 1 THEN 'denied' ELSE 'asserted' END AS polarity
    FROM documents JOIN labels USING (doc_id)), c AS (
    SELECT *, 'claim:' || sha256('{"kind":"claim","object":' || object || ',"predicate":{"name":"quality"},"schema":"claim-core-v0.1","subject":' || subject || '}') AS claim_id FROM d), o AS (
    SELECT *, 'claim-occ:' || sha256(claim_id || '|' || event_id || '|' || run_id || '|' || polarity) AS occurrence_id,
        'feature:' || sha256('topic|' || lang) AS feature_id FROM c), f AS (
    SELECT *, 'feature-occ:' || sha256(feature_id || '|' || event_id) AS feature_occurrence_id FROM o)"""
#: The events of a month as one shard, and their tokens, in SQL.
MONTH = E + """, s AS (SELECT * REPLACE ('/2024/01' AS shard_path), row_number() OVER (ORDER BY seq) AS local_id FROM e WHERE starts_with(shard_path, '/2024/01'))"""
MONTH_TOKENS = MONTH + """, k AS (
    SELECT shard_path, local_id, unnest(['event.kind:' || kind, 'actor:' || actor_key, 'channel:' || channel_key, 'root:' || root]) AS token FROM s)"""
