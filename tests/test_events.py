import itertools
import random

import pytest
from pyspark.sql import functions as F

from tracemill.functions import identity
from tracemill.operators import batches, privacy, scaling, snapshots
from tracemill.operators import events as ev
from tracemill.operators import postings as px
from tracemill.operators.components import components
from tracemill.sources import objects, pointer_log
from tracemill.streaming import ingest

AT = "2026-06-27T14:00:0{}Z"


def raw(spark, rows):
    base = {"payload": '{"k":1}', "observed_at": AT.format(0), "actor_path": ["a", "b"], "channel_path": ["c"], "value_kind": "message", "content_type": None, "preview": None, "provenance": None, "parent_event_ids": None, "root_event_id": None, "input_event_ids": None, "output_artifact_ids": None}
    return spark.createDataFrame([tuple(({"seq": i} | base | r).values()) for i, r in enumerate(rows)], ev.RAW_COLUMNS)


def test_identity_of_rows_is_that_of_plain_documents(spark):
    rows = raw(spark, [{"payload": '{"b": 1.0, "a": "é"}', "preview": "p"}, {"root_event_id": "event:x", "provenance": '{"source":"s"}'}])
    for r in ev.with_identities(rows).orderBy("seq").collect():
        plain = ev.identify({"payload": eval(r.payload), "observed_at": r.observed_at, "actor_path": r.actor_path, "channel_path": r.channel_path, "value_kind": r.value_kind, "preview": r.preview, "root_event_id": r.root_event_id, "provenance": eval(r.provenance) if r.provenance else None})
        assert (r.event_id, r.event_cid, r.payload_cid, r.envelope) == tuple(plain[k] for k in ("event_id", "event_cid", "payload_cid", "envelope"))
        assert identity.digest_of(r.event_cid) == r.event_id.removeprefix("event:")


def fold(rows):
    ids, cids, out = set(), set(), []
    for _, i, c in sorted(rows):
        said = "duplicate-event-id" if i in ids else "duplicate-event-cid" if c in cids else "accepted"
        if said == "accepted":
            ids.add(i)
            cids.add(c)
        out.append(said)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_conflicts_match_a_fold_in_order(spark, seed):
    rnd = random.Random(seed)
    n = rnd.choice([2, 3, 6])
    rows = [(i, f"i{rnd.randrange(n)}", f"c{rnd.randrange(n)}") for i in range(14)]
    got = ev.conflict_acks(spark.createDataFrame(rows, "seq long, event_id string, event_cid string")).orderBy("seq").collect()
    assert [r.ack for r in got] == fold(rows)


def test_a_row_rejected_for_its_cid_reserves_no_id(spark):
    rows = [(0, "1", "a"), (1, "2", "a"), (2, "2", "b"), (3, "2", "a")]
    got = ev.conflict_acks(spark.createDataFrame(rows, "seq long, event_id string, event_cid string")).orderBy("seq").collect()
    assert [r.ack for r in got] == ["accepted", "duplicate-event-cid", "accepted", "duplicate-event-id"]
    held = spark.createDataFrame([(9, "2", "z")], "seq long, event_id string, event_cid string")
    got = ev.conflict_acks(spark.createDataFrame(rows, "seq long, event_id string, event_cid string"), held).orderBy("seq").collect()
    assert [r.ack for r in got] == ["accepted", "duplicate-event-id", "duplicate-event-id", "duplicate-event-id"]


def test_roots_follow_first_parents(spark):
    rows = [{"payload": f'{{"n":{i}}}'} for i in range(5)]
    p = ev.pointers(ev.with_identities(raw(spark, rows)))
    ids = [r.event_id for r in p.orderBy("seq").collect()]
    parents = {ids[1]: [ids[0]], ids[2]: [ids[1], ids[4]], ids[3]: ["event:unknown"]}
    chained = spark.createDataFrame([(i, parents.get(i, []), None) for i in ids], "event_id string, parent_event_ids array<string>, root_event_id string")
    got = {r.event_id: r.root_event_id for r in ev.resolve_roots(chained).collect()}
    assert got == {ids[0]: ids[0], ids[1]: ids[0], ids[2]: ids[0], ids[3]: ids[3], ids[4]: ids[4]}
    known = spark.createDataFrame([("event:unknown", "event:far")], "event_id string, root_event_id string")
    assert {r.event_id: r.root_event_id for r in ev.resolve_roots(chained, known).collect()}[ids[3]] == "event:far"
    loop = spark.createDataFrame([("x", ["y"], None), ("y", ["x"], None)], chained.schema)
    with pytest.raises(ValueError, match="cycle"):
        ev.resolve_roots(loop)


def test_keys_repeated_in_an_event_count_once(spark):
    p = ev.pointers(ev.with_identities(raw(spark, [{"parent_event_ids": ["event:p", "event:p"]}])))
    assert px.lookup(px.event_postings(p), "parent", "event:p").count() == 1
    assert ev.parent_edges(p).count() == 2
    assert px.lookup(px.event_postings(p), "parent", "event:none").count() == 0
    assert px.all_of(px.event_postings(p), []).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components_match_union_find(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in {y for e in edges for y in e if e[0] != e[1]}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_objects(spark, tmp_path):
    for store in (objects.MemoryObjects(spark), objects.ParquetObjects(spark, f"file://{tmp_path}/o")):
        cid = store.put_json({"b": 1, "a": "é"})
        assert store.put_bytes('{"a":"é","b":1}'.encode(), "raw") == cid
        assert store.get_json(cid) == {"a": "é", "b": 1} and store.has(cid) and store.frame().count() == 1
        assert store.stat(cid)["codec"] == "dag-json" and store.verify(cid)["ok"] and not store.verify("none")["ok"]
        assert not store.has("none")
        with pytest.raises(KeyError):
            store.get_bytes("none")
        with pytest.raises(KeyError):
            store.stat("none")
    bad = store.frame().withColumn("data", F.lit("other").cast("binary"))
    assert not objects.audit(bad).first().ok
    with pytest.raises(Exception, match="don't match"):
        objects.verified(bad).collect()


def test_pointer_log(spark, tmp_path):
    path = tmp_path / "log"
    path.write_text('{"eventId":"a"}\n\n{"eventId":"b","x":1}\nbad\n{"eventId":"a","x":2}\n')
    lines = pointer_log.read_lines(spark, f"file://{path}")
    assert pointer_log.log_stats(lines).first().asDict() == {"line_count": 5, "unique_event_count": 2, "duplicate_event_ids": 1, "bad_json_lines": 1}
    assert [r.line for r in pointer_log.unique_pointers(lines).orderBy("seq").collect()] == ['{"eventId":"a"}', '{"eventId":"b","x":1}']
    assert pointer_log.checksum(spark, f"file://{path}") == identity.sha256_hex(path.read_bytes())
    path.write_text('{"eventId":7}\n')
    with pytest.raises(Exception, match="no string eventId"):
        pointer_log.unique_pointers(pointer_log.read_lines(spark, f"file://{path}")).collect()


def test_privacy(spark):
    rows = raw(spark, [{"payload": p, "provenance": q} for p, q in (('{"k":1}', '{"source":"s"}'), ('{"privacy":"secret"}', None), ('{"privacy":null}', None), ('{"privacy":"odd"}', None), ('{"privacy":"public"}', None))])
    shown, rejected = privacy.public_events(rows)
    assert [r.seq for r in shown.orderBy("seq").collect()] == [0, 4]
    assert [(r.seq, r.reason) for r in rejected.orderBy("seq").collect()] == [(1, "private-level"), (2, "unknown-level"), (3, "unknown-level")]
    import json

    assert json.loads(shown.orderBy("seq").first().provenance) == {"source": "s", "privacy": {"level": "public", "pathMode": "plain", "publicIndexAllowed": True, "reason": "public-level"}}
    held = raw(spark, [{"payload": '{"k":1}', "provenance": q} for q in ('{"privacy":{"old":1},"n":{"deep":[1,"}"]}}', "[1]", "not json")])
    merged = [json.loads(r.provenance) for r in privacy.public_events(held)[0].orderBy("seq").collect()]
    assert merged[0]["n"] == {"deep": [1, "}"]} and merged[0]["privacy"]["reason"] == "public-level" and set(merged[1]) == set(merged[2]) == {"privacy"}
    with pytest.raises(ValueError, match="salt"):
        privacy.hashed_path_events(rows, privacy.PublicIndexPolicy())
    hashed = privacy.hashed_path_events(rows, privacy.PublicIndexPolicy(salt="test-salt")).orderBy("seq").collect()
    assert len(hashed) == 5 and hashed[0].actor_path[0] == "hash-sha256:" + identity.sha256_hex(b"test-salt\0a")
    assert '"pathMode":"hashed"' in hashed[1].provenance and "secret" in hashed[1].provenance


def test_merkle_and_anchors(spark):
    import hashlib

    h = lambda b: hashlib.sha256(b).digest()
    assert batches.merkle_root([]) == hashlib.sha256(b"").hexdigest()
    assert batches.merkle_root([b"a"]) == h(b"a").hex()
    assert batches.merkle_root([b"a", b"b", b"c"]) == h(h(h(b"a") + h(b"b")) + h(h(b"c") + h(b"c"))).hex()
    p = ev.pointers(ev.with_identities(raw(spark, [{"payload": f'{{"n":{i}}}', "observed_at": AT.format(i)} for i in range(7)])))
    rows = batches.split(batches.pointer_documents(p), 3).cache()
    made = batches.anchors(rows, "r", "log").orderBy("batch").collect()
    assert [r.event_count for r in made] == [3, 3, 1] and {r.shard_path for r in made} == {"/2026/06/27/14"}
    assert (made[0].min_observed_at, made[0].max_observed_at) == ("2026-06-27T14:00:00Z", "2026-06-27T14:59:59Z")
    import json

    docs = [json.loads(r.pointer) for r in rows.orderBy("row_no").collect()]
    assert made[0].merkle_root == "sha256-merkle:" + batches.merkle_root([identity.ascii_json(d).encode() for d in docs[:3]])
    one = batches.anchor_lookup(batches.anchors(rows, "r", "log"), "merkle_root", made[1].merkle_root)
    assert [r.batch_id for r in one.collect()] == ["batch:r:0001"]
    with pytest.raises(ValueError):
        batches.anchor_lookup(rows, "color", "x")


def test_common_shards_of_mixed_and_missing_times(spark):
    rows = [(0, ["/2026", "/2026/06"]), (0, ["/2026", "/2026/07"]), (1, ["/2025"]), (1, ["/2026"]), (2, [])]
    got = {r.batch: r.shard_path for r in batches.common_shards(spark.createDataFrame(rows, "batch long, time_keys array<string>")).collect()}
    assert got == {0: "/2026", 1: "/stored-events", 2: "/stored-events"}


def test_streaming_counts_each_batch_once(spark, tmp_path):
    first, second = raw(spark, [{"payload": f'{{"n":{i}}}'} for i in range(4)]), raw(spark, [{"payload": f'{{"n":{i}}}'} for i in range(2, 6)])
    table = ingest.EventTable(spark, f"file://{tmp_path}/events")
    for number, batch in ((0, first), (1, second), (1, second)):
        shards = table.ingest(batch, number)
        ingest.rebuild(table, shards, f"file://{tmp_path}/snap")
    assert table.frame().count() == 6
    snap = snapshots.read(spark, f"file://{tmp_path}/snap", "/2026/06/27/14")
    assert sorted(r.local_id for r in snap.events.collect()) == list(range(1, 7))
    assert {r.shard_path for r in shards.collect()} == {"/2026/06/27/14"}


def test_sharding_advice_needs_more_than_the_limit(spark):
    measure = spark.createDataFrame([(5, 9)], "events long, total_index_entries long")
    shards = spark.createDataFrame([("/s", 3)], "shard_path string, posting_entries long")
    ask = lambda *limits: list(scaling.recommend(measure, shards, scaling.Thresholds(*limits)).first().reasons)
    assert ask(5, 9, 3) == [] and ask(4, 8, 2) == ["event-count", "index-entry-count", "snapshot-posting-entry-count"]


def test_numbering_is_dense_over_partitions(spark):
    rows = spark.range(0, 500, 1, 7).select((F.col("id") * 37 % 1009).alias("seq")).repartition(5)
    got = batches.numbered(rows).orderBy("seq").collect()
    assert [r.row_no for r in got] == list(range(500))
    assert list(itertools.islice((r.seq for r in got), 3)) == sorted(r.seq for r in got)[:3]
