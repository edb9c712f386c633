"""Artifact writers, facts, metrics, look-ups and stored snapshots against the recorder and plain Python."""

import json

import pytest
from pyspark.sql import functions as F

from tests.corpus import document
from tracemill import artifact_queries
from tracemill.functions import deltas, identity
from tracemill.operators import artifacts as art
from tracemill.operators import facts, metrics, mining, snapshots
from tracemill.operators import postings as px
from tracemill.plans import flow
from tracemill.schemas import FAMILIES
from tracemill.scratch import scratch_root
from tracemill.sources import objects, tables


@pytest.fixture(scope="module")
def done(spark):
    f = flow.Flow(spark, document())
    f.run()
    return f


def test_rows_are_written_as_the_recorder_writes_them(spark, done):
    """Every artifact of the flow, taken apart into columns and written again by Spark."""
    held = done.recorder.artifacts().collect()
    assert {r.family for r in held} == set(FAMILIES)
    for family, spec in FAMILIES.items():
        whole = not spec.body or family in ("pattern", "reasoning-input")
        fields = sorted({*([] if whole else spec.body.split()), *spec.pointer.split()})
        rows = []
        for r in (r for r in held if r.family == family):
            values = json.loads(r.pointer) | ({} if whole else json.loads(r.body))
            shown = [json.dumps(values[f], indent=1) if f in art.OPEN_FIELDS else values[f] for f in fields]
            rows.append((r.seq, *shown, *([r.body] if whole else [])))
        kind = lambda f: "string" if f in art.OPEN_FIELDS else "double" if f in art.FLOAT_FIELDS else "array<string>" if any(isinstance((json.loads(r.pointer) | json.loads(r.body)).get(f), list) for r in held if r.family == family) else "string"  # noqa: E731, B023
        schema = ", ".join(["seq long", *(f"`{f}` {kind(f)}" for f in fields), *(["core string"] if whole else [])])
        made = art.rows_of(family, spark.createDataFrame(rows, schema)).collect()
        assert sorted(map(tuple, made)) == sorted((r.seq, family, r.id, r.cid, r.body, r.pointer) for r in held if r.family == family)


def test_role_keys_and_odd_values(spark):
    runs = spark.createDataFrame([("claim-extraction", "a"), ("pattern-mining", "b"), ("reasoning", "c"), ("other", "d")], "runType string, actorKey string")
    assert [tuple(r)[2:] for r in art.with_role_keys(runs).orderBy("actorKey").collect()] == [("a", "", ""), ("", "b", ""), ("", "", "c"), ("", "", "")]
    odd = spark.createDataFrame([(1, 'quote " and \\ and\n', ["ü", ""]), (2, None, [])], "seq long, relation string, members array<string>").withColumn("method", F.lit(None).cast("string")).withColumn("confidence", F.lit(0.1))
    for r in art.rows_of("claim-cluster", odd).collect():
        body = json.loads(r.body)
        assert r.body == identity.canonical_json(body) and r.id == "claim-cluster:" + identity.sha256_hex(r.body.encode()) and body["method"] is None
    assert art.rows_of("claim-cluster", odd.where("false")).count() == 0


def test_look_ups_say_what_they_do_not_find(spark, done):
    held = done.recorder.artifacts()
    wanted = held.select("family", "id").unionByName(spark.createDataFrame([("run", "run:none"), ("run", "run:none"), ("none", "x")], "family string, id string"))
    got = art.get_many(held.unionByName(held), wanted).collect()
    assert len(got) == held.count() + 2 and {(r.family, r.id) for r in got if not r.found} == {("run", "run:none"), ("none", "x")}
    assert all((r.body is None) == (not r.found) for r in got)
    events = done.recorder.events()
    ids = events.select("event_id").limit(2).unionByName(spark.createDataFrame([("event:none",)], "event_id string"))
    assert sorted(r.found for r in px.get_many_events(events, ids).collect()) == [False, True, True]


def test_a_stored_snapshot_mines_as_a_fresh_one(spark, done, tmp_path):
    fresh = snapshots.build(done.recorder.events(), done.recorder.artifacts())
    snapshots.write(fresh, f"file://{tmp_path}/s")
    snapshots.write(fresh, f"file://{tmp_path}/s")  # shards are replaced
    for shard in (None, "/2031/03/04/09"):
        held = snapshots.read(spark, f"file://{tmp_path}/s", shard)
        fresh_part = fresh if shard is None else snapshots.Snapshot(shard, fresh.events.where(F.col("shard_path") == shard), fresh.tokens.where(F.col("shard_path") == shard), fresh.edges.where(F.col("shard_path") == shard), fresh.claims, fresh.features)
        mine = lambda s: sorted(map(str, mining.attached_claims(s, mining.mine_itemset(s, ["event.kind:reading"]).occurrences).collect()))
        assert mine(held) == mine(fresh_part) and any("claim-occ" in x for x in mine(held))
        assert sorted(map(tuple, held.tokens.select("shard_path", "token", "local_id").collect())) == sorted(map(tuple, fresh_part.tokens.select("shard_path", "token", "local_id").collect()))
    assert {r.feature_id for r in snapshots.read(spark, f"file://{tmp_path}/s").features.collect()} == {json.loads(x.pointer)["featureId"] for x in done.recorder.artifacts().collect() if x.family == "feature-occurrence"}


def most_joined_rows(df):
    """The rows of the largest join that ``df`` ran, by its plan's own figures."""
    df.collect()
    left, most = [df._jdf.queryExecution().executedPlan()], 0
    while left:
        node = left.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            left.append(node.plan())
        else:
            left += [node.children().apply(i) for i in range(node.children().size())]
        if "Join" in kind:
            most = max(most, node.metrics().apply("numOutputRows").value())
    return most


def test_a_feature_written_for_many_events_is_joined_once(spark):
    """A feature is one artifact, though each of its writers adds a row: joined by rows, tokens would take their number squared."""
    n, seen = 200, F.col("seq").cast("string")
    rows = spark.range(n).select(F.col("id").alias("seq"))
    made = lambda family, id_, **fields: rows.select("seq", F.lit(family).alias("family"), id_.alias("id"), F.lit("c").alias("cid"), F.lit("b").alias("body"), identity.sorted_json(**fields).alias("pointer"))
    written = made("feature", F.lit("feature:1"), featureId=F.lit("feature:1"), featureType=F.lit("topic")).unionByName(made("feature-occurrence", F.concat(F.lit("o"), seen), featureId=F.lit("feature:1"), sourceEventId=F.concat(F.lit("e"), seen)))
    keys, none = F.array(F.lit("/a")), F.array().cast("array<string>")
    events = rows.select("seq", F.concat(F.lit("e"), seen).alias("event_id"), F.lit("k").alias("value_kind"), keys.alias("actor_keys"), keys.alias("channel_keys"), F.lit("r").alias("root_event_id"), none.alias("parent_event_ids"), F.lit("/2031").alias("shard_path"))
    tokens = snapshots.build(events, written).tokens.where("token like 'feature%'")
    assert most_joined_rows(tokens) == n
    assert {(r.token, r["count"]) for r in tokens.groupBy("token").count().collect()} == {("feature:feature:1", n), ("feature.type:topic", n)}


@pytest.mark.parametrize("most", [0, 10**6])
def test_local_ids_by_ranges_and_by_shards(spark, monkeypatch, most):
    monkeypatch.setattr(snapshots, "SHARD_ROWS", most)
    rows = [(i, "a" if i % 3 else "b") for i in range(5000)]
    got = snapshots.with_local_ids(spark.createDataFrame(rows, "seq long, shard_path string").repartition(16)).collect()
    want, at = {}, {"a": 0, "b": 0}
    for seq, shard in rows:
        at[shard] += 1
        want[seq] = at[shard]
    assert {r.seq: r.local_id for r in got} == want


def test_a_large_shard_is_numbered_by_several_tasks(spark):
    """One window over a shard of hundreds of thousands of rows would sort them in one task, for each part of a snapshot again."""
    n = 300_000
    rows = spark.range(0, 2 * n, 2).select(F.col("id").alias("seq"), F.lit("/2031").alias("shard_path"))
    got = snapshots.with_local_ids(rows).withColumn("task", F.spark_partition_id())
    assert got.where("local_id <> seq / 2 + 1").count() == 0
    sizes = [r["count"] for r in got.groupBy("task").count().collect()]
    assert sum(sizes) == n and max(sizes) < n


def test_repeated_documents_have_an_occurrence_each(spark, tmp_path):
    """As in SQL: a claim's id comes from its own row, so rows of one id are not paired with each other."""
    spark.createDataFrame([(1, "en", "web"), (1, "en", "web"), (2, "de", "web")], "doc_id long, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = tables.artifacts(spark, str(tmp_path)).groupBy("family", "seq").count().collect()
    assert {(r.family, r.seq): r["count"] for r in found} == {(f, s): 3 - s for s in (1, 2) for f in ("run", "claim", "claim-occurrence", "feature", "feature-occurrence")}


def test_a_snapshot_stored_at_once_is_the_one_built_and_written(spark, done, tmp_path):
    events, artifacts = done.recorder.events(), done.recorder.artifacts()
    snapshots.write(snapshots.build(events, artifacts), f"file://{tmp_path}/built")
    snapshots.store(events, artifacts, f"file://{tmp_path}/stored")
    built, stored = (snapshots.read(spark, f"file://{tmp_path}/{x}") for x in ("built", "stored"))
    for part in snapshots.LAYOUTS:
        want, got = (sorted(map(str, getattr(s, part).collect())) for s in (built, stored))
        assert got == want and got
    with pytest.raises(Exception, match="already exists"):
        snapshots.store(events, artifacts, f"file://{tmp_path}/stored")


def test_a_stored_occurrence_is_drawn_once(spark, done, tmp_path):
    """Every pointer is built and parsed once, though several parts of a snapshot are made of it."""
    calls = spark.sparkContext.accumulator(0)

    def seen(pointer):
        calls.add(1)
        return pointer

    artifacts = done.recorder.artifacts()
    n = artifacts.where("family in ('claim-occurrence', 'feature-occurrence', 'feature')").count()
    drawn = artifacts.withColumn("pointer", F.udf(seen, "string")("pointer"))
    snapshots.write(snapshots.build(done.recorder.events(), drawn), f"file://{tmp_path}/s")
    assert calls.value == n


def test_occurrences_of_repeated_events_are_stored_once(spark, tmp_path):
    """A shard that has an event twice has each of its occurrences once, and tokens for both of its places."""
    spark.createDataFrame([(1, "a", "en", "web"), (1, "b", "en", "web"), (2, "c", "de", "web")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = artifact_queries.stored_snapshot_components(spark, str(tmp_path)).groupBy("kind", "event_id").count().collect()
    assert {(r.kind, r.event_id): r["count"] for r in rows} == {("claim", "doc:1"): 2, ("claim", "doc:2"): 1, ("feature", "doc:1"): 2, ("feature", "doc:2"): 1}
    snap = snapshots.build(tables.document_events(spark, str(tmp_path)), tables.artifacts(spark, str(tmp_path)))
    assert snap.claims.count() == snap.features.count() == 3
    assert snap.tokens.where("token = 'artifact.kind:claim-occurrence'").count() == 3


def test_compacted_postings_name_their_snapshot(spark):
    tokens = spark.createDataFrame([("s", "t", 5), ("s", "t", 2), ("u", "t", 1)], "shard_path string, token string, local_id long")
    named = spark.createDataFrame([("s", "cid-of-s")], "shard_path string, snapshot_cid string")
    got = {r.shard_path: (r.source_snapshot_cid, r.schema, list(r.gaps)) for r in deltas.compact_snapshot(tokens, named).collect()}
    assert got == {"s": ("cid-of-s", "delta-postings-v0.1", [2, 3]), "u": (None, "delta-postings-v0.1", [1])}


def test_facts_repeat_and_batches_may_leave_them_out(spark, done):
    events = done.recorder.events()
    found = facts.event_facts(events.unionByName(events), "ns").groupBy("name", "value").count().collect()
    assert {r["count"] for r in found} == {2} and all(r.name.startswith("ns:RSpace") for r in found)
    anchors = spark.createDataFrame([("b1", 3, "e", "p", "m", "/s")], "batch_id string, event_count long, event_manifest_cid string, postings_manifest_cid string, merkle_root string, shard_path string")
    alone, acks = facts.put_batch(anchors, events, "ns", details=False)
    assert alone.count() == 5 and acks.first().event_facts is False
    assert facts.put_batch(anchors, events, "ns", details=True)[0].count() == 5 + facts.event_facts(events, "ns").count()


def test_metrics_by_hand(spark):
    log = spark.createDataFrame(
        [("x", 1, 10, 0, 5, 20, 1, 3), ("x", 1, 10, 1, 9, 30, 2, 4), ("x", 2, 30, 2, 7, 40, 2, 4), ("y", 1, 5, 0, None, None, 9, 1)],
        "label string, batch_id long, events long, s int, i int, f int, block long, cost long",
    ).select("label", "batch_id", "events", *(F.timestamp_seconds(c).alias(n) for c, n in (("s", "submitted_at"), ("i", "included_at"), ("f", "finalized_at"))), "block", "cost")
    got = {r.label: r.asDict() for r in metrics.workload_metrics(log).collect()}
    x = got["x"]
    assert (x["events"], x["batches"], x["first_inclusion_s"], x["canonical_added_s"], x["finality_s"], x["canonical_block_count"], x["total_cost_sum"], x["cost_avg"]) == (40, 2, 5, 7, 40, 2, 7, 3.5)
    assert x["events_per_s_to_finality"] == 1 and x["canonical_added_to_finality_s"] == 33
    assert got["y"]["finality_s"] is None and got["y"]["total_cost_sum"] is None
    was = metrics.workload_metrics(log.withColumn("cost", F.col("cost") * 2))
    rows = {(r.label, r.measure): (r.delta, r.ratio) for r in metrics.compare_to_baseline(metrics.workload_metrics(log), was).collect()}
    assert rows["x", "total_cost_sum"] == (-7, 0.5) and rows["x", "finality_s"] == (0, 1) and not any(k[0] == "y" for k in rows)


def test_objects_of_a_session(spark):
    store = objects.MemoryObjects(spark)
    cid = store.put_json({"b": 1, "a": [2]})
    assert store.put_json({"a": [2], "b": 1}, "raw") == cid and store.frame().count() == 1
    assert store.get_json(cid) == {"a": [2], "b": 1} and store.stat(cid)["codec"] == "dag-json" and store.has(cid) and not store.has("none")
    with pytest.raises(KeyError):
        store.get_bytes("none")
    asked = spark.createDataFrame([(cid,), ("none",), (None,)], "cid string")
    assert {r.cid: r.found for r in objects.lookup(store.frame(), asked).collect()} == {cid: True, "none": False, None: False}
    broken = store.frame().withColumn("data", F.lit(b"other"))
    with pytest.raises(Exception, match="don't match"):
        objects.lookup(broken, asked).collect()


def test_scratch_of_a_cluster_must_be_shared():
    class Session:
        class conf:
            get = staticmethod(lambda name, default=None: None)

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                sc = staticmethod(lambda: type("S", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isDefined": staticmethod(lambda: False)}))}))

    with pytest.raises(RuntimeError, match="share"):
        scratch_root(Session)


def test_reports_are_events(spark, done):
    f = flow.Flow(spark, {"steps": document()["steps"] + [
        {"step": "report_pattern", "as": "found", "run": "$dig", "pattern": "$cool", "observedAt": "2031-03-04T10:00:00Z", "parents": ["$hot.event_id"], "agent": ["agent", "house", "miner", "digger-1"], "channel": ["system", "mining"]},
        {"step": "report_belief", "as": "thought", "run": "$think", "output": "$first", "observedAt": "2031-03-04T10:01:00Z", "parents": ["$hot.event_id"], "agent": ["agent", "house", "reasoner", "thinker-2"], "channel": ["system", "reasoning"]},
    ]})
    f.run()
    rows = {r.event_id: r for r in f.recorder.events().collect()}
    found, thought = rows[f.results["found"]["event_id"]], rows[f.results["thought"]["event_id"]]
    assert list(found.output_artifact_ids) == [f.results["cool"]["id"], *f.results["cool"]["occurrences"]] and found.value_kind == "pattern-discovery"
    assert list(thought.output_artifact_ids) == [f.results["first"]["id"]] and thought.root_event_id == f.results["hot"]["event_id"]
