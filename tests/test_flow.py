import json

import pytest
from pyspark.sql import functions as F

from tests.corpus import core, document, tool_run
from tracemill import cli
from tracemill.functions import identity
from tracemill.operators import mining, reasoning, snapshots
from tracemill.operators import postings as px
from tracemill.plans import flow
from tracemill.plans.recorder import Recorder


@pytest.fixture(scope="module")
def done(spark):
    f = flow.Flow(spark, document())
    return f, f.run()


def test_all_checks_hold(done):
    f, out = done
    assert out["ok"] and all(out["checks"].values()), out["checks"]
    assert out["events"] == 7 and out["artifacts"] == {"run": 4, "claim": 2, "claim-occurrence": 3, "claim-cluster": 1, "feature": 1, "feature-occurrence": 1, "pattern": 3, "pattern-occurrence": 4, "reasoning-input": 1, "reasoning-output": 2, "belief-revision-history": 1}
    assert f.results["hour"]["events"] == 6


def test_support_vectors(done):
    f, _ = done
    seq, item, motif = (f.results[k]["vector"] for k in ("cool", "twice", "reply"))
    assert (seq["rootTraceSupport"], seq["occurrenceSupport"], seq["eventSupport"], seq["sourceSupport"], seq["extractorRunSupport"]) == (1, 1, 3, 1, 0)
    assert item["itemsetSupport"] == item["occurrenceSupport"] == 2 and item["rootTraceSupport"] == 2 and item["actorSupport"] == 1
    assert motif["edgeSupport"] == 1 and f.results["nothing"] == {"id": None, "occurrences": [], "vector": {}}


def test_identities_are_content_hashes(done):
    f, _ = done
    run = next(a for a in f.recorder._artifacts.values() if a[2] == f.results["read"]["id"])
    assert run[2] == "run:" + identity.sha256_hex(run[4].encode()) and run[3] == identity.cid(run[4].encode())
    pointer = json.loads(run[5])
    assert pointer["extractorKey"] == "reader-7" and pointer["minerKey"] == pointer["reasonerKey"] == ""
    assert pointer["kind"] == "run-pointer" and pointer["schema"] == "run-pointer-v0.1"


def test_reverse_indexes(done):
    f, _ = done
    posts = px.derived_postings(f.recorder.artifacts())
    ids = lambda index, key: [r.id for r in px.lookup(posts, index, key).collect()]
    read, r = f.results["read"]["id"], f.results
    assert ids("outputs_by_run", read) == [r[k]["id"] for k in ("thirsty", "thirsty_too", "airless", "heat")]
    assert ids("runs_by_extractor", "reader-7") == [read] and ids("runs_by_miner", "") == []
    assert ids("patterns_by_input_snapshot", r["hour"]["cid"]) == [r[k]["id"] for k in ("cool", "twice", "reply")]
    assert ids("patterns_by_type", "itemset") == [r["twice"]["id"]] and ids("runs_by_reasoner", "thinker-2") == [r["think"]["id"], r["rethink"]["id"]]
    assert ids("outputs_by_input", r["given"]["id"]) == ids("outputs_by_claim", r["thirsty"]["claim"]["id"]) == [r["first"]["id"], r["second"]["id"]]
    assert ids("clusters_by_claim", r["airless"]["claim"]["id"]) == [r["needs"]["id"]]


def test_snapshot_tokens_carry_claims_and_features(done):
    f, _ = done
    snap = f.results["hour"]["frames"]
    tokens = {r.token for r in snap.tokens.collect()}
    assert {"artifact.kind:claim-occurrence", "feature.type:heat", f"claim:{f.results['thirsty']['claim']['id']}"} <= tokens
    assert snap.events.agg(F.max("local_id")).first()[0] == 6


def test_empty_and_unknown_candidates(done):
    snap = done[0].results["hour"]["frames"]
    assert mining.support_for_tokens(snap, []).count() == 0
    assert mining.support_for_tokens(snap, ["nothing"]).count() == 0
    assert mining.mine_sequence(snap, []).occurrences.count() == 0
    assert mining.mine_sequence(snap, ["message"], min_support=99).support.count() == 0
    assert mining.mine_sequence(snap, ["reading", "vent"], max_window_seconds=1).occurrences.count() == 1
    assert mining.mine_sequence(snap, ["reading", "vent"], max_window_seconds=1, enforce_window=True).occurrences.count() == 0


def test_reasoning_rules(spark, done):
    f, _ = done
    rows = spark.createDataFrame([("denied",), ("Denied",), ("negative",), ("asserted",), (None,)], "p string")
    assert [r[0] for r in rows.select(reasoning.is_negative(F.col("p"))).collect()] == [True, False, True, False, False]
    first, claim = f.results["first"], f.results["thirsty"]["claim"]["id"]
    with pytest.raises(ValueError, match="belongs to claim claim:other"):
        f.recorder.belief_history(claim, [first, first | {"state": first["state"] | {"claimId": "claim:other"}}], "p")
    assert first["state"]["beliefStateId"] != f.results["second"]["state"]["beliefStateId"]
    outputs = spark.createDataFrame([("c1", "o1"), ("c2", "o2")], "claim_id string, output_id string")
    with pytest.raises(Exception, match="o2 belongs to claim c2"):
        reasoning.require_one_claim(outputs, "c1").collect()


def test_workers_chain_events(spark):
    rec = Recorder(spark)
    root = rec.irc_message({k: document()["steps"][0][k] for k in ("server", "room", "nick", "message", "raw", "observedAt")})
    at = lambda m: f"2031-03-04T10:{m:02}:00Z"
    q, r = rec.memory_query("q", [{"id": 1}], at(1), at(2), [root["event_id"]], agent=["agent", "house", "memory", "m-1"], channel=["system", "memory"])
    s, t, out, err = rec.shell_action({"command": ["ls"], "cwd": "/", "allowlistPolicy": "p"}, 0, "text", b"", at(3), at(4), [r["event_id"]], agent=["agent", "house", "shell", "s-1"], channel=["system", "shell"])
    run, claims, features, event = rec.extraction(tool_run("claim-extraction", "reader-7", "20"), [{"core": core("water"), "event_id": root["event_id"]}], [{"core": {"kind": "feature", "schema": "feature-core-v0.1", "featureType": "heat", "value": 1}, "event_id": "event:unknown"}], [root["event_id"]], [root["event_id"]], agent=["agent", "house", "reader", "reader-7"], channel=["system", "reading"])
    events = rec.events()
    posts = px.event_postings(events)
    assert [x.id for x in px.lookup(posts, "root", root["event_id"]).collect()] == [e["event_id"] for e in (root, q, r, s, t, event)]
    row = events.where(F.col("event_id") == t["event_id"]).first()
    assert list(row.output_artifact_ids) == [out, err] and out == identity.cid(b"text") and list(row.actor_path)[-1] == "s-1"
    with pytest.raises(KeyError):
        rec.claim_occurrence(core("water"), "event:unknown", run["id"], {})
    assert rec.claim(core("water"))["duplicate"]
    cluster = rec.claim_cluster("same", [claims[0]["id"], claims[0]["id"]], {"name": "m"}, 0.5)
    assert [x.id for x in px.lookup(px.derived_postings(rec.artifacts()), "clusters_by_claim", claims[0]["id"]).collect()] == [cluster["id"]]


def test_documents_are_checked(spark):
    with pytest.raises(ValueError, match="schema"):
        flow.check_document(document(), schema="other")
    with pytest.raises(ValueError, match="covers"):
        flow.check_document(document(), covers=["x"])
    with pytest.raises(ValueError, match="unknown steps: dance"):
        flow.Flow(spark, {"steps": [{"step": "dance"}]})
    with pytest.raises(ValueError, match="one name"):
        flow.check_document({"steps": [{"step": "message", "as": "a"}] * 2})


def test_command_line(tmp_path, capsys, spark):
    path = tmp_path / "c.json"
    path.write_text(json.dumps(document()))
    assert cli.main(["summary", str(path)]) == 0
    assert json.loads(capsys.readouterr().out)["kind"] == "greenhouse-flow"
    assert cli.main(["run", str(path), "--section", "checks"]) == 0
    assert all(json.loads(capsys.readouterr().out).values())
    assert cli.main(["summary", str(tmp_path / "none")]) == 1


def test_snapshot_of_a_day_prefix(done):
    f, _ = done
    snap = snapshots.build(f.recorder.events(), f.recorder.artifacts(), "/2031/03")
    assert snap.events.count() == 7
    with pytest.raises(ValueError):
        snapshots.components(snapshots.build(f.recorder.events()))
