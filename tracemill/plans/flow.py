"""Flows: a document lists steps in order, and each is recorded, mined or reasoned over in turn.

A document holds ``kind`` and ``schema`` (any texts), optional ``covers``, the
``steps``, and ``checks``. A step is an object with ``step``, the name of an
action, an optional ``as``, the name of its result, and the action's arguments.
A text ``$name.field.0`` in an argument stands for that part of an earlier
result; ``$$`` stands for a dollar sign. A check lists two values that must be
equal; ``{"lookup": [index, key]}`` as a value is the list that an index holds.

Actions read frames from the recorder only where an operator needs them, so a
flow is for documents that a driver can hold; bulk data go through the
operators themselves.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import identity
from tracemill.operators import mining, reasoning, snapshots
from tracemill.operators import postings as px
from tracemill.plans.recorder import Recorder
from tracemill.schemas import VECTOR_FIELDS

ACTIONS: dict[str, Callable[..., Any]] = {}


def action(f: Callable[..., Any]) -> Callable[..., Any]:
    ACTIONS[f.__name__] = f
    return f


def load_document(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def check_document(document: dict, *, kind: str | None = None, schema: str | None = None, covers: list[str] | None = None) -> None:
    """Raise ValueError for a document of another kind, schema or coverage, or with unknown actions or repeated names."""
    for name, wanted in (("kind", kind), ("schema", schema), ("covers", covers)):
        if wanted is not None and document.get(name) != wanted:
            raise ValueError(f"the document's {name} is {document.get(name)!r}, not {wanted!r}")
    steps = document.get("steps")
    if not isinstance(steps, list):
        raise ValueError("the document lists no steps")
    names = [s["as"] for s in steps if "as" in s]
    unknown = sorted({str(s.get("step")) for s in steps} - set(ACTIONS))
    if unknown or len(names) != len(set(names)):
        raise ValueError(f"unknown steps: {', '.join(unknown)}" if unknown else "two steps have one name")


def vector_of(support: DataFrame) -> dict[str, int]:
    """The one row of support counts under the names that documents use; empty for no row."""
    row = support.first()
    return {} if row is None else {VECTOR_FIELDS[k]: v for k, v in row.asDict().items() if k in VECTOR_FIELDS}


class Flow:
    def __init__(self, spark: SparkSession, document: dict):
        check_document(document)
        self.recorder, self.document, self.results = Recorder(spark), document, {}

    def resolved(self, value: Any) -> Any:
        """``value`` with references replaced by what they stand for."""
        if isinstance(value, dict):
            return {k: self.resolved(v) for k, v in value.items()}
        if isinstance(value, list):
            return [self.resolved(v) for v in value]
        if not isinstance(value, str) or not value.startswith("$"):
            return value
        if value.startswith("$$"):
            return value[1:]
        name, *parts = value[1:].split(".")
        found = self.results[name]
        for part in parts:
            found = found[int(part)] if isinstance(found, list) else found[part]
        return found

    def run(self) -> dict[str, Any]:
        for step in self.document["steps"]:
            arguments = {k: self.resolved(v) for k, v in step.items() if k not in ("step", "as")}
            result = ACTIONS[step["step"]](self, **arguments)
            if "as" in step:
                self.results[step["as"]] = result
        return self.summary()

    def _side(self, value: Any, postings: DataFrame) -> Any:
        if isinstance(value, dict) and set(value) == {"lookup"}:
            index, key = self.resolved(value["lookup"])
            return [r.id for r in px.lookup(postings, index, key).collect()]
        return self.resolved(value)

    def summary(self) -> dict[str, Any]:
        events, artifacts = self.recorder.events(), self.recorder.artifacts()
        postings = px.event_postings(events).unionByName(px.derived_postings(artifacts))
        checks = {name: self._side(left, postings) == self._side(right, postings) for name, (left, right) in self.document.get("checks", {}).items()}
        families = {r.family: r["count"] for r in artifacts.groupBy("family").count().collect()}
        plain = lambda x: {k: v for k, v in x.items() if not isinstance(v, snapshots.Snapshot)} if isinstance(x, dict) else x
        return {"document": {k: self.document.get(k) for k in ("kind", "schema", "covers")}, "events": events.count(), "artifacts": families, "results": {k: plain(v) for k, v in self.results.items()}, "checks": checks, "ok": all(checks.values())}


# events

@action
def message(flow: Flow, **fields: str) -> dict:
    return flow.recorder.irc_message(fields)


@action
def event(flow: Flow, payload: dict, observedAt: str, actorPath: list[str], channelPath: list[str], valueKind: str, provenance: dict | None = None, parents: list[str] | None = None, inputs: list[str] | None = None, outputs: list[str] | None = None) -> dict:
    rest: dict[str, Any] = {"input_event_ids": inputs, "output_artifact_ids": outputs} if inputs or outputs else {}
    if provenance is not None:
        rest["provenance"] = provenance
    if parents is None:
        return flow.recorder.event(payload, observedAt, actorPath, channelPath, valueKind, **rest)
    return flow.recorder.child(payload, observedAt, actorPath, channelPath, valueKind, parents, **rest)


# artifacts

@action
def run(flow: Flow, run: dict, inputs: list[str] | None = None, snapshots: list[str] | None = None, outputs: list[str] | None = None) -> dict:
    return flow.recorder.run(run, input_event_ids=inputs, input_snapshot_cids=snapshots, output_artifact_ids=outputs)


@action
def claim(flow: Flow, core: dict, source: str, run: str, evidence: dict, polarity: str = "asserted", confidence: float = 1.0, provenance: dict | None = None) -> dict:
    made = flow.recorder.claim_occurrence(core, source, run, evidence, polarity=polarity, confidence=confidence, provenance=provenance)
    return made | {"claim": flow.recorder.claim(core)}


@action
def feature(flow: Flow, core: dict, source: str, run: str, evidence: dict, confidence: float = 1.0) -> dict:
    return flow.recorder.feature_occurrence(core, source, run, confidence, evidence)


@action
def cluster(flow: Flow, relation: str, members: list[str], method: dict, confidence: float = 1.0) -> dict:
    return flow.recorder.claim_cluster(relation, members, method, confidence)


# snapshots and patterns

@action
def snapshot(flow: Flow, shard: str) -> dict:
    built = snapshots.build(flow.recorder.events(), flow.recorder.artifacts(), shard)
    parts = snapshots.components(built)
    manifest = snapshots.manifest(shard, parts)
    for document in (*parts.values(), manifest):
        flow.recorder.put_json(document)
    cid = identity.cid(identity.canonical_json(manifest).encode())
    return {"cid": cid, "shard": shard, "events": len(parts["eventColumns"]["eventIds"]), "keys": len(parts["postings"]), "frames": built}


def _recorded(flow: Flow, mined: mining.Mined, of: dict, run: str, miner: str) -> dict:
    vector = vector_of(mined.support)
    if not vector:
        return {"id": None, "occurrences": [], "vector": {}}
    pattern = flow.recorder.pattern(mined.core, [of["cid"]], run, miner, vector)
    local = of["frames"].events.select(F.col("event_id").alias("first_id"), "local_id")
    rows = mining.attached_claims(of["frames"], mined.occurrences).withColumn("first_id", F.col("event_ids")[0]).join(local, "first_id").orderBy("local_id").collect()
    found = [flow.recorder.pattern_occurrence(pattern["id"], r.root_event_id, list(r.event_ids), list(r.claim_occurrence_ids), run) for r in rows]
    return {"id": pattern["id"], "cid": pattern["cid"], "occurrences": [o["id"] for o in found], "vector": vector}


@action
def sequence(flow: Flow, snapshot: dict, kinds: list[str], run: str, miner: str, least: int = 1, seconds: int = 30) -> dict:
    return _recorded(flow, mining.mine_sequence(snapshot["frames"], kinds, min_support=least, max_window_seconds=seconds), snapshot, run, miner)


@action
def itemset(flow: Flow, snapshot: dict, tokens: list[str], run: str, miner: str, least: int = 1) -> dict:
    return _recorded(flow, mining.mine_itemset(snapshot["frames"], tokens, min_support=least), snapshot, run, miner)


@action
def motif(flow: Flow, snapshot: dict, parent: str, child: str, run: str, miner: str, least: int = 1) -> dict:
    return _recorded(flow, mining.mine_parent_child_motif(snapshot["frames"], parent, child, min_support=least), snapshot, run, miner)


# reasoning

@action
def reasoning_input(flow: Flow, claim: dict, statement: str, patterns: list[str]) -> dict:
    evidence = reasoning.claim_evidence(flow.recorder.artifacts()).where(F.col("claim_id") == claim["id"])
    lists = reasoning.evidence_lists(evidence).first()
    positive, negative = (list(lists.positive), list(lists.negative)) if lists else ([], [])
    made = flow.recorder.reasoning_input(claim, statement, positive, negative, vector_of(reasoning.support_vectors(evidence, flow.recorder.events())), patterns)
    return made | {"claim": claim["id"], "positive": positive, "negative": negative}


@action
def belief(flow: Flow, given: dict, run: str, truth: dict, policy: str) -> dict:
    return flow.recorder.reasoning_output(given, given["claim"], given["positive"] + given["negative"], run, truth, policy)


@action
def history(flow: Flow, claim: str, outputs: list[dict], policy: str) -> dict:
    return flow.recorder.belief_history(claim, outputs, policy)


# reports of results

@action
def report_pattern(flow: Flow, run: dict, pattern: dict, observedAt: str, parents: list[str], agent: list[str], channel: list[str]) -> dict:
    return flow.recorder.discovery_event(run, pattern, observedAt, parents, agent=agent, channel=channel)


@action
def report_belief(flow: Flow, run: dict, output: dict, observedAt: str, parents: list[str], agent: list[str], channel: list[str]) -> dict:
    return flow.recorder.reasoning_event(run, output, observedAt, parents, agent=agent, channel=channel)
