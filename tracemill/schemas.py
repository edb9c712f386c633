"""Layouts of stored objects.

The names below are fixed values of the data model: kinds, schema versions and
field names of event and artifact documents and of their index pointers.
"""

from __future__ import annotations

from dataclasses import dataclass

EVENT_COLUMNS = (
    "seq long, event_id string, event_cid string, payload_cid string, observed_at timestamp, time_path array<int>, time_keys array<string>, "
    "actor_path array<string>, actor_keys array<string>, channel_path array<string>, channel_keys array<string>, value_kind string, "
    "parent_event_ids array<string>, root_event_id string, input_event_ids array<string>, output_artifact_ids array<string>, shard_path string"
)
ARTIFACT_COLUMNS = "seq long, family string, id string, cid string, body string, pointer string"
OBJECT_COLUMNS = "seq long, cid string, codec string, size long, digest string, data binary"


@dataclass(frozen=True)
class Family:
    """One kind of derived artifact. ``pointer`` lists the pointer's fields after id, CID, kind and schema."""

    prefix: str
    label: str
    schema: str
    body: str
    pointer: str
    pointer_schema: str


FAMILIES = {
    "run": Family("run", "run", "run-v0.1", "runType inputEventIds inputSnapshotCids tool config startedAt completedAt status outputArtifactIds", "runType inputEventIds inputSnapshotCids outputArtifactIds extractorKey minerKey reasonerKey tool config status", "run-pointer-v0.1"),
    "claim": Family("claim", "claim", "claim-core-v0.1", "", "subjectKey predicateKey objectKey", "claim-pointer-v0.1"),
    "claim-occurrence": Family("claim-occ", "occurrence", "claim-occurrence-v0.1", "claimId claimCid sourceEventId sourceEventCid sourcePayloadCid extractionRunId evidence polarity confidence provenance", "claimId claimCid sourceEventId sourceEventCid sourcePayloadCid extractionRunId polarity confidence", "claim-occurrence-pointer-v0.1"),
    "claim-cluster": Family("claim-cluster", "cluster", "claim-cluster-v0.1", "relation members method confidence", "relation members method confidence", "claim-cluster-pointer-v0.1"),
    "feature": Family("feature", "feature", "feature-core-v0.1", "", "featureType", "feature-pointer-v0.1"),
    "feature-occurrence": Family("feature-occ", "occurrence", "feature-occurrence-v0.1", "featureId featureCid sourceEventId extractionRunId confidence evidence", "featureId featureCid sourceEventId extractionRunId confidence", "feature-occurrence-pointer-v0.1"),
    "pattern": Family("pattern", "pattern", "pattern-core-v0.1", "patternType body constraints", "patternType inputSnapshotCids minedBy minerKey supportVector", "pattern-pointer-v0.1"),
    "pattern-occurrence": Family("pattern-occ", "occurrence", "pattern-occurrence-v0.1", "patternId rootEventId participatingEventIds participatingRunIds participatingClaimOccurrenceIds minedBy", "patternId rootEventId participatingEventIds participatingRunIds participatingClaimOccurrenceIds minedBy", "pattern-occurrence-pointer-v0.1"),
    "reasoning-input": Family("reasoning-input", "input", "nal-plr-input-v0.1", "claimId claimCid statement evidence derivedFromPatterns", "claimId claimCid evidenceOccurrenceIds supportVector derivedFromPatterns", "reasoning-input-pointer-v0.1"),
    "reasoning-output": Family("reasoning-output", "output", "reasoning-output-v0.1", "inputId inputCid claimId reasoningRunId beliefStateId truthValue revisionPolicy evidenceOccurrenceIds", "inputId inputCid claimId reasoningRunId beliefStateId evidenceOccurrenceIds", "reasoning-output-pointer-v0.1"),
    "belief-revision-history": Family("belief-revision-history", "history", "belief-revision-history-v0.1", "claimId revisionPolicy states", "claimId outputIds", "belief-revision-history-pointer-v0.1"),
}


# The names of support counts in documents.
VECTOR_FIELDS = {
    "event_support": "eventSupport",
    "actor_support": "actorSupport",
    "channel_support": "channelSupport",
    "day_support": "daySupport",
    "source_support": "sourceSupport",
    "extractor_run_support": "extractorRunSupport",
    "root_trace_support": "rootTraceSupport",
    "occurrence_support": "occurrenceSupport",
    "itemset_support": "itemsetSupport",
    "edge_support": "edgeSupport",
}


@dataclass(frozen=True)
class Index:
    """A reverse index: rows of ``family`` listed under ``key``. ``ID`` stands for the artifact's own id, a final ``[]`` for each item of a list."""

    name: str
    family: str
    key: str
    value: str = "ID"
    skip_blank: bool = False


DERIVED_INDEXES = (
    Index("runs_by_input_event", "run", "inputEventIds[]"),
    Index("runs_by_output_artifact", "run", "outputArtifactIds[]"),
    Index("outputs_by_run", "run", "ID", "outputArtifactIds[]"),
    Index("runs_by_extractor", "run", "extractorKey", skip_blank=True),
    Index("runs_by_miner", "run", "minerKey", skip_blank=True),
    Index("runs_by_reasoner", "run", "reasonerKey", skip_blank=True),
    Index("claims_by_subject", "claim", "subjectKey"),
    Index("claims_by_predicate", "claim", "predicateKey"),
    Index("claims_by_object", "claim", "objectKey"),
    Index("occurrences_by_claim", "claim-occurrence", "claimId"),
    Index("claim_occurrences_by_event", "claim-occurrence", "sourceEventId"),
    Index("outputs_by_run", "claim-occurrence", "extractionRunId"),
    Index("runs_by_output_artifact", "claim-occurrence", "ID", "extractionRunId"),
    Index("clusters_by_claim", "claim-cluster", "members[]"),
    Index("features_by_type", "feature", "featureType"),
    Index("occurrences_by_feature", "feature-occurrence", "featureId"),
    Index("feature_occurrences_by_event", "feature-occurrence", "sourceEventId"),
    Index("outputs_by_run", "feature-occurrence", "extractionRunId"),
    Index("runs_by_output_artifact", "feature-occurrence", "ID", "extractionRunId"),
    Index("patterns_by_type", "pattern", "patternType"),
    Index("patterns_by_input_snapshot", "pattern", "inputSnapshotCids[]"),
    Index("patterns_by_miner", "pattern", "minerKey", skip_blank=True),
    Index("occurrences_by_pattern", "pattern-occurrence", "patternId"),
    Index("occurrences_by_pattern_root", "pattern-occurrence", "rootEventId"),
    Index("outputs_by_run", "pattern-occurrence", "minedBy"),
    Index("runs_by_output_artifact", "pattern-occurrence", "ID", "minedBy"),
    Index("outputs_by_claim", "reasoning-output", "claimId"),
    Index("outputs_by_input", "reasoning-output", "inputId"),
    Index("outputs_by_reasoning_run", "reasoning-output", "reasoningRunId"),
    Index("outputs_by_run", "reasoning-output", "reasoningRunId"),
    Index("runs_by_output_artifact", "reasoning-output", "ID", "reasoningRunId"),
    Index("histories_by_claim", "belief-revision-history", "claimId"),
    Index("histories_by_output", "belief-revision-history", "outputIds[]"),
)
