"""Derived artifacts: runs, claims, features, patterns, reasoning and their occurrences.

Every family is rows of one table, artifacts(seq, family, id, cid, body,
pointer): ``body`` is the canonical JSON that the id hashes, ``pointer`` the JSON
that indexes read. Layouts and indexes are declared in ``schemas``.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import identity
from tracemill.schemas import FAMILIES

NEGATIVE_POLARITIES = ("denied", "negated", "negative")
#: Fields whose values are open JSON; they come as JSON text.
OPEN_FIELDS = frozenset("tool config evidence provenance method statement supportVector truthValue states".split())
#: Fields whose numbers Spark prints in another way than canonical JSON.
FLOAT_FIELDS = frozenset(["confidence"])


def role_keys(run_type: str, actor_key: str) -> dict[str, str]:
    """A run's actor is its extractor, miner or reasoner if the run type says so."""
    return {f"{role}Key": actor_key if sign in run_type else "" for role, sign in (("extractor", "extraction"), ("miner", "mining"), ("reasoner", "reasoning"))}


def make(family: str, fields: dict[str, Any], core: dict[str, Any] | None = None) -> dict[str, Any]:
    """One artifact row without seq. ``fields`` hold body and pointer values; ``core`` is a body that comes whole."""
    spec = FAMILIES[family]
    if core is None:
        core = {"kind": family, "schema": spec.schema} | {f: fields[f] for f in spec.body.split()}
    body = identity.canonical_json(core)
    digest = identity.sha256_hex(body.encode())
    id_, cid = f"{spec.prefix}:{digest}", identity.CID_PREFIX + digest
    pointer = {"kind": f"{family}-pointer", "schema": spec.pointer_schema, f"{spec.label}Id": id_, f"{spec.label}Cid": cid} | {f: fields[f] for f in spec.pointer.split()}
    return {"family": family, "id": id_, "cid": cid, "body": body, "pointer": identity.canonical_json(pointer)}


def _json_value(name: str, value: Column) -> Column:
    """The JSON text of one field's value."""
    if name in OPEN_FIELDS:
        return F.coalesce(value, F.lit("null"))
    inside = F.to_json(F.array(value), {"ignoreNullFields": "false"})
    return F.substr(inside, F.lit(2), F.length(inside) - 2)


def json_object(fields: dict[str, Column]) -> Column:
    """The text of a JSON object with sorted keys, of the JSON texts of its values."""
    parts = [F.concat(F.lit(json.dumps(k) + ":"), fields[k]) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def rows_of(family: str, rows: DataFrame) -> DataFrame:
    """Artifacts of one family (ARTIFACT_COLUMNS without order) from rows of seq and a column for each body and pointer field.

    A column ``core`` holds the whole body as canonical JSON, for families
    whose bodies are open. Open fields are JSON texts of any spelling. Nothing
    runs in Python but the spelling of open JSON and of floats.
    """
    spec = FAMILIES[family]
    text = lambda s: F.lit(json.dumps(s))
    value = {f: _json_value(f, F.col(f)) for f in {*spec.body.split(), *spec.pointer.split()} if f in rows.columns}
    spelt = lambda names, c: identity.canonical_json_column(c) if (OPEN_FIELDS | FLOAT_FIELDS) & set(names) else c
    whole = "core" in rows.columns
    body = F.col("core") if whole else spelt(spec.body.split(), json_object({"kind": text(family), "schema": text(spec.schema)} | {f: value[f] for f in spec.body.split()}))
    made = rows.withColumn("__body", body).withColumn("__id", identity.content_id_column(spec.prefix, F.col("__body"))).withColumn("__cid", identity.cid_column(F.col("__body")))
    own = {f"{spec.label}Id": _json_value("id", F.col("__id")), f"{spec.label}Cid": _json_value("cid", F.col("__cid"))}
    pointer = spelt(spec.pointer.split(), json_object({"kind": text(f"{family}-pointer"), "schema": text(spec.pointer_schema)} | own | {f: value[f] for f in spec.pointer.split()}))
    return made.select(F.col("seq").cast("long").alias("seq"), F.lit(family).alias("family"), F.col("__id").alias("id"), F.col("__cid").alias("cid"), F.col("__body").alias("body"), pointer.alias("pointer"))


def with_role_keys(runs: DataFrame) -> DataFrame:
    """Adds extractorKey, minerKey and reasonerKey to rows of runType and actorKey."""
    for role, sign in (("extractor", "extraction"), ("miner", "mining"), ("reasoner", "reasoning")):
        runs = runs.withColumn(f"{role}Key", F.when(F.contains("runType", F.lit(sign)), F.col("actorKey")).otherwise(""))
    return runs


def get_many(artifacts: DataFrame, wanted: DataFrame) -> DataFrame:
    """family, id, found, cid, body, pointer of each distinct (family, id) asked for; an unknown one is not found and has nulls."""
    asked = wanted.select("family", "id").distinct()
    held = first_writes(artifacts.join(asked, ["family", "id"], "left_semi")).select("family", "id", "cid", "body", "pointer")
    return asked.join(held, ["family", "id"], "left").select("family", "id", F.col("cid").isNotNull().alias("found"), "cid", "body", "pointer")


def first_writes(artifacts: DataFrame) -> DataFrame:
    """One row of each (family, id): the first written."""
    rest = [c for c in artifacts.columns if c not in ("family", "id")]
    return artifacts.groupBy("family", "id").agg(F.min_by(F.struct(*rest), F.struct("seq", "cid")).alias("r")).select(*(F.col(c) if c in ("family", "id") else F.col(f"r.{c}") for c in artifacts.columns))


def put_acks(artifacts: DataFrame) -> DataFrame:
    """seq, family, id, duplicate: whether an earlier row wrote the same artifact."""
    first = artifacts.groupBy("family", "id").agg(F.min("seq").alias("first_seq"))
    return artifacts.join(first, ["family", "id"]).select("seq", "family", "id", (F.col("seq") > F.col("first_seq")).alias("duplicate"))


def get(artifacts: DataFrame, family: str, id_: str) -> DataFrame:
    return artifacts.where((F.col("family") == family) & (F.col("id") == id_))


def field(name: str, kind: str = "string") -> Column:
    """A field of the pointer, typed."""
    text = F.get_json_object("pointer", f"$.{name}")
    return text if kind == "string" else F.from_json(text, kind) if kind.startswith(("array", "map", "struct")) else text.cast(kind)


def with_claims(cores: DataFrame) -> DataFrame:
    """Adds body, cid and id of the claim of each row's subject, predicate and object: each is canonical JSON text."""
    parts = F.concat(F.lit('{"kind":"claim","object":'), "object", F.lit(',"predicate":'), "predicate", F.lit(',"schema":"claim-core-v0.1","subject":'), "subject", F.lit("}"))
    return cores.withColumn("body", parts).withColumn("cid", identity.cid_column(F.col("body"))).withColumn("id", identity.content_id_column("claim", F.col("body")))


def claim_rows(cores: DataFrame) -> DataFrame:
    """Claim artifacts of (seq, subject, predicate, object): each part is canonical JSON text."""
    made = with_claims(cores)
    keys = {f"{p}Key": identity.content_id_column(p, F.col(p)) for p in ("subject", "predicate", "object")}
    pointer = identity.sorted_json(kind=F.lit("claim-pointer"), schema=F.lit("claim-pointer-v0.1"), claimId=F.col("id"), claimCid=F.col("cid"), **keys)
    return made.select("seq", F.lit("claim").alias("family"), "id", "cid", "body", pointer.alias("pointer"))


def occurrences_with_sources(occurrences: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(occurrences with their source event's CIDs, occurrences whose source event is unknown): the second must be empty for a write."""
    known = events.select(F.col("event_id").alias("source_event_id"), F.col("event_cid").alias("source_event_cid"), F.col("payload_cid").alias("source_payload_cid"))
    return occurrences.join(known, "source_event_id"), occurrences.join(known.select("source_event_id"), "source_event_id", "left_anti")
