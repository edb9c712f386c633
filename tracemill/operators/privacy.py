"""Which events a public index may show, and hashed paths for those that it may not name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.paths import hashed_path


@dataclass(frozen=True)
class PublicIndexPolicy:
    public_levels: tuple[str, ...] = ("public",)
    private_levels: tuple[str, ...] = ("private", "confidential", "secret")
    #: Mixed into hashed path segments; whoever publishes the index chooses it.
    salt: str = ""


def privacy_level(payload: Column) -> Column:
    """The payload's level: 'public' where it has none; an explicit null is the text 'None'."""
    has = F.array_contains(F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>")), "privacy")
    return F.when(~has, F.lit("public")).otherwise(F.coalesce(F.get_json_object(payload, "$.privacy"), F.lit("None")))


def classify(level: Column, policy: PublicIndexPolicy = PublicIndexPolicy()) -> Column:
    """Struct (allowed, level, reason)."""
    public, private = level.isin(*policy.public_levels), level.isin(*policy.private_levels)
    reason = F.when(public, "public-level").when(private, "private-level").otherwise("unknown-level")
    return F.struct(F.coalesce(public, F.lit(False)).alias("allowed"), level.alias("level"), reason.alias("reason"))


def _with_decision(rows: DataFrame, mode: str) -> DataFrame:
    """``rows`` with the decision under ``privacy`` of their provenance, in place of one that is there; a provenance that is no object is replaced."""
    said = F.to_json(F.struct(F.col("d.level").alias("level"), F.lit(mode).alias("pathMode"), F.col("d.allowed").alias("publicIndexAllowed"), F.col("d.reason").alias("reason")))
    held = F.coalesce(F.try_variant_get(F.try_parse_json("provenance"), F.lit("$"), "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    others = F.map_filter(held, lambda k, _: k != "privacy")
    merged = F.map_concat(others, F.create_map(F.lit("privacy"), F.parse_json(said)))
    return rows.withColumn("provenance", F.to_json(merged)).drop("d")


def public_events(raw: DataFrame, policy: PublicIndexPolicy = PublicIndexPolicy()) -> tuple[DataFrame, DataFrame]:
    """(rows that a public index may show, with the decision in their provenance; rejected rows). Nothing of the second is stored."""
    judged = raw.withColumn("d", classify(privacy_level(F.col("payload")), policy))
    return _with_decision(judged.where("d.allowed"), "plain"), judged.where("not d.allowed").select(*raw.columns, F.col("d.reason").alias("reason"))


def require_public(raw: DataFrame, policy: PublicIndexPolicy = PublicIndexPolicy()) -> DataFrame:
    """``raw``; reading a row that a public index may not show raises an error."""
    d = classify(privacy_level(F.col("payload")), policy)
    said = F.concat(F.lit("a public index may not show an event: "), d["reason"], F.lit(" "), d["level"])
    return raw.withColumn("payload", F.when(d["allowed"], F.col("payload")).otherwise(F.raise_error(said)))


def hashed_path_events(raw: DataFrame, policy: PublicIndexPolicy) -> DataFrame:
    """All rows with hashed actor and channel paths and the decision in their provenance; private ones are kept."""
    if not policy.salt:
        raise ValueError("hashed paths need a salt")
    judged = raw.withColumn("d", classify(privacy_level(F.col("payload")), policy))
    hashed = judged.withColumn("actor_path", hashed_path(F.col("actor_path"), policy.salt)).withColumn("channel_path", hashed_path(F.col("channel_path"), policy.salt))
    return _with_decision(hashed, "hashed")
