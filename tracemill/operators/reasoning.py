"""Evidence for a reasoner: polarity, support vectors and ordered belief histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions.paths import day_key, leaf_key_or_blank
from tracemill.operators.artifacts import NEGATIVE_POLARITIES, field


def is_negative(polarity: Column) -> Column:
    """Whether a polarity denies; letter case counts, and an absent one asserts."""
    return F.coalesce(polarity.isin(*NEGATIVE_POLARITIES), F.lit(False))


def claim_evidence(artifacts: DataFrame) -> DataFrame:
    """claim_id, occurrence_id, source_event_id, source_payload_cid, run_id, polarity, negative, seq of claim occurrences."""
    return artifacts.where("family = 'claim-occurrence'").select(
        field("claimId").alias("claim_id"), F.col("id").alias("occurrence_id"), field("sourceEventId").alias("source_event_id"), field("sourcePayloadCid").alias("source_payload_cid"),
        field("extractionRunId").alias("run_id"), field("polarity").alias("polarity"), is_negative(field("polarity")).alias("negative"), "seq",
    )


def evidence_lists(evidence: DataFrame) -> DataFrame:
    """claim_id, positive, negative: occurrence ids in the order written; all evidence is positives, then negatives."""
    pick = lambda want: F.transform(F.array_sort(F.collect_list(F.when(F.col("negative") == want, F.struct("seq", "occurrence_id")))), lambda x: x["occurrence_id"])
    return evidence.groupBy("claim_id").agg(pick(False).alias("positive"), pick(True).alias("negative")).withColumn("evidence", F.concat("positive", "negative"))


def support_vectors(evidence: DataFrame, events: DataFrame) -> DataFrame:
    """claim_id and seven counts; an occurrence whose event is unknown counts without actor, channel and day."""
    known = events.select(F.col("event_id").alias("source_event_id"), leaf_key_or_blank(F.col("actor_keys")).alias("actor_key"), leaf_key_or_blank(F.col("channel_keys")).alias("channel_key"), day_key(F.col("time_path"), "/").alias("day"))
    return evidence.join(known, "source_event_id", "left").groupBy("claim_id").agg(
        F.count(F.lit(1)).alias("occurrence_support"), F.count_distinct("source_event_id").alias("event_support"), F.count_distinct("actor_key").alias("actor_support"),
        F.count_distinct("channel_key").alias("channel_support"), F.count_distinct("day").alias("day_support"), F.count_distinct("source_payload_cid").alias("source_support"), F.count_distinct("run_id").alias("extractor_run_support"),
    )


def belief_histories(outputs: DataFrame) -> DataFrame:
    """claim_id, revision_policy, n_states, output_ids in order, from (claim_id, revision_policy, seq, output_id)."""
    return outputs.groupBy("claim_id", "revision_policy").agg(F.array_sort(F.collect_list(F.struct("seq", "output_id"))).alias("s")).select("claim_id", "revision_policy", F.size("s").cast("long").alias("n_states"), F.transform("s", lambda x: x["output_id"]).alias("output_ids"))


def require_one_claim(outputs: DataFrame, claim_id: str) -> DataFrame:
    """The outputs; one that belongs to another claim raises an error when it is read."""
    said = F.concat(F.lit("reasoning output "), "output_id", F.lit(" belongs to claim "), F.coalesce("claim_id", F.lit("null")))
    return outputs.withColumn("claim_id", F.when(F.col("claim_id").eqNullSafe(F.lit(claim_id)), F.col("claim_id")).otherwise(F.raise_error(said)))
