"""Event and artifact frames over the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.functions import identity, paths
from tracemill.operators.artifacts import claim_rows, with_claims


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pointer_frame(rows: DataFrame) -> DataFrame:
    """Index rows of (seq, event_id, payload_cid, observed_at, actor_path, channel_path, value_kind, parent_event_ids, root_event_id)."""
    ts = F.col("observed_at")
    none = F.array().cast("array<string>")
    return rows.select(
        "seq", "event_id", identity.cid_column(F.col("event_id")).alias("event_cid"), "payload_cid", "observed_at", paths.time_path(ts).alias("time_path"), paths.time_keys(ts).alias("time_keys"),
        "actor_path", paths.prefix_keys(F.col("actor_path")).alias("actor_keys"), "channel_path", paths.prefix_keys(F.col("channel_path")).alias("channel_keys"), "value_kind",
        "parent_event_ids", "root_event_id", none.alias("input_event_ids"), none.alias("output_artifact_ids"), paths.hour_shard(ts).alias("shard_path"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as pointers: a user's day is a trace, each event the child of the one before it."""
    named = lambda c: F.concat(F.lit("event:"), c.cast("string"))
    trace = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id")
    before = F.lag("event_id").over(trace)
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), named(F.col("event_id")).alias("event_id"), identity.cid_column(F.col("props")).alias("payload_cid"), F.col("ts").cast("timestamp").alias("observed_at"),
        F.array(F.lit("app"), F.lit("user"), F.col("user_id").cast("string")).alias("actor_path"), F.array(F.lit("app"), F.lit("events"), F.col("event_type")).alias("channel_path"), F.col("event_type").alias("value_kind"),
        F.when(before.isNull(), F.array().cast("array<string>")).otherwise(F.array(named(before))).alias("parent_event_ids"), named(F.first("event_id").over(trace)).alias("root_event_id"),
    )
    return pointer_frame(rows)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, quality, toxic of labelled documents."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id")


def _object(pairs: dict[str, F.Column]) -> F.Column:
    """Canonical JSON of a flat object of strings and integers."""
    return identity.sorted_json(**pairs)


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as derived artifacts: an extraction run a language, claims about sources' quality, an occurrence a document, topic features."""
    docs = labelled(spark, sf_dir)
    made = docs.select(F.col("doc_id").alias("seq"), _object({"source": F.col("source")}).alias("subject"), F.lit('{"name":"quality"}').alias("predicate"), _object({"quality": F.col("quality")}).alias("object"), "lang", "toxic")
    claims = claim_rows(made.select("seq", "subject", "predicate", "object"))
    run_id = identity.content_id_column("run", F.col("lang"))
    pointer = identity.sorted_json
    runs = docs.select(F.col("doc_id").alias("seq"), F.lit("run").alias("family"), run_id.alias("id"), identity.cid_column(F.col("lang")).alias("cid"), F.col("lang").alias("body"), pointer(runId=run_id, runType=F.lit("claim-feature-extraction"), extractorKey=F.concat(F.lit("extractor/"), "lang"), minerKey=F.lit(""), reasonerKey=F.lit(""), inputEventIds=F.array(F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))), outputArtifactIds=F.array().cast("array<string>")).alias("pointer"))
    source = F.concat(F.lit("doc:"), F.col("seq").cast("string"))
    occ = with_claims(made).withColumnsRenamed({"id": "claim_id", "cid": "claim_cid"}).drop("body").withColumn("polarity", F.when(F.col("toxic") == 1, "denied").otherwise("asserted"))
    body = F.concat_ws("|", "claim_id", source, run_id, "polarity")
    occ_id = identity.content_id_column("claim-occ", body)
    occurrences = occ.select("seq", F.lit("claim-occurrence").alias("family"), occ_id.alias("id"), identity.cid_column(body).alias("cid"), body.alias("body"), pointer(occurrenceId=occ_id, claimId=F.col("claim_id"), claimCid=F.col("claim_cid"), sourceEventId=source, sourcePayloadCid=identity.cid_column(source), extractionRunId=run_id, polarity=F.col("polarity")).alias("pointer"))
    feature_body = F.concat(F.lit("topic|"), "lang")
    feature_id = identity.content_id_column("feature", feature_body)
    features = docs.select(F.col("doc_id").alias("seq"), F.lit("feature").alias("family"), feature_id.alias("id"), identity.cid_column(feature_body).alias("cid"), feature_body.alias("body"), pointer(featureId=feature_id, featureType=F.lit("topic")).alias("pointer"))
    fo_body = F.concat_ws("|", feature_id, F.concat(F.lit("doc:"), F.col("doc_id").cast("string")))
    fo_id = identity.content_id_column("feature-occ", fo_body)
    feature_occ = docs.select(F.col("doc_id").alias("seq"), F.lit("feature-occurrence").alias("family"), fo_id.alias("id"), identity.cid_column(fo_body).alias("cid"), fo_body.alias("body"), pointer(occurrenceId=fo_id, featureId=feature_id, sourceEventId=F.concat(F.lit("doc:"), F.col("doc_id").cast("string")), extractionRunId=run_id).alias("pointer"))
    out = runs
    for part in (claims, occurrences, features, feature_occ):
        out = out.unionByName(part)
    return out


def document_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pointers, the source events of ``artifacts``; they carry no time of their own and share one."""
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("event_id"), identity.cid_column(F.coalesce("text", F.lit(""))).alias("payload_cid"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("observed_at"),
        F.array(F.lit("corpus"), F.col("lang")).alias("actor_path"), F.array(F.lit("corpus"), F.col("source")).alias("channel_path"), F.lit("document").alias("value_kind"), F.array().cast("array<string>").alias("parent_event_ids"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("root_event_id"),
    )
    return pointer_frame(rows)
