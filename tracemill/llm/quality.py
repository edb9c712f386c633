"""Quality classification by importance resampling over hashed n-grams.

Two generative models over hashed unigrams and bigrams of lower-cased words:
``raw`` from all documents, ``target`` from documents labelled good. A
document's log ratio is the sum over its n-grams of log(target / raw). Its log
importance weight is that sum over the square root of the number of n-grams:
n-grams of one text are not independent, and the plain sum would let length
decide; the root keeps weights of all lengths at one spread. Weights are
neither clipped nor calibrated. A sample without replacement in proportion to
the weights is drawn by Gumbel top-k: the k documents with the largest log
weight + Gumbel noise are kept. k is the share of labelled documents that are
good, and SLACK more, of all documents with words.

Raw counts, scores, k and the threshold cover all documents. The target model
learns from at most MOST_LABELS good labelled documents, picked by hash.

Nulls: a null text is empty; a document without n-grams has no weight and is
rejected. Null labels teach nothing; without any label every document with
words is kept. Noise is a function of doc_id alone, so equal doc_ids share it,
and rows that tie with the k-th are kept too. Labels of one id that differ
count as good if any is. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.textarrays import hashed_words, mix, row_chunks, tidied, utf8
from tracemill.scratch import discard, materialize, ship_package

BITS = 16
BUCKETS = 1 << BITS
MOST_LABELS = 100_000
#: Pseudo-counts that draw the target model to the raw one, but never more than the target's own counts.
PRIOR = 65_536.0
#: The share of documents kept beyond the labelled share of good ones.
SLACK = 0.015


def ngram_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, row) of every unigram and bigram."""
    w, first = hashed_words(data, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    shift = np.uint64(64 - BITS)
    one = (mix(w) >> shift).astype(np.int64)
    if len(w) < 2:
        return one, row
    two = (mix(w[:-1] * np.uint64(3) + w[1:] * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)
    inside = row[:-1] == row[1:]
    return np.concatenate([one, two[inside]]), np.concatenate([row, row[:-1][inside]])


@dataclass
class Model:
    """log(target / raw) of each bucket."""

    log_ratio: np.ndarray


def good_labels(labels: DataFrame, most: int = MOST_LABELS) -> np.ndarray:
    """Sorted ids of at most ``most`` documents labelled good and not toxic, picked by hash."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    rows = good.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()
    return np.sort(np.array([r.doc_id for r in rows], np.int64))


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(-(1 << 62)).to_numpy(zero_copy_only=False).astype(np.int64)


def fit(docs: DataFrame, good: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Count all documents' n-grams, and again those of the good ones; only bucket totals reach the driver."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(good)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            wanted = np.isin(_ids(batch.column(0)), shared.value)
            data, offsets = utf8(batch.column(1))
            for lo, hi in row_chunks(offsets):
                bucket, row = ngram_buckets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                raw += np.bincount(bucket, minlength=BUCKETS)
                target += np.bincount(bucket[wanted[lo:hi][row]], minlength=BUCKETS)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (used, raw[used], target[used])], ["bucket", "raw", "target"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = texts.mapInArrow(tidied(count), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[total["bucket"].to_numpy()], target[total["bucket"].to_numpy()] = total["raw"].to_numpy(), total["target"].to_numpy()
    if not target.any():
        return Model(np.zeros(BUCKETS))
    share = raw / raw.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        prior = min(PRIOR, target.sum())
        ratio = np.log((target + prior * share) / (target.sum() + prior) / share)
    return Model(np.where(raw > 0, ratio, 0.0))


def score(docs: DataFrame, model: Model, *, text_at: int) -> DataFrame:
    """The columns of ``docs`` named c0, c1, ..., then n_ngrams and log_ratio of the text in column ``text_at``."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)
    rows = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value.log_ratio
        for batch in batches:
            data, offsets = utf8(batch.column(text_at))
            for lo, hi in row_chunks(offsets):
                bucket, row = ngram_buckets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                n = np.bincount(row, minlength=hi - lo).astype(np.int64)
                ratio = np.bincount(row, table[bucket], hi - lo).astype(float)
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns), pa.array(n), pa.array(ratio)], [*batch.schema.names, "n_ngrams", "log_ratio"])

    return rows.mapInArrow(tidied(rate), ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", n_ngrams long, log_ratio double")


def log_weight(log_ratio: Column, n_ngrams: Column) -> Column:
    """Null for a document without n-grams."""
    return F.when(n_ngrams > 0, log_ratio / F.sqrt(n_ngrams))


def gumbel(doc_id: Column, seed: int = 17) -> Column:
    """Standard Gumbel noise from a hash of the id."""
    uniform = (F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(uniform))


def kth_largest(df: DataFrame, value: Column, k: int) -> int | None:
    """The k-th largest of a long column, by histograms of 1024 bins: only counts reach the driver."""
    v = df.select(value.cast("long").alias("v"))
    bounds = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n")).first()
    if k <= 0 or not bounds.n:
        return None
    lo, hi, k = bounds.lo, bounds.hi, min(k, bounds.n)
    while lo < hi:
        width = (hi - lo) // 1024 + 1
        bins = sorted(v.where(F.col("v").between(lo, hi)).groupBy(((F.col("v") - lo) / width).cast("long").alias("b")).count().collect(), reverse=True)
        for b, n in bins:
            if k <= n:
                lo, hi = lo + b * width, min(hi, lo + b * width + width - 1)
                break
            k -= n
    return lo


def target_size(scored: DataFrame, labels: DataFrame) -> int:
    """How many documents to keep: the share of labelled ones with words that are good, and SLACK more, of all with words."""
    label = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"))
    worded = scored.where("n_ngrams > 0").select("doc_id")
    n = worded.count()
    found = worded.join(label, "doc_id").agg(F.avg("good").alias("share")).first()
    return n if found.share is None else min(n, math.ceil((found.share + SLACK) * n))


def sample_key(doc_id: Column) -> Column:
    """Log weight + Gumbel noise, of rows with n_ngrams and log_ratio."""
    return log_weight(F.col("log_ratio"), F.col("n_ngrams")) + gumbel(doc_id)


def least_key(scored: DataFrame, k: int) -> float:
    """The k-th largest key over all rows; infinity where none is kept."""
    key = kth_largest(scored.where("n_ngrams > 0"), F.floor(sample_key(F.col("doc_id")) * 1e9), k)
    return float("inf") if key is None else key / 1e9


def _drawn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, k: int | None) -> tuple[Model, DataFrame, float]:
    """(model, doc_id with n_ngrams and log_ratio of every document, the least key that is kept)."""
    model = fit(docs, good_labels(labels), id_col=id_col, text_col=text_col)
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    scored = materialize(score(rows, model, text_at=1).select(F.col("c0").alias("doc_id"), "n_ngrams", "log_ratio"), "quality")
    return model, scored, least_key(scored, target_size(scored, labels) if k is None else k)


def resample(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int | None = None) -> DataFrame:
    """doc_id, n_ngrams, log_ratio, log_weight, sample_key, kept of every document; ``k`` overrides the size of the sample."""
    _, scored, least = _drawn(docs, labels, id_col, text_col, k)
    out = scored.withColumn("log_weight", log_weight(F.col("log_ratio"), F.col("n_ngrams"))).withColumn("sample_key", sample_key(F.col("doc_id")))
    return out.withColumn("kept", F.coalesce(F.col("sample_key") >= F.lit(least), F.lit(False)))


def kept_documents(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int | None = None) -> DataFrame:
    """The rows of ``docs`` that the sample keeps, with their columns as they are. Texts are scored again rather than shuffled."""
    model, scored, least = _drawn(docs, labels, id_col, text_col, k)
    discard(scored)
    rated = score(docs, model, text_at=docs.columns.index(text_col))
    own = F.col(f"c{docs.columns.index(id_col)}").cast("long")
    return rated.where(sample_key(own) >= F.lit(least)).select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
