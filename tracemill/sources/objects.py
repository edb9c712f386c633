"""Content-addressed objects: rows keyed by the hash of their bytes, in memory or as Parquet."""

from __future__ import annotations

import json
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions.identity import CID_PREFIX, canonical_json, cid_column
from tracemill.schemas import OBJECT_COLUMNS
from tracemill.scratch import materialize


def object_rows(data: DataFrame) -> DataFrame:
    """OBJECT_COLUMNS of (seq, codec, data)."""
    digest = F.sha2("data", 256)
    return data.select("seq", F.concat(F.lit(CID_PREFIX), digest).alias("cid"), "codec", F.octet_length("data").cast("long").alias("size"), F.concat(F.lit("sha256:"), digest).alias("digest"), "data")


def new_objects(rows: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """Rows to append: the first of each CID, of those not held. A second put is a no-op and its codec is dropped."""
    rest = [c for c in rows.columns if c != "cid"]
    first = rows.groupBy("cid").agg(F.min_by(F.struct(*rest), "seq").alias("r")).select(*(F.col("cid") if c == "cid" else F.col(f"r.{c}") for c in rows.columns))
    return first if held is None else first.join(held.select("cid"), "cid", "left_anti").select(rows.columns)


def checks() -> dict[str, Column]:
    """Whether an object's bytes still have the CID, digest and size of its row."""
    return {"cid_ok": F.col("cid") == cid_column(F.col("data")), "digest_ok": F.col("digest") == F.concat(F.lit("sha256:"), F.sha2("data", 256)), "size_ok": F.col("size") == F.octet_length("data")}


def audit(objects: DataFrame) -> DataFrame:
    """cid, cid_ok, digest_ok, size_ok, ok of every object; never raises."""
    made = {k: F.coalesce(v, F.lit(False)) for k, v in checks().items()}
    return objects.select("cid", *(v.alias(k) for k, v in made.items())).withColumn("ok", F.col("cid_ok") & F.col("digest_ok") & F.col("size_ok"))


def lookup(objects: DataFrame, wanted: DataFrame) -> DataFrame:
    """cid, found, codec, size, digest, data of each distinct CID of a table; an unknown one is not found and has nulls. Bytes are checked as they are read."""
    asked = wanted.select("cid").distinct()
    held = verified(objects.join(asked, "cid", "left_semi")).withColumn("__found", F.lit(True))
    return asked.join(held, "cid", "left").select("cid", F.coalesce("__found", F.lit(False)).alias("found"), "codec", "size", "digest", "data")


def verified(objects: DataFrame) -> DataFrame:
    """The objects; reading one whose bytes don't match raises an error."""
    good = F.sha2("data", 256) == F.substr("cid", F.lit(len(CID_PREFIX) + 1))
    return objects.withColumn("data", F.when(good, F.col("data")).otherwise(F.raise_error(F.concat(F.lit("bytes don't match "), "cid"))))


class ObjectStore(Protocol):
    """What a backend offers; another one needs only ``frame`` and ``append``."""

    spark: SparkSession

    def frame(self) -> DataFrame: ...

    def append(self, rows: DataFrame) -> None: ...


class _Store:
    spark: SparkSession

    def put_rows(self, data: DataFrame) -> None:
        """Store (seq, codec, data) rows; those held already are left alone."""
        self.append(new_objects(object_rows(data), self.frame()))

    def put_bytes(self, data: bytes, codec: str = "raw") -> str:
        seq = self.frame().count()
        rows = self.spark.createDataFrame([(seq, codec, bytearray(data))], "seq long, codec string, data binary")
        self.put_rows(rows)
        return object_rows(rows).first().cid

    def put_json(self, value: Any, codec: str = "dag-json") -> str:
        return self.put_bytes(canonical_json(value).encode(), codec)

    def get_bytes(self, cid: str) -> bytes:
        row = verified(self.frame().where(F.col("cid") == cid)).select("data").first()
        if row is None:
            raise KeyError(cid)
        return bytes(row.data)

    def get_json(self, cid: str) -> Any:
        return json.loads(self.get_bytes(cid))

    def has(self, cid: str) -> bool:
        return not self.frame().where(F.col("cid") == cid).isEmpty()

    def stat(self, cid: str) -> dict:
        row = self.frame().where(F.col("cid") == cid).select("cid", "codec", "size", "digest").first()
        if row is None:
            raise KeyError(cid)
        return row.asDict()

    def verify(self, cid: str) -> dict:
        row = audit(self.frame().where(F.col("cid") == cid)).first()
        return {"ok": row.ok, "checks": {"cid": row.cid_ok, "digest": row.digest_ok, "size": row.size_ok}} if row else {"ok": False, "checks": {"cid": False, "digest": False, "size": False}}


class MemoryObjects(_Store):
    """Objects of this session alone: appended frames are kept in shared scratch, which goes with the session."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._parts: list[DataFrame] = []

    def frame(self) -> DataFrame:
        out = self.spark.createDataFrame([], OBJECT_COLUMNS)
        for part in self._parts:
            out = out.unionByName(part)
        return out

    def append(self, rows: DataFrame) -> None:
        self._parts.append(materialize(rows.select(*(c.split()[0] for c in OBJECT_COLUMNS.split(", "))), "objects"))


class ParquetObjects(_Store):
    """Objects as Parquet files below ``path``, partitioned by the digest's first two characters so that a look-up reads one part."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def frame(self) -> DataFrame:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.spark._jsc.sc().hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], OBJECT_COLUMNS)
        return self.spark.read.schema(OBJECT_COLUMNS + ", part string").parquet(self.path).drop("part")

    def append(self, rows: DataFrame) -> None:
        rows.withColumn("part", F.substr("cid", F.lit(len(CID_PREFIX) + 1), F.lit(2))).write.mode("append").partitionBy("part").parquet(self.path)
