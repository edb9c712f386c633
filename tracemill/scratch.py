"""Shared scratch storage and worker set-up.

Intermediate tables that several jobs read are written as Parquet below the
folder named by ``spark.checkpoint.dir``: every executor sees that folder, so
losing an executor never loses an intermediate result.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES, DEFAULT_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
#: Whether Spark deletes a query's shuffle files as the query ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_made: list[tuple[SparkSession, str]] = []
_shipped: set[str] = set()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder. Where the session names none, a local session gets a temporary one; on a cluster that is an error, as executors could not see it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tracemill-")
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    path = f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_sweep)
    _made.append((spark, path))
    return path


def materialize(df: DataFrame, tag: str, *, free: bool = False) -> DataFrame:
    """Write ``df`` to shared scratch and read it back: lineage ends here.

    With ``free``, Spark deletes the write's shuffle files as it ends. Otherwise
    they go when the driver happens to collect the plan; for large steps.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    before = spark.conf.get(FREE_SHUFFLES, None)
    if free:
        spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if free and before is None:
            spark.conf.unset(FREE_SHUFFLES)
        elif free:
            spark.conf.set(FREE_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete scratch tables that no later step reads."""
    for df in frames:
        path = getattr(df, "_scratch_path", None)
        if path:
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(where, True)


def _sweep() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the JVM may be gone at exit; scratch folders are then left to the cluster's retention
            return


def ship_package(spark: SparkSession) -> None:
    """Give this package to the Python workers of executors, once an application, and bound Arrow batches by bytes.

    Batches are bounded by rows unless told otherwise, and rows of long texts
    make batches of any size; a bound that the session sets itself is kept.
    """
    if spark.conf.get(BATCH_BYTES, DEFAULT_BATCH_BYTES) == DEFAULT_BATCH_BYTES:
        spark.conf.set(BATCH_BYTES, "4m")
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="tracemill-code-"), "tracemill_code.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("tracemill", os.path.relpath(full, here)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)
