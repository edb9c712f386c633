"""Connected components of an edge table by alternating star contraction; nothing of the graph reaches the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.scratch import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id in ``edges`` (a, b): root is the least id that it reaches.

    Each round ties a node's larger neighbours, then its smaller ones, to the
    least node near it, until every edge points at a root. Rounds grow with
    the logarithm of the graph's size. Edges go to shared scratch each round.
    Self-loops and repeated edges are allowed, nulls are ignored.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u is not null and v is not null and u <> v").distinct(), "edges")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "edges")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        small = materialize(small, "edges")
        # done when every node has one edge, to a node that has none of its own
        shape = small.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("u").alias("d")).first()
        chained = shape.n and (shape.n != shape.d or not small.join(small.select(F.col("v").alias("u")), "u", "left_semi").isEmpty())
        discard(now, large)
        now = small
        if not chained:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
