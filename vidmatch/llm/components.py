"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidmatch.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (the smallest node it reaches) of all nodes that have a link.

    ``edges`` holds two comparable columns a, b; direction, repeats and loops do not
    matter. Each step links nodes to smaller ones only and halves the depth or so;
    minima are combined before the shuffle and a hub is the side of a join that
    adaptive execution splits. The links are written after each step.
    """
    now = cut_lineage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut_lineage(small.unionByName(low.withColumnRenamed("m", "b")).distinct())
        after = _mark(now)
        if after == mark:
            break
        mark = after
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal sets of links."""
    return tuple(
        edges.agg(
            F.count("*"),
            F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)),
            F.coalesce(F.bit_xor(F.xxhash64("b", "a")), F.lit(0)),
        ).first()
    )
