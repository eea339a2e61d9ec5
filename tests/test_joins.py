"""Hot keys: same result as a plain join, and the salt really spreads."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vidmatch.operators.joins import children_join, hot_keys, key_counts, skew_join
from vidmatch.operators.nesting import nest
from vidmatch.operators.ranking import (
    dedupe_matches,
    first_per_key,
    last_per_key,
    safe_marks,
    take,
    top_k,
)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows has one key, another part has none."""
    return spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 50).alias("k"),
        F.col("id").alias("row"),
    )


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_equals_join(spark, skewed, how):
    other = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    want = skewed.join(other, "k", how)
    got = skew_join(skewed, other, ["k"], how, salts=4, hot_rows=100)
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))


def test_skew_join_spreads_the_hot_key(spark, skewed):
    other = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = skew_join(skewed, other, ["k"], "left", spread=["row"], salts=16, hot_rows=100)
        parts = joined.where("k = 0").groupBy(F.spark_partition_id()).count().count()
        plain = skewed.join(other, "k", "left").where("k = 0").groupBy(F.spark_partition_id()).count().count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plain == 1 and parts > 1


def test_salts_grow_with_the_rows_of_a_key(spark, skewed):
    got = {r["k"]: r["_salts"] for r in hot_keys(key_counts(skewed, ["k"]), ["k"], 20, 2).collect()}
    assert got[0] >= 50 and got[5] == 2


def test_children_join_equals_left_join(spark, skewed):
    parents = spark.range(60).select(F.when(F.col("id") != 59, F.col("id")).alias("k"), (F.col("id") * 2).alias("v"))
    want = parents.join(skewed, "k", "left")
    got = children_join(parents, skewed, ["k"], ["row"])
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    empty = children_join(parents, skewed.where("false"), ["k"])
    assert empty.count() == 60


def test_unsupported_kind(skewed):
    with pytest.raises(ValueError):
        skew_join(skewed, skewed, ["k"], "full_outer")


def test_nest_bounds_arrays(spark, skewed):
    rows = skewed.withColumn("child", F.col("row").cast("string"))
    out = nest(rows, ["k"], "child", F.col("child"), "children", chunk=100)
    sizes = {(r["k"], r["chunk_no"]): r["n"] for r in out.select("k", "chunk_no", F.size("children").alias("n")).collect()}
    assert sum(sizes.values()) == 3000
    assert max(sizes.values()) < 200
    assert sum(1 for k, _ in sizes if k == 5) == 1


def test_ranking(spark):
    rows = spark.createDataFrame(
        [("a", 1, 0.3), ("a", 2, 0.1), ("a", 3, 0.1), ("b", 4, 0.9)], "k string, pos int, distance double"
    )
    assert [r["pos"] for r in top_k(rows, ["k"], ["distance", "pos"], 2, "rank").orderBy("pos").collect()] == [2, 3, 4]
    assert {r["pos"] for r in first_per_key(rows, ["k"], ["pos"]).collect()} == {1, 4}
    assert {r["pos"] for r in last_per_key(rows, ["k"], "pos").collect()} == {3, 4}
    assert [r["pos"] for r in take(rows, [F.col("pos").desc()], 2).collect()] == [4, 3]
    near = dedupe_matches(rows.withColumnRenamed("pos", "offer_id"), keys=("k",))
    assert near.count() == 4


def test_rank_limit_runs_before_the_shuffle(spark, skewed):
    plan = first_per_key(skewed, ["k"], ["row"])._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange") < plan.rindex("WindowGroupLimit")
    assert "Partial" in plan


def test_safe_marks(spark):
    stamps = ["2024-01-01 00:00:01", "2024-01-01 00:00:01", "2024-01-01 00:00:05", "2024-01-01 00:07:00",
              "2024-01-03 10:00:00", None]
    rows = spark.createDataFrame([(s,) for s in stamps], "t string").select(F.col("t").cast("timestamp").alias("timestamp"))
    got = safe_marks(rows, last_sync="2023-12-31 00:00:00").select(
        F.col("timestamp").cast("string"), F.col("safe_mark").cast("string")
    )
    assert {tuple(r) for r in got.collect()} == {
        ("2024-01-01 00:00:01", "2023-12-31 00:00:00"),
        ("2024-01-01 00:00:05", "2024-01-01 00:00:01"),
        ("2024-01-01 00:07:00", "2024-01-01 00:00:05"),
        ("2024-01-03 10:00:00", "2024-01-01 00:07:00"),
    }
