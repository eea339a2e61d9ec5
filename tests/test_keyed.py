"""Tables in key ranges, bitmap counts, and the stream with keyed state."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vidmatch.operators import sync
from vidmatch.plans import sync as jobs
from vidmatch.plans.sync import Targets, sync_matches, sync_matches_by_delta
from vidmatch.plans.totals import MatchCounts, bit_is_set
from vidmatch.schemas import MATCHED_PRODUCTS, VIDEO_ANALYSIS
from vidmatch.sources.keyed import KeyedTable
from vidmatch.streaming import match_state as M

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def files(path):
    return {str(f.relative_to(path)) for f in Path(path).rglob("part-*")}


def test_upsert_rewrites_touched_ranges_only(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "t"), ["id"], SCHEMA, parts=8)
    assert table.read(spark).count() == 0
    table.upsert(spark.createDataFrame([(f"k{i}", i, "x") for i in range(40)], SCHEMA), ["a", "b"])
    before = files(tmp_path / "t")
    patch = spark.createDataFrame([("k3", None), ("new", "n")], "id string, b string")
    touched = {r[0] for r in patch.select(table.part_of()).collect()}
    table.upsert(patch, ["b"])
    want = [(f"k{i}", i, None if i == 3 else "x") for i in range(40)] + [("new", None, "n")]
    assert rows(table.read(spark)) == sorted(want, key=str)
    kept = {f for f in before if int(f.split("/")[0].removeprefix("part=")) not in touched}
    assert len(kept) == 8 - len(touched) and kept <= files(tmp_path / "t")
    table.upsert(patch, ["b"])  # the same patch again
    assert rows(table.read(spark)) == sorted(want, key=str)
    table.upsert(patch.limit(0), ["b"])
    plan = table.matching(patch)._jdf.queryExecution().executedPlan().toString()
    assert "part" in plan[plan.index("PartitionFilters"):].split("]")[0]


def test_a_failing_merge_leaves_the_table(spark, tmp_path):
    table = KeyedTable(str(tmp_path / "t"), ["id"], SCHEMA, parts=4)
    table.upsert(spark.createDataFrame([("a", 1, "x")], SCHEMA), ["a", "b"])
    broken = lambda old, patch: old.unionByName(patch).withColumn("a", F.raise_error(F.lit("no")).cast("long"))
    with pytest.raises(Exception, match="no"):
        table.merge(spark.createDataFrame([("a", 2, "y")], SCHEMA), broken)
    assert rows(table.read(spark)) == [("a", 1, "x")]


def test_bits(spark):
    df = spark.createDataFrame([(n,) for n in (1, 2, 9, 300, 32768)], "n long")
    bits = df.agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("bits"))
    asked = spark.createDataFrame([(n,) for n in (1, 2, 3, 8, 9, 299, 300, 32767, 32768)], "n long")
    got = {r["n"] for r in asked.crossJoin(bits).where(bit_is_set(F.col("bits"), F.bitmap_bit_position("n"))).collect()}
    assert got == {1, 2, 9, 300, 32768}
    assert spark.range(1).select(bit_is_set(F.lit(None).cast("binary"), F.lit(3).cast("long")).alias("v")).first()["v"] is False


def log_of(spark, rows):
    at = dt.datetime(2024, 1, 1)
    full = [{"timestamp": at + dt.timedelta(minutes=m), "uuid": u, "matched_product_offer_id": o, "distance": d} for m, u, o, d in rows]
    return spark.createDataFrame([tuple(r.get(f.name) for f in MATCHED_PRODUCTS.fields) for r in full], MATCHED_PRODUCTS)


def analyses_of(spark, videos):
    product = VIDEO_ANALYSIS["identified_products"].dataType.elementType
    out = []
    for video, products in videos:
        listed = [tuple(p if f.name == "uuid" else None for f in product.fields) for p in products]
        out.append(tuple(video if f.name == "uuid" else listed if f.name == "identified_products" else None for f in VIDEO_ANALYSIS.fields))
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in VIDEO_ANALYSIS.fields])
    return spark.createDataFrame(out, schema)


VIDEOS = [("v1", ["p1", "p2"]), ("v2", ["p2", "p3"]), ("v3", []), ("v4", ["p5"])]
ROWS = [
    (1, "p1", "A", 0.5), (1, "p1", "A", 0.4), (1, "p2", "B", 0.3), (2, "p9", "Z", 0.1), (2, "p5", None, 0.2),
    (3, "p1", "A", 0.1), (3, "p1", "B", 0.2), (3, "p2", None, 0.7), (3, None, "A", 0.7), (4, "p2", None, 0.6),
    (5, "p3", "A", 0.9), (5, "p3", "C", None), (5, "p2", "B", 0.01),
]
PARTS = [(0, 2), (3, 4), (5, 9)]


def between(low, high):
    at = lambda m: F.lit(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m))
    return (F.col("timestamp") >= at(low)) & (F.col("timestamp") <= at(high))


def test_counts_by_delta_against_the_whole_log(spark, tmp_path):
    log, va = log_of(spark, ROWS), analyses_of(spark, VIDEOS)
    counts = MatchCounts(str(tmp_path / "counts"), parts=3)
    for batch, (low, high) in enumerate(PARTS):
        mark = dt.datetime(2024, 1, 1) + dt.timedelta(minutes=low, seconds=-1)
        seen = log.where(between(0, high))
        want = rows(sync.first_seen_since(seen, mark).select("timestamp", "idp_uuid", "offer_id", "distance"))
        for _ in range(2):  # once more, as after a failure
            got = counts.take(log.where(between(low, high)), batch)
            assert rows(got) == want
        assert rows(counts.totals(va)) == rows(sync.match_totals(seen, va))
    touched = spark.createDataFrame([("v2",)], "video_uuid string")
    assert rows(counts.totals(va, touched)) == [("v2", 3)]
    assert counts.take(log.limit(0), 9).count() == 0


def state_of(spark, targets):
    candidates = targets.candidates(spark).select("video_uuid", "identified_product_uuid", "offer_id", "distance")
    return rows(candidates), rows(targets.videos(spark).select("video_uuid", "stats_matched_count"))


def test_sync_by_delta_equals_sync_and_survives_a_repeat(spark, tmp_path, monkeypatch):
    log, va = log_of(spark, ROWS), analyses_of(spark, VIDEOS)
    whole, delta = Targets(str(tmp_path / "whole")), Targets(str(tmp_path / "delta"))
    counts = MatchCounts(str(tmp_path / "counts"), parts=3)
    for k, (_, high) in enumerate(PARTS):
        seen = log.where(between(0, high))
        sync_matches(seen, va, whole)
        if k == 1:  # the mark is lost, and more rows have come when the run is repeated
            with monkeypatch.context() as m:
                m.setattr(jobs, "set_mark", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
                with pytest.raises(RuntimeError):
                    sync_matches_by_delta(seen, va, delta, counts)
            sync_matches_by_delta(log, va, delta, counts)
        else:
            sync_matches_by_delta(seen, va, delta, counts)
        assert state_of(spark, delta) == state_of(spark, whole)
    sync_matches_by_delta(log, va, delta, counts)
    assert state_of(spark, delta) == state_of(spark, whole)


def test_state_stream_equals_batch_and_reads_new_rows_only(spark, tmp_path):
    log, va = log_of(spark, ROWS), analyses_of(spark, VIDEOS)
    batch, live = Targets(str(tmp_path / "batch")), Targets(str(tmp_path / "live"))
    va.coalesce(1).write.parquet(str(tmp_path / "va"))
    read = []
    for low, high in PARTS:
        log.where(between(low, high)).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        sync_matches(log.where(between(0, high)), va, batch)
        analyses = spark.readStream.schema(VIDEO_ANALYSIS).parquet(str(tmp_path / "va"))
        matches = spark.readStream.schema(MATCHED_PRODUCTS).parquet(str(tmp_path / "log"))
        query = M.stream_match_state(analyses, matches, live, str(tmp_path / "c"), salts=2, parts=3)
        query.awaitTermination()
        read.append(sum(p["numInputRows"] for p in query.recentProgress))
        assert state_of(spark, live) == state_of(spark, batch)
    assert read[0] == 5 + len(VIDEOS) and read[1:] == [5, 3]
    assert rows(M.match_totals(spark, live, 3)) == rows(sync.match_totals(log, va))
    # a video that comes late gets the pairs its products already have
    analyses_of(spark, [("v9", ["p1"])]).coalesce(1).write.mode("append").parquet(str(tmp_path / "va"))
    M.stream_match_state(
        spark.readStream.schema(VIDEO_ANALYSIS).parquet(str(tmp_path / "va")),
        spark.readStream.schema(MATCHED_PRODUCTS).parquet(str(tmp_path / "log")), live, str(tmp_path / "c"), 2, 3,
    ).awaitTermination()
    assert ("v9", 2) in rows(M.match_totals(spark, live, 3))


def test_state_beyond_the_inline_value_goes_to_maps_in_few_calls(monkeypatch):
    calls = []

    class Value:
        held = None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, value):
            calls.append("update")
            self.held = value

    class Map(dict):
        def exists(self):
            calls.append("exists")
            return bool(self)

        def containsKey(self, k):
            calls.append("contains")
            return k in self

        def updateValue(self, k, v):
            calls.append("put")
            self[k] = v

        def iterator(self):
            return iter(self.items())

    def step(given):
        del calls[:]
        part = pd.DataFrame(given, columns=["video_uuid", "offer_id", "distance"])
        out = list(state.handleInputRows(("p", 0), iter([part[:2], part[2:]]), None))
        return {tuple(None if x != x else x for x in r) for d in out for r in d.itertuples(index=False)}

    def started(inline):
        monkeypatch.setattr(M, "INLINE", inline)
        one = M.FirstSeen()
        one.few, one.offers, one.videos = Value(), Map(), Map()
        return one

    nan = float("nan")
    batches = [
        [(None, "a", nan), (None, "a", 2.0), (None, "a", 1.0), (None, "b", nan), (None, "c", 3.0), (None, None, nan)],
        [("v", None, nan), (None, "c", 0.5), (None, "d", 4.0), ("w", None, nan), ("x", None, nan), (None, None, 0.25)],
        [("v", None, nan), ("y", None, nan), (None, "d", 1.0), (None, "e", 5.0)],
    ]
    want = [set()]
    first = {"a": 1.0, "b": None, "c": 3.0, "d": 4.0}
    want.append({(v, "p", o, d) for v in "vwx" for o, d in [*first.items(), (None, 0.25)]})
    want.append({(v, "p", "e", 5.0) for v in "vwx"} | {("y", "p", o, d) for o, d in {**first, "e": 5.0}.items()})
    for inline in (256, 2, 0):
        state = started(inline)
        assert [step(b) for b in batches] == want
    state = started(256)
    step([(None, f"o{i}", 1.0) for i in range(100)])
    assert sorted(calls) == ["exists", "exists", "get", "update"]
    step([(None, f"o{i}", 1.0) for i in range(50, 150)])
    assert sorted(calls) == ["get", "update"] and len(state.few.held[0]) == 150


def test_a_repeated_batch_of_totals_starts_where_it_started(spark, tmp_path):
    table = M.totals_table(Targets(str(tmp_path)), 3)
    add = lambda n, batch: rows(M.add_totals(table, spark.createDataFrame([("v", n)], "video_uuid string, added long"), batch))
    assert add(2, 0) == [("v", 2)] and add(3, 1) == [("v", 5)] and add(3, 1) == [("v", 5)] and add(1, 2) == [("v", 6)]
