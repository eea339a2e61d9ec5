"""Marks, deltas, change logs; batch against stream."""

from __future__ import annotations

import datetime as dt
import shutil

import pytest
from pyspark.sql import functions as F

from vidmatch import schemas
from vidmatch.operators import sync
from vidmatch.plans.review import review
from vidmatch.plans.sync import Targets, sync_inventory, sync_matches, sync_videos
from vidmatch.sources.tables import compact, get_mark, read_current, set_mark, write_changes
from vidmatch.streaming.sync import (
    analysis_stream,
    match_stream,
    stream_embed,
    stream_sync_matches,
    stream_sync_videos,
)


def T(minute):
    return dt.datetime(2024, 1, 1, 0, minute)


def analyses(spark, rows):
    """(uuid, minute, title, [product uuids])"""
    out = []
    for uuid, minute, title, products in rows:
        row = dict.fromkeys(schemas.VIDEO_ANALYSIS.names)
        names = schemas.VIDEO_ANALYSIS["identified_products"].dataType.elementType.names
        row.update(
            uuid=uuid, timestamp=T(minute), source="google_ads", video_id=f"yt-{uuid}", metadata=(title, None),
            status="SUCCESS",
            identified_products=[tuple({"uuid": p, "title": f"t {p}", "video_timestamp": 5}.get(c) for c in names) for p in products],
        )
        out.append(tuple(row[c] for c in schemas.VIDEO_ANALYSIS.names))
    return spark.createDataFrame(out, schemas.VIDEO_ANALYSIS)


def matches(spark, rows):
    """(minute, product uuid, offer, distance)"""
    return spark.createDataFrame(
        [(T(m), u, "t", "d", o, "mt", "mb", d) for m, u, o, d in rows], schemas.MATCHED_PRODUCTS
    )


VIDEOS = [("v1", 1, "One", ["p1", "p2"]), ("v2", 1, "Two", ["p3"]), ("v1", 5, "One again", ["p1", "p2", "p4"]), ("v3", 7, None, [])]
MATCHES = [(2, "p1", "A", 0.5), (2, "p1", "A", 0.4), (3, "p2", "B", 0.3), (6, "p1", "A", 0.1), (6, "p3", "C", 0.2), (6, "p1", "D", 0.9)]


def test_delta_takes_pairs_first_seen_after_the_mark(spark):
    va, log = analyses(spark, VIDEOS), matches(spark, MATCHES)
    got = {(r["idp_uuid"], r["offer_id"], r["video_uuid"], r["total_count"]) for r in sync.new_matches(log, va, T(3)).collect()}
    assert got == {("p1", "D", "v1", 3), ("p3", "C", "v2", 1)}
    first = sync.new_matches(log, va, "0001-01-01 00:00:00").where("offer_id = 'A'").first()
    assert first["distance"] == 0.1 and first["timestamp"] == T(6)


def test_delta_equals_sql(spark):
    va, log = analyses(spark, VIDEOS), matches(spark, [*MATCHES, (1, "p1", None, 0.1), (6, "p1", None, 0.2), (6, None, "A", 0.2)])
    log.createOrReplaceTempView("m")
    want = spark.sql(
        """SELECT max(timestamp) AS timestamp, uuid AS idp_uuid, matched_product_offer_id AS offer_id, min(distance) AS distance
           FROM m WHERE timestamp > '2024-01-01 00:03:00' AND NOT EXISTS (
             SELECT 1 FROM m AS e WHERE e.uuid = m.uuid AND e.matched_product_offer_id = m.matched_product_offer_id
             AND e.timestamp <= '2024-01-01 00:03:00') GROUP BY 2, 3"""
    )
    got = sync.first_seen_since(log, T(3)).where(F.col("idp_uuid").isNotNull())
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.where("idp_uuid IS NOT NULL").collect()))
    assert va.count() == 4


def test_totals_count_distinct_pairs_over_all_history(spark):
    log = matches(spark, [(1, "p1", "A", 0.1), (2, "p1", "A", 0.1), (3, "p2", "B", 0.1), (4, "p3", None, 0.1)])
    got = {tuple(r) for r in sync.match_totals(log, analyses(spark, VIDEOS)).collect()}
    assert got == {("v1", 2), ("v2", 0)}


def test_active_offers(spark):
    log = matches(spark, [(1, "p1", "ABC", 0.1), (1, "p1", None, 0.1)])
    stored = spark.createDataFrame([("prod_ABC",), ("prod_XYZ",), ("other",)], "doc_id string")
    assert {r[0] for r in sync.active_offers(log, stored).collect()} == {"ABC", "XYZ"}


def test_since_is_strict_and_ordered(spark):
    got = [r["timestamp"] for r in sync.since(matches(spark, MATCHES), T(2)).collect()]
    assert got == sorted(got) and min(got) == T(3)


def test_change_log_folds_given_values(spark, tmp_path):
    path, schema = str(tmp_path / "log"), schemas.struct(k=schemas.STR, a=schemas.LONG, b=schemas.STR)

    def write(rows, ddl, component, batch, cols, where=path):
        write_changes(spark.createDataFrame(rows, ddl), where, component, batch, ["k"], cols)

    def current(where=path, before=None):
        return {tuple(r) for r in read_current(spark, where, ["k"], schema, before).collect()}

    assert current() == set()
    write([("x", 1, "one"), ("y", 5, "five")], "k string, a long, b string", "sync", 0, ["a", "b"])
    write([("x", 2)], "k string, a long", "sync", 1, ["a"])
    write([("x", None)], "k string, b string", "review", 0, ["b"])
    want = {("x", 2, None), ("y", 5, "five")}
    assert current() == want
    assert current(before=("sync", 1)) == {("x", 1, None), ("y", 5, "five")}
    # a repeated batch replaces itself
    write([("x", None)], "k string, b string", "review", 0, ["b"])
    assert current() == want
    target = str(tmp_path / "compacted")
    compact(spark, path, target, ["k"], schema)
    assert current(target) == want
    write([("x", 9)], "k string, a long", "sync", 2, ["a"], target)
    assert current(target) == {("x", 9, None), ("y", 5, "five")}


def test_review_of_synced_tables(spark, tmp_path):
    targets = Targets(str(tmp_path))
    va, log = analyses(spark, VIDEOS), matches(spark, MATCHES)
    sync_videos(va, targets)
    sync_matches(log.where(F.col("timestamp") < T(4)), va, targets)
    ddl = "video_uuid string, identified_product_uuid string, offer_id string, candidate_status string, user string, is_added_by_user boolean, position long"
    decisions = spark.createDataFrame(
        [("v1", "p1", "A", "DISAPPROVED", "me", False, 0), ("v1", "p1", "A", "APPROVED", "me", False, 1), ("v1", "p2", "Z", "APPROVED", "me", True, 2)], ddl
    )
    shutil.copytree(targets.state, str(tmp_path / "state-before"))
    review(decisions, targets, "2024-02-01 00:00:00")

    def state():
        return {r["video_uuid"]: (r["stats_approved_count"], r["stats_matched_count"], r["status"]) for r in targets.videos(spark).collect()}

    assert state()["v1"] == (2, 3, "Ready to Push") and state()["v2"] == (0, 0, None)
    # the same batch once more, as after a failure before its mark was written
    shutil.move(targets.state, str(tmp_path / "state-of-the-review"))
    shutil.copytree(str(tmp_path / "state-before"), targets.state)
    review(decisions, targets, "2024-02-01 00:00:00")
    assert state()["v1"] == (2, 3, "Ready to Push")
    rows = {(r["identified_product_uuid"], r["offer_id"]): (r["candidate_status"], r["distance"]) for r in targets.candidates(spark).collect()}
    assert rows == {("p1", "A"): ("APPROVED", 0.4), ("p2", "B"): (None, 0.3), ("p2", "Z"): ("APPROVED", None)}
    assert [(r["offer_id"], r["title"]) for r in targets.inventory(spark).collect()] == [("Z", "User Product Z")]
    # the next sync sets the total of the touched videos again, as it counts the match log
    sync_matches(log, va, targets)
    assert state()["v1"][1] == 3 and state()["v1"][0] == 2
    rows = {(r["identified_product_uuid"], r["offer_id"]): r["candidate_status"] for r in targets.candidates(spark).collect()}
    assert rows[("p1", "A")] == "APPROVED" and ("p1", "D") in rows


def test_marks(spark, tmp_path):
    path = str(tmp_path / "state")
    assert get_mark(spark, path, "videos") == ("0001-01-01 00:00:00", -1)
    set_mark(spark, path, "videos", "2024-01-01 00:00:01.123456", 0)
    set_mark(spark, path, "matches", "2024-02-01 00:00:00", 4)
    assert get_mark(spark, path, "videos") == ("2024-01-01 00:00:01.123456", 0)


def state_of(spark, targets):
    videos = targets.videos(spark).select(
        "video_uuid", "title", "timestamp", F.array_sort("search_keywords"), "stats_identified_count", "stats_matched_count",
        "stats_approved_count",
    )
    tables = videos, targets.identified(spark), targets.candidates(spark).select("video_uuid", "identified_product_uuid", "offer_id", "distance")
    return [sorted(map(repr, t.collect())) for t in tables]


def test_batch_sync(spark, tmp_path):
    targets = Targets(str(tmp_path))
    va, log = analyses(spark, VIDEOS), matches(spark, MATCHES)
    early = va.where(F.col("timestamp") < T(4)), log.where(F.col("timestamp") < T(4))
    sync_videos(early[0], targets)
    sync_matches(early[1], early[0], targets)
    rows = {r["video_uuid"]: r for r in targets.videos(spark).collect()}
    assert rows["v1"]["stats_matched_count"] == 2 and rows["v2"]["stats_matched_count"] == 0
    sync_videos(va, targets)
    sync_matches(log, va, targets)
    before = state_of(spark, targets)
    sync_videos(va, targets)
    sync_matches(log, va, targets)
    assert state_of(spark, targets) == before, "a second run changes nothing"
    rows = {r["video_uuid"]: r for r in targets.videos(spark).collect()}
    assert rows["v1"]["title"] == "One again" and rows["v1"]["stats_identified_count"] == 3
    assert set(rows["v1"]["search_keywords"]) == {"one", "again", "yt-v1"}
    assert rows["v3"]["title"] == "" and rows["v3"]["stats_identified_count"] == 0
    assert rows["v1"]["stats_matched_count"] == 3 and rows["v2"]["stats_matched_count"] == 1
    assert get_mark(spark, targets.state, "videos")[0].startswith("2024-01-01 00:07:00")
    # late rows are lost in the batch form, as before the mark
    late = va.unionByName(analyses(spark, [("v9", 2, "late", [])]))
    sync_videos(late, targets)
    assert "v9" not in {r["video_uuid"] for r in targets.videos(spark).collect()}


@pytest.mark.parametrize("strict", [False, True])
def test_stream_equals_batch(spark, tmp_path, strict):
    va, log = analyses(spark, VIDEOS), matches(spark, MATCHES)
    batch = Targets(str(tmp_path / "batch"))
    va_path, log_path = str(tmp_path / "va"), str(tmp_path / "log")
    live = Targets(str(tmp_path / "live"))
    for low, high in ((0, 4), (4, 60)):
        window = (F.col("timestamp") >= T(low)) & (F.col("timestamp") < F.lit(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=high)))
        va.where(window).coalesce(1).write.mode("append").parquet(va_path)
        log.where(window).coalesce(1).write.mode("append").parquet(log_path)
        stream_sync_videos(analysis_stream(spark, va_path, 1), live, str(tmp_path / "c1"), strict).awaitTermination()
        stream_sync_matches(match_stream(spark, log_path, 1), log_path, va_path, live, str(tmp_path / "c2"), strict).awaitTermination()
        so_far = F.col("timestamp") < F.lit(dt.datetime(2024, 1, 1) + dt.timedelta(minutes=high))
        sync_videos(va.where(so_far), batch)
        sync_matches(log.where(so_far), va.where(so_far), batch)
    assert state_of(spark, live) == state_of(spark, batch)
    # late rows: taken by the stream unless the mark is strict
    analyses(spark, [("v9", 2, "late", [])]).coalesce(1).write.mode("append").parquet(va_path)
    stream_sync_videos(analysis_stream(spark, va_path, 1), live, str(tmp_path / "c1"), strict).awaitTermination()
    assert ("v9" in {r["video_uuid"] for r in live.videos(spark).collect()}) is (not strict)


def test_stream_embed(spark, tmp_path):
    source = str(tmp_path / "texts")
    spark.createDataFrame([("o1", "red shoes")], "offer_id string, text string").write.parquet(source)
    stream = spark.readStream.schema("offer_id string, text string").parquet(source)
    stream_embed(stream, "text", "offer_id", "m", str(tmp_path / "out"), str(tmp_path / "c"), dim=8).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first()["id"] == "o1"


def test_sync_inventory(spark, tmp_path):
    catalog = spark.createDataFrame(
        [("A", "LOCAL", "local", "1.50"), ("A", "online", "shop", "2.50"), ("B", "ONLINE", "b", None)],
        "offer_id string, channel string, title string, p string",
    ).select("offer_id", "channel", "title", F.lit("br").alias("brand"), F.lit("img").alias("image_link"), F.lit("in stock").alias("availability"),
             F.struct(F.col("p").cast("decimal(18,4)").alias("value")).alias("price"))
    targets = Targets(str(tmp_path))
    got = sync_inventory(catalog, matches(spark, [(1, "p", "A", 0.1)]), targets).collect()
    assert [(r["offer_id"], r["title"], r["price"]) for r in got] == [("A", "shop", 2.5)]
    again = sync_inventory(catalog.withColumn("title", F.lit("new")), matches(spark, []), targets).collect()
    assert [(r["offer_id"], r["title"]) for r in again] == [("A", "new")]
