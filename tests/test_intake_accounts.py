from __future__ import annotations

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from vidmatch.operators import accounts, intake
from vidmatch.sources.files import read_id_list, scan_video_files, videos_of_manifest

CANDIDATE = "source string, video_id string, gcs_uri string, md5_hash string, title string, description string, position long"


def videos(spark, rows):
    """(source, video id, uri)"""
    return spark.createDataFrame([(s, v, u, None, None, None, i) for i, (s, v, u) in enumerate(rows)], CANDIDATE)


def processed(spark, rows):
    return spark.createDataFrame(rows, "video_id string, gcs_uri string")


def test_intake(spark):
    sheet = videos(spark, [("manual_entry", "sheet1", None), ("manual_entry", "ads1", None), ("manual_entry", None, "gs://b/v1.mp4"),
                           ("manual_entry", None, "gs://b/v2_proc.mp4")])
    ads = videos(spark, [("google_ads", "ads1", None), ("google_ads", "ads2_proc", None), ("google_ads", "ads3", None)])
    done = processed(spark, [("ads2_proc", None), (None, "gs://b/v2_proc.mp4")])
    union = intake.union_sources(sheet, ads)
    got = intake.unprocessed(union, done, limit=2).orderBy("source_rank", "position").collect()
    assert [r["video_id"] for r in got] == ["sheet1", "ads1"] and got[1]["source"] == "manual_entry"
    assert intake.unprocessed(union, done, limit=None).count() == 4


def test_processed_keys(spark):
    rows = processed(spark, [("vid1", None), (None, "gs://b/v2.mp4"), ("vid3", "gs://b/v3.mp4"), ("vid1", ""), ("", None)])
    assert {tuple(r) for r in intake.processed_keys(rows).collect()} == {("vid1", None), (None, "gs://b/v2.mp4"), (None, "gs://b/v3.mp4")}


def test_privacy(spark):
    rows = videos(spark, [("a", "public", None), ("a", "unlisted", None), ("a", "unknown", None), ("a", None, "gs://b/x.mp4"), ("a", "odd", None)])
    info = spark.createDataFrame([("public", "public", "T", "D"), ("unlisted", "unlisted", "T", "D"), ("odd", None, "T", "D")],
                                 "video_id string, privacy_status string, title string, description string")
    got = {r["video_id"]: r["title"] for r in intake.public_only(rows, info).collect()}
    assert got == {"public": "T", "unknown": None, None: None}


ACCOUNTS = [(1, None, True), (10, 1, True), (11, 1, False), (100, 10, False), (101, 10, True), (1000, 101, False), (2, None, False)]


@pytest.fixture(scope="module")
def tree(spark):
    return spark.createDataFrame(ACCOUNTS, "customer_id long, parent_id long, manager boolean")


def ids(df):
    return {r["customer_id"] for r in df.collect()}


def test_account_fanout(spark, tree):
    assert ids(accounts.target_accounts(tree, 1)) == {11, 100, 1000}
    assert ids(accounts.target_accounts(tree, 10)) == {100, 1000}
    assert ids(accounts.target_accounts(tree, 11)) == {11}
    assert ids(accounts.target_accounts(tree, 999)) == set()
    levels = {r["customer_id"]: r["level"] for r in accounts.descendants(tree, 1).collect()}
    assert levels == {10: 1, 11: 1, 100: 2, 101: 2, 1000: 3}
    assert ids(accounts.sub_accounts(accounts.descendants(tree, 1), exclude_managers=True)) == {11, 100, 1000}
    loop = tree.unionByName(spark.createDataFrame([(1, 1000, True)], tree.schema))
    assert ids(accounts.descendants(loop, 1)) == {10, 11, 100, 101, 1000}
    deep = spark.createDataFrame([(i, i - 1, True) for i in range(1, 56)], tree.schema)
    assert {r["level"] for r in accounts.descendants(deep, 1).collect()} == set(range(1, 55))


def test_ads_videos(spark, tree):
    ads = spark.createDataFrame([(100, 5, 1, "x"), (100, 5, 2, "x"), (11, 6, 1, "x"), (11, 7, 1, "search"), (2, 8, 1, "other")],
                                "customer_id long, campaign_id long, ad_group_id long, video_id string")
    campaigns = spark.createDataFrame([(100, 5, "DEMAND_GEN"), (11, 6, "DEMAND_GEN"), (11, 7, "SEARCH"), (2, 8, "DEMAND_GEN")],
                                      "customer_id long, campaign_id long, advertising_channel_type string")
    got = intake.ads_videos(ads, campaigns, accounts.target_accounts(tree, 1)).collect()
    assert [tuple(r) for r in got] == [("google_ads", "x")]
    counts = {tuple(r) for r in intake.account_video_counts(ads, campaigns, tree).collect()}
    assert counts == {(100, 1), (11, 1), (2, 1)}


def test_ads_are_not_made_distinct_before_they_are_filtered(spark, tree):
    ads = spark.createDataFrame([(100, 5, "x"), (100, 5, "x"), (100, 6, "y"), (100, 7, None), (None, 5, "z")],
                                "customer_id long, campaign_id long, video_id string")
    campaigns = spark.createDataFrame([(100, 5, "DEMAND_GEN"), (100, 5, "DEMAND_GEN"), (100, 6, "DEMAND_GEN"), (100, 7, "DEMAND_GEN"), (None, 5, "DEMAND_GEN")],
                                      "customer_id long, campaign_id long, advertising_channel_type string")
    found = intake.ads_videos(ads, campaigns, tree)
    assert {r["video_id"] for r in found.collect()} == {"x", "y", None}
    assert [tuple(r) for r in intake.account_video_counts(ads, campaigns, tree).collect()] == [(100, 3)]
    assert intake.unique_videos(ads, campaigns, tree).first()[0] == 3
    grouped = [line for line in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Aggregate [" in line]
    assert not any("campaign_id" in line and "video_id" in line for line in grouped)


def test_account_reads(spark):
    names = spark.createDataFrame([("customers/5",), ("customers/6",), ("customers/x",)], "resource_name string")
    details = spark.createDataFrame([(5, "Shop"), (7, "Other")], "customer_id long, descriptive_name string")
    assert [tuple(r) for r in accounts.accessible_accounts(names, details, 5).collect()] == [(5, "Shop", True)]
    assert accounts.search_named(details, "SHO", "descriptive_name", "customer_id").count() == 1
    assert accounts.search_named(details, "7", "descriptive_name", "customer_id").first()[0] == 7
    assert accounts.search_named(details, "", "descriptive_name", "customer_id").count() == 2
    campaigns = spark.createDataFrame([(1, "ENABLED", "DEMAND_GEN"), (2, "REMOVED", "DEMAND_GEN"), (3, "PAUSED", "SEARCH")],
                                      "campaign_id long, status string, advertising_channel_type string")
    assert [r[0] for r in accounts.active_campaigns(campaigns).collect()] == [3, 1]
    assert [r[0] for r in accounts.active_campaigns(campaigns, ["DEMAND_GEN"]).collect()] == [1]
    groups = spark.createDataFrame([(1, 1, "ENABLED"), (2, 1, "REMOVED"), (3, 2, "ENABLED")], "ad_group_id long, campaign_id long, status string")
    assert [r[0] for r in accounts.active_ad_groups(groups, 1).collect()] == [1]


def test_destinations_and_names(spark):
    use = spark.createDataFrame(
        [(1, 2, 3, "v", "DEMAND_GEN"), (1, 2, 3, "v", "DEMAND_GEN"), (1, None, 4, "v", "DEMAND_GEN"), (1, 2, 5, "v", "SEARCH"), (9, 2, 6, "v", "DEMAND_GEN")],
        "customer_id long, campaign_id long, ad_group_id long, video_id string, advertising_channel_type string",
    ).withColumn("campaign_name", F.lit("c")).withColumn("ad_group_name", F.lit("g"))
    assert {r["ad_group_id"] for r in accounts.discover_destinations(use, "v").collect()} == {3, 6}
    assert {r["ad_group_id"] for r in accounts.discover_destinations(use, "v", 1).collect()} == {3}
    entities = spark.createDataFrame([(1, 3), (0, 3), (1, 4)], "customer_id long, ad_group_id long")
    meta = spark.createDataFrame([(1, 3, "Shop", "C", "G"), (0, 3, "Bad", "C", "G")],
                                 "customer_id long, ad_group_id long, customer_name string, campaign_name string, ad_group_name string")
    got = {(r[0], r[1]): r["customer_name"] for r in accounts.enrich_entities(entities, meta).collect()}
    assert got == {(1, 3): "Shop", (0, 3): None, (1, 4): None}
    assert {tuple(r) for r in accounts.ad_groups_by_customer(entities).collect()} == {(1, 3), (1, 4)}


def test_id_list(spark, tmp_path):
    (tmp_path / "ids.csv").write_text("VideoIDs,note\nabc,x\n,y\n def ,z\n")
    assert {r[0] for r in read_id_list(spark, str(tmp_path / "ids.csv")).collect()} == {"abc", " def "}


def test_video_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, content in (("a.MP4", b"one"), ("sub/b.webm", b"two"), ("c.txt", b"no"), ("d.mp4.bak", b"no")):
        (tmp_path / name).write_bytes(content)
    got = {r["title"]: r for r in scan_video_files(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.MP4", "b.webm"}
    assert got["b.webm"]["md5_hash"] == hashlib.md5(b"two").hexdigest() and got["b.webm"]["source"] == "manual_entry"
    sums = [(r["gcs_uri"], base64.b64encode(bytes.fromhex(r["md5_hash"])).decode()) for r in got.values()]
    manifest = spark.createDataFrame([*sums, ("gs://b/x.txt", "AAAA")], "path string, md5_base64 string")
    listed = scan_video_files(spark, str(tmp_path), manifest)
    assert {(r["title"], r["md5_hash"]) for r in listed.collect()} == {(t, r["md5_hash"]) for t, r in got.items()}
    assert "content" not in listed._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]
    assert videos_of_manifest(manifest).count() == 2
