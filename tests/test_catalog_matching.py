from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vidmatch import schemas
from vidmatch.operators import analysis, catalog, matching, merge, validate, variants
from vidmatch.operators.encode import encode, hashing_encoder
from vidmatch.plans.catalog import embed_new_products, refresh_latest
from vidmatch.plans.match import match_new_products
from vidmatch.sources.tables import append_embeddings, append_matches, read_table, write_feed

D1, D2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)


def feed_row(date, offer, channel="ONLINE", lang="en", title="t"):
    row = dict.fromkeys(schemas.PRODUCT_FEED.names)
    row.update(data_date=date, offer_id=offer, channel=channel, content_language=lang, title=title,
               brand="b", google_product_category_path="a > b", price=None)
    return tuple(row[c] for c in schemas.PRODUCT_FEED.names)


@pytest.fixture(scope="module")
def feed(spark):
    return spark.createDataFrame(
        [
            feed_row(D1, "old"),
            feed_row(D2, "a", "LOCAL", "en", "local"),
            feed_row(D2, "a", "online", "de", "online german"),
            feed_row(D2, "a", "ONLINE", "en", "online english"),
            feed_row(D2, "b", None, None, "bare"),
            feed_row(D2, "known"),
        ],
        schemas.PRODUCT_FEED,
    )


def embeddings(spark, ids):
    return spark.createDataFrame(
        [(i, dt.datetime(2024, 1, 1), [1.0], "m") for i in ids], schemas.PRODUCT_EMBEDDINGS
    )


def test_new_products(spark, feed):
    got = catalog.new_products(feed, embeddings(spark, ["known", "known"])).collect()
    assert [(r["offer_id"], r["title"]) for r in got] == [("a", "online english"), ("b", "bare")]
    assert got[0]["google_product_category"] == "a > b"
    assert catalog.new_products(feed, embeddings(spark, []), limit=1).count() == 1


def test_staleness(spark, feed):
    def stale(latest):
        return catalog.snapshot_is_stale(latest, feed).first()["stale"]

    assert stale(None) is True
    assert stale(feed.limit(0)) is True
    assert stale(feed.where(F.col("data_date") == D1)) is True
    assert stale(feed.where(F.col("data_date") == D2)) is False


def test_refresh_latest_prunes_partitions(spark, feed, tmp_path):
    source, latest = str(tmp_path / "feed"), str(tmp_path / "latest")
    write_feed(feed.where(F.col("data_date") == D1), source)
    assert refresh_latest(spark, source, latest) is True
    assert spark.read.parquet(latest).count() == 1
    assert refresh_latest(spark, source, latest) is False
    write_feed(feed.where(F.col("data_date") == D2), source)
    assert refresh_latest(spark, source, latest) is True
    assert spark.read.parquet(latest).count() == 5
    assert "data_date" in spark.read.parquet(latest).columns
    snapshot = catalog.latest_snapshot(spark.read.schema(schemas.PRODUCT_FEED).parquet(source))
    plan = snapshot._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters"):].split("]")[0]
    assert "subquery" in filters.lower()


def analyses(spark, products, status="SUCCESS", uuid="v1"):
    rows = [
        dict(title=f"title {u}", description="d", embedding=v, uuid=u, video_timestamp=1) for u, v in products
    ]
    row = dict.fromkeys(schemas.VIDEO_ANALYSIS.names)
    row.update(uuid=uuid, timestamp=dt.datetime(2024, 1, 1), status=status, identified_products=[
        tuple(r.get(c) for c in schemas.VIDEO_ANALYSIS["identified_products"].dataType.elementType.names)
        for r in rows
    ])
    return spark.createDataFrame([tuple(row[c] for c in schemas.VIDEO_ANALYSIS.names)], schemas.VIDEO_ANALYSIS)


def matched(spark, pairs):
    return spark.createDataFrame(
        [(dt.datetime(2024, 1, 1), u, None, None, o, None, None, 0.5) for u, o in pairs],
        schemas.MATCHED_PRODUCTS,
    )


def test_unmatched(spark):
    va = analyses(spark, [("p1", [1.0]), ("p2", [2.0]), (None, [3.0])]).unionByName(
        analyses(spark, [("p3", [1.0])], status="FAILED", uuid="v2")
    )
    def uuids(df):
        return {r["uuid"] for r in df.collect()}

    assert uuids(matching.unmatched(va, matched(spark, []))) == {"p1", "p2", None}
    assert uuids(matching.unmatched(va, matched(spark, [("p1", "o")]))) == {"p2"}
    holes = matched(spark, [("p1", "o"), (None, "o")])
    assert uuids(matching.unmatched(va, holes)) == {"p2"}
    assert uuids(matching.unmatched(va, holes, strict_null=True)) == set()
    only_null = matched(spark, [(None, "o")])
    assert uuids(matching.unmatched(va, only_null)) == {"p1", "p2", None}
    assert uuids(matching.unmatched(va, only_null, strict_null=True)) == set()


def test_newest_embeddings(spark):
    rows = [("a", 1, [1.0]), ("a", 2, [2.0]), ("a", 2, [1.5]), ("b", 1, [3.0])]
    frame = spark.createDataFrame([(i, dt.datetime(2024, 1, d), v, "m") for i, d, v in rows], schemas.PRODUCT_EMBEDDINGS)
    assert {(r["id"], tuple(r["embedding"])) for r in matching.newest_embeddings(frame).collect()} == {("a", (1.5,)), ("b", (3.0,))}


def test_vectors_are_not_read_to_decide(spark, tmp_path):
    """The anti join sees uuids only; the vectors come in with the second scan."""
    path = str(tmp_path / "va")
    analyses(spark, [("p1", [1.0]), ("p2", [2.0])]).write.parquet(path)
    va = spark.read.schema(schemas.VIDEO_ANALYSIS).parquet(path)
    open_products = matching.unmatched(va, matched(spark, [("p1", "o")]))
    assert [r["uuid"] for r in open_products.collect()] == ["p2"]
    plan = open_products._jdf.queryExecution().optimizedPlan().toString()
    scans = open_products._jdf.queryExecution().executedPlan().toString().split("ReadSchema: ")[1:]
    assert "LeftAnti" in plan and len(scans) >= 2
    assert any("embedding:array" not in s.split("\n")[0] for s in scans)


def test_unmatched_equals_sql_not_in(spark):
    va = analyses(spark, [("p1", [1.0]), ("p2", [2.0]), (None, [3.0])])
    for pairs in ([], [("p1", "o")], [("p1", "o"), (None, "o")]):
        log = matched(spark, pairs)
        log.createOrReplaceTempView("log_view")
        matching.explode_identified(va).createOrReplaceTempView("products_view")
        want = spark.sql("SELECT uuid FROM products_view WHERE uuid NOT IN (SELECT uuid FROM log_view)")
        got = matching.unmatched(va, log, strict_null=True).select("uuid")
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_match_order_top_k_before_catalog(spark, feed):
    """The nearest vector has no listing: fewer than k rows are left, none moves up."""
    base = spark.createDataFrame(
        [("gone", dt.datetime(2024, 1, 1), [1.0, 0.0], "m"), ("a", dt.datetime(2024, 1, 1), [0.9, 0.1], "m"),
         ("b", dt.datetime(2024, 1, 1), [0.0, 1.0], "m"), ("a", dt.datetime(2023, 1, 1), [1.0, 0.0], "m")],
        schemas.PRODUCT_EMBEDDINGS,
    )
    va = analyses(spark, [("p1", [1.0, 0.0]), ("p2", [0.0, 1.0])])
    got = match_new_products(va, matched(spark, []), base, catalog.latest_snapshot(feed), k=2).collect()
    assert {(r["uuid"], r["matched_product_offer_id"]) for r in got} == {("p1", "a"), ("p2", "b"), ("p2", "a")}
    assert {r["matched_product_title"] for r in got if r["matched_product_offer_id"] == "a"} == {"online english"}
    again = match_new_products(va, matched(spark, [("p1", "x"), ("p2", "b")]), base, feed, k=2)
    assert again.count() == 0


def test_drop_existing(spark):
    hits = spark.createDataFrame([("u", "a", 0.1), ("u", "b", 0.2)], "uuid string, matched_product_offer_id string, distance double")
    assert [r[1] for r in matching.drop_existing(hits, matched(spark, [("u", "a"), ("w", "b")])).collect()] == ["b"]


def test_appends(spark, tmp_path):
    path = str(tmp_path / "embeddings")
    append_embeddings(embeddings(spark, ["a"]).drop("insertion_timestamp"), path)
    append_embeddings(embeddings(spark, ["b"]), path)
    assert read_table(spark, path, schemas.PRODUCT_EMBEDDINGS).count() == 2
    assert read_table(spark, str(tmp_path / "none"), schemas.PRODUCT_EMBEDDINGS).count() == 0
    append_matches(matched(spark, [("u", "a")]), str(tmp_path / "matches"))
    assert read_table(spark, str(tmp_path / "matches"), schemas.MATCHED_PRODUCTS).count() == 1


def test_encode(spark, feed):
    rows = embed_new_products(feed, embeddings(spark, []), "offline", dim=16).collect()
    assert {r["id"] for r in rows} == {"a", "b", "known"}
    assert all(len(r["embedding"]) == 16 and abs(sum(x * x for x in r["embedding"]) - 1) < 1e-9 for r in rows)
    texts = spark.createDataFrame([("x y",), (None,), ("",)], "t string")
    got = [r["embedding"] for r in encode(texts, "t", dim=8).collect()]
    assert got[1] is None and got[2] is None
    assert (hashing_encoder(8)(["a b"]) == hashing_encoder(8)(["b a"])).all()


ANSWER = (
    '[{"title": "Pencils", "description": "d", "category": "Home", "video_timestamp": "00:00:16.016"},'
    ' {"title": "Bag", "description": null, "subcategory": "Bags", "video_timestamp": "00:00:12.512"}]'
)


def test_parse_identified(spark):
    raw = spark.createDataFrame([("v", ANSWER), ("w", "null"), ("x", None), ("y", "[]"), ("z", "no json")], "uuid string, answer string")
    got = analysis.parse_identified(raw).orderBy("pos").collect()
    assert [(r["video_uuid"], r["title"], r["video_timestamp"]) for r in got] == [("v", "Pencils", 16016), ("v", "Bag", 12512)]
    assert len({r["uuid"] for r in got}) == 2


def test_build_video_analysis(spark):
    videos = spark.createDataFrame(
        [("google_ads", "yt", None, None, "T", None, ANSWER), ("manual_entry", None, "gs://b/x.mp4", "abc", None, None, None)],
        "source string, video_id string, gcs_uri string, md5_hash string, title string, description string, answer string",
    )
    rows = {r["source"]: r for r in analysis.build_video_analysis(videos, "em", "gm", dim=8).collect()}
    ads = rows["google_ads"]
    assert ads["uuid"] == "yt" and ads["status"] == "SUCCESS" and ads["metadata"]["title"] == "T"
    assert [p["title"] for p in ads["identified_products"]] == ["Pencils", "Bag"]
    assert [p["video_timestamp"] for p in ads["identified_products"]] == [16016, 12512]
    assert all(len(p["embedding"]) == 8 for p in ads["identified_products"])
    keys = analysis.parse_identified(videos.select(F.lit("yt").alias("uuid"), "answer")).select("uuid")
    assert {p["uuid"] for p in ads["identified_products"]} == {r["uuid"] for r in keys.collect()}
    assert rows["manual_entry"]["identified_products"] == [] and rows["manual_entry"]["metadata"] is None
    assert rows["manual_entry"]["embedding_model_id"] == "em"
    frame = analysis.build_video_analysis(videos, "em", "gm", dim=8)
    assert frame.columns == schemas.VIDEO_ANALYSIS.names
    assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()


def test_identified_rows(spark):
    va = analyses(spark, [("p1", [1.0]), ("", [2.0]), (None, [2.0])])
    got = analysis.identified_rows(va).collect()
    assert [r["idp_uuid"] for r in got] == ["p1"] and got[0]["relevance_reasoning"] == ""


def test_variants(spark):
    rows = spark.createDataFrame(
        [("i", "a", "A", "B", "img1", 0.3), ("i", "b", "A2", "B", "img1", 0.1), ("i", "c", "C", None, None, 0.2),
         ("i", "e", "E", None, None, 0.2), ("j", "a", "A", "B", "img1", 0.5)],
        "identified_product_uuid string, offer_id string, title string, brand string, image_link string, distance double",
    )
    got = {
        (r["identified_product_uuid"], r["hero_offer_id"]): [v["variant_offer_id"] for v in r["variants"]]
        for r in variants.group_variants(rows).collect()
    }
    assert got == {("i", "b"): ["b", "a"], ("i", "c"): ["c"], ("i", "e"): ["e"], ("j", "a"): ["a"]}
    many = spark.range(500).select(
        F.lit("i").alias("identified_product_uuid"), F.col("id").cast("string").alias("offer_id"), F.lit("t").alias("title"),
        F.lit("b").alias("brand"), F.lit("img").alias("image_link"), (F.col("id") / 10).alias("distance"),
    )
    pieces = variants.group_variants(many, chunk=100).collect()
    assert {r["hero_offer_id"] for r in pieces} == {"0"} and len(pieces) == 5
    assert sum(len(r["variants"]) for r in pieces) == 500


def test_upsert(spark):
    target = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, n int, s string")
    patch = spark.createDataFrame([("b", None, True), ("c", 3, False)], "k string, n int, extra boolean")
    got = {r["k"]: tuple(r)[1:] for r in merge.upsert(target, patch, ["k"], ["n", "extra"]).collect()}
    assert got == {"a": (1, "x", None), "b": (None, "y", True), "c": (3, None, False)}
    once = merge.upsert(target, patch, ["k"], ["n", "extra"])
    twice = merge.upsert(once, patch, ["k"], ["n", "extra"])
    assert sorted(map(repr, once.collect())) == sorted(map(repr, twice.collect()))


def test_validators(spark):
    videos = spark.createDataFrame(
        [("v", None, None), ("v", "gs://x", None), (None, "gs://x", "m"), (None, "gs://x", None), (None, None, None)],
        "video_id string, gcs_uri string, md5_hash string",
    )
    good, bad = validate.validate_videos(videos)
    assert good.count() == 2 and bad.count() == 3
    assert bad.where(F.col("reject_reason").startswith("VIDEO_ID_AND_FILE")).count() == 1
    offers = "map<string,string>"
    deployments = spark.createDataFrame(
        [(1, 2, 3, {"o": "x"}), (0, 2, 3, {"o": "x"}), (1, None, 3, {"o": "x"}), (1, 2, 0, {"o": "x"}),
         (1, 2, None, {"o": "x"}), (1, 2, 3, {}), (1, 2, 3, None)],
        f"ad_group_id long, campaign_id long, customer_id long, offers {offers}",
    )
    good, bad = validate.validate_deployments(deployments)
    assert good.count() == 2 and bad.count() == 5
    numbers = spark.createDataFrame([(0.0,), (-1.0,), (None,)], "distance double")
    good, bad = validate.validate(numbers, validate.non_negative("distance"))
    assert good.count() == 2 and bad.first()["reject_reason"] == "distance must be >= 0"
    candidates = spark.createDataFrame(
        [("v", "o", 0.1, "APPROVED"), ("v", "o", 0.1, None), ("v", "o", 0.1, "X"), (None, "o", 0.1, None), ("v", "o", -1.0, None)],
        "video_uuid string, offer_id string, distance double, candidate_status string",
    )
    good, bad = validate.validate_candidates(candidates)
    assert good.count() == 2 and bad.count() == 3
    requests = spark.createDataFrame([("PENDING", "x"), ("COMPLETED", "x"), ("SUCCESS", None)], "status string, timestamp string")
    assert validate.validate_requests(requests)[0].count() == 1
    stock = spark.createDataFrame([("o", "t", "in stock"), ("o", None, "in stock")], "offer_id string, title string, availability string")
    assert validate.validate_inventory(stock)[1].count() == 1
    row = dict.fromkeys(["offer_id", "title", "brand", "description", "product_type", "google_product_category"], "x")
    products = spark.createDataFrame([tuple(row.values()), ("o", None, "x", "x", "x", "x")], list(row))
    assert validate.validate_products(products)[0].count() == 1
