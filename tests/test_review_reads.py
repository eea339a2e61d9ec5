from __future__ import annotations

import datetime as dt
from pathlib import Path

from pyspark.sql import functions as F

from vidmatch.functions import nested
from vidmatch import schemas
from vidmatch.operators import reads, review
from vidmatch.session import shared_folder

NOW = "2024-02-01 00:00:00"
DECISION = (
    "video_uuid string, identified_product_uuid string, offer_id string, candidate_status string,"
    " user string, is_added_by_user boolean, position long"
)
STATE = (
    "video_uuid string, stats_approved_count long, stats_matched_count long, status string,"
    " active_pushes map<string,timestamp>, has_successful_push boolean"
)


def candidates(spark, rows):
    """(video, product, offer, status)"""
    return spark.createDataFrame(
        [(v, p, o, 0.1, s, "sys", False, None) for v, p, o, s in rows], schemas.CANDIDATES
    )


def decide(spark, rows):
    """(video, product, offer, status, added by user)"""
    return spark.createDataFrame([(v, p, o, s, "me", a, i) for i, (v, p, o, s, a) in enumerate(rows)], DECISION)


def states(spark, rows):
    return spark.createDataFrame(rows, STATE)


def inventory(spark, rows=()):
    return spark.createDataFrame(list(rows), schemas.INVENTORY)


def counters(df):
    return {r["video_uuid"]: (r["stats_approved_count"], r["stats_matched_count"], r["status"]) for r in df.collect()}


def test_counts_and_status(spark):
    videos = states(spark, [("v", 10, 17, "Ready to Push", {}, False), ("w", 0, 0, "x", {"r": dt.datetime(2024, 1, 1)}, False)])
    old = candidates(spark, [("v", "p", "A", "APPROVED"), ("v", "p", "B", "DISAPPROVED"), ("v", "p", "C", None)])
    new = decide(spark, [("v", "p", "A", "APPROVED", False), ("v", "p", "B", "APPROVED", False), ("v", "p", "C", "UNREVIEWED", False),
                         ("w", "q", "A", "APPROVED", True)])
    after, rows, stock = review.apply_candidates(videos, old, inventory(spark), new, NOW)
    assert counters(after) == {"v": (11, 17, "Ready to Push"), "w": (1, 1, "Push in Progress")}
    got = {(r["video_uuid"], r["offer_id"]): (r["candidate_status"], r["user"], r["distance"]) for r in rows.collect()}
    assert got[("v", "B")] == ("APPROVED", "me", 0.1) and got[("w", "A")] == ("APPROVED", "me", None)
    assert [tuple(r) for r in stock.select("offer_id", "title", "availability").collect()] == [("A", "User Product A", "in stock")]


def test_floor_at_zero(spark):
    videos = states(spark, [("v", 0, 0, "Needs Review", {}, False)])
    after, _, _ = review.apply_candidates(
        videos, candidates(spark, [("v", "p", "A", "APPROVED")]), inventory(spark), decide(spark, [("v", "p", "A", "DISAPPROVED", False)]), NOW
    )
    assert counters(after) == {"v": (0, 0, "Needs Review")}


def test_missing_video_starts_at_zero(spark):
    after, _, _ = review.apply_candidates(
        states(spark, []), candidates(spark, []), inventory(spark), decide(spark, [("v", "p", "A", "APPROVED", False)]), NOW
    )
    assert counters(after) == {"v": (1, 1, "Ready to Push")}


def test_repeated_decisions_count_once_and_the_last_wins(spark):
    new = decide(spark, [("v", "p", "A", "APPROVED", False), ("v", "p", "A", "APPROVED", False), ("v", "p", "B", "APPROVED", False),
                         ("v", "p", "B", "DISAPPROVED", False), ("w", "p", "A", "UNREVIEWED", False)])
    after, rows, _ = review.apply_candidates(states(spark, []), candidates(spark, []), inventory(spark), new, NOW)
    assert counters(after) == {"v": (1, 2, "Ready to Push"), "w": (0, 1, "Needs Review")}
    assert rows.count() == 3


def test_unchanged_videos_are_not_patched_and_push_rows_count(spark):
    videos = states(spark, [("v", 1, 1, "Ready to Push", {}, False)])
    same = review.candidate_deltas(decide(spark, [("v", "p", "A", "APPROVED", False)]), candidates(spark, [("v", "p", "A", "APPROVED")]))
    assert review.video_patches(videos, same).count() == 0
    pushes = spark.createDataFrame([("v", "r")], "video_uuid string, request_uuid string")
    assert review.video_patches(videos, same, pushes).first()["status"] == "Push in Progress"


def test_decision_after_decision_matches_recount(spark):
    videos, rows, stock = states(spark, []), candidates(spark, []), inventory(spark)
    for status in ("APPROVED", "DISAPPROVED", "APPROVED", "UNREVIEWED"):
        new = decide(spark, [("v", "p", o, status if o != "C" else "APPROVED", False) for o in "ABC"])
        videos, rows, stock = review.apply_candidates(videos, rows, stock, new, NOW)
    counts = {r["video_uuid"]: (r[1], r[2]) for r in review.recount(rows).collect()}
    assert counts == {"v": counters(videos)["v"][:2]} == {"v": (1, 3)}


# --- reads


def test_summary_page(spark):
    names = "video_uuid string, video_id string, source string, gcs_uri string, md5_hash string, title string, description string, timestamp timestamp, search_keywords array<string>, status string, stats_identified_count long, stats_matched_count long, stats_approved_count long, active_pushes map<string,timestamp>, has_successful_push boolean"

    def video(uuid, minute, words, source="google_ads", video_id="v", status="Needs Review"):
        ts = None if minute is None else dt.datetime(2024, 1, 1, 0, minute)
        return (uuid, video_id, source, None, None, "t", "d", ts, words, status, 1, None, None, None, None)

    videos = spark.createDataFrame(
        [video("a", 1, ["red", "shoes"]), video("b", 2, ["red"]), video("c", 3, ["shoes"]), video("stub", 4, ["red"], "", None),
         video("undated", None, ["red"]), video("e", 5, ["red"], "", "x", "Push Complete")], names,
    )
    page = reads.summary_page(videos, limit=2, offset=1, term="RED shoes!").collect()
    assert [r["video_uuid"] for r in page] == ["b"], "the stub takes a place and is hidden"
    assert page[0]["total_count"] == 5
    assert [r["video_uuid"] for r in reads.summary_page(videos, term="shoes", status="Needs Review").collect()] == ["c", "a"]
    assert reads.summary_page(videos, term="shoes!").count() == 0
    assert reads.summary_page(videos, term="shoes!", tokenize="regex").count() == 2
    assert reads.summary_page(videos, term="  ").first()["total_count"] == 6
    done = reads.summary_page(videos, status="Push Complete").first()
    assert done["source"] == "youtube" and done["stats_matched_count"] == 0 and done["active_pushes"] == {}


def detail_inputs(spark):
    videos = spark.createDataFrame([("v", "yt", "google_ads", None, None, "T")], "video_uuid string, video_id string, source string, gcs_uri string, md5_hash string, title string")
    identified = spark.createDataFrame([("v", "p1", "P1", None, None, None), ("v", "p2", None, "d", "r", 5)], schemas.IDENTIFIED_PRODUCTS)
    found = candidates(spark, [("v", "p1", "A", None), ("v", "p1", "B", "APPROVED"), ("v", "ghost", "A", None)])
    stock = inventory(spark, [("A", "Title A", None, "img", "in stock", 1.0)])
    return videos, identified, found, stock


def test_video_detail(spark):
    rows = reads.video_detail_rows(*detail_inputs(spark), as_of=NOW).collect()
    assert {(r["idp_uuid"], r["matched_offer_id"], r["matched_title"]) for r in rows} == {("p1", "A", "Title A"), ("p1", "B", "Unknown"), ("p2", None, None)}
    doc = reads.video_detail(*detail_inputs(spark), as_of=NOW, video_uuid="v").collect()
    assert len(doc) == 1
    products = {p["idp_uuid"]: p for p in doc[0]["identified_products"]}
    assert products["p2"]["matched_products"] == [] and products["p2"]["title"] == ""
    found = {m["offer_id"]: m for m in products["p1"]["matched_products"]}
    assert found["A"]["brand"] is None and found["B"]["brand"] == "" and found["A"]["candidate_status"] == "UNREVIEWED"
    assert found["A"]["user"] == "sys" and found["B"]["matched_timestamp"] == dt.datetime(2024, 2, 1)
    assert reads.video_detail(*detail_inputs(spark), as_of=NOW, video_uuid="none").count() == 0


def test_with_matches(spark):
    _, identified, found, _ = detail_inputs(spark)
    assert [r["idp_uuid"] for r in reads.with_matches(identified, found).collect()] == ["p1"]


def requests(spark, rows):
    """(request, video, status, minute)"""
    out = []
    for r, v, s, m in rows:
        row = dict.fromkeys(schemas.ADS_INSERTIONS.names)
        row.update(request_uuid=r, video_uuid=v, status=s, submitting_user="u", timestamp=None if m is None else dt.datetime(2024, 1, 1, 0, m))
        out.append(tuple(row[c] for c in schemas.ADS_INSERTIONS.names))
    return spark.createDataFrame(out, schemas.ADS_INSERTIONS)


def deployments(spark, rows):
    """(request, video, customer, group, offers, error)"""
    return spark.createDataFrame([(r, v, c, 1, g, None, e, o) for r, v, c, g, o, e in rows], schemas.DEPLOYMENTS)


def test_requests_and_deployments(spark):
    asked = requests(spark, [("r1", "v", "SUCCESS", 1), ("r2", "v", "PENDING", 2), ("r3", "w", "PENDING", None)])
    sent = deployments(spark, [("r1", "v", 7, 8, {"A": ("SUCCESS", 5, None), "B": None}, None), ("r1", "v", None, None, None, "boom"),
                               ("lost", "v", 7, 9, {"A": ("FAILED", None, "x")}, None)])
    page = reads.request_page(asked, limit=5).collect()
    assert [(r["request_uuid"], r["total_count"]) for r in page] == [("r2", 3), ("r1", 3)]
    assert reads.by_user(asked, "nobody").count() == 0
    joined = reads.attach_deployments(asked, sent)
    assert joined.count() == 4 and joined.where("ad_group_id = 0 AND customer_id = 0").first()["entity_error_message"] == "boom"
    nested = {r["request_uuid"]: r["ads_entities"] for r in reads.nested_requests(asked, sent).collect()}
    assert len(nested["r1"]) == 2 and nested["r2"] == []
    rows = {(r["request_uuid"], r["offer_id"]): r["status"] for r in reads.offer_rows(sent).collect()}
    assert rows == {("r1", "A"): "SUCCESS", ("r1", "B"): "PENDING", ("lost", "A"): "FAILED"}
    status = {r["request_uuid"]: r for r in reads.video_request_status(sent, asked, "v", NOW).collect()}
    assert status["r1"]["status"] == "SUCCESS" and status["r1"]["entities"] == 2
    assert status["lost"]["status"] == "PROCESSING" and status["lost"]["timestamp"] == dt.datetime(2024, 2, 1)
    videos = detail_inputs(spark)[0].withColumn("description", F.lit("d"))
    one = reads.request_detail(asked, sent, videos, "r1").collect()
    assert len(one) == 2 and one[0]["video"]["video_id"] == "yt"
    assert reads.request_detail(asked, sent, videos, "r9").count() == 0
    assert {tuple(r) for r in reads.inserted_offers(sent).collect()} == {("v", "A")}


def test_previous_destinations(spark):
    asked = requests(spark, [("r1", "v", "SUCCESS", 1), ("r2", "v", "FAILED", 2), ("r3", "v", "PENDING", 3)])
    entities = spark.createDataFrame(
        [("r1", 1, 2, 3, "Shop", None, "Group", None), ("r3", 1, 2, 3, "Shop", None, "Group", None), ("r2", 1, 2, 4, "Shop", None, "G", None),
         ("r1", 5, 2, 6, None, "Camp", None, None), ("r1", 5, 2, 7, None, None, None, "err")],
        "request_uuid string, customer_id long, campaign_id long, ad_group_id long, customer_name string, campaign_name string, ad_group_name string, error_message string",
    )
    got = {tuple(r)[1:] for r in reads.previous_destinations(asked, entities).collect()}
    assert got == {("Shop (1)", "2", "Group (3)"), ("5", "Camp (2)", "6")}


def test_as_json(spark):
    assert reads.as_json(spark.createDataFrame([("a", None)], "x string, y int")).first()[0] == '{"x":"a","y":null}'


def test_requests_of_videos_shuffle_the_entities_once(spark):
    offers = {"a": ("PENDING", 1, None), "b": ("PENDING", 1, None)}
    rows = [("r1", "v1", 7, g, offers) for g in range(9)] + [("r2", "v1", 7, 1, offers), ("r3", "gone", None, 1, None), ("r4", None, 7, 1, offers), (None, "v1", 7, 1, offers)]
    deployments = spark.createDataFrame(rows, f"request_uuid string, video_uuid string, customer_id long, ad_group_id long, offers {nested.OFFERS_MAP}")
    deployments = deployments.withColumn("campaign_id", F.lit(1).cast("long"))
    requests = spark.createDataFrame(
        [("r1", "u", "PENDING"), ("r2", "u", "SUCCESS"), ("r2", "w", "FAILED")], "request_uuid string, submitting_user string, status string"
    ).withColumn("timestamp", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    videos = spark.createDataFrame([("v1", "x", "s", "t", None)], "video_uuid string, video_id string, source string, title string, gcs_uri string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = reads.requests_of_videos(deployments, requests, videos, "2002-01-01 00:00:00", chunk=2)
        lines = out._jdf.queryExecution().executedPlan().toString().split("\n")
        got = out.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    found = sorted((r["request_uuid"], r["video_uuid"], r["submitting_user"] or "", r["status"], r["video"] and r["video"]["video_id"], e["ad_group_id"], e["customer_id"], len(e["offers"])) for r in got for e in r["ads_entities"])
    assert found == sorted(
        [("r1", "v1", "u", "PENDING", "x", g, 7, 2) for g in range(9)]
        + [("r2", "v1", "u", "SUCCESS", "x", 1, 7, 2), ("r2", "v1", "w", "FAILED", "x", 1, 7, 2), ("r3", "gone", "", "PROCESSING", None, 1, 0, 0)]
    )
    assert len({r["chunk_no"] for r in got if r["request_uuid"] == "r1"}) > 1
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    at = next(i for i, line in enumerate(lines) if "collect_list" in line)
    level = depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < level:
            level = depth(line)
            assert "Exchange" not in line


def test_requests_of_videos_deal_crowded_requests_over_tasks(spark):
    offers = {"a": ("PENDING", 1, None)}
    # r0 has many entities of one video, r1 one entity of each of many videos.
    rows = [("r0", "v1", g) for g in range(120)] + [("r1", f"v{v}", 5) for v in range(90)]
    rows += [(f"r{n}", f"v{n % 4}", g) for n in range(2, 30) for g in range(n % 7 + 1)] + [("r2", "v2", 0), ("r3", None, 1), (None, "v1", 1)]
    deployments = spark.createDataFrame(
        [(r, v, 7, 1, g, offers) for r, v, g in rows],
        f"request_uuid string, video_uuid string, customer_id long, campaign_id long, ad_group_id long, offers {nested.OFFERS_MAP}",
    )
    requests = spark.createDataFrame(
        [("r0", "a", "PENDING"), ("r1", "b", "SUCCESS"), *[(f"r{n}", "c", "FAILED") for n in range(2, 20)], ("r4", "d", "PENDING"), (None, "e", "PENDING")],
        "request_uuid string, submitting_user string, status string",
    ).withColumn("timestamp", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    videos = spark.createDataFrame(
        [(f"v{v}", f"x{v}", "s", "t", None) for v in range(60)] + [("v3", "again", "s", "t", None), (None, "no", "s", "t", None)],
        "video_uuid string, video_id string, source string, title string, gcs_uri string",
    )
    users, ids = {"r0": "a", "r1": "b", "r4": "cd"} | {f"r{n}": "c" for n in range(2, 20) if n != 4}, {f"v{v}": [f"x{v}"] for v in range(60)}
    ids["v3"] += ["again"]
    expected = sorted((r, v, u, i or "", g) for r, v, g in rows if r and v for u in users.get(r, "-") for i in ids.get(v, [None]))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    known = set(Path(shared_folder(spark)).iterdir()) if Path(shared_folder(spark)).exists() else set()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    found = {}
    try:
        for sizes in ({}, {"task_rows": 20, "crowd": 10}, {"task_rows": 7, "crowd": 0}):
            out = reads.requests_of_videos(deployments, requests, videos, "2002-01-01 00:00:00", chunk=4, **sizes)
            # Neither requests nor keys are shuffled again once the entities are dealt.
            assert "hashpartitioning(request_uuid" not in out._jdf.queryExecution().executedPlan().toString()
            got = out.collect()
            whole = [(r["request_uuid"], r["video_uuid"], r["submitting_user"] or "-", r["video"]["video_id"] if r["video"] else "", e["ad_group_id"]) for r in got for e in r["ads_entities"]]
            assert sorted(whole) == expected
            assert len({r["chunk_no"] for r in got if r["request_uuid"] == "r0"}) > 20
            found[len(found)] = sorted((r["request_uuid"], r["video_uuid"], r["submitting_user"] or "", str(r["video"]), r["chunk_no"], sorted(e["ad_group_id"] for e in r["ads_entities"])) for r in got)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    # The rows do not depend on how they are dealt, and no list of the requests was written.
    assert found[0] == found[1] == found[2]
    written = [spark.read.parquet(str(p)).columns for p in set(Path(shared_folder(spark)).iterdir()) - known]
    assert written and not any("request_uuid" in columns for columns in written)
    assert reads.requests_of_videos(deployments.limit(0), requests, videos, "2002-01-01 00:00:00").isEmpty()
