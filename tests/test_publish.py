from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vidmatch import schemas
from vidmatch.operators import publish, reads

NOW = dt.datetime(2024, 2, 1, 12, 0)
HOUR = dt.timedelta(hours=1)


def submissions(spark, rows):
    return spark.createDataFrame(rows, schemas.SUBMISSIONS)


def test_expand_submissions(spark):
    rows = submissions(
        spark,
        [("r1", "v", "a, b,a,", [(1, 10, 100), (2, 20, 200), (3, 30, 100)], "me", 1.5), (None, "w", None, None, "me", 0.0)],
    )
    requests, deployments, patches = publish.expand_submissions(rows, NOW)
    got = {r["video_uuid"]: r for r in requests.collect()}
    assert got["v"]["offer_ids"] == ["a", "b", "a", ""] and got["v"]["status"] == "PENDING"
    assert got["w"]["offer_ids"] == [] and len(got["w"]["request_uuid"]) == 36
    assert got["w"]["request_uuid"] == requests.where("video_uuid = 'w'").first()["request_uuid"]
    sent = {(r["ad_group_id"], r["customer_id"]): r["offers"] for r in deployments.collect()}
    assert set(sent) == {(200, 2), (100, 3)}, "the last destination of an ad group stays"
    assert {k: tuple(v) for k, v in sent[(200, 2)].items()} == {o: ("PENDING", 1500000, None) for o in ("a", "b", "")}
    assert {(r["video_uuid"], r["status"]) for r in patches.collect()} == {("v", "Push in Progress"), ("w", "Push in Progress")}
    plans = [f._jdf.queryExecution().executedPlan().toString() for f in (requests, deployments, patches)]
    assert not any("Exchange" in p for p in plans)


def test_start_pushes(spark):
    videos = spark.createDataFrame([("v", "Needs Review"), ("x", "Needs Review")], "video_uuid string, status string")
    pushes = spark.createDataFrame([("x", "old", NOW)], "video_uuid string, request_uuid string, active_since timestamp")
    rows = submissions(spark, [(r, v, "a", [(1, 1, 1)], "me", None) for r, v in (("r1", "v"), ("r2", "v"), ("r3", "ghost"))])
    _, _, patches = publish.expand_submissions(rows, NOW)
    states, running = publish.start_pushes(videos, pushes, patches)
    assert {tuple(r) for r in states.collect()} == {("v", "Push in Progress"), ("x", "Needs Review")}
    assert {tuple(r)[:2] for r in running.collect()} == {("x", "old"), ("v", "r1"), ("v", "r2")}


def leases(spark):
    rows = [("stale", "PROCESSING", NOW - 3 * HOUR, 1), ("fresh", "PROCESSING", NOW - HOUR, 1), ("p2", "PENDING", None, 2),
            ("p1", "PENDING", None, 1), ("undated", "PENDING", None, None), ("done", "SUCCESS", NOW - 9 * HOUR, 1)]
    return spark.createDataFrame(
        [(r, s, lease, None if m is None else dt.datetime(2024, 1, 1, 0, m)) for r, s, lease, m in rows],
        "request_uuid string, status string, leased_at timestamp, timestamp timestamp",
    )


def test_leases(spark):
    asked = leases(spark)
    assert {r[0] for r in publish.lease_eligible(asked, NOW).collect()} == {"stale", "p1", "p2", "undated"}
    edge = asked.withColumn("leased_at", F.lit(NOW - 2 * HOUR + dt.timedelta(minutes=1)))
    assert publish.lease_eligible(edge, NOW).where("status = 'PROCESSING'").count() == 0
    got = publish.work_batch(asked, NOW).orderBy("stage", "timestamp").collect()
    assert [(r["request_uuid"], r["stage"]) for r in got] == [("stale", 0), ("p1", 1), ("p2", 1)]
    assert publish.work_batch(asked, NOW, n=1).count() == 2


def tree(spark, rows):
    """(group, resource, type, parent, dimension, item)"""
    return spark.createDataFrame([(*r, False) for r in rows], schemas.LISTING_GROUPS)


ITEM = "product_item_id"
TREES = [
    (1, "unit", "UNIT", None, None, None),
    (2, "root", "SUBDIVISION", "", None, None),
    (2, "c1", "UNIT", "root", ITEM, "101"),
    (2, "other", "UNIT", "root", ITEM, None),
    (3, "root3", "SUBDIVISION", None, None, None),
    (3, "c3", "UNIT", "root3", "product_brand", None),
    (4, "odd", "99", None, None, None),
    (5, "orphan", "UNIT", "nowhere", ITEM, "7"),
    (6, "root6", "SUBDIVISION", None, None, None),
    (6, "deep", "UNIT", "c6", ITEM, "8"),
]


def test_tree_state(spark):
    got = {r["ad_group_id"]: r["state"] for r in publish.tree_state(tree(spark, TREES)).collect()}
    assert got == {1: "CLEAN", 2: "PARTITIONED", 3: "DIRTY", 4: "DIRTY", 5: "CLEAN", 6: "DIRTY"}
    children = publish.tree_children(tree(spark, TREES)).collect()
    assert {r["resource_name"] for r in children} == {"c1", "other", "c3"}


def targets(spark, group, offers, strategy=None):
    return spark.createDataFrame(
        [(group, o, i, strategy) for i, o in enumerate(offers)], "ad_group_id long, offer_id string, position long, strategy string"
    )


def outcome(df):
    return sorted((r["position"], r["offer_id"], r["status"]) for r in df.collect())


def test_rebuild(spark):
    wanted = targets(spark, 9, ["a", "a", "b"])
    ops = publish.listing_ops(wanted, tree(spark, TREES)).orderBy("step", "offer_id").collect()
    assert [(o["op"], o["offer_id"]) for o in ops] == [("CREATE_ROOT", None), ("CREATE_OTHER", None), ("CREATE_UNIT", "a"), ("CREATE_UNIT", "b")]
    assert ops[1]["negative"] is True and {o["parent"] for o in ops[1:]} == {"9~-1"}
    assert outcome(publish.offer_outcomes(wanted, tree(spark, TREES))) == [(0, "a", "SUCCESS"), (1, "a", "ALREADY_PRESENT"), (2, "b", "SUCCESS")]


def test_purge_removes_the_root(spark):
    ops = publish.listing_ops(targets(spark, 2, ["101"], "purge"), tree(spark, TREES)).collect()
    assert {(o["op"], o["resource_name"], o["offer_id"]) for o in ops} == {
        ("REMOVE_ROOT", "root", None), ("CREATE_ROOT", "2~-1", None), ("CREATE_OTHER", None, None), ("CREATE_UNIT", None, "101")}
    unit = publish.listing_ops(targets(spark, 1, ["x"]), tree(spark, TREES))
    assert unit.where("op = 'REMOVE_ROOT'").first()["resource_name"] == "unit"


def test_append(spark):
    wanted = targets(spark, 2, ["101", "102", "102"])
    ops = publish.listing_ops(wanted, tree(spark, TREES)).collect()
    assert [(o["op"], o["offer_id"], o["parent"]) for o in ops] == [("CREATE_UNIT", "102", "root")]
    assert outcome(publish.offer_outcomes(wanted, tree(spark, TREES))) == [
        (0, "101", "ALREADY_PRESENT"), (1, "102", "SUCCESS"), (2, "102", "ALREADY_PRESENT")]
    flags = publish.flag_existing(wanted, tree(spark, TREES))
    assert {(r["offer_id"], r["is_present"]) for r in flags.collect()} == {("101", True), ("102", False)}


def test_dirty_tree_fails_everything(spark):
    wanted = targets(spark, 3, ["a", "a", ""])
    assert publish.listing_ops(wanted, tree(spark, TREES)).count() == 0
    got = publish.offer_outcomes(wanted, tree(spark, TREES))
    assert outcome(got) == [(0, "a", "FAILED"), (1, "a", "FAILED"), (2, "", "FAILED")]
    assert got.first()["error_message"] == publish.NOT_ITEM_TREE


def test_blank_ids_are_skipped(spark):
    wanted = targets(spark, 9, ["", None, "a"])
    assert outcome(publish.offer_outcomes(wanted, tree(spark, TREES))) == [(2, "a", "SUCCESS")]
    assert publish.listing_ops(wanted, tree(spark, TREES)).where("op = 'CREATE_UNIT'").count() == 1


def test_failed_call(spark):
    errors = spark.createDataFrame([(2, "quota")], "ad_group_id long, error_message string")
    wanted = targets(spark, 2, ["101", "102", "102", "103"])
    got = publish.offer_outcomes(wanted, tree(spark, TREES), errors)
    assert outcome(got) == [(0, "101", "ALREADY_PRESENT"), (2, "102", "ALREADY_PRESENT"), (3, "103", "FAILED")]
    assert got.where("status = 'FAILED'").first()["error_message"] == "quota"
    # nothing to send, so no call could fail
    idle = publish.offer_outcomes(targets(spark, 2, ["101"]), tree(spark, TREES), errors)
    assert outcome(idle) == [(0, "101", "ALREADY_PRESENT")]


def test_too_many_operations(spark):
    wanted = spark.range(9_998).select(F.lit(9).cast("long").alias("ad_group_id"), F.col("id").cast("string").alias("offer_id"),
                                       F.col("id").alias("position"), F.lit(None).cast("string").alias("strategy"))
    trees = tree(spark, TREES)
    assert publish.offer_outcomes(wanted, trees).where("status <> 'SUCCESS'").count() == 0
    more = wanted.unionByName(targets(spark, 9, ["x"]).withColumn("position", F.lit(10_000).cast("long")))
    assert publish.offer_outcomes(more, trees).where("status <> 'FAILED'").count() == 0
    guard = publish.guard_ops(publish.listing_ops(more, trees)).first()
    assert guard["op_count"] == 10_001 and guard["overflow"] is True


@pytest.mark.parametrize("group", [1, 2, 3, 9])
@pytest.mark.parametrize("fails", [False, True])
def test_outcomes_equal_a_plain_walk(spark, group, fails):
    """The set-based result against one walk over the targets in order."""
    offers = ["101", "102", "102", "", "103", "101", "104", "103"]
    state = {1: "CLEAN", 2: "PARTITIONED", 3: "DIRTY", 9: "CLEAN"}[group]
    there = {"101"} if state == "PARTITIONED" else set()
    want, seen = [], set()
    if state == "DIRTY":
        want = [(o, "FAILED") for o in offers]
    else:
        for o in offers:
            if o and (o in seen or o in there):
                want.append((o, "ALREADY_PRESENT"))
            seen.add(o)
        added = [o for o in dict.fromkeys(offers) if o and o not in there]
        if fails:
            done = {o for o, _ in want}
            want += [(o, "FAILED") for o in offers if o not in done]
        else:
            want += [(o, "SUCCESS") for o in added]
    errors = spark.createDataFrame([(group, "e")] if fails else [], "ad_group_id long, error_message string")
    got = publish.offer_outcomes(targets(spark, group, offers), tree(spark, TREES), errors)
    assert sorted((r["offer_id"], r["status"]) for r in got.collect()) == sorted(want)


def test_unhandled(spark):
    handled = spark.createDataFrame([(9, "a")], "ad_group_id long, offer_id string")
    assert outcome(publish.fail_unhandled(targets(spark, 9, ["a", "b"]), handled)) == [(1, "b", "FAILED")]


def deployments(spark, rows):
    return spark.createDataFrame([(r, "v", c, k, g, None, None, o) for r, c, k, g, o in rows], schemas.DEPLOYMENTS)


def test_patches_and_maps(spark):
    sent = deployments(spark, [("r", 1, 2, 3, {"a": ("PENDING", 5, "old"), "b": ("PENDING", 5, None), "c": ("PENDING", 5, None)}),
                               ("s", 1, 2, 3, {"a": ("PENDING", 5, None)}), ("t", 1, None, 4, {"z": ("PENDING", 5, None)})])
    results = spark.createDataFrame(
        [("r", 3, "a", "SUCCESS", None), ("r", 3, "b", "FAILED", "quota"), ("r", 3, "ghost", "SUCCESS", None)],
        "request_uuid string, ad_group_id long, offer_id string, status string, error_message string",
    )
    lost = spark.createDataFrame([("s", 3, "a", "down"), ("r", 3, "c", "down")], "request_uuid string, ad_group_id long, offer_id string, error_message string")
    bad = publish.corrupt_outcomes(sent)
    assert [tuple(r)[:4] for r in bad.collect()] == [("t", 4, "z", "FAILED")]
    patched = publish.apply_outcomes(sent, publish.deployment_patches(results.unionByName(bad), lost))
    got = {(r["request_uuid"], r["offer_id"]): (r["status"], r["cpc_bid_micros"], r["error_message"]) for r in reads.offer_rows(patched).collect()}
    assert got == {
        ("r", "a"): ("SUCCESS", 5, "old"), ("r", "b"): ("FAILED", 5, "Fatal: quota"), ("r", "c"): ("PENDING", 5, None),
        ("s", "a"): ("FAILED", 5, "Fatal: down"),
        ("t", "z"): ("FAILED", 5, "Fatal: Corrupt deployment metadata (missing customer/campaign/offers)"),
    }


def test_counts_and_request_status(spark):
    results = spark.createDataFrame(
        [("r", 1, "SUCCESS"), ("r", 1, "ALREADY_PRESENT"), ("r", 2, "FAILED"), ("s", 1, "FAILED"), ("t", 1, "ALREADY_PRESENT"), ("u", 1, "PENDING")],
        "request_uuid string, ad_group_id long, status string",
    )
    counts = {(r[0], r[1]): tuple(r)[2:] for r in publish.entity_counts(results).collect()}
    assert counts[("r", 1)] == (1, 0, 1, 0) and counts[("r", 2)] == (0, 0, 0, 1) and counts[("u", 1)] == (0, 1, 0, 0)
    asked = spark.createDataFrame([(r, "v") for r in "rstxe"], "request_uuid string, video_uuid string")
    errors = spark.createDataFrame([("e", "boom")], "request_uuid string, error string")
    got = {r["request_uuid"]: (r["status"], r["error_message"], r["counts_as_push"]) for r in publish.finished_requests(asked, results, errors).collect()}
    assert got == {
        "r": ("PARTIAL_SUCCESS", None, True), "s": ("FAILED", None, False), "t": ("SUCCESS", None, True), "x": ("SUCCESS", None, False),
        "e": ("FAILED", "Critical Worker Fail: boom", False),
    }
    stored = asked.select("request_uuid", F.lit("PROCESSING").alias("status"), F.lit(None).cast("string").alias("error_message"))
    final = {r["request_uuid"]: r for r in publish.finalize_requests(stored, publish.finished_requests(asked, results, errors), NOW).collect()}
    assert final["e"]["failed_at"] == NOW and final["e"]["completed_at"] is None and final["r"]["completed_at"] == NOW


MATRIX = [
    (["other"], False, 0, 5, 5, "Push in Progress", True),
    ([], False, 0, 5, 5, "Push Complete", True),
    ([], True, 0, 0, 5, "Push Complete", True),
    ([], False, 1, 0, 5, "Ready to Push", False),
    ([], False, 0, 0, 5, "Needs Review", False),
    (["final"], False, 0, 5, 5, "Push Complete", True),
    (["other"], False, 0, 0, 5, "Push in Progress", False),
    ([], False, 0, 3, 5, "Push Complete", True),
    ([], False, 0, 0, 0, "Needs Review", False),
    (["final", "other"], False, 0, 5, 5, "Push in Progress", True),
]


def test_finalize_matrix(spark):
    """All ten cases at once: as maps inside the videos, and as push rows."""
    ddl = "video_uuid string, active_pushes map<string,timestamp>, has_successful_push boolean, stats_approved_count long, status string"
    videos = spark.createDataFrame(
        [(str(i), {f"{p}{i}": NOW for p in m[0]}, m[1], m[2], "x") for i, m in enumerate(MATRIX)] + [("idle", {"r": NOW}, None, 0, "x")], ddl
    )
    finished = spark.createDataFrame([(f"final{i}", str(i), m[3] > 0 and m[4] > 0) for i, m in enumerate(MATRIX)],
                                     "request_uuid string, video_uuid string, counts_as_push boolean")
    want = {str(i): (m[5], m[6]) for i, m in enumerate(MATRIX)} | {"idle": ("x", None)}
    after = publish.finalize_videos(videos, finished)
    assert {r["video_uuid"]: (r["status"], r["has_successful_push"]) for r in after.collect()} == want
    assert {r["video_uuid"]: set(r["active_pushes"]) for r in after.collect()}["9"] == {"other9"}
    pushes = publish.push_rows(videos)
    states, left = publish.finish_pushes(videos.drop("active_pushes"), pushes, finished)
    assert {r["video_uuid"]: (r["status"], r["has_successful_push"]) for r in states.collect()} == want
    assert {r["request_uuid"] for r in left.collect()} == {"other0", "other6", "other9", "r"}


def test_outcomes_plan_offers_and_roots_once(spark):
    """Targets are joined with written plans: few shuffles are left for the result."""
    rows = [(1, "a", 0, None), (1, "b", 1, None), (2, "a", 2, "PURGE")]
    targets = spark.createDataFrame(rows, "ad_group_id long, offer_id string, position long, strategy string")
    nodes = spark.createDataFrame([], schemas.LISTING_GROUPS)
    plan = publish.offer_outcomes(targets, nodes)._jdf.queryExecution().executedPlan().toString()
    plan = plan[plan.index("Initial Plan"):] if "Initial Plan" in plan else plan
    assert plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") <= 6
