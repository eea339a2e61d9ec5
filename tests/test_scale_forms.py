"""Fan-out by doubling, deep pages, postings, distinct encoding, ordered map merge."""

from __future__ import annotations

import datetime as dt
import time
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vidmatch.functions.nested import OFFERS_MAP
from vidmatch.operators import accounts, publish
from vidmatch.operators.encode import encode_distinct
from vidmatch.operators.ranking import newest_page
from vidmatch.sources.postings import Postings

ACCOUNT = "customer_id long, parent_id long, manager boolean"


def closure(links):
    """Least number of links from every account up to every other one above it."""
    up = defaultdict(set)
    for c, p, _ in links:
        if p is not None:
            up[c].add(p)
    out = set()
    for c in {c for c, *_ in links}:
        seen, frontier, level = {c}, {c}, 0
        while frontier:
            level += 1
            frontier = {p for x in frontier for p in up[x]} - seen
            seen |= frontier
            out |= {(p, c, level) for p in frontier}
    return out


def test_all_descendants_of_a_deep_chain_a_loop_and_a_bush(spark):
    rows = [(1, None, True), *[(i, i - 1, True) for i in range(2, 201)], (1000, 200, False)]
    rows += [(300, 302, True), (301, 300, True), (302, 301, True), (303, 301, False), (304, 304, True)]
    rows += [(400 + i, 1, i % 2 == 0) for i in range(30)] + [(410, 402, True), (410, None, None), (500, 999, False)]
    frame = spark.createDataFrame(rows, ACCOUNT)
    got = {tuple(r) for r in accounts.all_descendants(frame).collect()}
    assert got == closure(rows)
    every = defaultdict(set)
    for r in accounts.all_target_accounts(frame).collect():
        every[r["top_id"]].add(r["customer_id"])
    assert every[1] == {1000, 410, *range(401, 430, 2)} and every[150] == {1000}
    for top in (300, 304, 401, 500):
        assert every[top] == {r["customer_id"] for r in accounts.target_accounts(frame, top).collect()}, top
    assert accounts.all_descendants(frame.limit(0)).isEmpty()


AT = dt.datetime(2024, 5, 1)


@pytest.mark.parametrize("kind", ["spread", "one day", "one moment"])
def test_deep_pages(spark, kind):
    step = {"spread": dt.timedelta(hours=7), "one day": dt.timedelta(microseconds=1003), "one moment": dt.timedelta(0)}[kind]
    rows = [(AT + (i % 90) * step if i % 17 else None, f"{'ab'[i % 2]}{i:04d}") for i in range(400)]
    df = spark.createDataFrame(rows, "ts timestamp, id string")
    order = sorted([r for r in rows if r[0]], key=lambda r: (-r[0].timestamp(), r[1]))
    for offset in (1, 203, 372, 9999):
        got = [tuple(r) for r in newest_page(df, "ts", "id", 9, offset, page_rows=6).collect()]
        assert got == order[offset : offset + 9], offset


def test_a_deep_page_sorts_few_rows(spark):
    df = spark.range(50_000).select(F.timestamp_seconds(F.col("id") * 61).alias("ts"), F.col("id").cast("string").alias("id"))
    plan = newest_page(df, "ts", "id", 10, 30_000, page_rows=100)._jdf.queryExecution().optimizedPlan().toString()
    offset = int(plan.split("Offset ")[1].split("\n")[0]) if "Offset " in plan else 0
    assert offset < 100


def test_postings_follow_changed_videos(spark, tmp_path):
    videos = {f"v{i}": ["the", f"w{i % 5}", f"x{i}"] for i in range(30)} | {"none": [], "null": None, "odd": ["the", "the", None]}
    schema = "video_uuid string, search_keywords array<string>"
    frame = lambda d: spark.createDataFrame(list(d.items()), schema)
    index = Postings(str(tmp_path / "p"), parts=5, slices=3)
    terms = {1: "the", 2: " W3  x7 ", 3: "nothing here", 4: "", 5: None, 6: "new the"}

    def check():
        got = {(r["term_id"], r["video_uuid"]) for r in index.find(spark.createDataFrame(list(terms.items()), "term_id long, term string")).collect()}
        assert got == {(t, v) for t, term in terms.items() for v, words in videos.items() if set((term or "").lower().split()) & set(words or [])}

    index.update(frame(videos))
    check()
    changed = {"v3": ["new"], "v7": ["the", "x7"], "odd": None}
    old = {v: videos[v] for v in (*changed, "v9")}  # v9 is deleted
    videos |= changed
    del videos["v9"]
    for _ in range(2):
        index.update(frame(changed), frame(old))
        check()


def test_postings_update_costs_its_own_words(spark, tmp_path):
    schema = "video_uuid string, search_keywords array<string>"
    frame = lambda d: spark.createDataFrame(list(d.items()), schema)
    files = lambda at: {f: f.stat().st_mtime_ns for f in at.rglob("*.parquet")}
    rows = lambda fs: sum(spark.read.parquet(str(f)).count() for f in fs)
    index = Postings(str(tmp_path / "p"), parts=4, slices=2)
    index.update(frame({f"v{i}": ["the", f"w{i % 3}"] for i in range(50)}))
    first = files(tmp_path / "p")
    assert rows(first) == 100
    index.update(frame({"v1": ["new", "new", "the"]}), frame({"v1": ["the", "w1"]}))
    both = files(tmp_path / "p")
    # The stored rows stay where they are; the batch holds a row for each word that was or is.
    assert first.items() <= both.items() and rows(both.keys() - first.keys()) == 3
    short = index.compact(spark, str(tmp_path / "short"))
    assert rows(files(tmp_path / "short")) == 100 and files(tmp_path / "p") == both
    terms = spark.createDataFrame([(1, "new"), (2, "w1"), (3, "the")], "term_id long, term string")
    expected = [(1, "v1"), *[(2, f"v{i}") for i in range(4, 50, 3)], *[(3, f"v{i}") for i in range(50)]]
    for held in (index, short):
        assert sorted((r["term_id"], r["video_uuid"]) for r in held.find(terms).collect()) == sorted(expected)
    short.update(frame({"v1": ["the"]}), frame({"v1": ["new"]}))
    assert sorted(r["term_id"] for r in short.find(terms).where("video_uuid = 'v1'").collect()) == [3]


def test_postings_last_word_of_a_range_goes(spark, tmp_path):
    index = Postings(str(tmp_path / "p"), parts=1, slices=1)
    video = spark.createDataFrame([("v1", ["word"]), (None, ["word"])], "video_uuid string, search_keywords array<string>")
    term = spark.createDataFrame([(1, "word")], "term_id long, term string")
    assert index.find(term).isEmpty()
    index.update(video)
    assert {r["video_uuid"] for r in index.find(term).collect()} == {"v1", None}
    index.update(video.limit(0), video)
    assert index.find(term).isEmpty()
    index.update(video)
    assert index.find(term).count() == 2


def test_postings_pairs_are_not_shuffled(spark, tmp_path):
    index = Postings(str(tmp_path / "p"), parts=3, slices=2)
    videos = spark.createDataFrame([(f"v{i}", ["a", "b", f"w{i}"]) for i in range(20)], "video_uuid string, search_keywords array<string>")
    index.update(videos)
    index.update(videos.where("video_uuid = 'v1'").withColumn("search_keywords", F.array(F.lit("b"), F.lit("c"))), videos.where("video_uuid = 'v1'"))
    spark.createDataFrame([(1, "a b"), (2, "c w1 w2")], "term_id long, term string").write.parquet(str(tmp_path / "terms"))
    found = index.find(spark.read.parquet(str(tmp_path / "terms")))
    got = sorted((r["term_id"], r["video_uuid"]) for r in found.collect())
    assert got == sorted([(1, f"v{i}") for i in range(20)] + [(2, "v1"), (2, "v2")])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(video_uuid" in plan and "hashpartitioning(term_id" not in plan


def test_each_text_is_encoded_once_and_failures_are_alone(spark, tmp_path):
    log = str(tmp_path / "calls")

    def model(texts):
        with open(log, "a") as f:
            f.writelines(f"{t}\n" for t in texts)
        if any("bad" in t for t in texts):
            raise RuntimeError("refused")
        return np.array([[len(t), 1.0 if t != "nan" else np.nan] for t in texts])

    texts = ["hot"] * 50 + [f"text {i}" for i in range(20)] + ["bad one", "bad two", "bad one", None, "", "nan"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    good, rejected = encode_distinct(df, "text", model, full_dim=2)
    assert sorted((r["id"], r["error"]) for r in rejected.collect()) == [
        (70, "RuntimeError: refused"), (71, "RuntimeError: refused"), (72, "RuntimeError: refused"),
        (75, "ValueError: the model gave no finite vector for each text"),
    ]
    got = {r["id"]: r["embedding"] for r in good.collect()}
    assert got == {i: None if t is None else [len(t), 1.0] for i, t in enumerate(texts) if t is None or not ("bad" in t or t == "nan")}
    fine = spark.createDataFrame([(i, "same" if i % 2 else f"t{i}") for i in range(100)], "id long, text string")
    open(log, "w").close()
    assert encode_distinct(fine, "text", model, full_dim=2)[0].count() == 100
    assert len(open(log).read().splitlines()) == 51
    assert encode_distinct(df.limit(0), "text", model, full_dim=2)[0].count() == 0


def test_ten_thousand_offers_in_one_deployment(spark):
    offers = spark.range(10_000).select(F.col("id").cast("string").alias("offer_id"))
    info = F.struct(F.lit("PENDING").alias("status"), F.lit(1).cast("long").alias("cpc_bid_micros"), F.lit(None).cast("string").alias("error_message"))
    deployments = offers.agg(F.map_from_entries(F.collect_list(F.struct("offer_id", info))).cast(OFFERS_MAP).alias("offers")).select(
        F.lit("r").alias("request_uuid"), F.lit(1).cast("long").alias("ad_group_id"), "offers"
    )
    given = spark.range(12_000).select(
        F.lit("r").alias("request_uuid"), F.lit(1).cast("long").alias("ad_group_id"),
        F.when(F.col("id") != 5, F.col("id").cast("string")).alias("offer_id"), F.lit("FAILED").alias("status"),
        F.lit("why").alias("error_message"), F.lit(True).alias("error_given"),
    )
    deployments = spark.createDataFrame(deployments.collect(), deployments.schema)
    started = time.time()
    out = publish.apply_outcomes(deployments, given).first()["offers"]
    assert time.time() - started < 20
    assert len(out) == 10_000 and out["5"]["status"] == "PENDING" and sum(v["status"] == "FAILED" for v in out.values()) == 9_999


def test_many_patches_of_one_deployment_and_few_of_others(spark):
    keys = [("r", 1), ("r", 2), ("s", 1), (None, 1), ("t", None)]
    info = lambda o: ("PENDING", 7, "old" if o == "2" else None)
    sent = [(*k, {str(o): info(str(o)) for o in range(n)} if n is not None else None) for k, n in zip(keys, (6, 4, 0, 3, 3), strict=True)]
    sent += [("r", 1, {"5": info("5"), "own": info("own")}), ("u", 9, None)]  # a deployment that comes twice
    rank = {"FAILED": 0, "ALREADY_PRESENT": 1, "SUCCESS": 2}
    given = [(*k, None if i == 3 else str(i % 9), s, "why" if s == "FAILED" else None, s == "FAILED")
             for k in keys for i in range(20 if k == ("r", 1) else 4) for s in [list(rank)[i % 3]]]
    given += [given[0], ("v", 1, "0", "FAILED", "why", True)]
    deployments = spark.createDataFrame(sent, f"request_uuid string, ad_group_id long, offers {OFFERS_MAP}")
    patches = spark.createDataFrame(given, "request_uuid string, ad_group_id long, offer_id string, status string, error_message string, error_given boolean")

    def expected(r, g, offers):
        out = {}
        for o, (status, cpc, error) in (offers or {}).items():
            mine = [p for p in given if None not in (r, g) and p[:3] == (r, g, o)]
            best = max(mine, key=lambda p: rank[p[3]], default=None)
            out[o] = (best[3] if best else status, cpc, best[4] if best and best[5] else error)
        return out if offers is not None else None

    order = lambda rows: sorted(rows, key=str)
    want = order([(r, g, expected(r, g, o)) for r, g, o in sent])
    for limit in (0, 5, 10_000):
        got = publish.apply_outcomes(deployments, patches, gather_limit=limit).collect()
        assert order([(r[0], r[1], None if r[2] is None else {o: tuple(v) for o, v in r[2].items()}) for r in got]) == want, limit


def test_offers_of_deployments_with_few_patches_are_not_shuffled(spark, tmp_path):
    info = F.struct(F.lit("PENDING").alias("status"), F.lit(1).cast("long").alias("cpc_bid_micros"), F.lit(None).cast("string").alias("error_message"))
    key = [F.col("id").cast("string").alias("request_uuid"), F.col("id").alias("ad_group_id")]
    spark.range(300).select(*key, F.create_map(F.lit("a"), info, F.lit("b"), info).cast(OFFERS_MAP).alias("offers")).write.parquet(str(tmp_path / "d"))
    spark.range(300).select(
        *key, F.lit("a").alias("offer_id"), F.lit("SUCCESS").alias("status"), F.lit(None).cast("string").alias("error_message"), F.lit(False).alias("error_given")
    ).write.parquet(str(tmp_path / "p"))
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        out = publish.apply_outcomes(spark.read.parquet(str(tmp_path / "d")), spark.read.parquet(str(tmp_path / "p")))
        rows = out.collect()
    finally:
        spark.conf.set(threshold, before)
    assert len(rows) == 300 and all(r["offers"]["a"]["status"] == "SUCCESS" and r["offers"]["b"]["status"] == "PENDING" for r in rows)
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    # Patches and deployments by their key; the way of large ones is found empty.
    assert "offer_id" not in " ".join(line for line in plan.split("\n") if "hashpartitioning" in line)
    assert plan.count("Exchange hashpartitioning(") == 2
