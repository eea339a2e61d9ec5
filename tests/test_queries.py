"""Registered queries: plans of all, results of a few against their SQL."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from oracles import ORACLES  # noqa: E402
from tools.check_oracles import compare, connect  # noqa: E402
from vidmatch.plans.registry import QUERIES  # noqa: E402

SMALL = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="sample tables not there")

# Results depend on the encoder or on an approximate search.
ROWS_ONLY = {"ann_match"}
CHECKED = [
    "new_products", "unmatched_identified", "match_new_products_flow", "variant_groups", "sync_matches", "safe_watermark",
    "summary_page", "video_detail", "apply_candidates", "offer_outcomes", "listing_ops", "request_status_rollup",
    "video_push_finalize", "account_fanout", "unprocessed_videos", "submission_expand", "upsert_merge",
]


def test_every_query_has_sql_but_one():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(oracle_sql()) <= set(queries()) and set(QUERIES) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", CHECKED)
def test_equals_sql(spark, name):
    assert compare(spark, connect(str(SMALL)), str(SMALL), name) == ""


def test_plans_have_no_cross_joins_and_no_row_udfs(spark):
    for name in [*CHECKED, "knn_match", "sync_inventory", "requests_nested", "previous_destinations", "ads_entity_enrichment"]:
        plan = queries()[name](spark, str(SMALL))._jdf.queryExecution().executedPlan().toString()
        for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
            assert node not in plan, (name, node)


def test_scans_read_only_what_is_used(spark):
    plan = queries()["request_success_counts"](spark, str(SMALL))._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema"):].split("\n")[0]
    assert "l_returnflag" in schema and "l_extendedprice" not in schema
    plan = queries()["incremental_filter"](spark, str(SMALL))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(ts" in plan and "event_type" not in plan[plan.index("ReadSchema"):].split("\n")[0]
