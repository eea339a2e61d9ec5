"""Headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line.

Every query is planned and run to its end into a sink that drops the rows. The
value is the sum of the single times; nothing is cached between queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

from vidmatch.plans.registry import QUERIES
from vidmatch.session import build_session

HEADLINE = [
    "new_products",
    "product_text",
    "embed_products",
    "knn_match",
    "knn_match_cells",
    "ann_match",
    "match_new_products_flow",
    "variant_groups",
    "json_ingest_identified",
    "sync_matches",
    "video_match_totals",
    "safe_watermark",
    "sync_inventory",
    "search_keywords",
    "summary_page",
    "video_detail",
    "apply_candidates",
    "submission_expand",
    "offer_outcomes",
    "listing_ops",
    "request_status_rollup",
    "video_push_finalize",
    "requests_deployments",
    "work_batch",
    "account_fanout",
    "ads_video_scan",
    "unprocessed_videos",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM side and the Python workers before the first clock runs.
    spark.range(1000).mapInPandas(lambda batches: batches, "id long").write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
