"""Review decisions against the serving tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame

from vidmatch.functions.numbers import as_column, now_seconds
from vidmatch.operators.review import (
    candidate_deltas,
    candidate_patches,
    last_decisions,
    user_products,
    video_patches,
)
from vidmatch.plans.sync import CANDIDATE_KEY, VIDEO_KEY, Targets
from vidmatch.session import cut_lineage
from vidmatch.sources.tables import get_mark, set_mark, write_changes

REVIEW_COLUMNS = ["candidate_status", "user", "is_added_by_user", "modified_timestamp"]
COUNTER_COLUMNS = ["stats_approved_count", "stats_matched_count", "status"]


def review(
    decisions: DataFrame,
    targets: Targets,
    as_of: Column | dt.datetime | str | None = None,
    pushes: DataFrame | None = None,
) -> None:
    """Apply one batch of decisions: candidates, counters with status, user products.

    The counters depend on the tables as they are before the batch. So their patches
    are fixed in a table of their own before anything is written, and a repeated batch does
    not see what its first attempt may have written.
    """
    spark = decisions.sparkSession
    stamp = now_seconds() if as_of is None else as_column(as_of)
    _, last = get_mark(spark, targets.state, "review")
    batch = last + 1
    rows = last_decisions(decisions)
    own = ("review", batch)
    deltas = candidate_deltas(decisions, targets.candidates(spark, own))
    patches = cut_lineage(video_patches(targets.videos(spark, own), deltas, pushes))
    write_changes(patches, targets.path("videos"), "review", batch, VIDEO_KEY, COUNTER_COLUMNS)
    write_changes(
        candidate_patches(rows, stamp),
        targets.path("candidates"),
        "review",
        batch,
        CANDIDATE_KEY,
        REVIEW_COLUMNS,
    )
    write_changes(
        user_products(rows),
        targets.path("inventory"),
        "review",
        batch,
        ["offer_id"],
        ["availability", "title"],
    )
    set_mark(spark, targets.state, "review", "2000-01-01 00:00:00", batch)
