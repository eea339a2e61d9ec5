"""Review decisions: candidate rows, counters, video status, user products."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidmatch.functions.nested import empty_pushes
from vidmatch.functions.numbers import as_column, floor_zero, now_seconds
from vidmatch.functions.status import delta_rule, video_status
from vidmatch.operators.merge import upsert
from vidmatch.operators.ranking import last_per_key

CANDIDATE_KEY = ["video_uuid", "identified_product_uuid", "offer_id"]

# What is stored for a product that only a user knows.
USER_PRODUCT_TITLE = "User Product "
USER_PRODUCT_AVAILABILITY = "in stock"


def last_decisions(decisions: DataFrame) -> DataFrame:
    """Last decision per candidate, in ``position`` order."""
    return last_per_key(decisions, CANDIDATE_KEY, "position")


def decision_deltas(decisions: DataFrame, existing: DataFrame) -> DataFrame:
    """Each (de-duplicated) decision with what it adds to the counters."""
    old = existing.select(
        *CANDIDATE_KEY, F.col("candidate_status").alias("_old"), F.lit(True).alias("_exists")
    )
    delta = delta_rule(
        F.col("_old"), F.col("candidate_status"), F.coalesce("_exists", F.lit(False))
    )
    return (
        decisions.join(old, CANDIDATE_KEY, "left")
        .withColumn("_delta", delta)
        .select(
            *decisions.columns,
            F.col("_delta.approved").alias("delta_approved"),
            F.col("_delta.matched").alias("delta_matched"),
        )
    )


def candidate_deltas(decisions: DataFrame, existing: DataFrame) -> DataFrame:
    """Sum of both deltas per video; summed before the shuffle."""
    return (
        decision_deltas(last_decisions(decisions), existing)
        .groupBy("video_uuid")
        .agg(
            F.sum("delta_approved").alias("delta_approved"),
            F.sum("delta_matched").alias("delta_matched"),
        )
    )


def video_patches(
    videos: DataFrame, deltas: DataFrame, pushes: DataFrame | None = None
) -> DataFrame:
    """New counters and status of the decided videos, where something changed.

    Counters never fall below 0; a video without a row starts at 0. Running pushes
    are read from the map of the video, and from ``pushes`` rows if given.
    """
    state = videos.select(
        "video_uuid",
        F.col("stats_approved_count").alias("_approved"),
        F.col("stats_matched_count").alias("_matched"),
        F.col("status").alias("_status"),
        F.size(F.coalesce("active_pushes", empty_pushes())).alias("_active"),
        F.coalesce("has_successful_push", F.lit(False)).alias("_pushed"),
    )
    before = {n: F.coalesce(F.col(f"_{n}"), F.lit(0)).cast("long") for n in ("approved", "matched")}
    approved = floor_zero(before["approved"] + F.col("delta_approved"))
    matched = floor_zero(before["matched"] + F.col("delta_matched"))
    status = video_status(
        F.coalesce("_active", F.lit(0)), F.coalesce("_pushed", F.lit(False)), approved
    )
    changed = (
        (approved != before["approved"])
        | (matched != before["matched"])
        | ~status.eqNullSafe(F.col("_status"))
    )
    joined = deltas.join(state, "video_uuid", "left")
    if pushes is not None:
        running = pushes.groupBy("video_uuid").agg(F.count(F.lit(1)).alias("_running"))
        joined = (
            joined.join(running, "video_uuid", "left")
            .withColumn("_active", F.coalesce("_active", F.lit(0)) + F.coalesce("_running", F.lit(0)))
            .drop("_running")
        )
    return (
        joined.where(changed)
        .select(
            "video_uuid",
            approved.alias("stats_approved_count"),
            matched.alias("stats_matched_count"),
            status.alias("status"),
        )
    )


def candidate_patches(decisions: DataFrame, as_of: Column) -> DataFrame:
    return decisions.select(
        *CANDIDATE_KEY,
        "candidate_status",
        "user",
        "is_added_by_user",
        as_of.alias("modified_timestamp"),
    )


def user_products(decisions: DataFrame) -> DataFrame:
    """Inventory rows for the products that users added themselves."""
    return (
        decisions.where(F.col("is_added_by_user"))
        .select("offer_id")
        .distinct()
        .select(
            "offer_id",
            F.lit(USER_PRODUCT_AVAILABILITY).alias("availability"),
            F.concat(F.lit(USER_PRODUCT_TITLE), "offer_id").alias("title"),
        )
    )


def apply_candidates(
    videos: DataFrame,
    candidates: DataFrame,
    inventory: DataFrame,
    decisions: DataFrame,
    as_of: Column | dt.datetime | str | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(videos, candidates, inventory) after one batch of decisions."""
    stamp = now_seconds() if as_of is None else as_column(as_of)
    last = last_decisions(decisions)
    patches = video_patches(videos, candidate_deltas(decisions, candidates))
    return (
        upsert(
            videos, patches, ["video_uuid"], ["stats_approved_count", "stats_matched_count", "status"]
        ),
        upsert(
            candidates,
            candidate_patches(last, stamp),
            CANDIDATE_KEY,
            ["candidate_status", "user", "is_added_by_user", "modified_timestamp"],
        ),
        upsert(inventory, user_products(last), ["offer_id"], ["availability", "title"]),
    )


def recount(candidates: DataFrame) -> DataFrame:
    """Counters from the candidate rows themselves, to check the kept ones."""
    return candidates.groupBy("video_uuid").agg(
        F.count_if(F.col("candidate_status") == "APPROVED").alias("stats_approved_count"),
        F.count(F.lit(1)).alias("stats_matched_count"),
    )


def approved(candidates: DataFrame) -> DataFrame:
    return candidates.where(F.col("candidate_status") == "APPROVED")
