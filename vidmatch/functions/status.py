"""Derived statuses and counter rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Video statuses by falling priority, request and review statuses.
PUSH_IN_PROGRESS = "Push in Progress"
PUSH_COMPLETE = "Push Complete"
READY_TO_PUSH = "Ready to Push"
NEEDS_REVIEW = "Needs Review"
REQUEST_STATUSES = [
    "SUCCESS",
    "FAILED",
    "ALREADY_PRESENT",
    "PENDING",
    "PROCESSING",
    "PARTIAL_SUCCESS",
]
CANDIDATE_STATUSES = ["APPROVED", "DISAPPROVED", "UNREVIEWED"]


def video_status(active: Column, pushed: Column, approved: Column) -> Column:
    """``active`` is the number of running pushes."""
    return (
        F.when(active > 0, PUSH_IN_PROGRESS)
        .when(pushed, PUSH_COMPLETE)
        .when(approved > 0, READY_TO_PUSH)
        .otherwise(NEEDS_REVIEW)
    )


def request_status(success: Column, total: Column, error: Column) -> Column:
    """A request without items succeeds; see ``counts_as_push`` for the video."""
    return (
        F.when(error.isNotNull(), "FAILED")
        .when(total == 0, "SUCCESS")
        .when(success == 0, "FAILED")
        .when(success < total, "PARTIAL_SUCCESS")
        .otherwise("SUCCESS")
    )


def counts_as_push(success: Column, total: Column, error: Column) -> Column:
    return error.isNull() & (total > 0) & (success > 0)


def delta_rule(old: Column, new: Column, exists: Column) -> Column:
    """struct(approved, matched): what one decision adds to its video's counters."""
    before = F.coalesce(old, F.lit("UNREVIEWED"))
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    entering = F.when(new == "APPROVED", one).otherwise(zero)
    leaving = F.when(before == "APPROVED", one).otherwise(zero)
    approved = (
        F.when(~exists, entering).when(before == new, zero).otherwise(entering - leaving)
    )
    return F.struct(
        approved.alias("approved"), F.when(exists, zero).otherwise(one).alias("matched")
    )
