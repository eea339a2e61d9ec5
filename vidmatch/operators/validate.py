"""Split rows into valid ones and rejected ones with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidmatch.functions.status import CANDIDATE_STATUSES, REQUEST_STATUSES
from vidmatch.functions.text import is_blank

Rules = dict[str, Column]


def with_reason(df: DataFrame, rules: Rules) -> DataFrame:
    """Add ``reject_reason``: the first rule that does not hold, NULL if all do."""
    reason = F.coalesce(
        *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()],
        F.lit(None).cast("string"),
    )
    return df.withColumn("reject_reason", reason)


def validate(df: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with ``reject_reason``)."""
    marked = with_reason(df, rules)
    valid = marked.where(F.col("reject_reason").isNull()).drop("reject_reason")
    return valid, marked.where(F.col("reject_reason").isNotNull())


def non_negative(*names: str) -> Rules:
    """``>= 0`` for numbers that are given; a missing one is not checked."""
    return {
        f"{n} must be >= 0": F.col(n).isNull() | (F.col(n) >= 0) for n in names
    }


def required(*names: str) -> Rules:
    return {f"{n} is required": F.col(n).isNotNull() for n in names}


def video_rules() -> Rules:
    has_id = F.col("video_id").isNotNull()
    any_file = F.col("gcs_uri").isNotNull() | F.col("md5_hash").isNotNull()
    whole_file = F.col("gcs_uri").isNotNull() & F.col("md5_hash").isNotNull()
    return {
        "VIDEO_ID_AND_FILE": ~(has_id & any_file),
        "NO_VIDEO_ID_OR_FILE": has_id | whole_file,
    }


def validate_videos(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Exactly one of a video id and (uri + checksum)."""
    return validate(df, video_rules())


def deployment_rules() -> Rules:
    def truthy(name: str) -> Column:
        text = F.col(name).cast("string")
        return ~is_blank(text) & (text != "0")

    return {
        "missing ad group": truthy("ad_group_id"),
        "missing campaign": truthy("campaign_id"),
        "missing customer": F.col("customer_id").isNotNull(),
        "no offers": F.size("offers") > 0,
    }


def validate_deployments(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Customer 0 is allowed; 0 and '' count as missing elsewhere."""
    return validate(df, deployment_rules())


def product_rules() -> Rules:
    return required(
        "offer_id", "title", "brand", "description", "product_type", "google_product_category"
    )


def validate_products(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return validate(df, product_rules())


def candidate_rules() -> Rules:
    status = F.col("candidate_status")
    return {
        **required("video_uuid", "offer_id"),
        "unknown candidate_status": status.isNull() | status.isin(CANDIDATE_STATUSES),
        **non_negative("distance"),
    }


def validate_candidates(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return validate(df, candidate_rules())


def validate_inventory(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return validate(df, required("offer_id", "title", "availability"))


def validate_requests(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Status among the six values that jobs write; a timestamp."""
    return validate(
        df,
        {
            "unknown status": F.col("status").isin(REQUEST_STATUSES),
            **required("timestamp"),
        },
    )
