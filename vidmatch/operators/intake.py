"""Videos to analyse: union of sources, de-duplication, privacy, cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidmatch.functions.text import blank_to_null
from vidmatch.operators.ranking import first_per_key, take
from vidmatch.schemas import CHANNEL_TYPE

# Fixed value: default number of videos per run.
VIDEO_LIMIT = 10


def union_sources(*sources: DataFrame) -> DataFrame:
    """Bag union; the order of the arguments is the priority (``source_rank``)."""
    ranked = [s.withColumn("source_rank", F.lit(i)) for i, s in enumerate(sources)]
    out = ranked[0]
    for other in ranked[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def processed_keys(video_analysis: DataFrame) -> DataFrame:
    """Distinct (video_id, gcs_uri) ever analysed, whatever the outcome.

    A row with a uri counts as that file only.
    """
    uri = blank_to_null(F.col("gcs_uri"))
    return (
        video_analysis.select(
            F.when(uri.isNull(), blank_to_null(F.col("video_id"))).alias("video_id"),
            uri.alias("gcs_uri"),
        )
        .where(F.col("video_id").isNotNull() | F.col("gcs_uri").isNotNull())
        .distinct()
    )


def _key() -> Column:
    """Kind and value that identify a video; NULL when it has neither."""
    return F.coalesce(
        F.when(F.col("video_id") != "", F.concat(F.lit("id:"), "video_id")),
        F.when(F.col("gcs_uri") != "", F.concat(F.lit("uri:"), "gcs_uri")),
    )


def first_seen(candidates: DataFrame) -> DataFrame:
    """First occurrence per video in (source_rank, position) order."""
    keyed = candidates.withColumn("_key", _key())
    unique = first_per_key(
        keyed.where(F.col("_key").isNotNull()), ["_key"], ["source_rank", "position"]
    )
    return unique.unionByName(keyed.where(F.col("_key").isNull()))


def public_only(videos: DataFrame, info: DataFrame) -> DataFrame:
    """Drop videos known to be non-public; unknown ones and files stay.

    Title and description are taken from ``info`` where it is known. Of several rows
    of a video the last by ``position`` counts (without that column the greatest).
    """
    order = ["position"] if "position" in info.columns else []
    row = F.struct(*order, "privacy_status", "title", "description")
    known = (
        info.groupBy("video_id")
        .agg(F.max(row).alias("_row"))
        .select(
            "video_id",
            F.col("_row.privacy_status").alias("_privacy"),
            F.col("_row.title").alias("_title"),
            F.col("_row.description").alias("_description"),
            F.lit(True).alias("_known"),
        )
    )
    joined = videos.join(known, "video_id", "left")
    public = F.coalesce(F.col("_privacy") == "public", F.lit(False))
    kept = joined.where(F.col("_known").isNull() | public)
    return kept.select(
        *[F.col(c) for c in videos.columns if c not in ("title", "description")],
        F.when(F.col("_known"), F.col("_title")).otherwise(F.col("title")).alias("title"),
        F.when(F.col("_known"), F.col("_description"))
        .otherwise(F.col("description"))
        .alias("description"),
    )


def unprocessed(
    candidates: DataFrame,
    video_analysis: DataFrame,
    info: DataFrame | None = None,
    limit: int | None = VIDEO_LIMIT,
) -> DataFrame:
    """Candidates never analysed, first occurrence each, public, capped in order."""
    done = processed_keys(video_analysis).select(_key().alias("_key"))
    fresh = first_seen(candidates).join(done, "_key", "left_anti").drop("_key")
    if info is not None:
        fresh = public_only(fresh, info)
    return fresh if limit is None else take(fresh, ["source_rank", "position"], limit)


def ads_videos(
    video_ads: DataFrame, campaigns: DataFrame, accounts: DataFrame
) -> DataFrame:
    """Video ids used in campaigns of the wanted type, distinct over all accounts."""
    return (
        _video_use(video_ads, campaigns, accounts)
        .select("video_id")
        .distinct()
        .select(F.lit("google_ads").alias("source"), "video_id")
    )


def account_video_counts(
    video_ads: DataFrame, campaigns: DataFrame, accounts: DataFrame
) -> DataFrame:
    """Distinct videos per account."""
    return (
        _video_use(video_ads, campaigns, accounts)
        .distinct()
        .groupBy("customer_id")
        .agg(F.count(F.lit(1)).alias("videos"))
    )


def unique_videos(video_ads: DataFrame, campaigns: DataFrame, accounts: DataFrame) -> DataFrame:
    """Number of different videos over all accounts: one row."""
    return ads_videos(video_ads, campaigns, accounts).agg(F.count(F.lit(1)).alias("videos"))


def _video_use(video_ads: DataFrame, campaigns: DataFrame, accounts: DataFrame) -> DataFrame:
    """(account, video) of every ad that counts, repeats included.

    The accounts are applied to the campaigns, so the ads meet one list only; they are not
    made distinct before, which would hold nearly every ad in memory to drop a few.
    """
    wanted = (
        campaigns.where(F.col("advertising_channel_type") == CHANNEL_TYPE)
        .select("customer_id", "campaign_id")
        .join(accounts.select("customer_id").distinct(), "customer_id", "left_semi")
        .distinct()
    )
    return (
        video_ads.select("customer_id", "campaign_id", "video_id")
        .join(wanted, ["customer_id", "campaign_id"], "left_semi")
        .select("customer_id", "video_id")
    )
