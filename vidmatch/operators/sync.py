"""What is new since a mark: videos, matches, totals and inventory."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidmatch.functions.numbers import as_column, price_double
from vidmatch.functions.text import strip_key
from vidmatch.operators.catalog import pick_listing
from vidmatch.operators.joins import skew_join, spread_join

Mark = Column | dt.datetime | str

INVENTORY_COLUMNS = ["title", "brand", "image_link", "availability", "price"]


def since(df: DataFrame, last_sync: Mark, ts: str = "timestamp") -> DataFrame:
    """Rows strictly after the mark, oldest first."""
    return df.where(F.col(ts) > as_column(last_sync)).orderBy(ts)


def idp_videos(video_analysis: DataFrame) -> DataFrame:
    """Distinct (video_uuid, idp_uuid) pairs of all analyses."""
    return (
        video_analysis.select(
            F.col("uuid").alias("video_uuid"), F.explode("identified_products.uuid").alias("idp_uuid")
        )
        .where(F.col("idp_uuid").isNotNull())
        .distinct()
    )


def with_video(matched: DataFrame, video_analysis: DataFrame) -> DataFrame:
    """Matches with the video of their identified product."""
    matches = matched.withColumnRenamed("uuid", "idp_uuid")
    return skew_join(matches, idp_videos(video_analysis), ["idp_uuid"])


def match_pairs(matched: DataFrame, last_sync: Mark) -> DataFrame:
    """One row per (uuid, offer): what came after the mark, and how much before.

    One aggregate over the log serves the new pairs and the totals. It is reduced
    before the shuffle, so a pair or product with many rows costs nothing extra.
    """
    mark = as_column(last_sync)
    late = F.col("timestamp") > mark
    return matched.groupBy(
        F.col("uuid").alias("idp_uuid"), F.col("matched_product_offer_id").alias("offer_id")
    ).agg(
        F.max(F.when(late, F.col("timestamp"))).alias("timestamp"),
        F.min(F.when(late, F.col("distance"))).alias("distance"),
        F.count_if(late).alias("rows_after"),
        F.count_if(F.col("timestamp") <= mark).alias("rows_before"),
    )


def first_seen_since(matched: DataFrame, last_sync: Mark) -> DataFrame:
    """Pairs whose first row is after the mark.

    A pair without an offer equals no earlier row, so it is new every time.
    """
    unseen = (F.col("rows_before") == 0) | F.col("offer_id").isNull()
    return (
        match_pairs(matched, last_sync)
        .where((F.col("rows_after") > 0) & unseen)
        .select("timestamp", "idp_uuid", "offer_id", "distance")
    )


def match_delta(matched: DataFrame, video_analysis: DataFrame, last_sync: Mark) -> DataFrame:
    """New pairs with their video: newest timestamp and least distance."""
    return first_seen_since(matched, last_sync).join(idp_videos(video_analysis), "idp_uuid")


def match_totals(matched: DataFrame, video_analysis: DataFrame) -> DataFrame:
    """Distinct (uuid, offer) pairs per video, over all history.

    Counted per identified product first: a pair belongs to one product, so the
    video total is a sum.
    """
    per_product = (
        matched.select(F.col("uuid").alias("idp_uuid"), "matched_product_offer_id")
        .distinct()
        .groupBy("idp_uuid")
        # Pairs without an offer do not count, but their video appears, with 0.
        .agg(F.count("matched_product_offer_id").alias("pairs"))
    )
    return (
        per_product.join(idp_videos(video_analysis), "idp_uuid")
        .groupBy("video_uuid")
        .agg(F.sum("pairs").alias("total_count"))
    )


def touched(df: DataFrame, delta: DataFrame) -> DataFrame:
    """Only the videos that occur in the delta."""
    return df.join(delta.select("video_uuid").distinct(), "video_uuid", "left_semi")


def delta_with_totals(delta: DataFrame, totals: DataFrame) -> DataFrame:
    """Delta rows with the total of their video; other videos drop out."""
    return spread_join(delta, totals, ["video_uuid"], spread=["idp_uuid", "offer_id"])


def new_matches(matched: DataFrame, video_analysis: DataFrame, last_sync: Mark) -> DataFrame:
    """The delta with the totals of the videos it touches."""
    delta = match_delta(matched, video_analysis, last_sync)
    return delta_with_totals(delta, match_totals(matched, video_analysis))


def matched_offers(matched: DataFrame) -> DataFrame:
    return (
        matched.select(F.col("matched_product_offer_id").alias("offer_id"))
        .where(F.col("offer_id").isNotNull())
        .distinct()
    )


def active_offers(matched: DataFrame, inventory: DataFrame) -> DataFrame:
    """Offers ever matched, and offers stored already (document key ``prod_<id>``)."""
    stored = inventory.where(F.startswith("doc_id", F.lit("prod_"))).select(
        strip_key("prod_", F.col("doc_id")).alias("offer_id")
    )
    return matched_offers(matched).unionByName(stored).distinct()


def restrict_offers(catalog: DataFrame, active: DataFrame) -> DataFrame:
    return catalog.join(active.select("offer_id").distinct(), "offer_id", "left_semi")


def inventory_rows(catalog: DataFrame, active: DataFrame, ties=None) -> DataFrame:
    """Current catalog data of the active offers, one listing per offer."""
    listing = pick_listing(catalog, ("channel",), ties).withColumn(
        "price", price_double(F.col("price"))
    )
    return restrict_offers(listing, active).select("offer_id", *INVENTORY_COLUMNS)
