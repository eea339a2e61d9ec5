"""Product feed: newest snapshot, one listing per offer, offers without a vector."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidmatch.operators.ranking import first_per_key, take

# The preferred listing and the default number of products per run.
PREFERRED_CHANNEL = "ONLINE"
PREFERRED_LANGUAGE = "en"
PRODUCT_LIMIT = 1000

EMBED_COLUMNS = [
    "offer_id",
    "title",
    "brand",
    "description",
    "product_type",
    "google_product_category",
    "age_group",
    "color",
    "gender",
    "material",
    "pattern",
    "image_link",
    "additional_image_links",
]


def latest_partition(feed: DataFrame) -> DataFrame:
    return feed.agg(F.max("data_date").alias("data_date"))


def latest_snapshot(feed: DataFrame) -> DataFrame:
    """Rows of the newest date; a scalar subquery, so date partitions are pruned."""
    return feed.where(F.col("data_date") == latest_partition(feed).scalar())


def snapshot_is_stale(latest: DataFrame | None, feed: DataFrame) -> DataFrame:
    """One row ``stale``: no latest table, an empty one, or one of an older date."""
    newest = latest_partition(feed)
    if latest is None:
        return newest.select(F.lit(True).alias("stale"))
    held = latest.agg(F.any_value("data_date", True).alias("held"))
    return newest.select((~F.col("data_date").eqNullSafe(held.scalar())).alias("stale"))


def pick_listing(
    feed: DataFrame,
    prefer: Sequence[str] = ("channel",),
    ties: Sequence[str | Column] | None = None,
) -> DataFrame:
    """One row per offer: online first, then (``"language"``) the preferred language.

    ``ties`` orders what is left; all comparable columns by default.
    """
    rules = {
        "channel": F.upper("channel") == PREFERRED_CHANNEL,
        "language": F.col("content_language") == PREFERRED_LANGUAGE,
    }
    order = [F.coalesce(rules[name], F.lit(False)).desc() for name in prefer]
    if ties is None:
        ties = sorted(
            f.name
            for f in feed.schema.fields
            if f.name != "offer_id" and "map<" not in f.dataType.simpleString()
        )
    return first_per_key(feed, ["offer_id"], [*order, *ties])


def rename_category(feed: DataFrame) -> DataFrame:
    return feed.withColumnRenamed(
        "google_product_category_path", "google_product_category"
    )


def new_products(
    feed: DataFrame,
    embeddings: DataFrame,
    limit: int | None = PRODUCT_LIMIT,
    ties: Sequence[str | Column] | None = None,
) -> DataFrame:
    """Offers of the newest snapshot that have no vector yet, one listing each.

    Listings are reduced to one per offer before the anti join: both work on the
    offer id, so the join reuses that partitioning and never sees a hot offer.
    """
    listings = pick_listing(latest_snapshot(feed), ("channel", "language"), ties)
    known = embeddings.select(F.col("id").alias("offer_id")).distinct()
    fresh = rename_category(listings.join(known, "offer_id", "left_anti")).select(
        *EMBED_COLUMNS
    )
    return fresh if limit is None else take(fresh, ["offer_id"], limit)
