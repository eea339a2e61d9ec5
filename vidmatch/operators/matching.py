"""Identified products that need a match, and what happens to the search hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidmatch.operators.catalog import pick_listing
from vidmatch.operators.ranking import first_per_key


def successful(video_analysis: DataFrame) -> DataFrame:
    return video_analysis.where(F.col("status") == "SUCCESS")


def explode_identified(video_analysis: DataFrame) -> DataFrame:
    """One row per identified product beside its video; empty arrays vanish."""
    return video_analysis.select(
        F.col("uuid").alias("video_uuid"),
        F.col("embedding_model_id"),
        F.explode("identified_products").alias("product"),
    ).select("video_uuid", "embedding_model_id", "product.*")


def unmatched(
    video_analysis: DataFrame, matched: DataFrame, strict_null: bool = False
) -> DataFrame:
    """Identified products of successful analyses whose uuid has no match at all.

    SQL ``NOT IN``: a product without uuid is only kept while no match exists.
    With ``strict_null`` one match without uuid empties the result, as plain
    ``NOT IN`` does; by default such matches are ignored. Written as an anti join
    plus scalar tests, because a null-aware anti join would broadcast the matches.
    """
    products = explode_identified(successful(video_analysis))
    known = matched.select("uuid").where(F.col("uuid").isNotNull()).distinct()
    seen = matched if strict_null else matched.where(F.col("uuid").isNotNull())
    # Decided on the uuids alone: the vectors of all history are not shuffled, only
    # filtered by what is left (a broadcast, as long as that is small).
    left = (
        products.select("uuid")
        .join(known, "uuid", "left_anti")
        .where(F.col("uuid").isNotNull() | ~seen.select("uuid").exists())
    )
    if strict_null:
        left = left.where(~matched.where(F.col("uuid").isNull()).select("uuid").exists())
    keep = left.distinct().withColumnRenamed("uuid", "_open")
    return products.join(keep, F.col("uuid").eqNullSafe(F.col("_open")), "left_semi")


def newest_embeddings(embeddings: DataFrame) -> DataFrame:
    """Newest vector per id, so that a repeated append does not use up result slots.

    Only ids that occur more than once are sorted out; they are found by counting
    ids, and the vectors of all others stay where they are.
    """
    repeated = (
        embeddings.groupBy("id")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > 1)
        .select("id")
    )
    newest = first_per_key(
        embeddings.join(repeated, "id", "left_semi"),
        ["id"],
        [F.col("insertion_timestamp").desc_nulls_last(), "embedding"],
    )
    return embeddings.join(repeated, "id", "left_anti").unionByName(newest)


def attach_catalog(hits: DataFrame, catalog: DataFrame, ties=None) -> DataFrame:
    """Title and brand of each hit; hits without a listing are dropped.

    Runs after the top-k, so fewer than k rows may be left. A query has an offer at
    most once, which bounds the rows of one offer by the number of queries.
    """
    listing = pick_listing(catalog, ("channel",), ties).select(
        F.col("offer_id").alias("matched_product_offer_id"),
        F.col("title").alias("matched_product_title"),
        F.col("brand").alias("matched_product_brand"),
    )
    return hits.withColumnRenamed("id", "matched_product_offer_id").join(
        listing, "matched_product_offer_id"
    )


def drop_existing(hits: DataFrame, matched: DataFrame) -> DataFrame:
    """Remove (uuid, offer) pairs that are already stored."""
    stored = matched.select("uuid", "matched_product_offer_id").distinct()
    return hits.join(stored, ["uuid", "matched_product_offer_id"], "left_anti")
