"""Matches of one identified product that show the same picture."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidmatch.operators.joins import skew_join
from vidmatch.operators.nesting import nest

GROUP = ["identified_product_uuid", "image_link"]


def heroes(candidates: DataFrame) -> DataFrame:
    """Nearest candidate per (identified product, picture) and the group size.

    Rows without a picture are no variants of each other and stay out. A plain
    aggregate: large groups are reduced before the shuffle.
    """
    nearest = F.min(F.struct(F.col("distance"), F.col("offer_id"), F.col("title"), F.col("brand")))
    return (
        candidates.where(F.col("image_link").isNotNull())
        .groupBy(*GROUP)
        .agg(nearest.alias("hero"), F.count(F.lit(1)).alias("variant_count"))
        .select(
            *GROUP,
            F.col("hero.offer_id").alias("hero_offer_id"),
            F.col("hero.title").alias("hero_title"),
            F.col("hero.brand").alias("hero_brand"),
            F.col("hero.distance").alias("hero_distance"),
            "variant_count",
        )
    )


def variant_rows(candidates: DataFrame) -> DataFrame:
    """Every candidate with the hero of its group; one without picture is its own."""
    grouped = skew_join(candidates, heroes(candidates), GROUP, "left", spread=["offer_id"])
    return grouped.select(
        *[F.col(c) for c in candidates.columns],
        F.coalesce("hero_offer_id", "offer_id").alias("hero_offer_id"),
        F.coalesce("hero_distance", "distance").alias("hero_distance"),
        F.coalesce("variant_count", F.lit(1)).cast("long").alias("variant_count"),
    )


def group_variants(candidates: DataFrame, chunk: int = 1000) -> DataFrame:
    """One row per hero with its variants (the hero among them), nearest first.

    A group of more than ``chunk`` variants continues in further rows that carry
    the same hero and the next ``chunk_no``.
    """
    rows = variant_rows(candidates)
    variant = F.struct(
        F.col("distance"),
        F.col("offer_id").alias("variant_offer_id"),
        F.col("title").alias("variant_title"),
        F.col("brand").alias("variant_brand"),
    )
    keys = ["identified_product_uuid", "image_link", "hero_offer_id", "hero_distance"]
    nested = nest(rows, keys, "offer_id", variant, "variants", chunk, size="variant_count")
    return nested.withColumn(
        "variants",
        F.transform(F.array_sort("variants"), lambda v: v.dropFields("distance")),
    )
