"""Catalog refresh and vectors for new offers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidmatch.functions.numbers import now_seconds
from vidmatch.functions.text import product_text
from vidmatch.operators.catalog import latest_snapshot, new_products, snapshot_is_stale
from vidmatch.operators.encode import Encoder, encode_distinct
from vidmatch.schemas import PRODUCT_FEED
from vidmatch.sources.tables import read_feed, table_exists


def refresh_latest(spark: SparkSession, feed_path: str, latest_path: str) -> bool:
    """Rewrite the table of the newest snapshot if it is stale; tells whether it was."""
    feed = read_feed(spark, feed_path, PRODUCT_FEED)
    latest = spark.read.parquet(latest_path) if table_exists(spark, latest_path) else None
    if not snapshot_is_stale(latest, feed).first()["stale"]:
        return False
    latest_snapshot(feed).write.mode("overwrite").parquet(latest_path)
    return True


def text_of_products(products: DataFrame) -> DataFrame:
    """Offer id and the text to encode."""
    text = product_text(
        *[
            F.col(c)
            for c in (
                "title",
                "brand",
                "google_product_category",
                "product_type",
                "age_group",
                "color",
                "gender",
                "material",
                "pattern",
                "description",
            )
        ]
    )
    return products.select("offer_id", text.alias("text"))


def embed_new_products(
    feed: DataFrame,
    embeddings: DataFrame,
    model_id: str,
    encoder: Encoder | None = None,
    dim: int = 256,
    limit: int | None = None,
    ties=None,
) -> DataFrame:
    """Rows for ``append_embeddings``: vectors of the offers that have none.

    Without the offers whose text the model refused; see ``embed_or_reject``.
    """
    return embed_or_reject(feed, embeddings, model_id, encoder, dim, limit, ties)[0]


def embed_or_reject(
    feed: DataFrame,
    embeddings: DataFrame,
    model_id: str,
    encoder: Encoder | None = None,
    dim: int = 256,
    limit: int | None = None,
    ties=None,
) -> tuple[DataFrame, DataFrame]:
    """Rows for ``append_embeddings``, and offer_id, text, error of the offers that failed alone."""
    fresh = text_of_products(new_products(feed, embeddings, limit, ties))
    good, rejected = encode_distinct(fresh, "text", encoder, dim)
    rows = good.select(
        F.col("offer_id").alias("id"),
        now_seconds().alias("insertion_timestamp"),
        "embedding",
        F.lit(model_id).alias("embedding_model_id"),
    )
    return rows, rejected
