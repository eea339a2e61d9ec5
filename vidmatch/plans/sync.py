"""Incremental sync of analyses, matches and inventory into change logs.

The batch form reads the rows after the stored mark; the streaming form (package
``streaming``) hands over new rows batch by batch. Both write through the same two
functions, so they end in the same tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidmatch.functions.numbers import as_column, init_counter
from vidmatch.operators.analysis import identified_rows, video_rows
from vidmatch.operators.ranking import first_per_key
from vidmatch.operators.sync import (
    INVENTORY_COLUMNS,
    active_offers,
    idp_videos,
    inventory_rows,
    new_matches,
)
from vidmatch.plans.totals import MatchCounts
from vidmatch.schemas import CANDIDATES, IDENTIFIED_PRODUCTS, INVENTORY, VIDEOS
from vidmatch.session import cut_lineage
from vidmatch.sources.tables import get_mark, read_current, set_mark, table_exists, write_changes

VIDEO_KEY = ["video_uuid"]
PRODUCT_KEY = ["video_uuid", "idp_uuid"]
CANDIDATE_KEY = ["video_uuid", "identified_product_uuid", "offer_id"]
VIDEO_COLUMNS = [
    "video_id",
    "source",
    "gcs_uri",
    "md5_hash",
    "timestamp",
    "title",
    "description",
    "search_keywords",
    "stats_identified_count",
]
PRODUCT_COLUMNS = ["title", "description", "relevance_reasoning", "video_timestamp"]


@dataclass(frozen=True)
class Targets:
    """Folder of the serving tables."""

    root: str

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    @property
    def state(self) -> str:
        return self.path("sync_state")

    def videos(self, spark: SparkSession, before: tuple[str, int] | None = None) -> DataFrame:
        """Current videos; counters that nobody set yet are 0."""
        rows = read_current(spark, self.path("videos"), VIDEO_KEY, VIDEOS, before)
        for name in ("stats_matched_count", "stats_approved_count"):
            rows = rows.withColumn(name, init_counter(F.col(name)))
        return rows

    def identified(self, spark: SparkSession) -> DataFrame:
        return read_current(
            spark, self.path("identified_products"), PRODUCT_KEY, IDENTIFIED_PRODUCTS
        )

    def candidates(
        self, spark: SparkSession, before: tuple[str, int] | None = None
    ) -> DataFrame:
        return read_current(spark, self.path("candidates"), CANDIDATE_KEY, CANDIDATES, before)

    def inventory(self, spark: SparkSession) -> DataFrame:
        return read_current(spark, self.path("inventory"), ["offer_id"], INVENTORY)


def _latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return first_per_key(rows, keys, [F.col(c).desc_nulls_last() for c in order])


def write_videos(analyses: DataFrame, targets: Targets, batch_id: int) -> None:
    """Patch videos and identified products with a batch of analysis rows."""
    videos = _latest(video_rows(analyses), VIDEO_KEY, ["timestamp", "stats_identified_count", "title"])
    write_changes(videos, targets.path("videos"), "videos", batch_id, VIDEO_KEY, VIDEO_COLUMNS)
    products = _latest(identified_rows(analyses), PRODUCT_KEY, ["timestamp", "pos", "title"])
    write_changes(
        products,
        targets.path("identified_products"),
        "videos",
        batch_id,
        PRODUCT_KEY,
        PRODUCT_COLUMNS,
    )


def write_candidates(new: DataFrame, targets: Targets, batch_id: int) -> None:
    """Patch candidates with new pairs of videos."""
    rows = new.select(
        "video_uuid",
        F.col("idp_uuid").alias("identified_product_uuid"),
        "offer_id",
        "distance",
    )
    write_changes(
        rows, targets.path("candidates"), "matches", batch_id, CANDIDATE_KEY, ["distance"]
    )


def write_matches(new: DataFrame, totals: DataFrame, targets: Targets, batch_id: int) -> None:
    """Patch candidates and the match totals of their videos."""
    write_candidates(new, targets, batch_id)
    counts = totals.select("video_uuid", F.col("total_count").alias("stats_matched_count"))
    write_changes(
        counts, targets.path("videos"), "matches", batch_id, VIDEO_KEY, ["stats_matched_count"]
    )


def _newest(df: DataFrame) -> str | None:
    return df.agg(F.date_format(F.max("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS")).first()[0]


def sync_videos(video_analysis: DataFrame, targets: Targets) -> None:
    """Analyses after the stored mark; then the mark moves to the newest of them."""
    spark = video_analysis.sparkSession
    mark, last = get_mark(spark, targets.state, "videos")
    fresh = video_analysis.where(F.col("timestamp") > as_column(mark))
    newest = _newest(fresh)
    if newest is None:
        return
    # Bounded above, so that rows which arrive meanwhile wait for the next run.
    fresh = fresh.where(F.col("timestamp") <= as_column(newest))
    write_videos(fresh, targets, last + 1)
    set_mark(spark, targets.state, "videos", newest, last + 1)


def sync_matches(matched: DataFrame, video_analysis: DataFrame, targets: Targets) -> None:
    """Pairs first seen after the mark, and the totals of the videos they touch."""
    spark = matched.sparkSession
    mark, last = get_mark(spark, targets.state, "matches")
    newest = _newest(matched.where(F.col("timestamp") > as_column(mark)))
    if newest is None:
        return
    log = matched.where(F.col("timestamp") <= as_column(newest))
    new = new_matches(log, video_analysis, mark)
    totals = new.select("video_uuid", "total_count").distinct()
    write_matches(new, totals, targets, last + 1)
    set_mark(spark, targets.state, "matches", newest, last + 1)


def sync_matches_by_delta(
    matched: DataFrame, video_analysis: DataFrame, targets: Targets, counts: MatchCounts
) -> None:
    """``sync_matches`` that reads no match row twice: the rows after the mark meet ``counts``.

    Keep one set of targets with one of the two, from its first run on. A run that failed
    is repeated with the rows it had, whatever has arrived since.
    """
    spark = matched.sparkSession
    mark, last = get_mark(spark, targets.state, "matches")
    batch = last + 1
    bound = f"{counts.root}/bounds/batch={batch}"
    if not table_exists(spark, bound):
        newest = _newest(matched.where(F.col("timestamp") > as_column(mark)))
        if newest is None:
            return
        spark.range(1).select(F.lit(newest).alias("newest")).write.mode("overwrite").parquet(bound)
    newest = spark.read.parquet(bound).first()["newest"]
    window = (F.col("timestamp") > as_column(mark)) & (F.col("timestamp") <= as_column(newest))
    new = cut_lineage(counts.take(matched.where(window), batch).join(idp_videos(video_analysis), "idp_uuid"))
    write_matches(new, counts.totals(video_analysis, new), targets, batch)
    set_mark(spark, targets.state, "matches", newest, batch)


def sync_inventory(catalog: DataFrame, matched: DataFrame, targets: Targets, ties=None) -> DataFrame:
    """Refresh the inventory of active offers from the newest catalog."""
    spark = catalog.sparkSession
    stored = targets.inventory(spark).select(F.concat(F.lit("prod_"), "offer_id").alias("doc_id"))
    rows = inventory_rows(catalog, active_offers(matched, stored), ties)
    _, last = get_mark(spark, targets.state, "inventory")
    write_changes(
        rows, targets.path("inventory"), "inventory", last + 1, ["offer_id"], INVENTORY_COLUMNS
    )
    set_mark(spark, targets.state, "inventory", "2000-01-01 00:00:00", last + 1)
    return targets.inventory(spark)

