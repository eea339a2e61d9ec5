"""Distinct pairs per product, kept as bitmaps and merged with what is new.

Every offer gets a number; the offers of an identified product are bits. New rows are
looked up in the bitmaps of their products alone, and counts of products add up to
totals of videos: the match log is read once, as it grows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vidmatch.operators.joins import skew_join
from vidmatch.operators.sync import idp_videos
from vidmatch.session import cut_lineage
from vidmatch.sources.keyed import PART, KeyedTable
from vidmatch.sources.tables import table_exists

NUMBERS = T.StructType([T.StructField("offer_id", T.StringType()), T.StructField("number", T.LongType())])
BITMAPS = T.StructType(
    [
        T.StructField("idp_uuid", T.StringType()),
        T.StructField("bucket", T.LongType()),
        T.StructField("bits", T.BinaryType()),
        T.StructField("pairs", T.LongType()),
    ]
)


def bit_is_set(bits: Column, position: Column) -> Column:
    """Whether a bitmap of ``bitmap_construct_agg`` holds a position."""
    byte = F.conv(F.hex(F.substring(bits, (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (position % 8).cast("int"))) != 0, F.lit(False))


@dataclass(frozen=True)
class MatchCounts:
    """State of all matches taken in so far, in the folder ``root``."""

    root: str
    parts: int = 256

    @property
    def numbers(self) -> KeyedTable:
        return KeyedTable(f"{self.root}/offers", ["offer_id"], NUMBERS, self.parts)

    @property
    def bitmaps(self) -> KeyedTable:
        return KeyedTable(f"{self.root}/bitmaps", ["idp_uuid", "bucket"], BITMAPS, self.parts, spread=1)

    def take(self, rows: DataFrame, batch: int) -> DataFrame:
        """Add match rows; returns the pairs first seen in them: timestamp, idp_uuid, offer_id, distance.

        The newest timestamp and the least distance of the rows of a pair. A pair without
        an offer is no pair that was seen before, so it is new every time, and counts in no
        total; its product is kept with 0 pairs. What a batch found is written down before
        the bitmaps change: the same batch again finds the same.
        """
        spark = rows.sparkSession
        found = f"{self.root}/found/batch={batch}"
        if not table_exists(spark, found):
            pairs = rows.groupBy(F.col("uuid").alias("idp_uuid"), F.col("matched_product_offer_id").alias("offer_id")).agg(
                F.max("timestamp").alias("timestamp"), F.min("distance").alias("distance")
            )
            pairs = cut_lineage(pairs)
            self._number(pairs.select("offer_id").where("offer_id IS NOT NULL").distinct())
            numbered = self._placed(pairs)
            stored = self.bitmaps.matching(numbered).select("idp_uuid", "bucket", "bits")
            seen = numbered.join(stored, ["idp_uuid", "bucket"], "left")
            new = seen.where(~bit_is_set(F.col("bits"), F.col("position")))
            without = pairs.where("offer_id IS NULL")
            columns = ["timestamp", "idp_uuid", "offer_id", "distance"]
            new.select(*columns).unionByName(without.select(*columns)).write.mode("overwrite").parquet(found)
        new = spark.read.parquet(found)
        self._set(new)
        return new

    def totals(self, video_analysis: DataFrame, touched: DataFrame | None = None) -> DataFrame:
        """video_uuid and total_count of all videos with matches, or of the ``touched`` ones.

        Only the counts of the bitmaps are read.
        """
        videos = idp_videos(video_analysis)
        if touched is not None:
            videos = videos.join(touched.select("video_uuid").distinct(), "video_uuid", "left_semi")
        counts = self.bitmaps.read(videos.sparkSession).groupBy("idp_uuid").agg(F.sum("pairs").alias("pairs"))
        return counts.join(videos, "idp_uuid").groupBy("video_uuid").agg(F.sum("pairs").alias("total_count"))

    def _number(self, offers: DataFrame) -> None:
        """Numbers for the new offers: part + 1 + parts * place in the part, so they stay dense."""

        def combine(old: DataFrame, given: DataFrame) -> DataFrame:
            new = given.join(old.select(PART, "offer_id"), [PART, "offer_id"], "left_anti")
            had = old.groupBy(PART).agg(F.count(F.lit(1)).alias("had"))
            place = F.row_number().over(Window.partitionBy(PART).orderBy("offer_id")) - 1 + F.coalesce("had", F.lit(0))
            made = new.join(had, PART, "left").select(
                "offer_id", (place * self.parts + F.col(PART) + 1).cast("long").alias("number"), PART
            )
            return old.select("offer_id", "number", PART).unionByName(made)

        self.numbers.merge(offers, combine)

    def _placed(self, pairs: DataFrame) -> DataFrame:
        """Pairs with an offer, its bucket and position."""
        known = self.numbers.matching(pairs.where("offer_id IS NOT NULL").select("offer_id")).select("offer_id", "number")
        numbered = skew_join(pairs.where("offer_id IS NOT NULL"), known, ["offer_id"], spread=["idp_uuid"])
        return numbered.withColumns(
            {"bucket": F.bitmap_bucket_number("number"), "position": F.bitmap_bit_position("number")}
        )

    def _set(self, new: DataFrame) -> None:
        bits = self._placed(new).groupBy("idp_uuid", "bucket").agg(F.bitmap_construct_agg("position").alias("bits"))
        # Products whose rows have no offer: bucket 0 stays empty.
        empty = new.where("offer_id IS NULL").select("idp_uuid", F.lit(0).cast("long").alias("bucket")).distinct()
        given = bits.unionByName(empty.withColumn("bits", F.lit(None).cast("binary")))

        def combine(old: DataFrame, given: DataFrame) -> DataFrame:
            both = old.select("idp_uuid", "bucket", "bits", PART).unionByName(given.select("idp_uuid", "bucket", "bits", PART))
            merged = both.groupBy(PART, "idp_uuid", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
            return merged.withColumn("pairs", F.coalesce(F.bitmap_count("bits"), F.lit(0)).cast("long"))

        self.bitmaps.merge(given, combine)
