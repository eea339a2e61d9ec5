"""Matches as a stream with keyed state: what a batch costs does not depend on the history.

The state of an identified product holds its videos and the offers seen so far. New rows
are looked up there, and what they add (a pair that is new to a video) leaves the
operator once; totals of videos grow by what left it. Neither the match log nor the
analyses are read again. A product's offers are dealt over ``salts`` states, so that
a product with a large share of the rows is not one task's; its videos go to all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from vidmatch.plans.sync import VIDEO_KEY, Targets, write_candidates
from vidmatch.session import cut_lineage
from vidmatch.sources.keyed import KeyedTable
from vidmatch.sources.tables import write_changes

SALTS = 16
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PAIRS = "video_uuid string, idp_uuid string, offer_id string, distance double"
#: Offers and videos of a product that are kept in one value; more are entries of maps.
INLINE = 256
FEW = "offers array<string>, distances array<double>, videos array<string>, more_offers boolean, more_videos boolean"
TOTALS = T.StructType(
    [
        T.StructField("video_uuid", T.StringType()),
        T.StructField("total_count", T.LongType()),
        # The total before the batch that changed it last: a repeated batch starts there.
        T.StructField("batch", T.LongType()),
        T.StructField("before", T.LongType()),
    ]
)


class FirstSeen(StatefulProcessor):
    """Gives out (video, product, offer, least distance in the batch) when it is first complete.

    Every access to state is a call to the JVM. A product's first ``INLINE`` offers and
    videos are one value, read and written in one call each; those beyond lie in maps and
    are looked up one by one, so that a batch does not read a long history.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.few = handle.getValueState("few", FEW)
        self.offers = handle.getMapState("offers", "offer string", "distance double")
        self.videos = handle.getMapState("videos", "video string", "known boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        idp = key[0]
        videos: dict[str, bool] = {}
        offers: dict[str | None, float] = {}  # under None the rows without an offer
        for part in rows:
            given = part["video_uuid"].notna()
            videos.update(dict.fromkeys(part["video_uuid"][given].tolist(), True))
            matches = part[~given] if given.any() else part
            for offer, distance, bare in zip(
                matches["offer_id"].tolist(), matches["distance"].tolist(), matches["offer_id"].isna().tolist(), strict=True
            ):
                offer = None if bare else offer
                least = offers.get(offer, math.nan)
                # A distance that is missing counts only if all are.
                if offer not in offers or distance < least or least != least:
                    offers[offer] = distance
        bare = None in offers
        bare_least = offers.pop(None, None)
        few = self.few.get()
        # State of a stream that was started before there was ``few`` is in the maps alone.
        names, dists, known, more_offers, more_videos = few or ([], [], [], self.offers.exists(), self.videos.exists())
        inline, known = dict(zip(names, dists, strict=True)), list(known)
        seen = set(known)
        videos = [v for v in videos if v not in seen and not (more_videos and self.videos.containsKey((v,)))]
        fresh = {o: d for o, d in offers.items() if o not in inline and not (more_offers and self.offers.containsKey((o,)))}
        everywhere = known + ([v[0] for v in self.videos.keys()] if more_videos and (fresh or bare) else [])
        out = [(v, idp, o, d) for v in everywhere for o, d in fresh.items()]
        if videos:
            # A video that comes after its product's matches gets all of them.
            stored = {k[0]: d[0] for k, d in self.offers.iterator()} if more_offers else {}
            everything = {**inline, **stored, **fresh}
            out += [(v, idp, o, d) for v in videos for o, d in everything.items()]
        if bare:
            out += [(v, idp, None, bare_least) for v in [*everywhere, *videos]]
        for v in videos:
            if len(known) < INLINE:
                known.append(v)
            else:
                self.videos.updateValue((v,), (True,))
                more_videos = True
        for o, d in fresh.items():
            d = float(d) if d == d else None
            if len(inline) < INLINE:
                inline[o] = d
            else:
                self.offers.updateValue((o,), (d,))
                more_offers = True
        if videos or fresh:
            self.few.update((list(inline), list(inline.values()), known, more_offers, more_videos))
        if out:
            yield pd.DataFrame(out, columns=["video_uuid", "idp_uuid", "offer_id", "distance"])

    def close(self) -> None:
        pass


def first_seen_stream(analyses: DataFrame, matches: DataFrame, salts: int = SALTS) -> DataFrame:
    """PAIRS as they are first seen, of the streams of analyses and of matches."""
    videos = analyses.select(
        F.explode("identified_products.uuid").alias("idp_uuid"),
        F.col("uuid").alias("video_uuid"),
    ).where("idp_uuid IS NOT NULL")
    videos = videos.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    nothing = {"offer_id": F.lit(None).cast("string"), "distance": F.lit(None).cast("double")}
    rows = matches.where("uuid IS NOT NULL").select(
        F.col("uuid").alias("idp_uuid"),
        # Rows without an offer go to one state, so that they are given out once.
        F.when(F.col("matched_product_offer_id").isNull(), F.lit(0))
        .otherwise(F.pmod(F.xxhash64("matched_product_offer_id"), F.lit(salts)))
        .cast("int")
        .alias("salt"),
        F.lit(None).cast("string").alias("video_uuid"),
        F.col("matched_product_offer_id").alias("offer_id"),
        "distance",
    )
    events = videos.withColumns(nothing).unionByName(rows)
    return events.groupBy("idp_uuid", "salt").transformWithStateInPandas(FirstSeen(), PAIRS, "append", "none")


def totals_table(targets: Targets, parts: int = 256) -> KeyedTable:
    return KeyedTable(targets.path("match_totals"), ["video_uuid"], TOTALS, parts)


def add_totals(table: KeyedTable, added: DataFrame, batch_id: int) -> DataFrame:
    """Raise totals by ``added`` (video_uuid, added); the new totals of these videos.

    A batch that is repeated starts from the totals before it.
    """

    def combine(old: DataFrame, given: DataFrame) -> DataFrame:
        joined = old.join(given, ["part", "video_uuid"], "full_outer")
        start = F.coalesce(F.when(F.col("batch") == batch_id, F.col("before")).otherwise(F.col("total_count")), F.lit(0))
        hit = F.col("added").isNotNull()
        return joined.select(
            "video_uuid",
            F.when(hit, start + F.col("added")).otherwise(F.col("total_count")).alias("total_count"),
            F.when(hit, F.lit(batch_id).cast("long")).otherwise(F.col("batch")).alias("batch"),
            F.when(hit, start).otherwise(F.col("before")).alias("before"),
            "part",
        )

    table.merge(added, combine)
    return table.matching(added.select("video_uuid")).join(added.select("video_uuid"), "video_uuid", "left_semi").select("video_uuid", "total_count")


def stream_match_state(
    analyses: DataFrame, matches: DataFrame, targets: Targets, checkpoint: str, salts: int = SALTS, parts: int = 256
) -> StreamingQuery:
    """Keep candidates and match totals up to date with new matches and analyses.

    A micro-batch is computed once and written; candidates, totals and the videos'
    counters come from what was written.
    """
    matches.sparkSession.conf.set(STATE_STORE, ROCKSDB)

    def apply(batch: DataFrame, batch_id: int) -> None:
        new = cut_lineage(batch)
        write_candidates(new, targets, batch_id)
        added = new.groupBy("video_uuid").agg(F.count("offer_id").alias("added"))
        totals = add_totals(totals_table(targets, parts), cut_lineage(added), batch_id)
        counts = totals.select("video_uuid", F.col("total_count").alias("stats_matched_count"))
        write_changes(counts, targets.path("videos"), "matches", batch_id, VIDEO_KEY, ["stats_matched_count"])

    return (
        first_seen_stream(analyses, matches, salts)
        .writeStream.foreachBatch(apply)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def match_totals(spark: SparkSession, targets: Targets, parts: int = 256) -> DataFrame:
    return totals_table(targets, parts).read(spark).select("video_uuid", "total_count")
