"""Streams over the append-only tables.

A stream tracks files, so rows that arrive late are taken as well; with
``strict_watermark`` rows not newer than everything before are left out, as the
batch form with its mark does. The batch id of the stream names the folders a batch
writes, so a batch that is repeated after a failure replaces itself. Keep one set of
targets up to date either with the streams or with the batch form: both number their
batches on their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vidmatch.functions.numbers import EPOCH, as_column
from vidmatch.operators.encode import Encoder, encode
from vidmatch.operators.sync import idp_videos, match_totals, touched
from vidmatch.plans.sync import CANDIDATE_KEY, Targets, write_matches, write_videos
from vidmatch.schemas import CANDIDATES, MATCHED_PRODUCTS, SYNC_STATE, VIDEO_ANALYSIS
from vidmatch.sources.tables import append_embeddings, read_table, set_mark, written_keys


def analysis_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(VIDEO_ANALYSIS)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def match_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return (
        spark.readStream.schema(MATCHED_PRODUCTS)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(path)
    )


def _mark_before(spark: SparkSession, targets: Targets, component: str, batch_id: int) -> str:
    """Newest timestamp of the batches before this one."""
    row = (
        read_table(spark, targets.state, SYNC_STATE)
        .where((F.col("component") == component) & (F.col("batch_id") < batch_id))
        .agg(F.date_format(F.max("last_sync_timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        .first()
    )
    return row[0] or EPOCH


def _finish(batch: DataFrame, targets: Targets, component: str, batch_id: int) -> None:
    newest = batch.agg(
        F.date_format(F.max("timestamp"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    ).first()[0]
    set_mark(batch.sparkSession, targets.state, component, newest or EPOCH, batch_id)


def stream_sync_videos(
    stream: DataFrame, targets: Targets, checkpoint: str, strict_watermark: bool = False
) -> StreamingQuery:
    """Keep videos and identified products up to date with new analyses."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if strict_watermark:
            mark = _mark_before(spark, targets, "videos", batch_id)
            rows = batch.where(F.col("timestamp") > as_column(mark))
        write_videos(rows, targets, batch_id)
        _finish(rows, targets, "videos", batch_id)

    return (
        stream.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_sync_matches(
    stream: DataFrame,
    matched_path: str,
    analysis_path: str,
    targets: Targets,
    checkpoint: str,
    strict_watermark: bool = False,
) -> StreamingQuery:
    """Keep candidates and match totals up to date with new matches.

    New are the pairs that no earlier batch has written. Totals are counted over the
    whole match log, for the touched videos.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if strict_watermark:
            mark = _mark_before(spark, targets, "matches", batch_id)
            rows = batch.where(F.col("timestamp") > as_column(mark))
        analyses = read_table(spark, analysis_path, VIDEO_ANALYSIS)
        pairs = rows.groupBy(
            F.col("uuid").alias("idp_uuid"), F.col("matched_product_offer_id").alias("offer_id")
        ).agg(F.min("distance").alias("distance"))
        stored = written_keys(
            spark, targets.path("candidates"), CANDIDATE_KEY, CANDIDATES, "matches", batch_id
        ).withColumnRenamed("identified_product_uuid", "idp_uuid")
        new = pairs.join(idp_videos(analyses), "idp_uuid").join(
            stored, ["video_uuid", "idp_uuid", "offer_id"], "left_anti"
        )
        log = read_table(spark, matched_path, MATCHED_PRODUCTS)
        totals = touched(match_totals(log, analyses), new)
        write_matches(new, totals, targets, batch_id)
        _finish(rows, targets, "matches", batch_id)

    return (
        stream.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_embed(
    stream: DataFrame,
    text_col: str,
    id_col: str,
    model_id: str,
    path: str,
    checkpoint: str,
    encoder: Encoder | None = None,
    dim: int = 256,
) -> StreamingQuery:
    """Encode texts as they arrive and append their vectors.

    A repeated batch appends its rows again; readers keep the newest per id.
    """

    def apply(batch: DataFrame, _: int) -> None:
        rows = encode(batch, text_col, encoder, dim).select(
            F.col(id_col).alias("id"),
            "embedding",
            F.lit(model_id).alias("embedding_model_id"),
        )
        append_embeddings(rows, path)

    return (
        stream.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
