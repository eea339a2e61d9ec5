"""Model answers to analysis rows, and analysis rows to serving rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidmatch.functions.ids import idp_uuid, video_uuid
from vidmatch.functions.nested import identified_count
from vidmatch.functions.numbers import duration_ms, now_seconds
from vidmatch.functions.text import identified_text, search_keywords
from vidmatch.operators.encode import Encoder, encode_arrays
from vidmatch.schemas import MODEL_ANSWER


def _answers(raw: Column) -> Column:
    """Typed array of a model answer; NULL, 'null' and no array give an empty one."""
    return F.coalesce(F.from_json(raw, MODEL_ANSWER), F.array().cast(MODEL_ANSWER))


def parse_identified(
    raw: DataFrame, uuid: str = "uuid", answer: str = "answer"
) -> DataFrame:
    """One row per identified product of a JSON answer, with a stable key."""
    # Outer, with the test behind it: a plain explode would parse every answer twice,
    # once more in a filter that the optimizer puts before it.
    return (
        raw.select(
            F.col(uuid).alias("video_uuid"),
            F.posexplode_outer(_answers(F.col(answer))).alias("pos", "p"),
        )
        .where(F.col("pos").isNotNull())
        .select("video_uuid", "pos", "p.*")
        .withColumn("video_timestamp", duration_ms(F.col("video_timestamp")))
        .withColumn("uuid", idp_uuid(F.col("video_uuid"), F.col("pos")))
    )


def build_video_analysis(
    videos: DataFrame,
    embedding_model_id: str,
    generative_model_id: str,
    encoder: Encoder | None = None,
    dim: int = 256,
    timestamp: Column | None = None,
) -> DataFrame:
    """One nested ``video_analysis`` row per video with its model ``answer``.

    The products stay inside their row from the JSON text to the result; nothing
    is exploded and collected again, so there is no shuffle.
    """
    answers = videos.withColumn("_answers", _answers(F.col("answer"))).withColumn(
        "_uuid", video_uuid(F.col("video_id"), F.col("gcs_uri"), F.col("md5_hash"))
    )
    texts = F.transform(
        "_answers",
        lambda p: identified_text(
            p.title, p.description, p.color_pattern_style_usage, p.category, p.subcategory
        ),
    )
    encoded = encode_arrays(answers.withColumn("_texts", texts), "_texts", encoder, dim, "_vectors")
    products = F.transform(
        F.arrays_zip("_answers", "_vectors", F.sequence(F.lit(0), F.size("_answers")).alias("_pos")),
        lambda z: F.struct(
            z["_answers"].title.alias("title"),
            z["_answers"].description.alias("description"),
            z["_answers"].color_pattern_style_usage.alias("color_pattern_style_usage"),
            z["_answers"].category.alias("category"),
            z["_answers"].subcategory.alias("subcategory"),
            duration_ms(z["_answers"].video_timestamp).alias("video_timestamp"),
            z["_answers"].relevance_reasoning.alias("relevance_reasoning"),
            z["_vectors"].alias("embedding"),
            idp_uuid(F.col("_uuid"), z["_pos"]).alias("uuid"),
        ),
    )
    none = F.lit(None).cast("string")
    return encoded.select(
        F.col("_uuid").alias("uuid"),
        (now_seconds() if timestamp is None else timestamp).alias("timestamp"),
        "source",
        "video_id",
        F.when(
            F.col("title").isNotNull() | F.col("description").isNotNull(),
            F.struct("title", "description"),
        ).alias("metadata"),
        "gcs_uri",
        "md5_hash",
        F.lit("SUCCESS").alias("status"),
        none.alias("error_message"),
        F.lit(embedding_model_id).alias("embedding_model_id"),
        F.lit(generative_model_id).alias("generative_model_id"),
        F.slice(products, F.lit(1), F.size("_answers")).alias("identified_products"),
    )


def flatten_metadata(video_analysis: DataFrame) -> DataFrame:
    return video_analysis.select(
        *[c for c in video_analysis.columns if c != "metadata"],
        F.col("metadata.title").alias("title"),
        F.col("metadata.description").alias("description"),
    )


def identified_rows(video_analysis: DataFrame) -> DataFrame:
    """Identified products as rows; a missing text becomes '', a blank uuid no row."""
    def text(name: str) -> Column:
        return F.coalesce(F.col(f"p.{name}"), F.lit("")).alias(name)

    return (
        video_analysis.select(
            F.col("uuid").alias("video_uuid"),
            "timestamp",
            F.posexplode("identified_products").alias("pos", "p"),
        )
        .where(F.col("p.uuid") != "")
        .select(
            "video_uuid",
            F.col("p.uuid").alias("idp_uuid"),
            text("title"),
            text("description"),
            text("relevance_reasoning"),
            F.col("p.video_timestamp").alias("video_timestamp"),
            "timestamp",
            "pos",
        )
    )


def video_rows(video_analysis: DataFrame) -> DataFrame:
    """Analysis rows as serving rows; all rows count, whatever their status."""
    flat = flatten_metadata(video_analysis)
    title, text = F.col("title"), F.coalesce("title", F.lit(""))
    return flat.select(
        F.col("uuid").alias("video_uuid"),
        "video_id",
        "source",
        "gcs_uri",
        "md5_hash",
        "timestamp",
        text.alias("title"),
        F.coalesce("description", F.lit("")).alias("description"),
        search_keywords(title, F.col("video_id")).alias("search_keywords"),
        identified_count(F.col("identified_products")).alias("stats_identified_count"),
    )
