"""Id lists and folders of video files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidmatch.functions.ids import md5_hex
from vidmatch.schemas import VIDEO_EXTENSIONS


def read_id_list(spark: SparkSession, path: str, name: str = "video_id") -> DataFrame:
    """First column of a CSV export below its header; empty cells are skipped."""
    return (
        spark.read.schema(f"{name} string")
        .option("header", True)
        .option("enforceSchema", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
        .where(F.length(name) > 0)
    )


def keep_videos(files: DataFrame, path: str = "path") -> DataFrame:
    """Files with a video ending, in any case."""
    ends = [F.endswith(F.lower(path), F.lit(e)) for e in VIDEO_EXTENSIONS]
    condition = ends[0]
    for end in ends[1:]:
        condition = condition | end
    return files.where(condition)


def _as_candidates(files: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return files.select(
        F.lit("manual_entry").alias("source"),
        none.alias("video_id"),
        F.col("path").alias("gcs_uri"),
        "md5_hash",
        F.element_at(F.split("path", "/"), -1).alias("title"),
        none.alias("description"),
    )


def scan_video_files(
    spark: SparkSession, path: str, manifest: DataFrame | None = None
) -> DataFrame:
    """Video files below ``path`` as intake candidates.

    With a ``manifest`` (path, md5_base64), as object stores keep one, only names
    are listed and no content is read; a file it does not name has no checksum, and
    the rules for videos reject it with a reason. Without it the checksum is taken from the
    content, one file per row; that is meant for files that fit a task.
    """
    files = keep_videos(
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    )
    if manifest is None:
        return _as_candidates(files.select("path", F.md5("content").alias("md5_hash")))
    sums = manifest.select("path", md5_hex(F.col("md5_base64")).alias("md5_hash"))
    return _as_candidates(files.select("path").join(sums, "path", "left"))


def videos_of_manifest(manifest: DataFrame) -> DataFrame:
    """The same from a listing table alone: (path, md5_base64)."""
    return _as_candidates(
        keep_videos(manifest).select("path", md5_hex(F.col("md5_base64")).alias("md5_hash"))
    )
