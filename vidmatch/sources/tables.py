"""Parquet tables: appends, the dated feed, and change logs.

A change log holds patches instead of a table that is rewritten. Every batch of a
component (sync, review, ...) is one folder ``component=<name>/batch=<id>``, written
with overwrite, so that a repeated batch replaces itself. The current rows are a
fold over the log by the time of writing. ``compact`` starts a new, short log.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vidmatch.functions.numbers import EPOCH, now_seconds
from vidmatch.schemas import MATCHED_PRODUCTS, PRODUCT_EMBEDDINGS, SYNC_STATE


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table with declared columns; an absent one is empty."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error.getCondition()):
            return spark.createDataFrame([], schema)
        raise


def table_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
        return True
    except AnalysisException:
        return False


# --- feed ------------------------------------------------------------------------------


def write_feed(feed: DataFrame, path: str) -> None:
    """Add or replace the dates of ``feed``; other dates stay."""
    (
        feed.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("data_date")
        .parquet(path)
    )


def read_feed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


# --- appends -----------------------------------------------------------------------------


def append_embeddings(df: DataFrame, path: str) -> None:
    """Append (id, time, vector, model)."""
    stamped = df if "insertion_timestamp" in df.columns else df.withColumn(
        "insertion_timestamp", now_seconds()
    )
    stamped.select(*PRODUCT_EMBEDDINGS.names).write.mode("append").parquet(path)


def append_analysis(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def append_matches(df: DataFrame, path: str) -> None:
    df.select(*MATCHED_PRODUCTS.names).write.mode("append").parquet(path)


# --- change logs ---------------------------------------------------------------------------


def write_changes(
    df: DataFrame,
    path: str,
    component: str,
    batch_id: int,
    keys: Sequence[str],
    cols: Sequence[str],
) -> None:
    """Write one batch of patches; a key occurs at most once in it.

    ``given`` keeps the names of the columns a row sets, so that a given NULL
    overwrites and an absent column does not.
    """
    (
        df.select(
            *keys,
            *cols,
            F.array(*[F.lit(c) for c in cols]).alias("given"),
            F.current_timestamp().alias("stamp"),
        )
        .write.mode("overwrite")
        .parquet(f"{path}/component={component}/batch={batch_id}")
    )


def _read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    extra = [
        T.StructField("given", T.ArrayType(T.StringType())),
        T.StructField("stamp", T.TimestampType()),
        T.StructField("component", T.StringType()),
        T.StructField("batch", T.LongType()),
    ]
    return read_table(spark, path, T.StructType([*schema.fields, *extra]))


def read_current(
    spark: SparkSession,
    path: str,
    keys: Sequence[str],
    schema: T.StructType,
    before: tuple[str, int] | None = None,
) -> DataFrame:
    """Current rows of a change log: per column the value given last.

    ``before=(component, batch)`` leaves out that batch and later ones of the
    component: what it may have written in an attempt that failed.
    """
    cols = [f.name for f in schema.fields if f.name not in keys]
    log = _read_log(spark, path, schema)
    if before is not None:
        component, batch = before
        log = log.where((F.col("component") != component) | (F.col("batch") < batch))
    order = F.struct("stamp", "batch", "component")
    latest = [
        F.max_by(F.col(c), F.when(F.array_contains("given", F.lit(c)), order)).alias(c)
        for c in cols
    ]
    return log.groupBy(*keys).agg(*latest).select(*schema.names)


def written_keys(
    spark: SparkSession,
    path: str,
    keys: Sequence[str],
    schema: T.StructType,
    component: str,
    before_batch: int,
) -> DataFrame:
    """Distinct keys that a component has written in its earlier batches."""
    log = _read_log(spark, path, schema)
    mine = (F.col("component") == component) & (F.col("batch") < before_batch)
    return log.where(mine).select(*keys).distinct()


def compact(
    spark: SparkSession, path: str, target: str, keys: Sequence[str], schema: T.StructType
) -> None:
    """Start a new log ``target`` with the current rows of ``path`` as its only batch.

    For a pause of the writers; readers and writers switch to ``target`` after it.
    The old log is not touched.
    """
    cols = [c for c in schema.names if c not in keys]
    write_changes(read_current(spark, path, keys, schema), target, "compacted", 0, keys, cols)


# --- marks -----------------------------------------------------------------------------------


def get_mark(spark: SparkSession, path: str, component: str) -> tuple[str, int]:
    """(last mark, last batch id) of a component; the epoch and -1 at first."""
    row = (
        read_table(spark, path, SYNC_STATE)
        .where(F.col("component") == component)
        .orderBy(F.col("batch_id").desc())
        # As text: the time zone of the driver plays no part.
        .select(
            F.date_format("last_sync_timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("mark"),
            "batch_id",
        )
        .first()
    )
    return (EPOCH, -1) if row is None else (row["mark"] or EPOCH, row["batch_id"])


def set_mark(spark: SparkSession, path: str, component: str, mark: str, batch_id: int) -> None:
    """Record a finished batch. Written after its data: a crash in between repeats
    the batch under the same id, which replaces the same folders."""
    spark.range(1).select(
        F.lit(component).alias("component"),
        F.lit(mark).cast("timestamp").alias("last_sync_timestamp"),
        F.lit(batch_id).cast("long").alias("batch_id"),
    ).coalesce(1).write.mode("append").parquet(path)
