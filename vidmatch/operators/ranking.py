"""Top-k, first/last per key, ordering and tie-safe marks.

Every ``rank <= k`` below is planned with a partial group limit before the shuffle,
so a key that holds a large share of all rows sends at most k rows per input
partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vidmatch.functions.numbers import as_column


def top_k(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    k: int,
    rank: str | None = None,
) -> DataFrame:
    """The first ``k`` rows per key; ``rank`` names a column that keeps the rank."""
    name = rank or "_rank"
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)
    return ranked if rank else ranked.drop(name)


def first_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]
) -> DataFrame:
    return top_k(df, keys, order, 1)


def last_per_key(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """Last row per key in input order; ``position`` must be unique per key."""
    return top_k(df, keys, [F.col(position).desc()], 1)


def dedupe_matches(
    candidates: DataFrame,
    keys: Sequence[str] = ("video_uuid", "identified_product_uuid"),
    offer: str = "offer_id",
) -> DataFrame:
    """Nearest row per offer of an identified product."""
    return first_per_key(
        candidates, [*keys, offer], [F.col("distance").asc_nulls_last()]
    )


#: Rows that may be sorted for one page.
PAGE_ROWS = 10_000
#: Time units, each of at most about a thousand of the next.
UNITS = ("day", "minute", "second", "millisecond", "microsecond")
ID_LENGTH = 64


def newest_page(df: DataFrame, ts: str, ident: str, limit: int, offset: int, page_rows: int = PAGE_ROWS) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` by ``ts``, newest first, then by ``ident``; rows without ``ts`` have no place.

    Up to ``page_rows`` rows are sorted at once. Beyond that, counts per day tell on which day
    the page begins, counts of that day per minute in which minute, and so on down to a
    microsecond and to the first characters of the ids in it; newer rows are counted and
    left out. What is sorted then is the page and less than ``page_rows`` rows before it.
    """
    rows = df.where(F.col(ts).isNotNull())
    skipped = 0
    if offset + limit > page_rows:
        rows, skipped = _from_place(rows, ts, ident, offset, page_rows)
    return rows.orderBy(F.col(ts).desc(), ident).offset(offset - skipped).limit(limit)


def _from_place(rows: DataFrame, ts: str, ident: str, offset: int, page_rows: int) -> tuple[DataFrame, int]:
    """Rows from some place at or before ``offset`` on, and how many rows were left out before it."""
    skipped, inside = 0, rows  # the bucket in which the page begins
    after = rows.limit(0)  # rows behind that bucket
    for unit in UNITS:
        bucket = F.date_trunc(unit, F.col(ts))
        found = _find(inside, bucket, F.desc("b"), offset - skipped)
        if found is None:
            return after, skipped
        start, before, size = found
        after = after.unionByName(inside.where(bucket < F.lit(start)))
        inside = inside.where(bucket == F.lit(start))
        skipped += before
        if size <= page_rows:
            return after.unionByName(inside), skipped
    for length in range(1, ID_LENGTH + 1):
        prefix = F.coalesce(F.substring(ident, 1, length), F.lit(""))
        start, before, size = _find(inside, prefix, F.asc("b"), offset - skipped)
        after = after.unionByName(inside.where(prefix > F.lit(start)))
        inside = inside.where(prefix == F.lit(start))
        skipped += before
        if size <= page_rows:
            break
    return after.unionByName(inside), skipped


def _find(rows: DataFrame, bucket: Column, order: Column, place: int):
    """The bucket that holds the row at ``place``, the number of rows before it and its own."""
    counts = rows.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    before = 0
    # Days of the table, or parts of one unit: few rows whatever the table holds.
    for r in counts.orderBy(order).collect():
        if place < before + r["n"]:
            return r["b"], before, r["n"]
        before += r["n"]
    return None


def drop_rank(df: DataFrame, rank: str = "rn") -> DataFrame:
    return df.drop(rank)


def ordered(df: DataFrame, *keys: Column | str) -> DataFrame:
    return df.orderBy(*keys)


def take(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """``ORDER BY ... LIMIT n``: a top-n per partition, merged once."""
    return df.orderBy(*order).limit(n)


def safe_marks(
    df: DataFrame, ts: str = "timestamp", last_sync: Column | str | None = None
) -> DataFrame:
    """Each distinct timestamp with the last one strictly before it.

    A job that stops right after a row may store that earlier mark without losing
    rows of a tie. No single task sees all timestamps: neighbours are looked up
    inside a minute, then among the minutes of a day, then among days.
    """
    start = F.lit(None).cast("timestamp") if last_sync is None else as_column(last_sync)
    stamps = (
        df.where(F.col(ts).isNotNull())
        .select(F.col(ts).alias("ts"))
        .distinct()
        .withColumn("minute", F.date_trunc("minute", "ts"))
        .withColumn("day", F.date_trunc("day", "ts"))
    )
    inside = stamps.withColumn(
        "before", F.lag("ts").over(Window.partitionBy("minute").orderBy("ts"))
    )
    minutes = stamps.groupBy("day", "minute").agg(F.max("ts").alias("last_ts"))
    minute_marks = minutes.select(
        "minute",
        F.lag("last_ts").over(Window.partitionBy("day").orderBy("minute")).alias("minute_before"),
    )
    # One row per day: the only global order, over a calendar rather than over data.
    days = minutes.groupBy("day").agg(F.max("last_ts").alias("last_ts"))
    day_marks = days.select(
        "day", F.lag("last_ts").over(Window.orderBy("day")).alias("day_before")
    )
    return (
        inside.join(minute_marks, "minute")
        .join(day_marks, "day")
        .select(
            F.col("ts").alias(ts),
            F.coalesce("before", "minute_before", "day_before", start).alias("safe_mark"),
        )
    )
