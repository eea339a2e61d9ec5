"""Nest child rows under their key in arrays of bounded length."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 1000
SALTS = 16


def nest(
    rows: DataFrame,
    keys: Sequence[str],
    child_key: str,
    child: Column,
    name: str,
    chunk: int = CHUNK,
    size: str | None = None,
    count_in: DataFrame | None = None,
) -> DataFrame:
    """``keys, chunk_no, <name>``: the children of a key, in arrays.

    A key with up to ``chunk`` children gives one row. One with more is cut by a
    hash of ``child_key`` into several rows of about ``chunk`` children, so that no
    array grows with the data. The children are counted in the rows themselves, in
    ``count_in`` (a cheaper table that has some of the key columns), or not at all
    if a column ``size`` holds their number already.
    """
    keys = list(keys)
    if size is not None:
        numbered = rows.withColumn("_pieces", F.ceil(F.col(size) / chunk))
    else:
        numbered = _with_pieces(rows, keys, child_key, count_in, chunk)
    piece = F.pmod(F.xxhash64(child_key), F.coalesce("_pieces", F.lit(1)))
    return (
        numbered.withColumn("chunk_no", piece.cast("int"))
        .groupBy(*keys, "chunk_no")
        .agg(F.collect_list(child).alias(name))
    )


def _with_pieces(
    rows: DataFrame, keys: list[str], child_key: str, count_in: DataFrame | None, chunk: int
) -> DataFrame:
    """Rows with the number of pieces of their key, NULL where one is enough."""
    source = rows if count_in is None else count_in
    by = [k for k in keys if k in source.columns]
    pieces = (
        source.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > chunk)
        .select(
            *[F.col(k).alias(f"_k_{k}") for k in by],
            F.ceil(F.col("_n") / chunk).cast("int").alias("_pieces"),
            # These are the large keys, so their rows are salted for this join.
            F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_p_salt"),
        )
    )
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(child_key), F.lit(SALTS)).cast("int"))
    # Null-safe: a NULL in a key column is a key like any other.
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in by]
    condition = reduce(Column.__and__, same, F.col("_salt") == F.col("_p_salt"))
    return salted.join(pieces, condition, "left")
