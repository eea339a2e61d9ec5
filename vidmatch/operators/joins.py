"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidmatch.session import cut_lineage

# Bounds the list that is broadcast (a key and a number each). A key beyond the most
# frequent ones holds less than one row in this many, too few to unbalance a join.
MAX_HOT_KEYS = 50_000
# Rows without a key are spread over this many tasks; they match nothing.
NO_KEY_SALTS = 1 << 20


def key_counts(fact: DataFrame, on: Sequence[str]) -> DataFrame:
    return fact.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))


def hot_keys(counts: DataFrame, on: Sequence[str], hot_rows: int, salts: int) -> DataFrame:
    """The most frequent keys with at least ``hot_rows`` rows each, and their ``_salts``.

    A key has one salt for each ``hot_rows`` rows, ``salts`` at least.
    """
    return (
        counts.where(F.col("_rows") >= hot_rows)
        .orderBy(F.desc("_rows"), *on)
        .limit(MAX_HOT_KEYS)
        .select(*on, F.greatest(F.lit(salts), F.ceil(F.col("_rows") / hot_rows)).cast("int").alias("_salts"))
    )


def skew_join(
    fact: DataFrame,
    other: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    spread: Sequence[str] | None = None,
    salts: int = 32,
    hot_rows: int = 2_000_000,
    count_in: DataFrame | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Equi-join with salted hot keys (``how``: inner, left, left_semi, left_anti).

    The rows of a hot key are spread over as many tasks as their number asks for, by a
    hash of their ``spread`` columns (all columns by default), and only the few rows of
    ``other`` with that key are repeated. Rows without a key match nothing and are spread too.
    The keys are counted in ``count_in`` if given: a table with the same keys that is
    cheaper to read than ``fact``; ``counts`` holds them counted already, as ``_rows``.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type: {how}")
    on = list(on)
    if counts is None:
        counts = key_counts(fact if count_in is None else count_in, on)
    hot = F.broadcast(hot_keys(counts, on, hot_rows, salts))
    no_key = F.greatest(*[F.col(c).isNull() for c in on], F.lit(False))
    among = F.coalesce("_salts", F.when(no_key, F.lit(NO_KEY_SALTS)), F.lit(1))
    salt = F.pmod(F.xxhash64(*(spread or _hashable(fact))), among).cast("int")
    left = fact.join(hot, on, "left").withColumn("_salt", salt).drop("_salts")
    repeats = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    right = other.join(hot, on, "left").withColumn("_salt", F.explode(repeats)).drop("_salts")
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def children_join(
    parents: DataFrame,
    children: DataFrame,
    on: Sequence[str],
    spread: Sequence[str] | None = None,
    count_in: DataFrame | None = None,
    keys_in: DataFrame | None = None,
) -> DataFrame:
    """Parents with their children, a parent without any once with NULLs.

    The rows of a left join. There the many side is on the right, where adaptive
    execution cannot split a hot key; here the children are the left side of an inner
    join with salted keys, and the childless parents come from an anti join.

    Children that are costly to derive should be derived once: ``count_in`` is a table
    with about as many rows per key that is cheaper to read, and ``keys_in`` one with
    exactly the keys that have children (by default the table that is counted).
    """
    on = list(on)
    counted = children if count_in is None else count_in
    # Written once: it names the hot keys and, by default, the parents with children.
    counts = cut_lineage(key_counts(counted, on))
    found = skew_join(children, parents, on, spread=spread, counts=counts)
    known = counts.select(*on) if keys_in is None else keys_in.select(*on).distinct()
    childless = parents.join(known, on, "left_anti")
    columns = [*on, *[c for c in [*parents.columns, *children.columns] if c not in on]]
    return found.unionByName(childless, allowMissingColumns=True).select(*columns)


def spread_join(
    fact: DataFrame,
    parent: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    spread: Sequence[str] | None = None,
    salts: int = 16,
) -> DataFrame:
    """Equi-join of many rows with their parents, every key salted (inner or left).

    Each parent row is repeated ``salts`` times. For parents that are few compared
    with their children, and children too costly to count beforehand as
    ``skew_join`` does.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join type: {how}")
    salt = F.pmod(F.xxhash64(*(spread or _hashable(fact))), F.lit(salts)).cast("int")
    repeated = parent.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return fact.withColumn("_salt", salt).join(repeated, [*on, "_salt"], how).drop("_salt")


def _hashable(df: DataFrame) -> list[str]:
    """Columns that can be hashed (maps cannot)."""
    return [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
