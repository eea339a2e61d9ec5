"""Insert-or-patch of tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(
    target: DataFrame, patch: DataFrame, keys: Sequence[str], cols: Sequence[str]
) -> DataFrame:
    """Insert new keys, set only ``cols`` on known ones.

    A NULL given in the patch overwrites; columns not named keep their value. The
    patch holds a key at most once (see ``ranking.last_per_key``).
    """
    keys = list(keys)
    given = patch.select(
        *keys, *[F.col(c).alias(f"_new_{c}") for c in cols], F.lit(True).alias("_given")
    )
    joined = target.join(given, keys, "full_outer")
    out = [F.col(k) for k in keys]
    for name in [*target.columns, *[c for c in cols if c not in target.columns]]:
        if name in keys:
            continue
        if name not in cols:
            out.append(F.col(name))
        elif name in target.columns:
            out.append(
                F.when(F.col("_given"), F.col(f"_new_{name}")).otherwise(F.col(name)).alias(name)
            )
        else:
            out.append(F.col(f"_new_{name}").alias(name))
    return joined.select(*out)
