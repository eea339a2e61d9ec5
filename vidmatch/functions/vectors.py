"""Vector expressions on ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: vectors of this size arrive already normalised.
FULL_DIM = 3072


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(v: Column, full_dim: int = FULL_DIM) -> Column:
    """v / |v| unless the vector has the full size; a zero vector gives NULL."""
    # The norm goes through an array of one: inside the lambda it would be computed
    # again for every element.
    scaled = F.transform(
        F.array(l2_norm(v)), lambda norm: F.when(norm > 0, F.transform(v, lambda x: x / norm))
    )[0]
    return F.when(F.size(v) == full_dim, v).otherwise(scaled)


def l2_distance(a: Column, b: Column) -> Column:
    """Euclidean distance; NULL where the sizes differ."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.when(
        F.size(a) == F.size(b),
        F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x)),
    )
