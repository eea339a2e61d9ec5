"""Tables kept in key ranges: a merge reads and rewrites only the ranges that a patch touches."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vidmatch.operators import merge
from vidmatch.session import cut_lineage
from vidmatch.sources.tables import read_table

PART = "part"


@dataclass(frozen=True)
class KeyedTable:
    """Rows of ``schema`` in folders ``part=<hash of the first ``spread`` keys>``.

    ``parts`` belongs to the table for good: choose it so that a part is a file or two
    (a task rewrites one part).
    """

    path: str
    keys: Sequence[str]
    schema: T.StructType
    parts: int = 256
    #: How many of the keys place a row (all by default).
    spread: int | None = None

    def part_of(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys[: self.spread]), F.lit(self.parts)).cast("int")

    def read(self, spark: SparkSession) -> DataFrame:
        """All rows; none before the first merge."""
        return self._stored(spark).drop(PART)

    def matching(self, patch: DataFrame) -> DataFrame:
        """The stored rows, with ``part``, of the ranges that the keys of ``patch`` fall into."""
        spark = patch.sparkSession
        # No more numbers than the table has parts.
        touched = [r[0] for r in patch.select(self.part_of().alias(PART)).distinct().collect()]
        return self._stored(spark).where(F.col(PART).isin(touched))

    def merge(self, patch: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Replace the touched ranges by ``combine(their rows, patch)``, both with ``part``.

        The new rows are computed and written aside first, so that a failure on the way
        leaves the table as it was; the same patch again must give the same rows.
        """
        patch = cut_lineage(patch.withColumn(PART, self.part_of()))
        touched = patch.select(PART).distinct().count()
        if not touched:
            return
        new = cut_lineage(combine(self.matching(patch), patch).select(*self.schema.names, PART))
        (
            new.repartition(touched, PART)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(PART)
            .parquet(self.path)
        )

    def upsert(self, patch: DataFrame, cols: Sequence[str]) -> None:
        """Insert new keys, set only ``cols`` on known ones (see ``merge.upsert``)."""
        keys = [PART, *self.keys]
        absent = [f for f in self.schema.fields if f.name not in (*self.keys, *cols)]

        def combine(old: DataFrame, given: DataFrame) -> DataFrame:
            out = merge.upsert(old, given, keys, cols)
            return out.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields], PART)

        nothing = {f.name: F.lit(None).cast(f.dataType) for f in absent}
        self.merge(patch.select(*self.keys, *cols).withColumns(nothing) if nothing else patch.select(*self.keys, *cols), combine)

    def _stored(self, spark: SparkSession) -> DataFrame:
        return read_table(spark, self.path, T.StructType([*self.schema.fields, T.StructField(PART, T.IntegerType())]))
