"""A stored vector index: cells fitted once, vectors kept in folders by cell.

``centres`` holds the cells' centres (space, cell, centre), ``vectors`` the vectors under
``batch=../space=../cell=..``, ``spokes`` the range of distances between the vectors of a
cell and its centre, a row for each cell and batch. New vectors are assigned when they
are appended; a search plans the cells of every query first and reads no other folder.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vidmatch.operators import knn

#: Vectors that the centres are fitted on at most, chosen by hash. Every vector is indexed.
FIT_ROWS = 1_000_000
CENTRES = T.StructType(
    [
        T.StructField("space", T.StringType()),
        T.StructField("cell", T.IntegerType()),
        T.StructField("centre", T.ArrayType(T.DoubleType())),
    ]
)
SPOKES = T.StructType(
    [
        T.StructField("space", T.StringType()),
        T.StructField("cell", T.IntegerType()),
        T.StructField("inner", T.DoubleType()),
        T.StructField("outer", T.DoubleType()),
        T.StructField("n", T.LongType()),
        T.StructField("batch", T.LongType()),
    ]
)


@dataclass
class VectorIndex:
    """An index at ``path`` over (``ident``, ``vector``) rows of one or several vector spaces."""

    path: str
    ident: str = "id"
    vector: str = "embedding"
    #: Column of the embedding model, where vectors of different models must not meet.
    model: str | None = None

    # --- writing ---------------------------------------------------------------------------

    def fit(self, base: DataFrame, cells: int, fit_rows: int = FIT_ROWS, seed: int = 42) -> None:
        """Fit and store the centres of every space of ``base``; no vectors are stored yet."""
        spark = base.sparkSession
        rows = self._vectors(base)
        counts = rows.groupBy("space").agg(F.count(F.lit(1)).alias("n")).limit(knn.MAX_CELLS + 1).collect()
        if len(counts) * cells > knn.MAX_CELLS:
            raise ValueError(f"at most {knn.MAX_CELLS} cells over all spaces")
        found = []
        for space, n in sorted((r["space"], r["n"]) for r in counts):
            share = F.pmod(F.xxhash64("bid"), F.lit(max(1, -(-n // fit_rows))))
            own = rows.where((F.col("space") == space) & (share == 0)).select("vec")
            model = knn.ivf_fit(own, min(cells, n), vector="vec", seed=seed)
            for centres in model.centres.values():
                found += [(space, i, c.tolist()) for i, c in enumerate(centres)]
        spark.createDataFrame(found, CENTRES).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centres")

    def append(self, base: DataFrame, batch: int = 0) -> None:
        """Store the vectors of one batch by cell; the same batch again replaces itself.

        Vectors of a space without centres are refused. Those without a distance to
        anything (``knn.incomparable``) are left out, as in every search.
        """
        spark = base.sparkSession
        centres = self.centres(spark)
        rows = self._vectors(base)
        new = [r["space"] for r in rows.where(~F.col("space").isin(list(centres))).select("space").distinct().limit(5).collect()]
        if new:
            raise ValueError(f"no centres for {new}: fit the index anew")
        # Written from where the vectors are: no shuffle by cell.
        placed = knn.assign(rows, centres)
        placed.write.mode("overwrite").partitionBy("space", "cell").parquet(f"{self.path}/vectors/batch={batch}")
        stored = self._stored(spark).where(F.col("batch") == batch)
        spokes = stored.groupBy("space", "cell").agg(
            F.min("spoke").alias("inner"), F.max("spoke").alias("outer"), F.count(F.lit(1)).alias("n")
        )
        spokes.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/spokes/batch={batch}")

    # --- reading ---------------------------------------------------------------------------

    def centres(self, spark: SparkSession) -> dict[str, np.ndarray]:
        """At most ``MAX_CELLS`` rows."""
        table = spark.read.schema(CENTRES).parquet(f"{self.path}/centres").orderBy("space", "cell").toArrow()
        return {s: knn.matrix(t.column("centre")) for s, t in knn.by_space(table)} if table.num_rows else {}

    def sizes(self, spark: SparkSession) -> DataFrame:
        """space, cell, n, inner, outer over all batches."""
        rows = spark.read.schema(SPOKES).parquet(f"{self.path}/spokes")
        return rows.groupBy("space", "cell").agg(
            F.sum("n").alias("n"), F.min("inner").alias("inner"), F.max("outer").alias("outer")
        )

    def vectors(self, spark: SparkSession, space: str, cells: list[int]) -> DataFrame:
        """bid, space, vec, cell of some cells; other folders are not read."""
        return self._stored(spark).where((F.col("space") == space) & F.col("cell").isin(cells)).drop("spoke", "batch")

    def search(
        self,
        queries: DataFrame,
        k: int,
        nprobe: int | None = None,
        query_id: str = "uuid",
        max_broadcast_bytes: int = 64 << 20,
    ) -> DataFrame:
        """The ``k`` nearest stored rows per query: query id, id, distance, rank.

        ``nprobe`` cells are probed for each query. Without it the result is exact: a
        scan of the nearest filled cell bounds the k-th distance, and of the others those
        are read that can hold something nearer (triangle inequality).
        """
        spark = queries.sparkSession
        centres = self.centres(spark)
        q = knn.vectors(queries, query_id, self.vector, self.model, "qid")
        bid = self._stored(spark).schema["bid"].dataType
        known = {(r["space"], r["cell"]): (r["inner"], r["outer"]) for r in self.sizes(spark).collect()}  # a row for each cell

        def scans(block: pa.Table, cells: dict[str, dict[int, np.ndarray]], bound=None) -> list[tuple[DataFrame, knn.Wanted]]:
            out = []
            for space, own in cells.items():
                filled = {c: rows for c, rows in own.items() if (space, c) in known}
                if filled:
                    out.append((self.vectors(spark, space, sorted(filled)), knn.Wanted(block, {space: filled}, bound)))
            return out

        def approximate(block: pa.Table) -> list[tuple[DataFrame, knn.Wanted]]:
            return scans(block, knn.nearest_cells(block, centres, nprobe))

        def exact(block: pa.Table) -> list[tuple[DataFrame, knn.Wanted]]:
            cells, bounds = {}, {}
            for space, rows in knn.by_space(block) if block.num_rows else ():
                if space not in centres:
                    continue
                filled = np.array(sorted(c for s, c in known if s == space), np.int64)
                if not len(filled):
                    continue
                vecs = knn.matrix(rows.column("vec"))
                rough, slack = knn.squares(vecs, centres[space][filled])
                dist, own = np.sqrt(rough), rough.argmin(1)
                first = scans(block, {space: knn.by_cell(filled[own], np.arange(len(vecs)))})
                bound = knn.bounded(*first[0], k, q.schema["qid"].dataType, bid, share=1).bound[space]
                inner = np.array([known[space, c][0] for c in filled])
                outer = np.array([known[space, c][1] for c in filled])
                lower = np.maximum(dist - outer, inner - dist)
                visit = lower <= (bound + np.sqrt(slack))[:, None] + 1e-6
                visit[np.arange(len(own)), own] = True
                at, cell = np.nonzero(visit)
                cells[space], bounds[space] = knn.by_cell(filled[cell], at), bound
            return scans(block, cells, bounds)

        hits = knn.search(q, exact if nprobe is None else approximate, k, max_broadcast_bytes, bid)
        return knn.ranked(hits, k, query_id, self.ident)

    # --- helpers ---------------------------------------------------------------------------

    def _vectors(self, base: DataFrame) -> DataFrame:
        return knn.vectors(base, self.ident, self.vector, self.model, "bid")

    def _stored(self, spark: SparkSession) -> DataFrame:
        path = f"{self.path}/vectors"
        # Folder names are typed here: a space of digits is still a text.
        typed = {"space": T.StringType(), "cell": T.IntegerType(), "batch": T.LongType()}
        fields = spark.read.parquet(path).schema.fields
        schema = T.StructType([T.StructField(f.name, typed.get(f.name, f.dataType)) for f in fields])
        return spark.read.schema(schema).parquet(path)
