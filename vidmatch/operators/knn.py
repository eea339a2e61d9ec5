"""Nearest-neighbour search over vector columns.

The queries travel, the base stays where it is. Queries are cut into blocks of at most
``max_broadcast_bytes`` or so; each block is broadcast and the base is scanned once for
it, in place: a task keeps a heap of the k best base rows of every query of the block.
The heaps are merged in a tree, first those of neighbouring tasks, then the rest. No
base row is in a shuffle. Where there are several blocks, a first look at some of the
base's partitions gives every query a distance that its k-th neighbour cannot exceed,
and the scan sends only pairs within it.

``ivf_knn`` scans in the same way, but compares a query with the ``nprobe`` nearest of
the K-means cells alone; approximate unless every cell is probed. For a base that is
searched again and again, ``sources.vector_index`` stores the cells.

Spark moves and splits the work; NumPy computes one bounded block of distances at a
time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vidmatch.operators.ranking import top_k
from vidmatch.session import new_folder

BLOCK_BYTES = 32 << 20  # base vectors held at once by one task
PAIR_LIMIT = 2 << 20  # entries of one distance matrix
TIE_SLACK = 1e-9  # rows this close to the k-th are measured again, exactly
ROUNDING = 1e-13  # of the squared norms: what the product form of a distance may lose
LARGEST = 1e150  # elements beyond this have no finite squared norm
GROUP = 16  # columns of a distance matrix whose least one stands for them
FEW_PAIRS = 32  # fewer than one in so many base rows are measured without looking for the k-th best
MAX_CELLS = 4096
FAN_IN = 64  # groups of tasks whose heaps are merged first
FIRST_LOOK = 16  # one in so many partitions gives the bound


@dataclass
class CellModel:
    """Cell centres per vector space; small by construction (``MAX_CELLS``)."""

    centres: dict[str, np.ndarray]


def knn(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    metric: str = "l2",
    query_id: str = "uuid",
    base_id: str = "id",
    vector: str = "embedding",
    same_model: bool = False,
    model: str = "embedding_model_id",
    max_broadcast_bytes: int = 64 << 20,
) -> DataFrame:
    """Exact ``k`` nearest base rows per query, ties broken by base id."""
    if metric != "l2":
        raise ValueError(f"unsupported metric: {metric}")
    q = vectors(queries, query_id, vector, model if same_model else None, "qid")
    b = vectors(base, base_id, vector, model if same_model else None, "bid")
    hits = search(q, lambda block: [(b, Wanted(block))], k, max_broadcast_bytes, b.schema["bid"].dataType)
    return ranked(hits, k, query_id, base_id)


def ivf_fit(
    base: DataFrame,
    cells: int,
    vector: str = "embedding",
    same_model: bool = False,
    model: str = "embedding_model_id",
    seed: int = 42,
    max_iter: int = 10,
) -> CellModel:
    """K-means centres of the base vectors (all of one size and model)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    if cells > MAX_CELLS:
        raise ValueError(f"at most {MAX_CELLS} cells")
    b = vectors(base, None, vector, model if same_model else None, None)
    spaces = [r["space"] for r in b.select("space").distinct().limit(2).collect()]
    if not spaces:
        return CellModel({})
    if len(spaces) > 1:
        raise ValueError("fit one model per vector size and embedding model")
    fitted = KMeans(k=cells, seed=seed, maxIter=max_iter, featuresCol="features").fit(
        b.select(array_to_vector("vec").alias("features"))
    )
    return CellModel({spaces[0]: np.array(fitted.clusterCenters())})


def ivf_knn(
    queries: DataFrame,
    base: DataFrame,
    cells: CellModel,
    k: int,
    nprobe: int,
    query_id: str = "uuid",
    base_id: str = "id",
    vector: str = "embedding",
    same_model: bool = False,
    model: str = "embedding_model_id",
    max_broadcast_bytes: int = 64 << 20,
) -> DataFrame:
    """The ``k`` nearest base rows among the ``nprobe`` cells nearest to a query."""
    q = vectors(queries, query_id, vector, model if same_model else None, "qid")
    b = vectors(base, base_id, vector, model if same_model else None, "bid")
    placed = assign(b, cells.centres)
    plan = lambda block: [(placed, Wanted(block, nearest_cells(block, cells.centres, nprobe)))]
    return ranked(search(q, plan, k, max_broadcast_bytes, b.schema["bid"].dataType), k, query_id, base_id)


def nearest_cells(block: pa.Table, centres: dict[str, np.ndarray], nprobe: int) -> dict[str, dict[int, np.ndarray]]:
    """For each space and cell the queries of the block that probe it, as places in the space's matrix."""
    out: dict[str, dict[int, np.ndarray]] = {}
    for space, rows in by_space(block):
        if space in centres:
            n = min(nprobe, len(centres[space]))
            near = np.argpartition(distances(matrix(rows.column("vec")), centres[space]), n - 1, axis=1)[:, :n]
            out[space] = by_cell(near.ravel(), np.repeat(np.arange(len(near)), n))
    return out


def by_cell(cells: np.ndarray, rows: np.ndarray) -> dict[int, np.ndarray]:
    order = np.argsort(cells, kind="stable")
    different, first = np.unique(cells[order], return_index=True)
    return dict(zip(different.tolist(), np.split(rows[order], first[1:]), strict=True))


# --- shaping -----------------------------------------------------------------------


def vectors(
    df: DataFrame, ident: str | None, vector: str, model: str | None, name: str | None
) -> DataFrame:
    """id, vector as doubles, and the space in which vectors may be compared.

    Vectors that have no distance to anything (see ``comparable``) are left out of
    queries and base alike, whichever way the search goes.
    """
    size = F.size(vector).cast("string")
    space = F.concat_ws("|", size, F.coalesce(F.col(model), F.lit(""))) if model else size
    cols = [space.alias("space"), F.col(vector).cast("array<double>").alias("vec")]
    if ident is not None:
        cols.insert(0, F.col(ident).alias(name))
    return df.where(comparable(vector)).select(*cols)


def comparable(vector: str = "embedding") -> Column:
    """True for vectors with elements that are all numbers of a finite square."""
    sound = F.forall(
        F.col(vector).cast("array<double>"),
        lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) <= LARGEST), F.lit(False)),
    )
    return F.coalesce((F.size(vector) > 0) & sound, F.lit(False))


def incomparable(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows that a search leaves out: no vector, or a NULL, NaN or infinite element."""
    return df.where(~comparable(vector))


def ranked(hits: DataFrame, k: int, query_id: str, base_id: str) -> DataFrame:
    best = top_k(hits, ["qid"], ["distance", "bid"], k, rank="rank")
    return best.select(
        F.col("qid").alias(query_id), F.col("bid").alias(base_id), "distance", "rank"
    )


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def by_space(table: pa.Table) -> Iterator[tuple[str, pa.Table]]:
    spaces = table.column("space").unique().to_pylist()
    if len(spaces) == 1:
        yield spaces[0], table
        return
    for space in spaces:
        yield space, table.filter(pa.compute.equal(table.column("space"), space))


# --- block computation ---------------------------------------------------------------


def squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances in product form, and by how much those of a row may be off."""
    own, other = (a * a).sum(1), (b * b).sum(1)
    found = own[:, None] + other[None, :] - 2.0 * (a @ b.T)
    return np.maximum(found, 0.0), ROUNDING * a.shape[1] * (own + other.max(initial=0.0))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(squares(a, b)[0])


def _top_block(
    q: np.ndarray, b: np.ndarray, ids: pa.Array, k: int, bound: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, base row, distance) of at least the k best pairs of every query.

    ``bound`` drops pairs that cannot belong to the result any more. A row's k-th best is
    looked for only where the bound leaves many of its pairs.
    """
    rows, cols, dists = [], [], []
    step = max(1, PAIR_LIMIT // max(1, len(b)))
    other = (b * b).sum(1)
    # One product gives the squared distances without the query's own square.
    side = np.column_stack([b, other]).T
    room = np.empty((min(step, len(q)), len(b)))
    for start in range(0, len(q), step):
        part = q[start : start + step]
        own = (part * part).sum(1)
        # The product form loses digits in proportion to the norms.
        slack = ROUNDING * q.shape[1] * (own + other.max(initial=0.0))
        rough = np.matmul(np.column_stack([-2.0 * part, np.ones(len(part))]), side, out=room[: len(part)])
        limit = np.full(len(part), np.inf)
        if bound is not None:
            limit = (bound[start : start + step] + TIE_SLACK) ** 2 + slack + TIE_SLACK**2 - own
        near = rough <= limit[:, None]
        if rough.shape[1] > k:
            many = np.flatnonzero(near.sum(1) > max(k, rough.shape[1] // FEW_PAIRS))
            if len(many):
                some = rough if len(many) == len(part) else rough[many]
                best = _reached(some, k) + 2 * slack[many] + TIE_SLACK**2
                near[many] = some <= np.minimum(limit[many], best)[:, None]
        r, c = np.divmod(np.flatnonzero(near), max(1, len(b)))
        exact = _exact(part, b, r, c)
        r, c, exact = _cut(r, c, exact, ids, k)
        rows.append(r + start)
        cols.append(c)
        dists.append(exact)
    if not rows:
        return np.array([], int), np.array([], int), np.array([], float)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(dists)


def _reached(rough: np.ndarray, k: int) -> np.ndarray:
    """For each row a value that at least k of its columns do not exceed.

    The k-th of the minima of groups of columns: hardly more than the k-th of all columns,
    for one pass over them. Few columns are not grouped.
    """
    groups = rough.shape[1] // GROUP
    if groups > k:
        rough = rough[:, : groups * GROUP].reshape(len(rough), GROUP, groups).min(1)
    return np.partition(rough, k - 1, axis=1)[:, k - 1]


def _exact(q: np.ndarray, b: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(r))
    step = max(1, BLOCK_BYTES // (8 * max(1, q.shape[1])))
    for start in range(0, len(r), step):
        diff = q[r[start : start + step]] - b[c[start : start + step]]
        out[start : start + step] = np.sqrt((diff * diff).sum(1))
    return out


def _cut(
    r: np.ndarray, c: np.ndarray, dist: np.ndarray, ids: pa.Array, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keep the k smallest (distance, id) per query row; ``ids`` are those of the base rows."""
    order = np.lexsort((dist, r))
    r, c, dist = r[order], c[order], dist[order]
    same = (r[1:] == r[:-1]) & (dist[1:] == dist[:-1])
    if same.any():
        # Only pairs of one distance are told apart by their ids.
        tied = np.zeros(len(r), bool)
        tied[1:] = same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        names = _id_array(ids.take(pa.array(c[at], pa.int64())))
        c[at] = c[at][np.lexsort((names, dist[at], r[at]))]
    first = np.searchsorted(r, r, side="left")
    keep = np.arange(len(r)) - first < k
    return r[keep], c[keep], dist[keep]


def _id_array(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    values = column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()
    return values.astype(str) if values.dtype == object else values


# --- search: the queries travel, the base stays ------------------------------------------


@dataclass
class Wanted:
    """A block of queries (qid, space, vec), with the cells that each probes (none: all rows) and its bound."""

    block: pa.Table
    cells: dict[str, dict[int, np.ndarray]] | None = None
    #: By space, in the order of the block: no farther pair is wanted.
    bound: dict[str, np.ndarray] | None = None


#: Plans the scans of one block: base frames (bid, space, vec, and cell if cells are given) with what they are searched for.
Plan = Callable[[pa.Table], list[tuple[DataFrame, Wanted]]]


def search(q: DataFrame, plan: Plan, k: int, max_bytes: int, bid_type: T.DataType) -> DataFrame:
    """At least the k best hits (qid, bid, distance) of every query, block by block."""
    spark = q.sparkSession
    qid_type = q.schema["qid"].dataType
    sizes = q.agg(F.count(F.lit(1)), F.sum(F.size("vec") * F.lit(8) + F.lit(64))).first()
    rows, total = sizes[0], sizes[1] or 0
    if total <= max_bytes or rows <= 1:
        found = [merged(scan(base, wanted, k, qid_type, bid_type), k) for base, wanted in plan(q.toArrow())]
        return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], hit_schema(qid_type, bid_type))
    # Half full on average, so that none is much larger than the limit.
    blocks = min(rows, -(-2 * total // max(max_bytes, 1)))
    stored = new_folder(spark)
    number = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))
    q.withColumn("block", number).repartition("block").write.partitionBy("block").parquet(stored)
    results = new_folder(spark)
    for i in range(blocks):
        one = spark.read.parquet(stored).where(F.col("block") == i).drop("block").toArrow()
        for j, (base, wanted) in enumerate(plan(one) if one.num_rows else []):
            wanted = bounded(base, wanted, k, qid_type, bid_type)
            merged(scan(base, wanted, k, qid_type, bid_type), k, tree=True).write.parquet(f"{results}/block={i}/scan={j}")
    schema = hit_schema(qid_type, bid_type)
    try:
        return spark.read.schema(schema).parquet(results).select(*schema.names)
    except AnalysisException:  # no block had anything to scan
        return spark.createDataFrame([], schema)


def hit_schema(qid_type: T.DataType, bid_type: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("qid", qid_type),
            T.StructField("bid", bid_type),
            T.StructField("distance", T.DoubleType()),
        ]
    )


def merged(hits: DataFrame, k: int, tree: bool = False) -> DataFrame:
    """The k best of the tasks' heaps; in a tree, heaps of ``FAN_IN`` groups of tasks are merged first."""
    if tree:
        grouped = hits.withColumn("_group", F.pmod(F.spark_partition_id(), F.lit(FAN_IN)))
        hits = top_k(grouped, ["qid", "_group"], ["distance", "bid"], k).drop("_group")
    return top_k(hits, ["qid"], ["distance", "bid"], k)


def bounded(
    base: DataFrame, wanted: Wanted, k: int, qid_type: T.DataType, bid_type: T.DataType, share: int = FIRST_LOOK
) -> Wanted:
    """``wanted`` with the distance of the k-th best among one in ``share`` of the base's partitions.

    Any base rows give a valid bound, so it does not matter which partitions they are
    or whether the next scan deals them the same. Queries with fewer hits get none.
    """
    if wanted.bound is not None:
        return wanted
    first = merged(scan(base, wanted, k, qid_type, bid_type, share, numbered=True), k)
    # One row for each query of the block at most.
    worst = first.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("d")).where(F.col("n") >= k).toArrow()
    found = dict(zip(worst.column("qid").to_pylist(), worst.column("d").to_pylist(), strict=True))
    bound = {
        space: np.array([found.get(f"{space}#{i}", np.inf) for i in range(rows.num_rows)])
        for space, rows in by_space(wanted.block)
    }
    return Wanted(wanted.block, wanted.cells, bound)


def scan(
    base: DataFrame,
    wanted: Wanted,
    k: int,
    qid_type: T.DataType,
    bid_type: T.DataType,
    share: int = 1,
    numbered: bool = False,
) -> DataFrame:
    """The heaps of all tasks: at least the k best pairs of each query among a task's base rows.

    With ``share`` only one in so many partitions is looked at; ``numbered`` names queries
    by space and place instead of by id, which need not be unique.
    """
    schema = hit_schema(T.StringType() if numbered else qid_type, bid_type)
    sides = {}
    for space, t in by_space(wanted.block) if wanted.block.num_rows else ():
        ids = pa.array([f"{space}#{i}" for i in range(t.num_rows)]) if numbered else t.column("qid").combine_chunks()
        cells = None if wanted.cells is None else wanted.cells.get(space, {})
        sides[space] = (ids, matrix(t.column("vec")), cells, None if wanted.bound is None else wanted.bound.get(space))
    shared = base.sparkSession.sparkContext.broadcast(sides)
    arrow = pa.schema([("qid", _arrow(schema["qid"].dataType)), ("bid", _arrow(bid_type)), ("distance", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if TaskContext.get().partitionId() % share:
            return
        best: dict[str, tuple] = {}
        for table in _blocks(batches):
            for space, rows in by_space(table):
                if space not in shared.value:
                    continue
                _, q, cells, bound = shared.value[space]
                if cells is None:
                    best[space] = _merge(best.get(space), q, rows, k, bound)
                    continue
                # Rows of the cells that every query probes are looked at together.
                places = rows.column("cell").to_numpy()
                common = np.isin(places, [c for c, own in cells.items() if len(own) == len(q)])
                if common.any():
                    best[space] = _merge(best.get(space), q, rows if common.all() else rows.filter(pa.array(common)), k, bound)
                    rest = np.flatnonzero(~common)
                    if not len(rest):
                        continue
                    rows, places = rows.take(pa.array(rest)), places[rest]
                for cell, some in by_cell(places, np.arange(rows.num_rows)).items():
                    if cell in cells:
                        best[space] = _merge(best.get(space), q, rows.take(pa.array(some)), k, bound, cells[cell])
        for space, (q_rows, ids, dist) in best.items():
            q_ids = shared.value[space][0].take(pa.array(q_rows))
            yield from pa.table([q_ids.cast(arrow.field("qid").type), ids, pa.array(dist)], schema=arrow).to_batches()

    columns = ["bid", "space", "vec", *(["cell"] if wanted.cells is not None else [])]
    return base.where(F.col("space").isin(list(sides))).select(*columns).mapInArrow(run, schema)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Input batches gathered to blocks of bounded size."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= BLOCK_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        table = pa.Table.from_batches(held)
        if table.num_rows:
            yield table


def _merge(
    best: tuple | None, q: np.ndarray, rows: pa.Table, k: int, bound: np.ndarray | None, only: np.ndarray | None = None
) -> tuple:
    """Best pairs so far of one partition, joined with those of a new block (for the queries ``only``)."""
    bid = rows.column("bid").combine_chunks()
    limit = np.full(len(q), np.inf) if bound is None else bound
    if best is not None:
        count = np.bincount(best[0], minlength=len(q))
        worst = np.zeros(len(q))
        np.maximum.at(worst, best[0], best[2])
        limit = np.minimum(limit, np.where(count >= k, worst, np.inf))
    chosen = q if only is None else q[only]
    r, c, dist = _top_block(chosen, matrix(rows.column("vec")), bid, k, limit if only is None else limit[only])
    r = r if only is None else only[r]
    ids = bid.take(pa.array(c, pa.int64()))
    if best is not None:
        r = np.concatenate([best[0], r])
        ids = pa.concat_arrays([best[1], ids])
        dist = np.concatenate([best[2], dist])
    r, c, dist = _cut(r, np.arange(len(r)), dist, ids, k)
    return r, ids.take(pa.array(c, pa.int64())), dist


def _arrow(data_type: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(data_type)


# --- cells ---------------------------------------------------------------------------------


def assign(df: DataFrame, centres: dict[str, np.ndarray]) -> DataFrame:
    """Base rows with their nearest cell and the distance to its centre; rows of other spaces are left out."""
    schema = T.StructType(
        [*df.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("spoke", T.DoubleType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for space, rows in by_space(pa.Table.from_batches([batch])):
                dist = distances(matrix(rows.column("vec")), centres[space])
                cell = dist.argmin(1)
                spoke = _exact(matrix(rows.column("vec")), centres[space], np.arange(len(cell)), cell)
                yield from (
                    rows.append_column("cell", pa.array(cell.astype("int32")))
                    .append_column("spoke", pa.array(spoke))
                    .to_batches()
                )

    return df.where(F.col("space").isin(list(centres))).mapInArrow(run, schema)
