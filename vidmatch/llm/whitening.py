"""Whitened embeddings: leading eigenvectors of the covariance by Jacobi-Davidson.

The covariance V is never formed. Vectors are packed into blocks, centred exactly, and
a pass over the blocks gives ``V W`` for a few columns W at once: each task sums its
blocks' products, Spark adds up the tasks' sums by dimension, and the driver receives a
matrix of dimensions by columns. On the driver live the search space and the
eigenvectors, tens of vectors whatever the number of rows.

Jacobi-Davidson keeps an orthonormal search space. Rayleigh-Ritz on it gives pairs
(value, u) with residuals ``r = V u - value u``. Each unfinished pair adds a solution of
its correction equation ``P (V - value) P t = -r``, where P projects away the finished
vectors and the pairs' own; a few MINRES steps solve it, in lockstep for all pairs, so
that one pass serves them all. Pairs are locked from the largest value down when their
residual reaches double precision, and one pair more than wanted is followed to see that
nothing larger was missed. A full space is cut back to its best Ritz vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidmatch.session import cut_lineage

# The contract's scale, shift and number of components.
SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Bytes of a block of vectors, and of the vectors that one task of a pass holds.
BLOCK, TASK = 1 << 21, 1 << 25
#: Residuals of locked pairs, in units of the largest value; the next pair's is looser.
PRECISION = 64 * np.finfo(float).eps
LOOSE = 1e-6
#: Values below this share of the largest are rounding: the component is absent.
SMALLEST = 1e-12
#: MINRES steps for one correction, how far they reduce the residual, and outer rounds.
INNER, REDUCE, OUTER = 20, 1e-3, 300
#: Search space, in blocks of wanted pairs, before it is cut back to half of them.
SPACE = 6
SEED = 11


def vectors(df: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """key and ``x`` (array of long) of the rows that have a whole vector.

    Rows go whose vector is null or empty, holds a null, NaN or infinity or an entry whose
    x is beyond a long, or has another length than most (of equally many, the longest).
    """
    v = F.col(f"`{vector}`")
    whole = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(2.0**52)), F.lit(False)))
    x = F.transform(v, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)
    found = df.where(v.isNotNull() & (F.size(v) > 0) & whole).select(F.col(f"`{key}`").alias(key), x.alias("x"))
    length = found.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found.where(F.size("x") == (length["d"] if length else -1))


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``n x - S``, exactly: as 64-bit integers, or as Python's where those are too short."""
    largest = max((abs(int(x.max())), abs(int(x.min())))) if x.size else 0
    if n * largest + max(map(abs, map(int, sums)), default=0) < 1 << 62:
        return x * np.int64(n) - sums.astype(np.int64)
    return x.astype(object) * n - sums


def squares(c: np.ndarray) -> pa.Array:
    """Sum of squares of each row, exactly."""
    if c.dtype != object:
        largest = max((abs(int(c.max())), abs(int(c.min())))) if c.size else 0
        if largest * largest * c.shape[1] < 1 << 63:
            return pa.array((c * c).sum(1)).cast(pa.decimal128(38, 0))
        c = c.astype(object)
    return pa.array([Decimal(int(v)) for v in (c * c).sum(1)], pa.decimal128(38, 0))


@dataclass
class Fit:
    """Mean and leading components: plain numbers, of the size of the dimensions."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float
    passes: int


class Covariance:
    """The rows of ``x`` in cached blocks, and products with their covariance."""

    def __init__(self, rows: DataFrame) -> None:
        self.passes = 0

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column(0)) if batch.num_rows else np.zeros((0, 1), np.int64)
                step = max(1, BLOCK // (8 * x.shape[1]))
                for k in range(0, len(x), step):
                    part = np.ascontiguousarray(x[k : k + step])
                    exact = part if np.abs(part).max() < 1 << 40 else part.astype(object)
                    sums = pa.array([[Decimal(int(v)) for v in exact.sum(0)]], pa.list_(pa.decimal128(38, 0)))
                    yield pa.RecordBatch.from_arrays([pa.array([len(part)]), pa.array([part.tobytes()]), sums], names=["n", "x", "sums"])

        packed = cut_lineage(rows.select("x").mapInArrow(pack, "n long, x binary, sums array<decimal(38,0)>"))
        totals = packed.select("n", F.posexplode("sums")).groupBy("pos").agg(F.sum("n").alias("n"), F.sum("col").cast("string").alias("s"))
        found = totals.orderBy("pos").collect()  # a row for each dimension
        self.dims, self.n = len(found), found[0]["n"] if found else 0
        self.sums = np.array([int(r["s"]) for r in found], object)
        n, sums, dims = self.n, self.sums, self.dims

        def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for raw in batch.column(0).to_pylist():
                    c = centred(np.frombuffer(raw, np.int64).reshape(-1, dims), n, sums)
                    c = (c / n).astype(float)
                    yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()]), pa.array([float((c * c).sum())])], names=["c", "squares"])

        tasks = 1 + n * dims * 8 // TASK
        self.blocks = packed.select("x").coalesce(tasks).mapInArrow(centre, "c binary, squares double").persist(StorageLevel.MEMORY_AND_DISK)
        self.trace = (self.blocks.agg(F.sum("squares")).first()[0] or 0.0) / max(n, 1)

    def sum_over_blocks(self, part: Callable[[np.ndarray], np.ndarray], rows: int, columns: int) -> np.ndarray:
        """The sum of ``part(block)``, a matrix of ``rows`` by ``columns``, over all blocks."""
        dims = self.dims
        self.passes += 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((rows, columns))
            for batch in batches:
                for raw in batch.column(0).to_pylist():
                    total += part(np.frombuffer(raw).reshape(-1, dims))
            arrays = [pa.array(np.arange(rows)), *[pa.array(np.ascontiguousarray(total[:, j])) for j in range(columns)]]
            yield pa.RecordBatch.from_arrays(arrays, names=["i", *[f"c{j}" for j in range(columns)]])

        schema = ", ".join(["i long", *[f"c{j} double" for j in range(columns)]])
        parts = self.blocks.select("c").mapInArrow(run, schema)
        found = parts.groupBy("i").agg(*[F.sum(f"c{j}") for j in range(columns)]).collect()
        out = np.zeros((rows, columns))
        for row in found:
            out[row[0]] = row[1:]
        return out

    def times(self, w: np.ndarray) -> np.ndarray:
        """``V w``, one pass."""
        return self.sum_over_blocks(lambda c: c.T @ (c @ w), self.dims, w.shape[1]) / self.n

    def covariance_of(self, w: np.ndarray) -> np.ndarray:
        """The covariance of the vectors' products with ``w``, centred by its own mean."""
        k = w.shape[1]
        mean = self.sum_over_blocks(lambda c: (c @ w).sum(0, keepdims=True), 1, k)[0] / self.n
        return self.sum_over_blocks(lambda c: (c @ w - mean).T @ (c @ w - mean), k, k) / self.n


def _orthonormal(new: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    """The directions of ``new`` that are not in ``bases``, orthonormal."""
    found = np.zeros((len(new), 0))
    for t in new.T:
        size = np.linalg.norm(t)
        for _ in range(3):  # repeated, for cancellation
            for basis in (*bases, found):
                t = t - basis @ (basis.T @ t)
        left = np.linalg.norm(t)
        if size > 0 and left > 1e-10 * size:
            found = np.hstack([found, (t / left)[:, None]])
    return found


def minres(times: Callable[[np.ndarray, np.ndarray], np.ndarray], rhs: np.ndarray, steps: int = INNER, reduce: float = REDUCE) -> np.ndarray:
    """Approximate solutions of ``times(x) = rhs`` for symmetric operators, all columns in lockstep.

    ``times(v, live)`` applies to each column its own operator and returns the ``live``
    ones. A column stands still once its residual is below ``reduce`` of its start or its
    Krylov space is full.
    """
    gamma = np.linalg.norm(rhs, axis=0)
    start, live = gamma.copy(), gamma > 0
    v = np.divide(rhs, gamma, out=np.zeros_like(rhs), where=live)
    x, v_old, w, w_old = (np.zeros_like(rhs) for _ in range(4))
    eta, c, c_old = gamma.copy(), np.ones_like(gamma), np.ones_like(gamma)
    s, s_old = np.zeros_like(gamma), np.zeros_like(gamma)
    for _ in range(steps):
        if not live.any():
            break
        image = np.zeros_like(rhs)
        image[:, live] = times(v, live)
        delta = (v * image).sum(0)
        v_new = image - delta * v - gamma * v_old
        beta = np.linalg.norm(v_new, axis=0)
        a0 = c * delta - c_old * s * gamma
        a1 = np.hypot(a0, beta)
        a2, a3 = s * delta + c_old * c * gamma, s_old * gamma
        live = live & (a1 > 0)
        safe = np.where(a1 > 0, a1, 1.0)
        c_old, s_old, c, s = c, s, a0 / safe, beta / safe
        w, w_old = np.where(live, (v - a3 * w_old - a2 * w) / safe, w), w
        x = np.where(live, x + c * eta * w, x)
        eta = np.where(live, -s * eta, eta)
        v_old = v
        live = live & (np.abs(eta) > reduce * start) & (beta > 1e-14 * (np.abs(delta) + gamma + beta))
        v = np.divide(v_new, beta, out=np.zeros_like(rhs), where=live)
        gamma = beta
    return x


def leading(v: Covariance, k: int, precision: float = PRECISION) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and unit eigenvectors (columns)."""
    d = v.dims
    k = min(k, d)
    follow = min(k + 1, d)  # one more pair than wanted
    most = min(d, SPACE * (follow + 1))
    locked, values = np.zeros((d, 0)), np.zeros(0)
    space = _orthonormal(np.random.default_rng(SEED).standard_normal((d, min(d, follow + 2))))
    image = v.times(space)
    for _ in range(OUTER):
        h = space.T @ image
        theta, y = np.linalg.eigh((h + h.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        u, au = space @ y, image @ y
        scale = max(float(np.abs(np.append(values, theta)).max()), np.finfo(float).tiny)
        r = au - theta * u
        r -= locked @ (locked.T @ r)
        size = np.linalg.norm(r, axis=0) / scale
        whole = space.shape[1] + locked.shape[1] >= d  # nothing is left to search
        done = 0
        while done < len(theta) and locked.shape[1] + done < k and (size[done] <= precision or (whole and size[done] <= 100 * precision)):
            done += 1
        if done:
            locked, values = np.hstack([locked, u[:, :done]]), np.append(values, theta[:done])
            u, au, theta, r, size = u[:, done:], au[:, done:], theta[done:], r[:, done:], size[done:]
            space, image = u, au
        missing = follow - locked.shape[1]
        if locked.shape[1] == k:
            if not missing or not len(theta) or size[0] <= LOOSE or whole:
                # Were the next one larger, a vector would have been missed: take it in and go on.
                if not len(theta) or theta[0] <= values[-1] * (1 + 1e-9) + scale * precision:
                    order = np.argsort(-values, kind="stable")
                    return values[order], locked[:, order]
                space = np.hstack([locked, space])
                image = v.times(space)
                locked, values = np.zeros((d, 0)), np.zeros(0)
                continue
        wanted = max(1, min(follow - locked.shape[1] + 1, len(theta)))
        space, image = u, au
        if space.shape[1] + wanted > most:
            keep = max(wanted + 2, most // 2)
            space, image = space[:, :keep], image[:, :keep]
        # Corrections of the pairs that are not there yet.
        open_pairs = np.flatnonzero(size[:wanted] > precision)
        block = np.hstack([locked, u[:, :wanted]])
        project = lambda t, b=block: t - b @ (b.T @ t)
        shift = theta[open_pairs]

        def shifted(t: np.ndarray, live: np.ndarray, p=project, s=shift) -> np.ndarray:
            t = p(t[:, live])
            return p(v.times(t) - s[live] * t)

        steps = min(INNER, max(1, d - block.shape[1]))
        t = minres(shifted, project(-r[:, open_pairs]), steps) if block.shape[1] < d else np.zeros((d, 0))
        fresh = _orthonormal(np.hstack([t, r[:, open_pairs]]), locked, space)[:, : max(0, most - space.shape[1])]
        if not fresh.shape[1]:
            if whole:
                # Rounding is all that is left: fresh products, then accept what they give.
                space = _orthonormal(space, locked)
                image = v.times(space)
                precision *= 4
                continue
            fresh = _orthonormal(np.random.default_rng(SEED + v.passes).standard_normal((d, 1)), locked, space)
        space, image = np.hstack([space, fresh]), np.hstack([image, v.times(fresh)])
    raise RuntimeError(f"no convergence in {OUTER} rounds")


def fit(rows: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """Mean and components of the rows of ``x``; None without rows."""
    v = Covariance(rows)
    try:
        if not v.n:
            return None
        values, basis = leading(v, components)
        kept = values > max(SMALLEST * values[0], 0) if v.trace > 0 else np.zeros(len(values), bool)
        values, basis = values[kept], basis[:, kept]
        error = float(np.abs(v.covariance_of(basis / np.sqrt(values)) - np.eye(len(values))).max()) if len(values) else 0.0
        return Fit(v.n, v.sums, values, basis, v.trace, error, v.passes)
    finally:
        v.blocks.unpersist()


COLUMNS = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(df: DataFrame, components: int = COMPONENTS, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """A row for each whole vector and component: key, component, n, deviation, whitened, explained, identity_error.

    Rows without a whole vector (see ``vectors``) are left out, of the fit as well; a null
    key is a key like any other, and repeated rows count as often as they come. Equal
    eigenvalues have some orthonormal basis of their space. Components of no variance are
    absent: fewer than ``components`` where the vectors span fewer dimensions, none where
    all are equal, in a single vector or in an empty table. Other columns are ignored.
    """
    rows = vectors(df, vector, key)
    name = rows.columns[0]
    schema = rows.select(name).schema
    empty = f"`{name}` {schema[0].dataType.simpleString()}, {COLUMNS}"
    model = fit(rows, components)
    if model is None or not len(model.values):
        return df.sparkSession.createDataFrame([], empty)
    n, sums, k = model.n, model.sums, len(model.values)
    basis = model.vectors / np.sqrt(model.values)
    explained = np.asarray(model.values / model.trace)
    error = model.identity_error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            step = max(1, BLOCK // (8 * len(basis)))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                c = centred(matrix(batch.column(1)), n, sums)
                m = len(c)
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(each),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, n)),
                        squares(c).take(each),
                        pa.array(((c / n).astype(float) @ basis).ravel()),
                        pa.array(np.tile(explained, m)),
                        pa.array(np.full(m * k, error)),
                    ],
                    names=[name, *[c.split()[0] for c in COLUMNS.split(", ")]],
                )

    return rows.mapInArrow(run, empty)
