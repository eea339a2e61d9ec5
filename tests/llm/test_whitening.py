import math
from decimal import Decimal

import numpy as np
import pytest

from vidmatch.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long, component string, x string"


@pytest.fixture()
def frame(spark):
    """Embeddings with clashing extra columns."""

    def make(vectors, ids=None):
        rows = [(i if ids is None else ids[i], v, 0, 7, "c", "x") for i, v in enumerate(vectors)]
        return spark.createDataFrame(rows, SCHEMA).repartition(3) if rows else spark.createDataFrame([], SCHEMA)

    return make


class Plain:
    """Products without Spark."""

    def __init__(self, c):
        self.c, self.passes = c, 0
        self.n, self.dims = c.shape

    def times(self, w):
        self.passes += 1
        return self.c.T @ (self.c @ w) / self.n


@pytest.mark.parametrize(("n", "d", "rank"), [(500, 64, 64), (2000, 3, 3), (10, 64, 64), (400, 300, 300), (400, 64, 5), (90, 1, 1)])
def test_pairs_to_double_precision(n, d, rank):
    rng = np.random.default_rng(n)
    c = rng.standard_normal((n, rank)) @ (np.eye(d) if rank == d else rng.standard_normal((rank, d)))
    c -= c.mean(0)
    values, u = whitening.leading(Plain(c), 8)
    cov = c.T @ c / n
    want = np.linalg.eigvalsh(cov)[::-1][: min(8, d)]
    assert np.abs(values - want).max() < 1e-13 * want[0]
    assert np.abs(cov @ u - u * values).max() < 2e-14 * want[0]
    assert np.abs(u.T @ u - np.eye(len(values))).max() < 1e-13


def test_close_and_equal_values():
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    wanted = np.array([9.0] * 3 + [9 - 1e-9] + [5.0] * 7 + [1.0] * 29)
    c = (q * np.sqrt(wanted)).T * np.sqrt(40)
    values, u = whitening.leading(Plain(c), 8)
    assert np.abs(values - wanted[:8]).max() < 1e-12
    assert np.abs(u.T @ u - np.eye(8)).max() < 1e-12


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(4)
    q = np.linalg.qr(rng.standard_normal((12, 12)))[0]
    a = (q * np.array([-3, -2, -1, 1, 2, 3, 4, 5, 6, 7, 8, 9.0])) @ q.T
    b = rng.standard_normal((12, 3))
    b[:, 1] = 0
    x = whitening.minres(lambda v, live: a @ v[:, live], b, 40, 1e-13)
    assert np.abs(a @ x - b).max() < 1e-10 and not x[:, 1].any()


def check(df, whole, k=8):
    """``df`` holds the whitened rows of ``whole``, a list of (id, vector)."""
    x = np.array([[math.floor(1024 * float(c)) + 100000 for c in v] for _, v in whole], object)
    n, sums = len(x), x.sum(0)
    dev = [int(sum(v * v)) for v in x * n - sums]
    c = ((x * n - sums) / n).astype(float)
    values, u = np.linalg.eigh(c.T @ c / n)
    values, u = values[::-1], u[:, ::-1]
    k = min(k, int((values > 1e-12 * values[0]).sum()))
    got = sorted(df.collect(), key=lambda r: (r["vec_id"] is not None, r["vec_id"] or 0, r["deviation"], r["component"]))
    assert len(got) == k * n and {r["n"] for r in got} == {n}
    order = sorted(range(n), key=lambda i: (whole[i][0] is not None, whole[i][0] or 0, dev[i]))
    assert [(r["vec_id"], r["component"], r["deviation"]) for r in got] == [(whole[i][0], j + 1, dev[i]) for i in order for j in range(k)]
    white = np.array([r["whitened"] for r in got]).reshape(n, k)
    for j in range(k):
        assert abs(got[j]["explained"] - values[j] / values.sum()) < 1e-9 * got[j]["explained"]
    spread = white.T @ white / n - np.outer(white.mean(0), white.mean(0))
    assert np.abs(spread - np.eye(k)).max() < 1e-9
    assert abs(got[0]["identity_error"]) < 1e-9
    if k == min(8, x.shape[1]) and np.all(np.diff(values[: k + 1]) < -1e-6 * values[0]):
        want = c[order] @ u[:, :k] / np.sqrt(values[:k])
        assert np.abs(np.abs(white) - np.abs(want)).max() < 1e-7


def test_against_a_dense_solution(frame):
    rng = np.random.default_rng(1)
    good = [[float(np.float32(c)) for c in v] for v in rng.standard_normal((60, 12)) * np.arange(1, 13)]
    bad = [None, [], [None] * 12, [1.0] * 11 + [float("nan")], [float("inf")] + [1.0] * 11, [1.0, 2.0], [1e30] * 12, [None] + [1.0] * 11]
    vectors = good + bad + good[:5]
    ids = [None if i % 20 == 0 else i // 2 for i in range(len(vectors))]
    whole = [(i, v) for i, v in zip(ids, vectors, strict=True) if v in good]
    out = whitening.whiten(frame(vectors, ids))
    assert out.columns == ["vec_id", *[c.split()[0] for c in whitening.COLUMNS.split(", ")]]
    check(out, whole)


def test_fewer_dimensions_than_components(frame):
    rng = np.random.default_rng(2)
    vectors = [[float(a), float(b), float(a + b)] for a, b in rng.integers(-50, 50, (40, 2))]
    check(whitening.whiten(frame(vectors)), list(enumerate(vectors)))
    check(whitening.whiten(frame([[1.0], [2.0], [2.0]])), [(0, [1.0]), (1, [2.0]), (2, [2.0])])


def test_large_entries_are_exact(frame):
    vectors = [[float(2**45 + 2**23 * i), float(-(2**44)), float(i % 3)] for i in range(9)]
    check(whitening.whiten(frame(vectors)), list(enumerate(vectors)))


def test_nothing_to_fit(frame):
    for vectors in ([], [None, []], [[1.0, 2.0]], [[1.0, 2.0]] * 5):
        assert whitening.whiten(frame(vectors)).isEmpty()


def test_exact_squares():
    c = np.array([[3, -4], [2**40, 2**41]], object)
    assert whitening.squares(c).to_pylist() == [Decimal(25), Decimal(2**80 + 2**82)]
    assert whitening.squares(c[:1].astype(np.int64)).to_pylist() == [Decimal(25)]
