"""Nearest neighbours against brute force, in all three ways."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from vidmatch.operators import knn as K
from vidmatch.sources.vector_index import VectorIndex


def frame(spark, vectors, name, start=0, model="m"):
    rows = [(f"{name}{start + i:04d}", [float(x) for x in v], model) for i, v in enumerate(vectors)]
    key = "uuid" if name == "q" else "id"
    return spark.createDataFrame(rows, f"{key} string, embedding array<double>, embedding_model_id string")


def brute(q, b, k):
    d = np.sqrt(((q[:, None, :] - b[None, :, :]) ** 2).sum(2))
    out = set()
    for i, row in enumerate(d):
        order = sorted(range(len(b)), key=lambda j: (row[j], j))[:k]
        out |= {(f"q{i:04d}", f"b{j:04d}", round(float(row[j]), 6), r + 1) for r, j in enumerate(order)}
    return out


def found(df):
    return {(r["uuid"], r["id"], round(r["distance"], 6), r["rank"]) for r in df.collect()}


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(6, 16)) * 4
    base = np.concatenate(
        [
            centres[rng.integers(0, 6, 300)] + rng.normal(size=(300, 16)),
            # a third of all rows are copies of one vector
            np.repeat(centres[:1], 150, axis=0),
        ]
    )
    queries = np.concatenate([base[:20], centres[:2], rng.normal(size=(20, 16))])
    return queries, base


@pytest.mark.parametrize("k", [1, 10, 200, 500])
def test_broadcast_path(spark, data, k):
    q, b = data
    assert found(K.knn(frame(spark, q, "q"), frame(spark, b, "b"), k)) == brute(q, b, k)


ROW = 16 * 8 + 64  # bytes of a query


@pytest.mark.parametrize("rows", [2, 9, 1000])
def test_blocks_of_queries(spark, data, rows):
    q, b = data
    got = K.knn(frame(spark, q, "q"), frame(spark, b, "b").repartition(5), 10, max_broadcast_bytes=rows * ROW)
    assert found(got) == brute(q, b, 10)


def test_blocks_with_tiny_base_blocks(spark, data, monkeypatch):
    q, b = data
    monkeypatch.setattr(K, "BLOCK_BYTES", 16 * 8 * 20)
    monkeypatch.setattr(K, "PAIR_LIMIT", 64)
    for rows in (15, 1000):
        got = K.knn(frame(spark, q, "q"), frame(spark, b, "b"), 10, max_broadcast_bytes=rows * ROW)
        assert found(got) == brute(q, b, 10)


def test_the_bound_keeps_the_kth_neighbour_and_cuts_the_rest(spark, data):
    q, b = data
    vecs = K.vectors(frame(spark, q, "q"), "uuid", "embedding", None, "qid")
    base = K.vectors(frame(spark, b, "b").repartition(20), "id", "embedding", None, "bid")
    kinds = vecs.schema["qid"].dataType, base.schema["bid"].dataType
    wanted = K.bounded(base, K.Wanted(vecs.toArrow()), 5, *kinds, share=4)
    exact = np.sort(np.sqrt(((q[:, None] - b[None]) ** 2).sum(2)), 1)[:, 4]
    assert (wanted.bound["16"] >= exact - 1e-9).all() and np.isfinite(wanted.bound["16"]).all()
    free, cut = K.scan(base, K.Wanted(wanted.block), 5, *kinds).count(), K.scan(base, wanted, 5, *kinds).count()
    assert cut < free


def test_repeated_query_ids_share_their_neighbours(spark):
    """Rows of one id, in one block or several, are one query."""
    base = spark.createDataFrame([(f"b{i}", [float(i)]) for i in range(20)], "id string, embedding array<double>")
    queries = spark.createDataFrame([("q", [0.2]), ("q", [10.3]), ("p", [19.0])], "uuid string, embedding array<double>")
    want = [("p", "b19", 1), ("p", "b18", 2), ("q", "b0", 1), ("q", "b10", 2)]
    for limit in (64 << 20, 80):
        assert _pairs(K.knn(queries, base, 2, max_broadcast_bytes=limit)) == sorted(want)


def test_spaces_are_not_mixed(spark, data):
    q, b = data
    base = frame(spark, b, "b").unionByName(frame(spark, b[:, :4], "b", start=5000))
    assert found(K.knn(frame(spark, q, "q"), base, 5)) == brute(q, b, 5)
    other = frame(spark, b, "b").unionByName(frame(spark, b + 0.001, "b", start=5000, model="x"))
    assert found(K.knn(frame(spark, q, "q"), other, 5, same_model=True)) == brute(q, b, 5)
    mixed = K.knn(frame(spark, q, "q"), other, 5, same_model=True, max_broadcast_bytes=20 * ROW)
    assert found(mixed) == brute(q, b, 5)


def test_empty_sides(spark, data):
    q, b = data
    nothing = frame(spark, b, "b").limit(0)
    assert K.knn(frame(spark, q, "q"), nothing, 3).count() == 0
    assert K.knn(frame(spark, q, "q").limit(0), frame(spark, b, "b"), 3).count() == 0
    assert K.knn(frame(spark, q, "q"), nothing, 3, max_broadcast_bytes=20 * ROW).count() == 0


def test_ivf_all_cells_is_exact_and_recall_is_reported(spark, data):
    q, b = data
    base = frame(spark, b, "b")
    model = K.ivf_fit(base, cells=6)
    exact = brute(q, b, 10)
    assert found(K.ivf_knn(frame(spark, q, "q"), base, model, 10, nprobe=6)) == exact
    some = found(K.ivf_knn(frame(spark, q, "q"), base, model, 10, nprobe=3))
    pairs = lambda rows: {(a, i) for a, i, *_ in rows}
    recall = len(pairs(some) & pairs(exact)) / len(exact)
    assert recall > 0.7


def test_the_base_is_never_in_a_shuffle(spark, data, tmp_path):
    q, b = data
    frame(spark, b, "b").write.parquet(str(tmp_path / "b"))
    base = K.vectors(spark.read.parquet(str(tmp_path / "b")), "id", "embedding", None, "bid")
    block = K.Wanted(K.vectors(frame(spark, q, "q"), "uuid", "embedding", None, "qid").toArrow())
    kind = base.schema["bid"].dataType
    one = K.knn(frame(spark, q, "q"), spark.read.parquet(str(tmp_path / "b")), 5)
    tree = K.merged(K.scan(base, block, 5, kind, kind), 5, tree=True)
    ivf = K.ivf_knn(frame(spark, q, "q"), spark.read.parquet(str(tmp_path / "b")), K.ivf_fit(spark.read.parquet(str(tmp_path / "b")), 4), 5, 2)
    for hits in (one, tree, ivf):
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        assert "Exchange" not in plan[plan.index("MapInArrow"):]


def test_unknown_metric(spark, data):
    q, b = data
    with pytest.raises(ValueError):
        K.knn(frame(spark, q, "q"), frame(spark, b, "b"), 5, metric="cosine")


def _dirty(spark):
    rng = np.random.default_rng(9)
    rows = [(f"b{i:03d}", [float(x) for x in rng.normal(size=8)], f"m{i % 100}") for i in range(400)]
    bad = [[float("nan")] * 8, [1.0, None, *[0.0] * 6], [float("inf"), *[0.0] * 7], [1e200, *[0.0] * 7], [], None]
    rows += [(f"x{i}", v, "m1") for i, v in enumerate(bad)]
    base = spark.createDataFrame(rows, "id string, embedding array<double>, embedding_model_id string")
    queries = base.where("id < 'b030' or id >= 'x'").withColumnRenamed("id", "uuid")
    return queries, base


def _pairs(df):
    return sorted((r["uuid"], r["id"], r["rank"]) for r in df.collect())


def test_dirty_vectors_lose_no_neighbour_on_either_path(spark):
    queries, base = _dirty(spark)
    near = _pairs(K.knn(queries, base, 10))
    assert len(near) == 300 and not any(r[1].startswith("x") for r in near)
    assert _pairs(K.knn(queries, base, 10, max_broadcast_bytes=1000)) == near
    assert K.incomparable(base).count() == 6


def test_many_spaces_on_either_path(spark):
    queries, base = _dirty(spark)
    near = _pairs(K.knn(queries, base, 3, same_model=True))
    assert near and _pairs(K.knn(queries, base, 3, same_model=True, max_broadcast_bytes=1000)) == near


def test_large_common_offset(spark):
    rng = np.random.default_rng(10)
    values = rng.normal(size=(120, 8)) + 1e6
    base = spark.createDataFrame([(f"b{i:03d}", [float(x) for x in v]) for i, v in enumerate(values)], "id string, embedding array<double>")
    queries = base.where("id < 'b050'").withColumnRenamed("id", "uuid")
    wanted = []
    for i in range(50):
        dist = np.sqrt(((values - values[i]) ** 2).sum(1))
        order = np.lexsort((np.arange(120), dist))[:5]
        wanted += [(f"b{i:03d}", f"b{j:03d}", r + 1) for r, j in enumerate(order)]
    for limit in (64 << 20, 2000):
        assert _pairs(K.knn(queries, base, 5, max_broadcast_bytes=limit)) == sorted(wanted)


@pytest.fixture(scope="module")
def index(spark, data, tmp_path_factory):
    base = frame(spark, data[1], "b")
    made = VectorIndex(str(tmp_path_factory.mktemp("index")))
    made.fit(base, 6)
    made.append(base.where("id < 'b0200'"), 0)
    made.append(base.where("id >= 'b0200'"), 1)
    return made


def test_index_is_exact_without_nprobe_and_with_all_cells(spark, data, index):
    q, b = data
    queries = frame(spark, q, "q")
    for k in (1, 10, 200):
        assert found(index.search(queries, k)) == brute(q, b, k)
    assert found(index.search(queries, 10, max_broadcast_bytes=9 * ROW)) == brute(q, b, 10)
    assert found(index.search(queries, 10, nprobe=6)) == brute(q, b, 10)
    pairs = lambda rows: {(a, i) for a, i, *_ in rows}
    near = pairs(found(index.search(queries, 10, nprobe=3)))
    assert len(near & pairs(brute(q, b, 10))) / len(brute(q, b, 10)) > 0.7
    assert index.search(queries.limit(0), 3).count() == 0


def test_index_reads_the_wanted_folders_only(spark, index):
    plan = index.vectors(spark, "16", [2, 4])._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters"):]
    assert "cell" in filters[: filters.index("PushedFilters")] and "space" in filters[: filters.index("PushedFilters")]
    files = {r[0] for r in index.vectors(spark, "16", [2]).select(F.input_file_name()).distinct().collect()}
    assert files and all("/space=16/cell=2/" in f for f in files)


def test_index_batches_replace_themselves(spark, data, index):
    """A repeated batch changes nothing, a later one is found, centres stay as they were."""
    q, b = data
    before = index.centres(spark)
    index.append(frame(spark, b, "b").where("id >= 'b0200'"), 1)
    index.append(frame(spark, q[:3] + 1e-7, "b", start=7000), 2)
    assert {s: c.tolist() for s, c in index.centres(spark).items()} == {s: c.tolist() for s, c in before.items()}
    assert index.sizes(spark).agg(F.sum("n")).first()[0] == len(b) + 3
    near = {r["uuid"]: r["id"] for r in index.search(frame(spark, q[20:22], "q", start=20), 1).collect()}
    assert set(near) == {"q0020", "q0021"}
    ids = {r["id"] for r in index.search(frame(spark, q[:3], "q"), 2, nprobe=1).collect()}
    assert ids & {"b7000", "b7001", "b7002"}
    index.append(frame(spark, q[:0], "b"), 2)
    assert index.sizes(spark).agg(F.sum("n")).first()[0] == len(b)


def test_index_spaces(spark, data, tmp_path):
    """Models do not meet, a space without centres is refused, dirty vectors are left out."""
    q, b = data
    both = frame(spark, b[:60], "b").unionByName(frame(spark, b[:40] + 0.001, "b", start=5000, model="x"))
    made = VectorIndex(str(tmp_path / "i"), model="embedding_model_id")
    made.fit(both, 3)
    dirty = spark.createDataFrame([("n", [float("nan")] * 16, "m"), ("e", [], "m"), ("z", None, "x")], both.schema)
    made.append(both.unionByName(dirty))
    assert found(made.search(frame(spark, q, "q"), 5)) == brute(q, b[:60], 5)
    with pytest.raises(ValueError):
        made.append(frame(spark, b[:3], "b", model="new"), 1)
    assert made.search(frame(spark, q, "q", model="new"), 5).count() == 0


@pytest.mark.parametrize("columns", [3, 10, 100, 700])
def test_block_finds_the_nearest_with_few_looks_for_the_kth(monkeypatch, columns):
    rng = np.random.default_rng(columns)
    b = rng.integers(0, 3, (columns, 4)).astype(float)  # many equal distances
    b[columns // 2 :] += rng.normal(size=(columns - columns // 2, 4)) * 1e-3
    q = np.concatenate([b[:20], rng.normal(size=(60, 4)) * 2])
    ids = pa.array([f"v{(i * 11) % columns}" for i in range(columns)])
    looked = []
    partition = np.partition
    monkeypatch.setattr(K.np, "partition", lambda a, *rest, **more: looked.append(a.shape) or partition(a, *rest, **more))
    monkeypatch.setattr(K, "PAIR_LIMIT", 5000)
    dist = np.sqrt(((q[:, None] - b[None]) ** 2).sum(2))
    want = [sorted(zip(dist[i].tolist(), ids.to_pylist(), strict=True))[:10] for i in range(len(q))]

    def found(bound):
        looked.clear()
        r, c, d = K._top_block(q, b, ids, 10, bound)
        return [sorted(zip(d[r == i].tolist(), ids.take(pa.array(c[r == i])).to_pylist(), strict=True)) for i in range(len(q))]

    close = lambda a, b: [[n for _, n in x] for x in a] == [[n for _, n in x] for x in b]
    assert close(found(None), want)
    # Without a bound the k-th is looked for among groups of columns, with a good one hardly ever.
    assert columns < 700 or (looked and max(w for _, w in looked) <= columns // K.GROUP)
    worst = np.array([w[-1][0] for w in want])
    assert close(found(worst), want)
    assert columns < 700 or sum(n for n, _ in looked) < len(q)


def test_cells_that_every_query_probes_are_scanned_together(spark):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(300, 3)).tolist()
    base = spark.createDataFrame([(f"v{i}", p) for i, p in enumerate(points)], "bid string, vec array<double>").withColumn("space", F.lit("3"))
    q = pa.table({"qid": [f"q{i}" for i in range(40)], "space": ["3"] * 40, "vec": points[:40]})
    placed = K.assign(base, {"3": np.array(points[:6])})
    every = np.arange(40)
    whole = K.Wanted(q, {"3": {c: every for c in range(6)}})
    mixed = K.Wanted(q, {"3": {c: every if c in (1, 4) else every[c::2] for c in range(5)}})
    cell = {r["bid"]: r["cell"] for r in placed.collect()}
    for wanted in (whole, mixed):
        hits = K.merged(K.scan(placed, wanted, 7, placed.schema["bid"].dataType, placed.schema["bid"].dataType), 7).collect()
        got = {i: sorted((round(h["distance"], 9), h["bid"]) for h in hits if h["qid"] == f"q{i}") for i in range(40)}
        for i in range(40):
            own = [c for c, rows in wanted.cells["3"].items() if i in rows]
            near = sorted((round(float(np.linalg.norm(np.subtract(points[i], p))), 9), f"v{j}") for j, p in enumerate(points) if cell[f"v{j}"] in own)
            assert got[i] == near[:7]
