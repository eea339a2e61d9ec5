import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from vidmatch.llm import sharding


def plain_places(n, seed=sharding.SEED):
    """The permutation in plain integers."""
    a = max(sharding.Shuffle(n).a, 1)
    b = sharding.Shuffle(n).b

    def spread(half, key):
        x = (half + key) & sharding.MASK
        for factor, shift in ((sharding.MIX_A, 15), (sharding.MIX_B, 13)):
            x = (x * factor) & sharding.MASK
            x ^= x >> shift
        return x

    def once(p):
        x, y = p % a, p // a
        for k, m in sharding.round_keys(seed):
            x = (x + spread(y, k)) % a
            y = (y + spread(x, m)) % b
        return y * a + x

    out = []
    for p in range(n):
        p = once(p)
        while p >= n:
            p = once(p)
        out.append(p)
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 7, 25, 130, 2503])
def test_permutation_and_its_inverse(spark, n):
    shuffle = sharding.Shuffle(n, 5)
    rows = spark.range(n).withColumn("p", shuffle.place(F.col("id"), shuffle.steps(spark)))
    placed = [r["p"] for r in rows.orderBy("id").collect()]
    assert placed == plain_places(n) and sorted(placed) == list(range(n))
    at = rows.select("id", shuffle.shard(F.col("p")).alias("shard"), shuffle.slot(F.col("p")).alias("slot"))
    assert shuffle.source(spark, at).where("row <> id or row is null").isEmpty()
    beyond = spark.createDataFrame([(0, n), (5, 0), (-1, 0), (0, -1)], "shard int, slot long")
    assert {r["row"] for r in shuffle.source(spark, beyond).collect()} == {None}


def test_order_of_rows_is_lost(spark):
    placed = plain_places(10_000)
    after = Counter((b - a) % 10_000 for a, b in zip(placed, placed[1:], strict=False))
    assert max(after.values()) < 20
    assert plain_places(10_000, 1) != placed


def test_every_row_gets_one_place(spark, docs_of, odd_texts):
    texts = [*odd_texts, *["hot copy"] * 60]
    docs = docs_of(texts, [None if i % 4 == 0 else i // 2 for i in range(len(texts))])
    placed, shuffle = sharding.assign(docs, 7)
    assert placed.columns == [*docs.columns, "row_1", "slot", "shard"] and shuffle.rows == len(texts)
    rows = placed.collect()
    assert sorted(r["row_1"] for r in rows) == list(range(len(texts)))
    order = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in sorted(rows, key=lambda r: r["row_1"])]
    assert order == sorted(order)
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(7))
    for shard in range(7):
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(counts[shard]))
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in rows) == sorted((r["doc_id"] or -1, r["text"] or "") for r in docs.collect())


def test_places_do_not_depend_on_partitions(spark, docs_of, odd_texts):
    docs = docs_of(odd_texts)
    first = sorted(map(tuple, sharding.places(docs).collect()))
    assert sorted(map(tuple, sharding.places(docs.repartition(7)).collect())) == first
    for row in sharding.places(docs).collect():
        raw = (odd_texts[row["doc_id"]] or "").encode()
        assert (row["size"], row["text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))
        assert (row["law"], row["grown_shard"]) == ("rows", None)


def test_empty_table_and_more_shards_than_rows(spark, docs_of):
    assert sharding.places(docs_of([])).isEmpty()
    assert {(r["shard"], r["slot"]) for r in sharding.places(docs_of(["a", "b", "c"])).collect()} == {(0, 0), (1, 0), (2, 0)}


def test_written_shards(spark, docs_of, tmp_path):
    docs = docs_of([f"t{i}" for i in range(100)]).drop("row")
    shuffle = sharding.write_shards(docs, str(tmp_path / "out"), 6)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and shuffle.rows == 100
    wrong = back.where((F.col("shard") + F.col("slot") * 6) != shuffle.place(F.col("row"), shuffle.steps(spark)))
    assert wrong.isEmpty()
    with pytest.raises(ValueError):
        sharding.write_shards(docs.withColumn("Shard", F.lit(1)), str(tmp_path / "no"))


def test_sql_agrees(spark, docs_of, odd_texts):
    texts = odd_texts[:5] + ["Ünï çödé 漢字 😀 text"] + [f"t{i}" for i in range(40)]
    docs = docs_of(texts)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    got = sorted(tuple(r)[:6] for r in sharding.places(docs).collect())
    assert got == sorted(r[:6] for r in con.sql(sharding.places_sql()).fetchall())


def test_no_python_in_the_plan(docs_of):
    plan = sharding.assign(docs_of(["a", "b"]))[0]._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
