import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from vidmatch.llm import exact, fuse


def brute(rows):
    """(doc_id, keep_id, group_size, kept, sha) in order; of repeated rows the first is kept."""
    groups = {}
    for k, (doc, text) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(((doc is None, doc or 0), k))
    out = []
    for clean, members in groups.items():
        first = min(members)
        for (_, doc), k in members:
            keep = rows[first[1]][0]
            out.append((rows[k][0], keep, len(members), k == first[1], hashlib.sha256(clean.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect()], key=str)


TEXTS = ["a b", "a  b", "a\tb", "c", None, "", " ", "c", "d" * 5000, "d" * 5000, "e", "A b"]


def test_against_brute_force_for_any_split(docs_of):
    rows = list(enumerate(TEXTS))
    docs = docs_of(TEXTS)
    for older in (None, F.lit(True), F.lit(False), F.col("key") < 5):
        assert got(exact.decide(docs, older=older)) == brute(rows)


def test_equal_digests_of_unequal_texts(docs_of):
    weak = lambda text: F.substring(exact.sha256(text), 1, 1).cast("binary") if text is None else F.encode(F.substring(text, 1, 1), "UTF-8")
    assert got(exact.decide(docs_of(TEXTS), digest=weak)) == brute(list(enumerate(TEXTS)))


def test_hot_group_in_parts(docs_of, monkeypatch):
    monkeypatch.setattr(exact, "PART", 7)
    monkeypatch.setattr(exact, "BUCKET", 16)
    texts = ["hot"] * 60 + [f"t{i % 90}" for i in range(140)]
    assert got(exact.decide(docs_of(texts))) == brute(list(enumerate(texts)))


def test_repeated_rows_null_keys_and_empty_tables(docs_of):
    docs = docs_of(["x", "x", "x", "y", "y", "z"], [3, 3, 1, None, None, None])
    kept = exact.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept.collect()) == [(-1, "y"), (-1, "z"), (1, "x")]
    assert exact.keep_first(docs_of([])).count() == 0 and exact.decide(docs_of([])).count() == 0


def test_filters_hold_their_keys_and_few_others():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 10, 1000, 60_000):
        keys = rng.integers(-(1 << 63), 1 << 63, n, dtype=np.int64)
        built = fuse.build(np.append(keys, keys[:5]))
        assert built.holds(keys).all()
        others = rng.integers(-(1 << 63), 1 << 63, 100_000, dtype=np.int64)
        assert built.holds(others).mean() < 0.001
        # 18 bits a key when large; the published factor is 1.375 at 1000 keys, rounded up to whole segments
        assert n < 1000 or len(built.cells) <= (1.375 if n == 1000 else 1.25) * n + 2 * built.segment


def test_columns_of_the_operators_own_names(spark, docs_of):
    """A user's ``row`` is no row number, and rows without a key are still told apart."""
    texts = ["x", "x", "x ", "y", None, "", "x"]
    docs = docs_of(texts).withColumn("row", F.lit(0)).withColumn("keep", F.lit("k")).withColumn("key", F.lit(None).cast("int"))
    assert got(exact.decide(docs)) == brute(list(enumerate(texts)))
    for clash in (docs, docs.withColumn("row_1", F.lit(1)), docs.withColumn("row_of_dedup", F.lit(2))):
        kept = exact.keep_first(clash)
        assert kept.columns == clash.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3, 4]


def test_many_rows_of_one_text_without_a_key(spark):
    docs = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same text " * 20).alias("text"))
    rows = exact.decide(docs).groupBy("kept", "group_size").count().collect()
    assert sorted((r["kept"], r["group_size"], r["count"]) for r in rows) == [(False, 100_000, 99_999), (True, 100_000, 1)]
