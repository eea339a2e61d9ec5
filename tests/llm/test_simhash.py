import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from vidmatch.llm import simhash
from vidmatch.llm.components import components


def brute_print(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints):
    """Smallest index reachable over links of at most two bits."""
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 2 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def texts():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(300)] + ["Éa", "x" * 500, "ÀB"]
    out = [None, "", "  \n", "One", "one TWO", " one  two\n", "a b c", "A  B\tC"]
    for _ in range(60):
        words = list(rng.choice(vocabulary, rng.integers(3, 400)))
        out.append(" ".join(words))
        if rng.random() < 0.6:
            words[rng.integers(len(words))] = "changed"
            out.append("\n ".join(words))
    return out


def test_classes_against_brute_force(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, print string, key string").repartition(3)
    docs = docs.withColumn("row", F.lit(0)).withColumn("best", F.lit("b"))
    prints = [brute_print(t) for _, t, *_ in rows]
    wanted = brute_classes(prints)
    for pairwise in (128, 1):  # 1: every key goes by points
        got = sorted(simhash.classes(docs, pairwise=pairwise).collect(), key=lambda r: r["doc_id"])
        assert [r["fingerprint"] for r in got] == [f"{p:016x}" for p in prints]
        assert [r["component_id"] for r in got] == wanted
        assert all(r["stays"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_links_of_random_and_chained_prints(spark):
    rng = np.random.default_rng(5)
    prints = [int(x) for x in rng.integers(0, 1 << 63, 40)]
    for p in prints[:20]:
        for _ in range(6):  # chains: each step within two bits
            a, b = rng.choice(64, 2, replace=False)
            p ^= 1 << int(a) ^ 1 << int(b)
            prints.append(p)
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    label = brute_classes(prints)
    frame = spark.createDataFrame([(s,) for s in signed], "print long")
    for pairwise in (128, 1):
        roots = {r["node"]: r["root"] for r in components(simhash.links(frame, pairwise=pairwise)).collect()}
        root = [roots.get(s, s) for s in signed]
        assert all((root[i] == root[j]) == (label[i] == label[j]) for i in range(len(root)) for j in range(i))


def test_keep_first_with_repeated_rows_and_null_keys(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (7, "q r s t u v w"), (None, "only here it is")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.keep_first(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(5, "a b c d"), (7, "q r s t u v w"), (None, "only here it is")], key=str)
    assert simhash.classes(docs.limit(0)).count() == 0
    clash = docs.withColumn("row", F.lit(0)).withColumn("row_1", F.lit(0)).withColumn("row_of_simhash", F.lit(1))
    assert simhash.keep_first(clash).columns == clash.columns and simhash.keep_first(clash).count() == 3


def test_components(spark):
    edges = [(1, 2), (3, 2), (3, 4), (10, 9), (5, 5), *[(100, i) for i in range(101, 140)], *[(i, i + 1) for i in range(200, 260)]]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in (1, 2, 3, 4)} == {1} and got[10] == got[9] == 9
    assert {got[i] for i in range(100, 140)} == {100} and {got[i] for i in range(200, 261)} == {200}
