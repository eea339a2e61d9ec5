"""SimHash near duplicates, searched through tables of distances to references.

Fingerprints link when at most two bits differ. The distance to any reference differs
by no more than that for a linked pair. A first table holds the distances to 33
references: the zero fingerprint and one mask for every two bits. Relative to the zero
fingerprint, each mask's coordinate moves only with its own two bits, so that a linked
pair differs in at most two of the 32 coordinates and agrees on all coordinates of at
least three of five groups: the agreeing groups are the keys on which pairs meet. A
second table, of mixed references, discards pairs by their largest coordinate
difference; the rest is verified bit by bit.

Keys on which very many different fingerprints meet are not compared in pairs. Linked
fingerprints have a common neighbour at no more than one bit from both, and around any
point there are at most 65 fingerprints, all of them linked with each other; so
members of such keys meet at those points instead, in groups that cannot grow.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidmatch.llm.arrays import LOWER, blocks, free_name, mixed, ragged, words
from vidmatch.llm.components import components
from vidmatch.session import cut_lineage

SHINGLE, MAX_BITS, SEED = 3, 2, 42
#: Different fingerprints of one key that are compared in pairs; more meet at points.
PAIRWISE = 128

MASKS = np.array([3 << (2 * j) for j in range(32)], np.uint64)
GROUPS = np.array_split(np.arange(32), 5)
#: Further references, spread over all fingerprints.
MIXED = mixed(np.arange(1, 25, dtype=np.uint64))


def distances(prints: np.ndarray, references: np.ndarray) -> np.ndarray:
    """The table of Hamming distances, a row for each fingerprint."""
    return np.bitwise_count(prints[:, None] ^ references[None, :]).astype(np.int16)


def pivot_keys(prints: np.ndarray) -> np.ndarray:
    """Ten keys for each fingerprint; linked fingerprints share at least one."""
    table = distances(prints, MASKS) - distances(prints, np.zeros(1, np.uint64))
    out = np.empty((len(prints), 10), np.uint64)
    for k, chosen in enumerate(combinations(range(5), 3)):
        key = np.full(len(prints), k + 1, np.uint64)
        for j in np.concatenate([GROUPS[g] for g in chosen]):
            key = mixed(key + (table[:, j] + 3).astype(np.uint64))
        out[:, k] = key
    return out


def linked(prints: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Links that join what is linked among the fingerprints: each with the smallest of its group."""
    prints = np.sort(prints)
    table = distances(prints, MIXED)
    near = np.abs(table[:, None, :] - table[None, :, :]).max(2) <= max_bits
    at, to = np.nonzero(np.triu(near, 1))
    real = np.bitwise_count(prints[at] ^ prints[to]) <= max_bits
    at, to = at[real], to[real]
    label = np.arange(len(prints))
    while len(at):
        low = np.minimum(label[at], label[to])
        before = label.copy()
        np.minimum.at(label, at, low)
        np.minimum.at(label, to, low)
        if (before == label).all():
            break
    moved = np.flatnonzero(label != np.arange(len(prints)))
    signed = prints.view(np.int64)
    return [(int(signed[i]), int(signed[label[i]])) for i in moved]


def block_fingerprints(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text of a block."""
    low = LOWER[data]
    starts, ends, first = words(low, offsets)
    lengths = ends - starts + 1
    joined = np.append(low, np.uint8(0))[ragged(starts, lengths)]
    to = np.cumsum(lengths) - 1
    joined[to] = 0x20
    raw, begin = joined.tobytes(), to - lengths + 1
    n = np.diff(first)
    out = np.zeros(len(n), np.uint64)
    # A text of fewer words is one shingle; one without words has none.
    count = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    at = ragged(first[:-1], count)
    last = np.minimum(at + shingle, np.repeat(first[1:], count)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(raw[s:e], SEED) for s, e in zip(begin[at].tolist(), to[last].tolist(), strict=True)], np.uint64)
    some = np.flatnonzero(count)
    edges = np.append(0, np.cumsum(count[some]))
    k = 0
    while k < len(some):  # a limited number of bit rows at a time, whole texts
        stop = max(k + 1, int(np.searchsorted(edges, edges[k] + 100_000, "right")) - 1)
        totals = np.zeros((stop - k, 64), np.int64)
        for a in range(edges[k], edges[stop], 100_000):
            b = min(a + 100_000, edges[stop])
            bits = np.unpackbits(hashes[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            if stop - k == 1:
                totals[0] += bits.sum(0, dtype=np.int64)
            else:
                totals += np.add.reduceat(bits, edges[k:stop] - a, axis=0, dtype=np.int32)
        ones = totals * 2 > count[some[k:stop]][:, None]
        out[some[k:stop]] = np.packbits(ones, axis=1, bitorder="little").view(np.uint64).ravel()
        k = stop
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with ``print`` (the fingerprint as a signed long)."""
    kept = [c for c in docs.columns if c not in (text, "print")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [block_fingerprints(d, o, shingle) for _, d, o in blocks(batch.column(len(kept)))]
            prints = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints.view(np.int64))], names=[*kept, "print"])

    narrow = docs.select(*[f"`{c}`" for c in kept], F.col(text).cast("string").alias(text))
    return narrow.mapInArrow(run, narrow.drop(text).schema.add("print", "long"))


def links(prints: DataFrame, max_bits: int = MAX_BITS, pairwise: int = PAIRWISE) -> DataFrame:
    """Links a, b between the different fingerprints of ``print``: enough to join all that are linked.

    ``max_bits`` is at most 2, for which the keys and the points are made.
    """
    if max_bits > 2:
        raise ValueError("the keys are made for at most two bits")

    @F.pandas_udf("array<long>")
    def keys_of(column: pd.Series) -> pd.Series:
        return pd.Series(list(pivot_keys(column.to_numpy(np.int64).view(np.uint64)).view(np.int64)))

    @F.pandas_udf("array<struct<a:long,b:long>>")
    def links_of(column: pd.Series) -> pd.Series:
        return pd.Series([[{"a": a, "b": b} for a, b in linked(np.asarray(x, np.int64).view(np.uint64), max_bits)] for x in column])

    keyed = cut_lineage(prints.select("print", F.explode(keys_of("print")).alias("key")))
    counts = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = cut_lineage(keyed.join(counts, "key"))
    few = met.where(F.col("n") <= pairwise).groupBy("key").agg(F.collect_list("print").alias("prints"))
    pairs = few.select(F.explode(links_of("prints")).alias("l")).select("l.a", "l.b")
    many = met.where(F.col("n") > pairwise).select("print").distinct()
    near = many.select("print", F.explode(_around(max_bits)).alias("point"))
    least = near.groupBy("point").agg(F.min("print").alias("least"), F.count("*").alias("n")).where("n > 1")
    points = near.join(least, "point").where("print <> least").select(F.col("print").alias("a"), F.col("least").alias("b"))
    if max_bits < 2:
        points = points.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    return pairs.unionByName(points)


def _around(max_bits: int) -> Column:
    """The points where linked fingerprints meet: itself and, but for ``max_bits`` 0, each at one bit."""
    bits = [(1 << j) - (1 << 64 if j == 63 else 0) for j in range(64)] if max_bits else []
    return F.array(F.col("print"), *[F.col("print").bitwiseXOR(F.lit(b).cast("long")) for b in bits])


def classes(
    docs: DataFrame,
    shingle: int = SHINGLE,
    max_bits: int = MAX_BITS,
    pairwise: int = PAIRWISE,
    text: str = "text",
    key: str = "doc_id",
    row: str | None = None,
) -> DataFrame:
    """row, key, fingerprint, component_id, stays of every row of ``docs``.

    Words are lower-cased (A-Z); a bit is set if it is set in more than half of the
    shingles' hashes, repeats included. A text of fewer words than a shingle is one
    shingle; a null text or one without words has fingerprint zero and links as any
    other. ``component_id`` is the smallest key reachable over links (nulls last);
    ``stays`` is true for that row, of repeated rows for exactly one. Rows are told apart
    by a number of their own; ``row`` names a column that holds one already. Other
    columns are ignored.
    """
    number = F.monotonically_increasing_id() if row is None else F.col(f"`{row}`")
    narrow = docs.select(number.alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    prints = cut_lineage(fingerprints(narrow, shingle))
    first = F.min(F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("id"), F.col("row")))
    heads = cut_lineage(prints.groupBy("print").agg(first.alias("keep")))
    found = components(links(heads, max_bits, pairwise)).withColumnRenamed("node", "print")
    rooted = cut_lineage(heads.join(found, "print", "left").withColumn("root", F.coalesce("root", "print")))
    best = rooted.groupBy("root").agg(F.min("keep").alias("best"))
    of_print = cut_lineage(rooted.join(best, "root").select("print", "best"))
    return prints.join(of_print, "print").select(
        "row",
        F.col("key").alias(key),
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        F.col("best.id").alias("component_id"),
        (F.col("row") == F.col("best.row")).alias("stays"),
    )


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each class of near duplicates; all columns as they are."""
    name = free_name("row", docs.columns)
    numbered = cut_lineage(docs.withColumn(name, F.monotonically_increasing_id()))
    found = classes(numbered, shingle, max_bits, text=text, key=key, row=name)
    return numbered.join(found.where("stays").select(F.col("row").alias(name)), name, "left_semi").drop(name)
