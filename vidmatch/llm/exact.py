"""Exact duplicates of an incoming batch against immutable snapshots.

A snapshot keeps one entry for each different text (digest, who keeps it, how often it
came), dealt into buckets by the digest, and a binary fuse filter for each bucket. A
batch is first grouped by itself; the digests of its groups are screened by the filters
and only positives are joined with the buckets. Rows that would go are then compared
byte by byte with the row that stays. Texts whose digests agree and whose bytes don't
are grouped by their bytes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vidmatch.llm import fuse
from vidmatch.llm.arrays import free_name
from vidmatch.session import cut_lineage

#: Keys of a filter; also the digests of a batch that one task screens.
BUCKET = 16_384
#: Rows of one digest that are compared in one task.
PART = 2_000


def normalised(text: str | Column) -> Column:
    """Each run of white space as one blank; a null text is empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


def row_keys(rows: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """row, key, digest and sha (of the normalised text) of ``rows`` (row, key, text)."""
    clean = rows.select("row", "key", normalised("text").alias("clean"))
    return cut_lineage(clean.select("row", "key", digest(F.col("clean")).alias("digest"), F.hex(sha256(F.col("clean"))).alias("sha")))


def groups_of(keys: DataFrame) -> DataFrame:
    """One row for each digest: who stays (smallest key, nulls last, then first row) and how many rows."""
    first = F.min(F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("id"), F.col("row")))
    return keys.groupBy("digest").agg(first.alias("keep"), F.count("*").alias("n"))


@dataclass
class Snapshot:
    """Immutable: entries (bucket, digest, keep, n), filters (bucket and the filter's parts)."""

    entries: DataFrame
    filters: DataFrame
    buckets: int


FILTER = "bucket int, seed long, segment int, segments int, cells binary"


def snapshot(groups: DataFrame) -> Snapshot:
    """Write the entries of grouped rows and build the filters of their buckets."""
    groups = cut_lineage(groups)
    buckets = max(1, -(-groups.count() // BUCKET))
    entries = groups.withColumn("bucket", _bucket(buckets))

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        f = fuse.build(rows["hashed"].to_numpy(np.int64))
        return pd.DataFrame([[rows["bucket"].iloc[0], f.seed, f.segment, f.segments, f.cells.tobytes()]], columns=_names(FILTER))

    hashed = entries.select("bucket", F.xxhash64("digest").alias("hashed"))
    return Snapshot(entries, cut_lineage(hashed.groupBy("bucket").applyInPandas(build, FILTER)), buckets)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.hash("digest"), F.lit(buckets))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def screen(groups: DataFrame, known: Snapshot) -> DataFrame:
    """The groups whose digest may be in the snapshot: all that are, and one in 65,536 others.

    Groups are dealt to (bucket, slice), so that a large batch meets a small snapshot in
    many tasks; a bucket's filter goes to each of its slices.
    """
    slices = max(1, -(-groups.count() // (BUCKET * known.buckets)))
    hashed = F.xxhash64("digest")
    incoming = groups.withColumns({"hashed": hashed, "bucket": _bucket(known.buckets), "slice": F.pmod(F.hash(hashed), F.lit(slices))})
    filters = known.filters.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    schema = incoming.select("digest", "hashed").schema

    def test(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        rows = rows[["digest", "hashed"]]
        if not len(rows) or not len(own):
            return rows.iloc[:0]
        f = own.iloc[0]
        cells = np.frombuffer(f["cells"], np.uint16)
        held = fuse.Filter(int(f["seed"]), int(f["segment"]), int(f["segments"]), cells).holds(rows["hashed"].to_numpy(np.int64))
        return rows[held]

    narrow = incoming.select("digest", "hashed", "bucket", "slice")
    return narrow.groupBy("bucket", "slice").cogroup(filters.groupBy("bucket", "slice")).applyInPandas(test, schema).select("digest")


def merge(known: Snapshot, batch: DataFrame) -> DataFrame:
    """Groups of snapshot and batch together: digest, keep, n."""
    positive = screen(batch, known).join(known.entries, "digest").select("digest", "keep", "n")
    fresh = batch.join(positive.select("digest"), "digest", "left_anti")
    hit = batch.join(positive.select("digest"), "digest", "left_semi")
    both = known.entries.select("digest", "keep", "n").unionByName(hit)
    return both.groupBy("digest").agg(F.min("keep").alias("keep"), F.sum("n").alias("n")).unionByName(fresh)


def unequal(rows: DataFrame, keys: DataFrame, groups: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Digests that stand for more than one text: byte checks of all rows against the one that stays.

    Texts are fetched by the number of their row, whatever the keys are. A large group is
    compared in parts of about ``PART`` rows, each with its own copy of the text that stays.
    """
    parts = F.ceil(F.col("n") / PART).cast("int")
    shared = groups.where("n > 1").select("digest", F.col("keep.row").alias("keep_row"), parts.alias("parts"))
    members = keys.select("digest", "row").join(shared, "digest")
    texts = rows.select("row", normalised("text").alias("clean"))
    found = members.join(texts, "row").select("digest", "row", "keep_row", "parts", "clean", F.pmod(F.hash("row"), F.col("parts")).alias("part"))
    found = cut_lineage(found)
    stays = found.where("row = keep_row").select("digest", F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.col("clean").alias("wanted"))
    return found.join(stays, ["digest", "part"]).where("clean <> wanted").select("digest").distinct()


def decide(
    docs: DataFrame,
    digest: Callable[[Column], Column] = sha256,
    text: str = "text",
    key: str = "doc_id",
    older: Column | None = None,
    row: str | None = None,
) -> DataFrame:
    """row, key, keep_id, group_size, kept, text_sha256 of every row of ``docs``.

    The rows for which ``older`` (over the columns ``key`` and ``row``) is true form the
    snapshot, the others the incoming batch (by default halves by the key's hash; the
    result is the same for any split). Texts are equal when they are identical after
    ``normalised``; null counts as empty. The row with the smallest key stays, of repeated
    rows exactly one, and a null key comes after all others. Rows are told apart by a
    number of their own; ``row`` names a column that holds one already and whose table is
    stored, so that it is not written again. Other columns are ignored.
    """
    if row is None:
        number = F.monotonically_increasing_id()
        rows = cut_lineage(docs.select(number.alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")))
    else:
        rows = docs.select(F.col(f"`{row}`").alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    older = F.pmod(F.xxhash64("key"), F.lit(2)) == 0 if older is None else older
    keys = row_keys(rows, digest)
    split = keys.withColumn("older", F.coalesce(older, F.lit(False)))
    known = snapshot(groups_of(split.where("older")))
    groups = cut_lineage(merge(known, cut_lineage(groups_of(split.where("not older")))))
    wrong = cut_lineage(unequal(rows, keys, groups, digest))
    result = _decided(keys.join(groups, "digest"), key)
    if wrong.isEmpty():
        return result
    by_text = rows.select("row", "key", normalised("text").alias("clean"))
    again = by_text.withColumn("old", digest(F.col("clean"))).join(wrong.withColumnRenamed("digest", "old"), "old", "left_semi")
    again = cut_lineage(again.select("row", "key", F.col("clean").alias("digest"), F.hex(sha256(F.col("clean"))).alias("sha")))
    exact = _decided(again.join(groups_of(again), "digest"), key)
    return _decided(keys.join(wrong, "digest", "left_anti").join(groups, "digest"), key).unionByName(exact)


def _decided(joined: DataFrame, key: str) -> DataFrame:
    return joined.select(
        "row",
        F.col("key").alias(key),
        F.col("keep.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("keep.row")).alias("kept"),
        F.lower("sha").alias("text_sha256"),
    )


def keep_first(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that repeat an earlier text; all columns as they are."""
    name = free_name("row", docs.columns)
    numbered = cut_lineage(docs.withColumn(name, F.monotonically_increasing_id()))
    kept = decide(numbered, text=text, key=key, row=name).where("kept").select(F.col("row").alias(name))
    return numbered.join(kept, name, "left_semi").drop(name)
