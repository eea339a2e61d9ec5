"""Reproducible shuffle into shards: a Feistel permutation of global row numbers.

Rows get gapless global numbers in the order of their key. A keyed permutation of
``0 .. n - 1`` shuffles them: a Feistel network over pairs of digits (x, y) with
``x < a``, ``y < b`` and ``a * b`` just above ``n``; a result beyond ``n - 1`` is permuted
again until it falls inside (cycle walking). The place ``p`` of a row gives its shard
``p mod shards`` and its slot ``p div shards``, and the permutation can be inverted: who
knows n, the number of shards and the seed finds any row's place, and the row of any
place, without a table. Column expressions alone: no Python in tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vidmatch.llm.arrays import free_name
from vidmatch.session import cut_lineage

SHARDS, SEED = 24, 20_240_607
#: Pairs of Feistel rounds.
ROUNDS = 4
MASK = (1 << 31) - 1
# Any odd numbers below 2^31 do: products stay below 2^62.
MIX_A, MIX_B = 0x5851F42D, 0x4C957F2D


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """Two keys for each pair of rounds."""
    keys, x = [], (seed ^ 0x2545F491) & MASK
    for _ in range(2 * rounds):
        x = (x * MIX_A + MIX_B) & MASK
        keys.append(x ^ (x >> 15))
    return list(zip(keys[::2], keys[1::2], strict=True))


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _round(half: Column, key: Column) -> Column:
    """A number below 2^31 that depends on all bits of ``half`` and ``key``."""

    def step(factor: int, shift: int) -> Callable[[Column], Column]:
        return lambda v: (v * _long(factor)).bitwiseAND(_long(MASK)).bitwiseXOR(
            F.shiftright((v * _long(factor)).bitwiseAND(_long(MASK)), shift)
        )

    # A step needs its input twice; as a lambda's variable it is computed once.
    x = F.array((half + key).bitwiseAND(_long(MASK)))
    return F.get(F.transform(F.transform(x, step(MIX_A, 15)), step(MIX_B, 13)), F.lit(0))


@dataclass(frozen=True)
class Shuffle:
    """The permutation of ``0 .. rows - 1`` that a seed stands for."""

    rows: int
    shards: int = SHARDS
    seed: int = SEED

    def __post_init__(self) -> None:
        if self.shards < 1 or not 0 <= self.rows < 1 << 62:
            raise ValueError("shards must be positive and rows below 2^62")

    @property
    def a(self) -> int:
        return math.isqrt(max(self.rows, 1) - 1) + 1

    @property
    def b(self) -> int:
        return -(-max(self.rows, 1) // self.a)

    def permuted(self, p: Column, backward: bool = False) -> Column:
        """One application over ``0 .. a * b - 1``."""
        a, b = _long(self.a), _long(self.b)
        keys = round_keys(self.seed)
        listed = F.array(*[F.struct(_long(k).alias("k"), _long(m).alias("m")) for k, m in (keys[::-1] if backward else keys)])

        def forth(s: Column, key: Column) -> Column:
            x = (s["x"] + _round(s["y"], key["k"])) % a
            return F.struct(x.alias("x"), ((s["y"] + _round(x, key["m"])) % b).alias("y"))

        def back(s: Column, key: Column) -> Column:
            y = F.pmod(s["y"] - _round(s["x"], key["m"]), b)
            return F.struct(F.pmod(s["x"] - _round(y, key["k"]), a).alias("x"), y.alias("y"))

        start = F.struct((p % a).alias("x"), _div(p, a).alias("y"))
        return F.aggregate(listed, start, back if backward else forth, lambda s: s["y"] * a + s["x"])

    def steps(self, spark: SparkSession, backward: bool = False) -> int:
        """Applications that the longest walk from inside to inside needs.

        The fewer than ``a`` numbers beyond ``rows`` are permuted until those that are
        still outside no longer get fewer: such circles never meet a walk.
        """
        if self.a * self.b == self.rows or self.rows < 2:
            return 1
        outside = spark.range(self.rows, self.a * self.b).select(F.col("id").alias("p"))
        left, n = self.a * self.b - self.rows, 1
        while left:
            outside = cut_lineage(outside.select(self.permuted(F.col("p"), backward).alias("p")).where(F.col("p") >= self.rows))
            before, left = left, outside.count()
            if left == before:
                break
            n += 1
        return n

    def place(self, row: Column, steps: int, backward: bool = False) -> Column:
        """The shuffled place of a row number, or, ``backward``, the row number of a place."""
        walk = F.sequence(F.lit(2), F.lit(steps)) if steps > 1 else F.array().cast("array<int>")
        return F.aggregate(
            walk,
            self.permuted(row, backward),
            lambda p, _: F.when(p < self.rows, p).otherwise(self.permuted(p, backward)),
        )

    def shard(self, place: Column) -> Column:
        return (place % self.shards).cast("int")

    def slot(self, place: Column) -> Column:
        return _div(place, _long(self.shards))

    def source(self, spark: SparkSession, places: DataFrame, shard: str = "shard", slot: str = "slot") -> DataFrame:
        """``places`` with ``row``: the global number of the row at (shard, slot), null where there is none."""
        p = F.col(slot).cast("long") * self.shards + F.col(shard)
        inside = F.col(shard).between(0, self.shards - 1) & (F.col(slot) >= 0) & (p < self.rows)
        return places.withColumn("row", F.when(inside, self.place(p, self.steps(spark, True), True)))


def numbered(df: DataFrame, order: list[Column], name: str = "row") -> DataFrame:
    """``df`` with ``name``: gapless numbers from 0 in the order of ``order``.

    Rows are dealt by range of ``order`` and counted per partition; the running totals of
    the counts, one row a partition, are broadcast. Rows that agree in ``order`` are told
    apart by where they were read, so that no range has to hold them all.
    """
    tie = free_name("tie", [*df.columns, name])
    keys = [*order, F.col(tie)]
    dealt = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    local, part, first = (free_name(n, [*df.columns, name]) for n in ("local", "part", "first"))
    stored = cut_lineage(dealt.drop(tie).withColumn(local, F.monotonically_increasing_id()))
    # Partition number in the upper 31 bits, place in the partition in the lower 33.
    stored = stored.withColumn(part, F.shiftright(F.col(local), 33)).withColumn(local, F.col(local).bitwiseAND(_long((1 << 33) - 1)))
    counts = stored.groupBy(part).agg(F.count("*").alias("n"))
    # One row a partition.
    running = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.sum("n").over(running) - F.col("n")
    offsets = counts.select(part, before.alias(first))
    return stored.join(F.broadcast(offsets), part).withColumn(name, F.col(local) + F.col(first)).drop(part, local, first)


def assign(
    docs: DataFrame,
    shards: int = SHARDS,
    seed: int = SEED,
    text: str = "text",
    key: str = "doc_id",
    names: tuple[str, str, str] = ("row", "shard", "slot"),
) -> tuple[DataFrame, Shuffle]:
    """``docs`` with global row number, shard and slot, and the shuffle that placed them.

    Row numbers follow the key (nulls first), then the text by its hash and itself; the
    result does not depend on how the table is cut into files. Rows that repeat another's
    key and text may change places with it. Shards differ by one row at most, slots have
    no gaps. Every row gets a place, whatever is null in it; an empty table has none. A
    new column whose name is taken is named with a number behind it.
    """
    row, shard, slot = [], [], []
    for target, wanted in zip((row, shard, slot), names, strict=True):
        target.append(free_name(wanted, [*docs.columns, *row, *shard, *slot]))
    order = [F.col(f"`{key}`"), F.xxhash64(F.col(f"`{text}`")), F.col(f"`{text}`")]
    rows = numbered(docs, order, row[0])
    shuffle = Shuffle(rows.count(), shards, seed)
    place = shuffle.place(F.col(row[0]), shuffle.steps(docs.sparkSession))
    placed = rows.withColumn(slot[0], place)
    return placed.withColumn(shard[0], shuffle.shard(F.col(slot[0]))).withColumn(slot[0], shuffle.slot(F.col(slot[0]))), shuffle


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, text: str = "text", key: str = "doc_id") -> Shuffle:
    """Write ``docs`` as folders ``shard=0 ..``, rows by slot; a large shard in several files.

    Columns ``row``, ``shard`` and ``slot`` are added (``docs`` must not have them). The
    files of a shard hold consecutive ranges of slots.
    """
    taken = {"row", "shard", "slot"} & {c.lower() for c in docs.columns}
    if taken:
        raise ValueError(f"columns already there: {sorted(taken)}")
    placed, shuffle = assign(docs, shards, seed, text, key)
    dealt = placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    dealt.write.partitionBy("shard").parquet(path)
    return shuffle


def places(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard of every row; texts are not moved.

    ``size`` is the UTF-8 bytes of the text (null: none) plus 8; a null text has the
    checksum of an empty one. The law is ``rows``: counts differ by one at most; a new
    number of shards deals all rows anew, so ``grown_shard`` is null. Row numbers follow
    key and a hash of the text: rows that agree in both may change places.
    """
    body = F.encode(F.coalesce(F.col(f"`{text}`"), F.lit("")), "UTF-8")
    narrow = docs.select(
        F.col(f"`{key}`").alias("key"),
        F.xxhash64(F.col(f"`{text}`")).alias("text"),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
    )
    placed, _ = assign(narrow, shards, seed, "text", "key")
    return placed.select(
        F.col("key").alias(key),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def places_sql(shards: int = SHARDS, seed: int = SEED) -> str:
    """The same over ``documents`` with different keys, in DuckDB's SQL."""

    def mixed(x: str, key: int) -> str:
        x = f"(({x}) + {key}) & {MASK}"
        for factor, shift in ((MIX_A, 15), (MIX_B, 13)):
            x = f"list_transform([(({x}) * {factor}) & {MASK}], lambda v: xor(v, v >> {shift}))[1]"
        return x

    def permuted(p: str) -> str:
        """p through all rounds, a select for each half round."""
        sql = f"SELECT i, ({p}) % a AS x, ({p}) // a AS y, a, b, n FROM todo"
        for k, m in round_keys(seed):
            sql = f"SELECT i, (x + {mixed('y', k)}) % a AS x, y, a, b, n FROM ({sql})"
            sql = f"SELECT i, x, (y + {mixed('x', m)}) % b AS y, a, b, n FROM ({sql})"
        return sql

    table = "[" + ", ".join(str(crc_entry(i)) for i in range(256)) + "]"
    return f"""
WITH RECURSIVE bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sums AS (SELECT doc_id, len(h) // 2 + 8 AS size, xor(4294967295, list_reduce(list_transform(range(1, len(h), 2),
 lambda j: ('0x' || substr(h, j, 2))::BIGINT), lambda c, x: xor(c >> 8, ({table})[xor(c & 255, x) + 1]), 4294967295::BIGINT)) AS text_crc32 FROM bytes),
sized AS (SELECT n, a, ((n + a - 1) // a)::BIGINT AS b FROM (SELECT n, greatest(ceil(sqrt(n)), 1)::BIGINT AS a FROM (SELECT count(*) AS n FROM documents))),
walk AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, row_number() OVER (ORDER BY doc_id) - 1 AS p, a, b, n, false AS done FROM documents, sized
 UNION ALL SELECT i, y * a + x AS p, a, b, n, y * a + x < n AS done FROM ({permuted('p').replace('FROM todo', 'FROM walk WHERE NOT done')})),
rows AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)
SELECT s.doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, (p % {shards})::INT AS shard, p // {shards} AS slot, NULL::INT AS grown_shard
FROM sums s JOIN rows USING (doc_id) JOIN walk ON walk.i = rows.i AND done"""


def crc_entry(i: int) -> int:
    """Entry of the table of the reflected polynomial 0xEDB88320."""
    for _ in range(8):
        i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
    return i
