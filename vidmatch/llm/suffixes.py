"""Repeated byte strings: prefix doubling over the positions that can still repeat.

Prefix doubling ranks every position by its first ``h`` bytes, then by the pair of its
rank and the rank ``h`` bytes on, and so doubles ``h``; positions of unique rank leave.
A rank here is a 64-bit fingerprint of the bytes, so that equal strings have equal
ranks everywhere, and Spark sorts ranks by range: each shard of the sorted order keeps
the ranks that more than one position has, as a sorted array in the shared folder that
the next round maps into memory. A round sends only positions that all earlier rounds
left in question:

- *32 bytes*, at anchors only. The anchor of a 200-byte window is its 32-byte string of
  smallest rank; equal windows have equal anchors at equal places. An anchor that occurs
  once ends all windows around it. One whose whole surroundings (all windows that it is
  the anchor of) occur again settles all of them at once.
- *100 bytes*, at the windows of the remaining anchors.
- *200 bytes*, by pairs of ranks at offset 100, at the windows that are still there.

Every position is judged; anchors only decide which positions a round must send.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidmatch.llm.arrays import ONE, blocks, mixed, prefix_sums, ragged, span_hashes, span_mask
from vidmatch.llm.ngrams import load, mounted, save, shard_of, shards_for

LENGTH, ANCHOR = 200, 32
#: Ranks that a map task reduces before it sends them.
FLUSH = 2_000_000
LOW = np.uint64(0xFFFFFFFF)
HIGH = np.uint64(0xFFFFFFFF00000000)
SENT = "shard int, ranks binary, anchors binary, several binary"


@dataclass
class Ranks:
    """Sorted arrays of the ranks that more than one position has."""

    path: str
    name: str
    shards: int

    def file(self, shard: int) -> str:
        return f"{self.path}/{self.name}/{shard}.npy"

    def holds(self, ranks: np.ndarray) -> np.ndarray:
        different, inverse = np.unique(ranks, return_inverse=True)
        found = np.zeros(len(different), bool)
        cuts = np.searchsorted(shard_of(different, self.shards), np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            if os.path.exists(self.file(s)) and len(known := load(self.file(s))):
                own = slice(cuts[s], cuts[s + 1])
                at = np.minimum(np.searchsorted(known, different[own]), len(known) - 1)
                found[own] = known[at] == different[own]
        return found[inverse]


class Block:
    """The windows of the texts of a block and their anchors."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, anchor: int):
        self.length = length
        self.sums = prefix_sums(data.astype(np.uint64) + ONE)
        #: Windows by their first byte, text after text.
        self.starts = ragged(offsets[:-1], np.maximum(np.diff(offsets) - length + 1, 0))
        if not len(self.starts):
            self.first = self.last = np.zeros(0, np.int64)
            self.anchors = self.spans = np.zeros(0, np.uint64)
            return
        places = np.arange(len(data) - anchor + 1)
        ranks = span_hashes(self.sums, places, places + anchor)
        # The place is part of the value: the smallest one tells where it stands.
        low = ranks & HIGH | places.astype(np.uint64)
        width, have = length - anchor + 1, 1
        while 2 * have <= width:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if have < width:
            low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
        at = (low[self.starts] & LOW).astype(np.int64)
        change = np.flatnonzero((at[1:] != at[:-1]) | (self.starts[1:] != self.starts[:-1] + 1)) + 1
        #: Runs of windows with one anchor, as places in ``starts``.
        self.first = np.append(0, change)
        self.last = np.append(change, len(at)) - 1
        at = at[self.first]
        a, b = self.starts[self.first], self.starts[self.last]
        self.anchors = ranks[at]
        place = mixed(((at - a).astype(np.uint64) << np.uint64(32)) | (b - a).astype(np.uint64))
        self.spans = mixed(span_hashes(self.sums, a, b + length) ^ place)

    def ranks(self, starts: np.ndarray, length: int) -> np.ndarray:
        return span_hashes(self.sums, starts, starts + length)

    def windows(self, runs: np.ndarray) -> np.ndarray:
        """First bytes of the windows of some runs."""
        return self.starts[ragged(self.first[runs], self.last[runs] - self.first[runs] + 1)]


def _reduce(ranks: np.ndarray, several: np.ndarray, more: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Different ranks in order, whether each came more than once, and what belongs to it."""
    order = np.argsort(ranks, kind="stable")
    ranks, several = ranks[order], several[order]
    if not len(ranks):
        return ranks, several, more
    first = np.flatnonzero(np.append(True, ranks[1:] != ranks[:-1]))
    count = np.diff(np.append(first, len(ranks)))
    return ranks[first], np.logical_or.reduceat(several, first) | (count > 1), None if more is None else more[order][first]


def _rows(ranks: np.ndarray, several: np.ndarray, more: np.ndarray | None, shards: int) -> Iterator[tuple]:
    """Reduced ranks dealt by range."""
    cuts = np.searchsorted(shard_of(ranks, shards), np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cuts)):
        own = slice(cuts[s], cuts[s + 1])
        yield int(s), ranks[own].tobytes(), b"" if more is None else more[own].tobytes(), np.packbits(several[own]).tobytes()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3))],
        names=["shard", "ranks", "anchors", "several"],
    )


def _gathered(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    ranks = [np.frombuffer(x, np.uint64) for x in rows["ranks"]]
    several = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(r)).astype(bool) for x, r in zip(rows["several"], ranks, strict=True)]
    more = np.concatenate([np.frombuffer(x, np.uint64) for x in rows["anchors"]])
    ranks = np.concatenate(ranks)
    return _reduce(ranks, np.concatenate(several), more if len(more) == len(ranks) else None)


def send(texts: DataFrame, shards: int, ranks_of: Callable[[Block], tuple[np.ndarray, np.ndarray | None]], length: int, anchor: int) -> DataFrame:
    """The ranks of all texts, reduced within each flush of a task and dealt by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, more, n = [], [], 0

        def flush() -> pa.RecordBatch:
            own = np.concatenate(held)
            extra = np.concatenate(more) if more[0] is not None else None
            return _batch(list(_rows(*_reduce(own, np.zeros(len(own), bool), extra), shards)))

        for batch in batches:
            for _, data, offsets in blocks(batch.column(0)):
                ranks, extra = ranks_of(Block(data, offsets, length, anchor))
                if len(ranks):
                    held.append(ranks)
                    more.append(extra)
                    n += len(ranks)
                if n >= FLUSH:
                    yield flush()
                    held, more, n = [], [], 0
        if n:
            yield flush()

    return texts.mapInArrow(run, SENT)


def keep_repeated(sent: DataFrame, to: Ranks) -> None:
    """Sort each shard and keep the ranks that came more than once."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ranks, several, _ = _gathered(rows)
        shard = int(rows["shard"].iloc[0])
        save(to.file(shard), ranks[several])
        return pd.DataFrame({"n": [int(several.sum())]})

    sent.groupBy("shard").applyInPandas(run, "n long").agg(F.sum("n")).collect()


def keep_spans(sent: DataFrame, spans: Ranks, anchors: Ranks) -> None:
    """Keep the surroundings that came more than once, and the anchors that have several surroundings.

    A frequent anchor is counted where its surroundings are, and only these counts meet.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ranks, several, own = _gathered(rows)
        save(spans.file(int(rows["shard"].iloc[0])), ranks[several])
        out = _reduce(own, np.zeros(len(own), bool), None)
        return pd.DataFrame(_rows(*out, anchors.shards), columns=["shard", "ranks", "anchors", "several"])

    keep_repeated(sent.groupBy("shard").applyInPandas(run, SENT), anchors)


def remove(
    docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, text: str = "text", key: str = "doc_id", with_kept: bool = True
) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256, kept of every row of ``docs``.

    Bytes inside a string of ``length`` bytes that starts anywhere else too, in any
    row, are removed; ``kept`` holds the others as binary. Texts never join: a string
    lies within one row. ``with_kept`` false leaves ``kept`` null. Repeated rows remove each other. A null text is empty, and a
    text shorter than ``length`` stays as it is. Other columns are ignored.
    """
    if not 0 < anchor <= length // 2:
        raise ValueError("an anchor is at most half of the length")
    texts = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    path = mounted(docs.sparkSession)
    # About one anchor for every ``length - anchor`` / 2 bytes, and few windows remain.
    few, many = shards_for(total / 50e6), shards_for(total / 20e6)
    spans, anchors = Ranks(path, "spans", few), Ranks(path, "anchors", few)
    halves, whole = Ranks(path, "halves", many), Ranks(path, "whole", many)
    half = length // 2

    keep_spans(send(texts, few, lambda b: (b.spans, b.anchors), length, anchor), spans, anchors)

    def open_windows(b: Block, runs: np.ndarray) -> np.ndarray:
        """Windows whose first half occurs more than once."""
        starts = b.windows(runs)
        return starts[halves.holds(b.ranks(starts, half))]

    def pair(b: Block, starts: np.ndarray) -> np.ndarray:
        second = mixed(b.ranks(starts + (length - half), half))
        return mixed(b.ranks(starts, half) + second)

    in_question = lambda b: np.flatnonzero(anchors.holds(b.anchors))
    keep_repeated(send(texts, many, lambda b: (b.ranks(b.windows(in_question(b)), half), None), length, anchor), halves)
    keep_repeated(send(texts, many, lambda b: (pair(b, open_windows(b, in_question(b))), None), length, anchor), whole)

    narrow = docs.select(key, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in blocks(batch.column(1)):
                b = Block(data, offsets, length, anchor)
                settled = spans.holds(b.spans)
                runs = np.flatnonzero(settled)
                starts = open_windows(b, np.flatnonzero(~settled & anchors.holds(b.anchors)))
                starts = starts[whole.holds(pair(b, starts))]
                mask = np.zeros(len(data), bool)
                if len(runs) or len(starts):
                    a = np.concatenate([b.starts[b.first[runs]], starts])
                    mask = span_mask(len(data), a, np.concatenate([b.starts[b.last[runs]] + length, starts + length]))
                removed = np.diff(np.append(0, np.cumsum(mask))[offsets])
                begins = mask & ~np.append(False, mask[:-1])
                begins[offsets[:-1][offsets[:-1] < len(data)]] |= mask[offsets[:-1][offsets[:-1] < len(data)]]
                n_spans = np.diff(np.append(0, np.cumsum(begins))[offsets])
                rest = data[~mask].tobytes()
                at = np.append(0, np.cumsum(~mask))[offsets].tolist()
                kept = [rest[a:z] for a, z in zip(at, at[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, len(kept)),
                        pa.array(np.diff(offsets), pa.int64()),
                        pa.array(removed, pa.int64()),
                        pa.array(n_spans, pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
                        pa.array(kept if with_kept else [None] * len(kept), pa.binary()),
                    ],
                    names=[key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    return narrow.mapInArrow(cut, schema)
