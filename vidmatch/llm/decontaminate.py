"""Benchmark items in documents, with up to a few edits, by the pigeonhole principle.

Texts are sequences of normalised words. An item of ``n`` words may differ by ``k =
n // 10`` word edits (insertions, deletions, replacements). Cut into ``k + 1`` pieces,
at least one piece of it stands unchanged in any such passage: piece hits, found by a
hash over each piece length, are the candidates. Around each the bit-parallel distance
of Myers, with free ends in the document, verifies the item.

The items are a stated query set: they go to the tasks in blocks of bounded size, and
the documents are read once for each block.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidmatch.llm.arrays import BASE_A, BASE_B, LOWER, blocks, prefix_sums, span_hashes

#: One edit for so many words of an item.
WORDS_FOR_EDIT = 10
#: Bytes of items that go to the tasks at once.
ITEM_BLOCK = 8 << 20

#: Bytes that separate words: ASCII other than letters and digits.
SEPARATES = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def normalised_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z lower-cased, other signs as blanks), their starts and ends, each text's first."""
    n = len(data)
    low = LOWER[data]
    inside = ~SEPARATES[low]
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:] = ~inside[:-1]
    after[:-1] = ~inside[1:]
    before[offsets[offsets < n]] = True
    after[offsets[offsets > 0] - 1] = True
    starts, ends = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
    sums = prefix_sums(low.astype(np.uint64) + np.uint64(1), BASE_A)
    return span_hashes(sums, starts, ends, BASE_A), starts, ends, np.searchsorted(starts, offsets)


def item_words(text: str | None) -> np.ndarray:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return normalised_words(data, np.array([0, len(data)]))[0]


def pieces(n: int, k: int) -> list[tuple[int, int]]:
    """Starts and lengths of ``k + 1`` pieces of an item of ``n`` words, as even as can be."""
    edges = [n * j // (k + 1) for j in range(k + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def best_matches(item: list[int], text: list[int], k: int) -> tuple[int, int]:
    """Myers: the smallest distance of the item to a passage of the text, and where the passage ends.

    The first end of smallest distance; ``k + 1`` if every distance exceeds ``k``.
    """
    m = len(item)
    where = defaultdict(int)
    for j, w in enumerate(item):
        where[w] |= 1 << j
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = k + 1, -1
    for i, w in enumerate(text):
        eq = where.get(w, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | ~(xh | up) & full
        mh = up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        up = mh | ~(xv | ph) & full
        down = ph & xv
        if score < best:
            best, end = score, i + 1
    return best, end


class Index:
    """Piece hashes of some items by piece length."""

    def __init__(self, items: list[tuple[int, np.ndarray]], words_for_edit: int):
        self.items = {}
        by_length: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for number, (item, hashes) in enumerate(items):
            if not len(hashes):
                continue
            k = len(hashes) // words_for_edit
            self.items[number] = (item, hashes.tolist(), k)
            sums = prefix_sums(hashes, BASE_B)
            for start, length in pieces(len(hashes), k):
                found = span_hashes(sums, np.array([start]), np.array([start + length]), BASE_B)
                by_length[length].append((int(found[0]), number, start))
        self.pieces = []
        for length, rows in sorted(by_length.items()):
            rows.sort()
            self.pieces.append((length, np.array([r[0] for r in rows], np.uint64), np.array([r[1:] for r in rows], np.int64)))

    def candidates(self, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, item number, where the item would begin) of every piece hit."""
        sums = prefix_sums(hashes, BASE_B)
        of_word = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for length, known, rows in self.pieces:
            at = np.arange(max(0, len(hashes) - length + 1))
            at = at[at + length <= first[1:][of_word[at]]]
            found = span_hashes(sums, at, at + length, BASE_B)
            low, high = np.searchsorted(known, found, "left"), np.searchsorted(known, found, "right")
            for j in np.flatnonzero(high > low):
                for number, start in rows[low[j] : high[j]]:
                    yield int(of_word[at[j]]), int(number), int(at[j] - start)

    def hits(self, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(text, item number, item, edits, first word, last word + 1) of every verified item."""
        near: dict[tuple[int, int], list[int]] = defaultdict(list)
        for text, number, begin in self.candidates(hashes, first):
            near[text, number].append(begin)
        for (text, number), begins in sorted(near.items()):
            item, own, k = self.items[number]
            low, high = int(first[text]), int(first[text + 1])
            best = (k + 1, -1)
            done = -1
            for begin in sorted(set(begins)):
                # The passage lies within k words of where this piece puts the item.
                a, b = max(low, begin - k), min(high, begin + len(own) + k)
                if b <= done:
                    continue
                edits, end = best_matches(own, hashes[a:b].tolist(), k)
                done = b
                if edits <= k and edits < best[0]:
                    best = (edits, a + end)
            if best[0] <= k:
                edits, end = best
                # Backwards from the end: the shortest passage of that distance.
                a = max(low, end - len(own) - edits)
                _, length = best_matches(own[::-1], hashes[a:end][::-1].tolist(), edits)
                yield text, number, item, edits, end - length, end


def item_blocks(benchmark: DataFrame, words_for_edit: int, item: str, text: str) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The items in blocks of about ``ITEM_BLOCK`` bytes, read one partition after the other."""
    held, size = [], 0
    for row in benchmark.select(item, text).where(F.col(text).isNotNull()).toLocalIterator():
        held.append((row[0], item_words(row[1])))
        size += len(row[1])
        if size >= ITEM_BLOCK:
            yield held
            held, size = [], 0
    yield held


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    words_for_edit: int = WORDS_FOR_EDIT,
    text: str = "text",
    key: str = "doc_id",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """key, item_id, n_edits, n_words, start_word, end_word of each item that a document holds.

    One row for a document's row and an item: the passage of fewest edits, of equals
    the first. Items without a word and null items match nothing; shorter items than
    ``words_for_edit`` match exactly. A null text holds nothing. Repeated documents and
    repeated items give a row each; other columns are ignored.
    """
    kind, item_kind = (docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString())
    schema = f"`{key}` {kind}, item_id {item_kind}, n_edits int, n_words int, start_word long, end_word long"
    narrow = docs.select(key, F.col(text).cast("string").alias("text"))

    def part(items: list[tuple[int, np.ndarray]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(items, words_for_edit)
            names = None
            for batch in batches:
                rows, at = [], []
                for row, data, offsets in blocks(batch.column(1)):
                    hashes, _, _, first = normalised_words(data, offsets)
                    for t, number, name, edits, a, b in index.hits(hashes, first):
                        at.append(row + t)
                        rows.append((name, edits, len(index.items[number][1]), a - int(first[t]), b - int(first[t])))
                names = [key, "item_id", "n_edits", "n_words", "start_word", "end_word"]
                kinds = [out_types[1], pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array([r[c] for r in rows], kinds[c]) for c in range(5))],
                    names=names,
                )

        return narrow.mapInArrow(run, schema)

    from pyspark.sql.pandas.types import to_arrow_type

    out_types = [None, to_arrow_type(benchmark.schema[item].dataType)]
    found = None
    for items in item_blocks(benchmark, words_for_edit, item, item_text):
        own = part(items)
        found = own if found is None else found.unionByName(own)
    return found


def keep_clean(docs: DataFrame, benchmark: DataFrame, words_for_edit: int = WORDS_FOR_EDIT) -> DataFrame:
    """``docs`` without the rows that hold an item; all columns as they are.

    Decided in place, row by row, for each block of items: no join and no shuffle.
    """
    k = docs.columns.index("text")

    def without(items: list[tuple[int, np.ndarray]], frame: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(items, words_for_edit)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for row, data, offsets in blocks(batch.column(k)):
                    hashes, _, _, first = normalised_words(data, offsets)
                    for hit in index.hits(hashes, first):
                        keep[row + hit[0]] = False
                yield batch.filter(pa.array(keep))

        return frame.mapInArrow(run, frame.schema)

    for items in item_blocks(benchmark, words_for_edit, "item_id", "text"):
        docs = without(items, docs)
    return docs
