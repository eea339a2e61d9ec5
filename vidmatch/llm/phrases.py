"""Repeated phrases: every word inside a window that an earlier document has as well.

1. *Screen.* Map tasks hash all windows of 13 words, reduce repeats within a flush and
   send (hash, smallest document) to shards by the hash. A shard keeps the hashes that
   came from at least two documents, each with its owner, the smallest document, as
   sorted arrays in the shared folder.
2. *Passages.* All documents look their windows up in the mapped arrays. An owner gives
   out its recurring passages, any other document the segments that may repeat some.
3. *Automata.* Passages are dealt into shards by their owner. A shard compiles
   Aho-Corasick automata of its windows (a word is one letter), each of a bounded
   number of characters and one at a time, and streams the segments of its owners
   through them, which confirms the words and locates every occurrence. A shard with
   many segments is streamed in several parts.
4. *Cut.* Covered words are removed from the documents that have any.

A window whose hash is known and whose words are not (a collision) is compared with the
other such windows by its words. Nothing is capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vidmatch.llm.arrays import (
    BASE_B,
    blocks,
    prefix_sums,
    ragged,
    span_hashes,
    span_mask,
    word_hashes,
    words,
)
from vidmatch.llm.ngrams import load, mounted, save, shard_of, shards_for, stored_shards
from vidmatch.session import cut_lineage

WINDOW = 13
#: Windows that a map task reduces before it sends them.
FLUSH = 2_000_000
#: Characters of passages in one automaton, and of segments that one task streams.
PASSAGES, SEGMENTS = 300_000, 8_000_000
#: A null key counts as the largest one.
LAST = (1 << 63) - 1


def windows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows, and their count for each text."""
    count = np.maximum(np.diff(first) - size + 1, 0)
    at = ragged(first[:-1], count)
    return span_hashes(prefix_sums(word_hashes(data, starts, ends), BASE_B), at, at + size, BASE_B), count


#: Any function of the words that gives equal windows equal hashes.
Hashed = Callable[..., tuple[np.ndarray, np.ndarray]]


def reduced(hashes: np.ndarray, docs: np.ndarray, several: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different hashes, the smallest document of each, and whether it came from several."""
    order = np.argsort(hashes, kind="stable")
    hashes, docs, several = hashes[order], docs[order], several[order]
    first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
    if not len(first):
        return hashes, docs, several
    low, high = np.minimum.reduceat(docs, first), np.maximum.reduceat(docs, first)
    return hashes[first], low, (low != high) | np.logical_or.reduceat(several, first)


def _sent(hashes: list[np.ndarray], docs: list[np.ndarray], shards: int) -> Iterator[pa.RecordBatch]:
    h, d, s = reduced(np.concatenate(hashes), np.concatenate(docs), np.zeros(sum(map(len, hashes)), bool))
    order = np.lexsort((d, shard_of(h, shards)))  # by document: ids then compress to little
    h, d, s = h[order], d[order], s[order]
    cuts = np.searchsorted(shard_of(h, shards), np.arange(shards + 1))
    rows = []
    for k in np.flatnonzero(np.diff(cuts)):
        own = slice(cuts[k], cuts[k + 1])
        ids, n = np.unique(d[own], return_counts=True)
        rows.append((int(k), h[own].tobytes(), np.diff(ids, prepend=0).tobytes(), n.astype(np.uint32).tobytes(), np.packbits(s[own]).tobytes()))
    yield pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(1, 5))],
        names=["shard", "hashes", "ids", "runs", "several"],
    )


SENT = "shard int, hashes binary, ids binary, runs binary, several binary"


def screen(texts: DataFrame, path: str, shards: int, size: int = WINDOW, hashed: Hashed = windows) -> np.ndarray:
    """Write the sorted arrays of recurring window hashes and owners of ``texts`` (id, text).

    Returns which shards have files, so that a lost one is not taken for an empty one.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, docs, held = [], [], 0
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for row, data, offsets in blocks(batch.column("text")):
                starts, ends, first = words(data, offsets)
                found, count = hashed(data, starts, ends, first, size)
                hashes.append(found)
                docs.append(np.repeat(ids[row : row + len(count)], count))
                held += len(found)
                if held >= FLUSH:
                    yield from _sent(hashes, docs, shards)
                    hashes, docs, held = [], [], 0
        if held:
            yield from _sent(hashes, docs, shards)

    def keep(rows: pd.DataFrame) -> pd.DataFrame:
        shard = int(rows["shard"].iloc[0])
        hashes = [np.frombuffer(x, np.uint64) for x in rows["hashes"]]
        docs = [
            np.repeat(np.cumsum(np.frombuffer(i, np.int64)), np.frombuffer(n, np.uint32))
            for i, n in zip(rows["ids"], rows["runs"], strict=True)
        ]
        several = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(h)).astype(bool) for x, h in zip(rows["several"], hashes, strict=True)]
        h, d, s = reduced(np.concatenate(hashes), np.concatenate(docs), np.concatenate(several))
        save(f"{path}/{shard}/hashes.npy", h[s])
        save(f"{path}/{shard}/owners.npy", d[s])
        return pd.DataFrame({"shard": [shard], "n": [int(s.sum())]})

    sent = texts.mapInArrow(send, SENT)
    return stored_shards(cut_lineage(sent.groupBy("shard").applyInPandas(keep, "shard int, n long")), shards)


def owners(path: str, stored: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The owner of each hash, -1 for one that does not recur."""
    order = np.argsort(hashes)
    ordered = hashes[order]
    found = np.full(len(hashes), -1, np.int64)
    cuts = np.searchsorted(shard_of(ordered, len(stored)), np.arange(len(stored) + 1))
    for s in np.flatnonzero((np.diff(cuts) > 0) & stored):
        known = load(f"{path}/{s}/hashes.npy")
        if len(known):
            own = slice(cuts[s], cuts[s + 1])
            at = np.minimum(np.searchsorted(known, ordered[own]), len(known) - 1)
            found[own] = np.where(known[at] == ordered[own], load(f"{path}/{s}/owners.npy")[at], -1)
    out = np.empty_like(found)
    out[order] = found
    return out


CLEAN, TOUCHED, SEGMENT, PASSAGE = range(4)
PARTS = "kind int, row long, id long, owner long, start long, n_words long, sha string, words string"


def passages(texts: DataFrame, path: str, stored: np.ndarray, size: int = WINDOW, all_words: bool = False, hashed: Hashed = windows) -> DataFrame:
    """What documents give out (see PARTS): results of untouched ones, words of the others (or of all), segments, passages."""
    names = [c.split()[0] for c in PARTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers = batch.column("id").to_numpy(), batch.column("row").to_numpy()
            for row, data, offsets in blocks(batch.column("text")):
                out = list(_given(data, offsets, ids[row:], numbers[row:], path, stored, size, all_words, hashed))
                columns = list(zip(*out, strict=True))
                kinds = [pa.int32(), *[pa.int64()] * 5, pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return texts.mapInArrow(run, PARTS)


def _given(data, offsets, ids, numbers, path, stored, size, all_words, hashed) -> Iterator[tuple]:
    starts, ends, first = words(data, offsets)
    lengths = ends - starts + 1
    joined = np.append(data, np.uint8(0))[ragged(starts, lengths)]
    stop = np.cumsum(lengths) - 1  # where the blank after each word is
    joined[stop] = 0x20
    raw, begin = joined.tobytes(), np.append(stop - lengths + 1, len(joined))
    hashes, count = hashed(data, starts, ends, first, size)
    owner = owners(path, stored, hashes)
    text = lambda a, b: raw[begin[a] : begin[b] - 1] if b > a else b""  # noqa: E731  words a to b - 1
    cuts = np.append(0, np.cumsum(count))
    for k in range(len(first) - 1):
        a, b = int(first[k]), int(first[k + 1])
        own = owner[cuts[k] : cuts[k + 1]]
        row, doc = int(numbers[k]), int(ids[k])
        change = np.flatnonzero(np.diff(own)) + 1 if len(own) else np.zeros(0, np.int64)
        runs = [(int(s), int(e), int(own[s])) for s, e in zip(np.append(0, change), np.append(change, len(own)), strict=True) if e > s and own[s] >= 0]
        touched = False
        for s, e, o in runs:
            part = text(a + s, a + e + size - 1).decode()
            if o == doc:
                yield PASSAGE, row, doc, o, s, None, None, part
            elif o < doc:
                touched = True
                yield SEGMENT, row, doc, o, s, None, None, part
        if touched:
            yield TOUCHED, row, doc, None, None, b - a, None, text(a, b).decode()
        else:
            own = text(a, b)
            yield CLEAN, row, doc, None, None, b - a, hashlib.sha256(own).hexdigest(), own.decode() if all_words else None


FOUND = "row long, id long, start long, length long, words string"


def locate(parts: DataFrame, size: int = WINDOW) -> DataFrame:
    """Located windows as runs (row, id, start, length; ``words`` null), and windows that no passage confirms."""
    dictionary = parts.where(F.col("kind") == PASSAGE).select("owner", "words")
    segments = parts.where(F.col("kind") == SEGMENT).select("row", "id", "owner", "start", "words")
    total = dictionary.agg(F.sum(F.length("words"))).first()[0] or 0
    shard = F.pmod(F.hash("owner"), F.lit(max(1, -(-total // PASSAGES)))).alias("shard")
    sizes = segments.groupBy(shard).agg(F.ceil(F.sum(F.length("words")) / SEGMENTS).cast("int").alias("parts"))
    part = F.pmod(F.hash("row", "start"), F.col("parts")).alias("part")
    streamed = segments.select(shard, "row", "id", "start", "words").join(sizes, "shard").select("shard", part, "row", "id", "start", "words")
    compiled = dictionary.select(shard, "owner", "words").join(sizes, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "owner", F.col("words").alias("passage"))

    def run(texts: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        hits = [None] * len(texts)
        for chunk in chunks(zip(own["owner"], own["passage"], strict=True), size):
            letters: dict[str, str] = {}
            automaton = ahocorasick.Automaton()
            for owner, passage in chunk:
                line = "".join([letters.get(w) or letters.setdefault(w, _letter(len(letters))) for w in passage])
                for i in range(len(line) - size + 1):
                    window = line[i : i + size]
                    automaton.add_word(window, min(owner, automaton.get(window, owner)))
            automaton.make_automaton()
            for k, (doc, segment) in enumerate(zip(texts["id"], texts["words"], strict=True)):
                line = "".join([letters.get(w, "\x01") for w in segment.split(" ")])
                hit = np.zeros(len(line) - size + 1, bool) if hits[k] is None else hits[k]
                if len(automaton):
                    for end, owner in automaton.iter(line):
                        if owner < doc:
                            hit[end - size + 1] = True
                hits[k] = hit
        rows = []
        for hit, row, doc, start, segment in zip(hits, texts["row"], texts["id"], texts["start"], texts["words"], strict=True):
            hit = np.zeros(segment.count(" ") + 2 - size, bool) if hit is None else hit
            edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]])))
            rows += [(row, doc, start + a, b - a + size - 1, None) for a, b in zip(edge[::2], edge[1::2], strict=True)]
            if not hit.all():
                split = segment.split(" ")
                rows += [(row, doc, start + i, size, " ".join(split[i : i + size])) for i in np.flatnonzero(~hit)]
        return pd.DataFrame(rows, columns=["row", "id", "start", "length", "words"])

    return streamed.groupBy("shard", "part").cogroup(compiled.groupBy("shard", "part")).applyInPandas(run, FOUND)


def chunks(passages: Iterable[tuple[int, str]], size: int) -> Iterator[list[tuple[int, list[str]]]]:
    """The passages (owner, words) in lists of about ``PASSAGES`` characters, one automaton each.

    A longer passage is cut; the pieces overlap by all but one word of a window.
    """
    held, room = [], PASSAGES
    for owner, passage in passages:
        split, first = passage.split(" "), 0
        while True:
            last, n = first, 0
            while last < len(split) and (n < room or last - first < size):
                n += len(split[last]) + 1
                last += 1
            held.append((owner, split[first:last]))
            room -= n
            if room <= 0:
                yield held
                held, room = [], PASSAGES
            if last == len(split):
                break
            first = last - size + 1
    if held:
        yield held


def _letter(k: int) -> str:
    """One character for each word; those of UTF-16 pairs are left out."""
    k += 2
    return chr(k if k < 0xD800 else k + 0x800)


def remove(docs: DataFrame, size: int = WINDOW, text: str = "text", key: str = "doc_id", hashed: Hashed = windows) -> DataFrame:
    """key, n_words, n_removed, kept_sha256, kept of every row of ``docs``.

    ``kept`` holds the words that stay, joined by one blank. ``key`` is an integer; a
    null key counts as the largest one. Rows of equal keys do not remove words of each
    other. A null text, one of blanks or an empty one has no words, and fewer words
    than ``size`` are never removed. Other columns are ignored.
    """
    return _cut(docs, size, text, key, True, hashed)


def _cut(docs: DataFrame, size: int, text: str, key: str, with_words: bool, hashed: Hashed = windows) -> DataFrame:
    spark = docs.sparkSession
    number = F.monotonically_increasing_id()
    texts = docs.select(
        F.when(F.col(key).isNull(), -1 - number).otherwise(number).alias("row"),  # negative: no key
        F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("id"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    path, shards = mounted(spark), shards_for(total / 6e6)
    stored = screen(texts.select("id", "text"), path, shards, size, hashed)
    parts = cut_lineage(passages(texts, path, stored, size, with_words, hashed))
    found = cut_lineage(locate(parts, size))
    runs = found.where("words is null").select("row", "start", "length")
    apart = found.where("words is not null")
    if not apart.isEmpty():
        least = apart.groupBy("words").agg(F.min("id").alias("least"))
        runs = runs.unionByName(apart.join(least, "words").where("id > least").select("row", "start", "length"))
    # A document's own runs, at most one for each of its windows.
    covered = runs.groupBy("row").agg(F.collect_list("start").alias("starts"), F.collect_list("length").alias("lengths"))
    touched = parts.where(F.col("kind") == TOUCHED).select("row", "id", "n_words", "words").join(covered, "row", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, shas, kept = [], [], []
            for line, n, starts, lengths in zip(*(batch.column(c).to_pylist() for c in ("words", "n_words", "starts", "lengths")), strict=True):
                at = np.array(starts or [], np.int64)
                mask = span_mask(n, at, at + np.array(lengths or [], np.int64))
                rest = " ".join([w for w, gone in zip(line.split(" "), mask.tolist(), strict=True) if not gone])
                removed.append(int(mask.sum()))
                shas.append(hashlib.sha256(rest.encode()).hexdigest())
                kept.append(rest if with_words else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("id"), batch.column("n_words"), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(kept, pa.string())],
                names=["row", "id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    result = touched.mapInArrow(cut, "row long, id long, n_words long, n_removed long, kept_sha256 string, kept string")
    clean = parts.where(F.col("kind") == CLEAN).select(
        "row", "id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"), F.col("words").alias("kept")
    )
    every = clean.unionByName(result)
    return every.select(F.when(F.col("row") >= 0, F.col("id")).alias(key), "n_words", "n_removed", "kept_sha256", "kept")


def digests(docs: DataFrame, size: int = WINDOW, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``remove`` without the words: key, n_words, n_removed, kept_sha256."""
    return _cut(docs, size, text, key, False).drop("kept")
