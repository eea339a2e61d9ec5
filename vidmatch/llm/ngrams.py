"""An interpolated modified Kneser-Ney bigram model, counted in Spark.

Words are counted into shards by the top bits of their hashes; each shard becomes a
sorted hash array, and a word's id is its place in all of them together. Bigrams are
pairs of ids, again in sorted arrays of (mixed) pairs with their counts. What contexts
and words need besides (totals, how many successors came once, twice or more often, how
many different words precede) are dense arrays by id. The arrays are files in the
shared folder that workers map into memory; a text is scored by binary searches.

Map tasks count before they send: a frequent word or pair is one entry of each flush.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vidmatch.llm.arrays import LOWER, blocks, mixed, word_hashes, words
from vidmatch.session import cut_lineage, shared_folder

#: Tokens that a map task counts before it sends.
FLUSH = 3_000_000
#: The end of a text as a token.
END = np.uint64(0x5BD1E995A5A5F00D)
BLOBS = "shard int, keys binary, more binary, counts binary"
U32 = np.uint64(32)


def unmixed(x: np.ndarray) -> np.ndarray:
    """The number that ``mixed`` makes ``x`` of."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(pow(0xA0761D6478BD642F, -1, 1 << 64))
    x ^= (x >> np.uint64(29)) ^ (x >> np.uint64(58))
    x *= np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
    x ^= x >> np.uint64(32)
    return x


def shards_for(size: float) -> int:
    """The next power of two, so that shards are ranges of hashes."""
    return 1 << max(0, int(np.ceil(np.log2(max(size, 1)))))


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    bits = shards.bit_length() - 1
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


def mounted(spark: SparkSession) -> str:
    """A new folder in the shared one, as a path of the file system that all machines mount."""
    folder = shared_folder(spark)
    path = folder.removeprefix("file:").replace("//", "/") if folder.startswith("file:") else folder
    if "://" in path:
        raise ValueError("memory mapping needs spark.checkpoint.dir to be a mounted file system")
    path = f"{path.rstrip('/')}/vidmatch-ngrams-{uuid.uuid4()}"
    os.makedirs(path)
    return path


def save(path: str, array: np.ndarray) -> None:
    """Written aside and renamed: a repeated task replaces its file with an equal one."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    aside = f"{path}-{uuid.uuid4()}.tmp"
    with open(aside, "wb") as file:
        np.save(file, array)
    os.replace(aside, path)


@lru_cache(4096)
def load(path: str) -> np.ndarray:
    return np.load(path, mmap_mode="r") if os.path.getsize(path) > 128 else np.load(path)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens (words, then the end, of each text) and where each text's begin."""
    low = LOWER[data]
    starts, ends, first = words(low, offsets)
    place = first + np.arange(len(first))  # one more token for each text before
    out = np.empty(len(starts) + len(offsets) - 1, np.uint64)
    end = np.zeros(len(out), bool)
    end[place[1:] - 1] = True
    out[end] = END
    out[~end] = word_hashes(low, starts, ends)
    return out, place


def count_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order and their sums."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Counter:
    """Counts keys of a task and gives them out as one row for each shard."""

    def __init__(self, shards: int, pairs: bool):
        self.shards, self.pairs = shards, pairs
        self.held: list[np.ndarray] = []
        self.n = 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(keys)
        self.n += len(keys)
        if self.n >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        keys, counts = np.unique(np.concatenate(self.held), return_counts=True)
        self.held, self.n = [], 0
        shard = shard_of(mixed(keys) if self.pairs else keys, self.shards)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(self.shards + 1))
        rows = []
        for s in np.flatnonzero(np.diff(cuts)):
            own = order[cuts[s] : cuts[s + 1]]
            rows.append((int(s), *pack(keys[own], self.pairs), counts[own].astype(np.uint32).tobytes()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3))],
            names=["shard", "keys", "more", "counts"],
        )


def pack(keys: np.ndarray, pairs: bool) -> tuple[bytes, bytes]:
    """Sorted keys as bytes; of pairs, the steps of the first and the second, which compress well."""
    if not pairs:
        return keys.tobytes(), b""
    high = (keys >> U32).astype(np.uint32)
    return np.diff(high, prepend=np.uint32(0)).astype(np.uint32).tobytes(), keys.astype(np.uint32).tobytes()


def unpack(keys: bytes, more: bytes, pairs: bool) -> np.ndarray:
    if not pairs:
        return np.frombuffer(keys, np.uint64)
    high = np.cumsum(np.frombuffer(keys, np.uint32), dtype=np.uint64)
    return high << U32 | np.frombuffer(more, np.uint32)


def summed(rows: pd.DataFrame, pairs: bool) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([unpack(k, m, pairs) for k, m in zip(rows["keys"], rows["more"], strict=True)])
    counts = np.concatenate([np.frombuffer(c, np.uint32) for c in rows["counts"]]).astype(np.int64)
    return count_up(keys, counts)


@dataclass
class Vocabulary:
    """Sorted hash arrays of the words and their counts; ``base`` is the first id of each shard."""

    path: str
    base: list[int]
    total: int

    @property
    def size(self) -> int:
        return self.base[-1]

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (the vocabulary's size for an unknown word) and counts of sorted hashes."""
        shards = len(self.base) - 1
        ids, counts = np.full(len(hashes), self.size, np.int64), np.zeros(len(hashes), np.int64)
        cuts = np.searchsorted(shard_of(hashes, shards), np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            if self.base[s] == self.base[s + 1]:
                continue
            own = slice(cuts[s], cuts[s + 1])
            known = load(f"{self.path}/words-{s}/hashes.npy")
            at = np.minimum(np.searchsorted(known, hashes[own]), len(known) - 1)
            hit = known[at] == hashes[own]
            ids[own] = np.where(hit, at + self.base[s], self.size)
            counts[own] = np.where(hit, load(f"{self.path}/words-{s}/counts.npy")[at], 0)
        return ids, counts


@dataclass
class Model:
    words: Vocabulary
    pairs: int  # different bigrams
    shards: int  # of the bigrams
    discounts: list[float]  # of counts 0, 1, 2, 3 and more
    word_discounts: list[float]  # of numbers of preceding words
    held_back: float  # the share of the lowest level that goes to all words alike
    pairs_stored: np.ndarray  # whether a shard has a file
    dense_stored: np.ndarray

    def dense(self, name: str, ids: np.ndarray) -> np.ndarray:
        """Values of sorted ids; zero for ids without one."""
        base = self.words.base
        out = np.zeros(len(ids), np.int64)
        # The begin of a text has the id after all words and lives in a shard of its own.
        edges = np.append(np.asarray(base), base[-1] + 1)
        cuts = np.searchsorted(ids, edges)
        for s in np.flatnonzero(np.diff(cuts)):
            if self.dense_stored[s]:  # a file that should be there and isn't is an error
                own = slice(cuts[s], cuts[s + 1])
                out[own] = load(f"{self.words.path}/dense-{s}/{name}.npy")[ids[own] - edges[s]]
        return out

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of different bigrams."""
        hashes = mixed(keys)
        order = np.argsort(hashes)
        hashes = hashes[order]
        found = np.zeros(len(keys), np.int64)
        cuts = np.searchsorted(shard_of(hashes, self.shards), np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            if not self.pairs_stored[s]:
                continue
            path = f"{self.words.path}/pairs-{s}"
            own = slice(cuts[s], cuts[s + 1])
            known = load(f"{path}/hashes.npy")
            at = np.minimum(np.searchsorted(known, hashes[own]), len(known) - 1)
            hit = known[at] == hashes[own]
            count = load(f"{path}/counts.npy")[at].astype(np.int64)
            large = np.flatnonzero(hit & (count == 255))
            if len(large):
                places = load(f"{path}/large.npy")
                count[large] = places[1][np.searchsorted(places[0], at[large])]
            found[own] = np.where(hit, count, 0)
        out = np.empty(len(keys), np.int64)
        out[order] = found
        return out

    def probabilities(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """p(word | context) of pairs of ids, ``words.size`` meaning unknown as a word and begin or unknown as a context."""
        size = self.words.size
        ids, of_word = np.unique(word, return_inverse=True)
        before = self.dense("before", ids) * (ids < size)
        discount = np.array(self.word_discounts)[np.minimum(before, 3)]
        low = np.maximum(before - discount, 0) / max(self.pairs, 1) + self.held_back / (size + 1)
        low = low[of_word]
        ids, of_context = np.unique(context, return_inverse=True)
        total = self.dense("total", ids)
        held = sum(self.discounts[k] * self.dense(f"after{k}", ids) for k in (1, 2, 3))
        held = np.where(total > 0, held / np.maximum(total, 1), 1.0)[of_context]
        total = total[of_context]
        count = self.pair_counts((context.astype(np.uint64) << U32) | word.astype(np.uint64))
        count = np.where((word < size) & (total > 0), count, 0)
        discount = np.array(self.discounts)[np.minimum(count, 3)]
        return np.maximum(count - discount, 0) / np.maximum(total, 1) + held * low


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts of counts 0, 1, 2, 3+ from how many have counts 1 to 4.

    Where too little data gives no such estimate, half the usual ones.
    """
    n1, n2, n3, n4 = n
    if not all(n):
        return [0.0, 0.5, 0.75, 1.0]
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [0.0, *(min(max(d, 0.05 * k), k - 0.05) for k, d in enumerate(found, 1))]


STATS = "kind string, shard int, n long, total long, n1 long, n2 long, n3 long, n4 long, ids binary, counts binary"


def _row(kind: str, shard: int, n: int = 0, total: int = 0, few=(0, 0, 0, 0), ids: bytes = b"", counts: bytes = b"") -> list:
    return [kind, shard, n, total, *map(int, few), ids, counts]


def _few(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def train(docs: DataFrame, text: str = "text") -> Model:
    """Count ``text`` of all rows; a null text is empty and still has an end.

    Every row counts, repeated ones too; other columns are ignored. Without rows the
    model knows nothing and gives every token the same probability.
    """
    spark = docs.sparkSession
    path = mounted(spark)
    texts = docs.select(F.col(text).cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    names = [c.split()[0] for c in STATS.split(", ")]

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter(word_shards, False)
        for batch in batches:
            for _, data, offsets in blocks(batch.column(0)):
                yield from held.add(tokens(data, offsets)[0])
        yield from held.flush()

    def store_words(rows: pd.DataFrame) -> pd.DataFrame:
        s = int(rows["shard"].iloc[0])
        keys, counts = summed(rows, False)
        save(f"{path}/words-{s}/hashes.npy", keys)
        save(f"{path}/words-{s}/counts.npy", counts)
        return pd.DataFrame([_row("words", s, len(keys), int(counts.sum()))], columns=names)

    word_shards = shards_for(size / 64e6)
    stored = texts.mapInArrow(count_words, BLOBS).groupBy("shard").applyInPandas(store_words, STATS)
    rows = cut_lineage(stored).select("shard", "n", "total").collect()  # a row for each shard
    sizes = np.zeros(word_shards, np.int64)
    for r in rows:
        sizes[r["shard"]] = r["n"]
    vocabulary = Vocabulary(path, [0, *np.cumsum(sizes).tolist()], sum(r["total"] for r in rows))
    if vocabulary.size >= 1 << 32:
        raise ValueError("more than 4.29e9 different words: ids have 32 bits")
    base = np.asarray(vocabulary.base)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter(shards, True)
        for batch in batches:
            for _, data, offsets in blocks(batch.column(0)):
                word, context = pair_ids(vocabulary, *tokens(data, offsets))[:2]
                yield from held.add(context.astype(np.uint64) << U32 | word.astype(np.uint64))
        yield from held.flush()

    def dense_rows(kind: str, ids: np.ndarray, values: np.ndarray) -> Iterator[list]:
        """Values by id, dealt to the shards of the vocabulary; the begin of texts goes behind them."""
        edges = np.append(base, base[-1] + 1)
        cuts = np.searchsorted(ids, edges)
        for s in np.flatnonzero(np.diff(cuts)):
            own = slice(cuts[s], cuts[s + 1])
            yield _row(kind, int(s), ids=(ids[own] - edges[s]).astype(np.uint32).tobytes(), counts=np.ascontiguousarray(values[own]).astype(np.int64).tobytes())

    def store_pairs(rows: pd.DataFrame) -> pd.DataFrame:
        s = int(rows["shard"].iloc[0])
        keys, counts = summed(rows, True)
        hashes = mixed(keys)
        order = np.argsort(hashes)
        stored = counts[order]
        large = np.flatnonzero(stored >= 255)
        save(f"{path}/pairs-{s}/hashes.npy", hashes[order])
        save(f"{path}/pairs-{s}/counts.npy", np.minimum(stored, 255).astype(np.uint8))
        save(f"{path}/pairs-{s}/large.npy", np.stack([large, stored[large]]))
        out = [_row("pairs", s, len(keys), int(counts.sum()), _few(counts))]
        context, first = np.unique((keys >> U32).astype(np.int64), return_index=True)
        several = np.stack([counts, counts == 1, counts == 2, counts >= 3], 1).astype(np.int64)
        out += dense_rows("context", context, np.add.reduceat(several, first))
        word, before = np.unique(keys.astype(np.uint32).astype(np.int64), return_counts=True)
        out += dense_rows("word", word, before)
        return pd.DataFrame(out, columns=names)

    def store_dense(rows: pd.DataFrame) -> pd.DataFrame:
        s = int(rows["shard"].iloc[0])
        n = int(sizes[s]) if s < len(sizes) else 1
        values = np.zeros((n, 4), np.int64)
        before = np.zeros(n, np.int64)
        for kind, ids, counts in zip(rows["kind"], rows["ids"], rows["counts"], strict=True):
            at, got = np.frombuffer(ids, np.uint32), np.frombuffer(counts, np.int64)
            if kind == "word":
                before[at] += got
            else:
                values[at] += got.reshape(-1, 4)
        for k, name in enumerate(["total", "after1", "after2", "after3"]):
            save(f"{path}/dense-{s}/{name}.npy", values[:, k])
        save(f"{path}/dense-{s}/before.npy", before)
        few = [*_few(before)[:4]]
        return pd.DataFrame([_row("dense", s, int((before >= 3).sum()), 0, few)], columns=names)

    shards = shards_for(vocabulary.total / 2e6)
    stored = cut_lineage(texts.mapInArrow(count_pairs, BLOBS).groupBy("shard").applyInPandas(store_pairs, STATS))
    few = ["n", "n1", "n2", "n3", "n4"]
    sums = lambda df: [x or 0 for x in df.agg(*[F.sum(c) for c in few]).first()]
    pairs = sums(stored.where("kind = 'pairs'"))
    dense = stored.where("kind <> 'pairs'").select("kind", "shard", "ids", "counts")
    of_words = cut_lineage(dense.groupBy("shard").applyInPandas(store_dense, STATS))
    pairs_stored = stored_shards(stored.where("kind = 'pairs'"), shards)
    dense_stored = stored_shards(of_words, len(base))
    of_words = sums(of_words)
    own, word_own = discounts(pairs[1:]), discounts(of_words[1:])
    kept_back = word_own[1] * of_words[1] + word_own[2] * of_words[2] + word_own[3] * of_words[0]
    held_back = kept_back / pairs[0] if pairs[0] else 1.0
    return Model(vocabulary, pairs[0], shards, own, word_own, held_back, pairs_stored, dense_stored)


def stored_shards(rows: DataFrame, shards: int) -> np.ndarray:
    """Which of the shards the tasks have written: readers then know a lost file from an empty shard."""
    out = np.zeros(shards, bool)
    out[[r["shard"] for r in rows.select("shard").collect()]] = True
    return out


def pair_ids(vocabulary: Vocabulary, hashes: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the tokens, ids of the tokens before them (for the first the begin's), and the tokens' counts."""
    different, inverse = np.unique(hashes, return_inverse=True)
    ids, counts = vocabulary.find(different)
    word = ids[inverse]
    context = np.empty_like(word)
    context[1:] = word[:-1]
    # An unknown word as a context has no id; it shares none with the begin of a text.
    context[context == vocabulary.size] = vocabulary.size + 1
    context[place[:-1]] = vocabulary.size
    return word, context, counts[inverse]


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with n_tokens, n_known, train_tokens, base_score and score.

    ``score`` is the log10 probability of the text and its end; ``base_score`` that of
    counts plus one. A null text is empty. Whole texts, one by one; other columns are
    kept, those named as the new ones are replaced.
    """
    new = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kept = [c for c in docs.columns if c not in (text, *new)]
    narrow = docs.select(*[f"`{c}`" for c in kept], F.col(text).cast("string").alias(text))
    schema = narrow.drop(text).schema
    for name in new:
        schema = schema.add(name, "double" if name.endswith("score") else "long")
    vocabulary = model.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros((0, 4))]
            for _, data, offsets in blocks(batch.column(len(kept))):
                hashes, place = tokens(data, offsets)
                word, context, count = pair_ids(vocabulary, hashes, place)
                base = np.log10((count + 1) / (vocabulary.total + vocabulary.size + 1))
                keys, inverse = np.unique(context.astype(np.uint64) << U32 | word.astype(np.uint64), return_inverse=True)
                p = np.log10(model.probabilities((keys >> U32).astype(np.int64), keys.astype(np.uint32).astype(np.int64)))
                columns = [np.add.reduceat(x.astype(np.float64), place[:-1]) for x in (count > 0, base, p[inverse])]
                out.append(np.stack([np.diff(place), *columns], 1))
            rows = np.concatenate(out)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.array(rows[:, 0].astype(np.int64)),
                    pa.array(rows[:, 1].astype(np.int64)),
                    pa.array(np.full(len(rows), vocabulary.total, np.int64)),
                    pa.array(rows[:, 2]),
                    pa.array(rows[:, 3]),
                ],
                names=[*kept, *new],
            )

    return narrow.mapInArrow(run, schema)


def perplexity(log10_probability: float, n_tokens: int) -> float:
    return 10 ** (-log10_probability / n_tokens)
