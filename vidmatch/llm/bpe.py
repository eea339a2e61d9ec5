"""Byte-level BPE: boundaries by automaton scans over arrays, cached pair merging.

The text is cut where the byte-level BPE pattern of the rank file would cut it, but
without a regular expression. Each code point gets a class; an automaton over the
classes says where a piece begins. The automaton's transition functions are
associative under composition, so a long array is cut into rows that are scanned side
by side: one pass composes the functions of each row, the row results are chained,
and a second pass gives the state at every place.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from vidmatch.llm.arrays import blocks

# The white space of the pattern's \s (Unicode White_Space).
WHITE_SPACE = [
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]
# The endings that the pattern cuts off after an apostrophe.
SHORT_ENDINGS, LONG_ENDINGS = "stmd", ["re", "ve", "ll"]

# Longer pieces are merged one by one with a heap and are not kept; the places of the
# shorter ones fit into a byte. So many places are merged side by side.
SHORT_PIECE, MERGED_PLACES = 200, 1 << 15

LETTER, NUMBER, OTHER, WHITE, SHORT, LONG = range(6)  # SHORT, LONG: apostrophe before an ending

# States: the run that the last code point belongs to; FREE after a finished ending;
# ONE_MORE, TWO_MORE inside an ending.
IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_WHITE, FREE, ONE_MORE, TWO_MORE = range(7)


def _transitions() -> np.ndarray:
    """``table[class, state]``: the next state."""
    table = np.empty((6, 7), np.uint8)
    table[LETTER], table[NUMBER], table[OTHER], table[WHITE] = IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_WHITE
    # An apostrophe opens an ending only where a piece begins with it: not inside a
    # run of other signs (nor after one blank, which is taken along; see _classes).
    table[SHORT], table[LONG] = ONE_MORE, TWO_MORE
    table[SHORT, IN_OTHER] = table[LONG, IN_OTHER] = IN_OTHER
    table[:, TWO_MORE] = ONE_MORE
    table[:, ONE_MORE] = FREE
    return table


TRANSITIONS = _transitions()


@cache
def code_point_classes() -> np.ndarray:
    """The class of every code point: letter, number, white space, other."""
    table = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            table[c] = LETTER
        elif kind == "N":
            table[c] = NUMBER
    table[WHITE_SPACE] = WHITE
    return table


def _classes(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Classes of the code points; ``first`` marks those that begin a text."""
    kinds = code_point_classes()[points]
    n = len(points)
    at = np.flatnonzero(points == ord("'"))
    at = at[at + 1 < n]
    at = at[~first[at + 1]]
    # After a blank the apostrophe belongs to " ?[^\s\p{L}\p{N}]+".
    at = at[(at == 0) | first[at] | (points[at - 1] != ord(" "))]
    follow = points[at + 1]
    short = np.isin(follow, [ord(c) for c in SHORT_ENDINGS])
    kinds[at[short]] = SHORT
    at, follow = at[~short], follow[~short]
    keep = at + 2 < n
    at, follow = at[keep], follow[keep]
    third = points[at + 2]
    long = np.zeros(len(at), bool)
    for a, b in LONG_ENDINGS:
        long |= (follow == ord(a)) & (third == ord(b))
    kinds[at[long & ~first[at + 2]]] = LONG
    return kinds


def scan(kinds: np.ndarray, first: np.ndarray, width: int = 1024) -> np.ndarray:
    """The automaton's state after every place; it starts anew at each text."""
    n = len(kinds)
    # A code point that begins a text has a constant function: the step from FREE.
    table = np.concatenate([TRANSITIONS, np.repeat(TRANSITIONS[:, FREE : FREE + 1], 7, 1)])
    rows = -(-n // width)
    symbols = np.zeros(rows * width, np.uint8)
    symbols[:n] = kinds + np.uint8(6) * first
    symbols = np.ascontiguousarray(symbols.reshape(rows, width).T)
    flat = table.ravel()
    states = np.tile(np.arange(7, dtype=np.intp), (rows, 1))
    for j in range(width):  # compose the functions of all rows side by side
        states = flat[symbols[j].astype(np.intp)[:, None] * 7 + states].astype(np.intp)
    enter = np.empty(rows, np.intp)
    state = FREE
    for r in range(rows):
        enter[r] = state
        state = states[r, state]
    out = np.empty((width, rows), np.uint8)
    for j in range(width):
        out[j] = flat[symbols[j].astype(np.intp) * 7 + enter]
        enter = out[j].astype(np.intp)
    return out.T.ravel()[:n]


def boundaries(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places of the code points that begin a piece."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kinds = _classes(points, first)
    states = scan(kinds, first)
    before = np.empty(n, np.uint8)
    before[0] = FREE
    before[1:] = states[:-1]
    before[first] = FREE
    starts = (states != before) & (before != ONE_MORE) & (before != TWO_MORE)
    starts |= first | (before == FREE)
    # Of several white spaces before a sign, the last one stands apart; a blank there
    # is the beginning of the next piece.
    white = states == IN_WHITE
    last = np.zeros(n, bool)
    last[:-1] = white[:-1] & ~white[1:] & ~first[1:]
    starts |= last
    taken = np.zeros(n, bool)
    taken[1:] = last[:-1] & (points[:-1] == ord(" "))
    return np.flatnonzero(starts & ~taken)


class Encoder:
    """Ranks, a cache of merged pieces and the way back from ids to bytes."""

    def __init__(self, ranks: dict[bytes, int], cache_size: int = 60_000):
        self.ranks = ranks
        self.pieces = [b""] * (max(ranks.values(), default=-1) + 1)
        for piece, i in ranks.items():
            self.pieces[i] = piece
        self.none = len(self.pieces)  # beyond every rank: ranks may have gaps
        self.lengths = [len(p) for p in self.pieces]
        self.decimals = [str(i) for i in range(len(self.pieces))]
        #: Ids by piece; old ones go when there are many.
        self.known: dict[bytes, tuple[int, ...]] = {}
        self.old: dict[bytes, tuple[int, ...]] = {}
        self.size = cache_size
        #: The ids of the 256 bytes and of all pairs of them (``none``: not a piece), and the sorted
        #: pairs of ids that merge (first times ``none`` plus second) with the id that they give.
        self.bytes = np.array([ranks.get(bytes([i]), self.none) for i in range(256)], np.int64)
        self.first = np.array([ranks.get(bytes([a, b]), self.none) for a in range(256) for b in range(256)], np.int64)
        pairs = sorted(
            (first * self.none + second, i)
            for piece, i in ranks.items()
            for cut in range(1, len(piece))
            if (first := ranks.get(piece[:cut])) is not None and (second := ranks.get(piece[cut:])) is not None
        )
        self.pairs = np.array([*[k for k, _ in pairs], np.iinfo(np.int64).max], np.int64)
        self.into = np.array([*[i for _, i in pairs], self.none], np.int64)

    def learn(self, pieces: set[bytes]) -> list[bytes]:
        """Merge the pieces that are not known yet, all at once; the long ones, not worth keeping."""
        if len(self.known) >= self.size:
            self.known, self.old = {}, self.known
        known, ranks = self.known, self.ranks
        new = pieces.difference(known)
        kept = self.old.keys() & new
        known.update(zip(kept, map(self.old.__getitem__, kept), strict=True))
        whole = ranks.keys() & (new - kept)
        known.update((p, (ranks[p],)) for p in whole)
        new = sorted(new - kept - whole, key=len)
        long = new[bisect.bisect(new, SHORT_PIECE, key=len) :]
        known.update((p, self._merge_long(p)) for p in long)
        del new[len(new) - len(long) :]
        at = 0
        while at < len(new):
            # Pieces of about the same length, few enough for their places to stay near.
            end = min(len(new), at + max(1, MERGED_PLACES // len(new[at])))
            while len(new[end - 1]) * (end - at) > 2 * MERGED_PLACES and end - at > 1:
                end = at + (end - at) // 2
            known.update(zip(new[at:end], self._merge_many(new[at:end]), strict=True))
            at = end
        return long

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece: the pair of lowest rank is merged first, the leftmost of equals."""
        if piece in self.ranks:
            return (self.ranks[piece],)
        return self._merge_long(piece) if len(piece) > SHORT_PIECE else self._merge_many([piece])[0]

    def _ranks_of(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The id that each pair of ids gives, ``none`` if it does not merge."""
        wanted = first * self.none + second
        at = np.searchsorted(self.pairs, wanted)
        return np.where(self.pairs[at] == wanted, self.into[at], self.none)

    def _merge_many(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of pieces sorted by length, merged side by side: a round merges one pair of each.

        A column holds the places of a piece; a part stands at the place where it
        begins. ``key`` is the rank of the pair that begins at a place, then the place,
        so that the least key of a column is the leftmost pair of lowest rank.
        """
        none, n, width = self.none, len(pieces), len(pieces[-1])
        lengths = np.array([len(p) for p in pieces])
        data = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8).reshape(n, width).T
        places = np.arange(width)[:, None]
        part = np.where(places < lengths, self.bytes[data], none)
        after = np.broadcast_to(places + 1, (width, n)).copy()  # where the next part begins
        before = np.broadcast_to(places - 1, (width, n)).copy()
        key = np.full((width, n), none << 8, np.int64)
        key[:-1] = np.where(places[1:] < lengths, self.first[data[:-1].astype(np.int64) << 8 | data[1:]], none) << 8 | places[:-1]
        alive = places < lengths
        columns = np.arange(n)  # those with a pair that may merge
        open_keys = key
        while len(columns):
            low = open_keys.min(0)
            going = low < none << 8
            if not going.all():
                columns, low = columns[going], low[going]
                open_keys = np.ascontiguousarray(open_keys[:, going])
            at, own = low & 255, np.arange(len(columns))
            part[at, columns] = low >> 8
            gone = after[at, columns]
            follow = after[gone, columns]
            alive[gone, columns] = False
            open_keys[gone, own] = none << 8
            after[at, columns] = follow
            # The pair that begins here now, if a part follows.
            more = follow < lengths[columns]
            some = columns[more]
            before[follow[more], some] = at[more]
            open_keys[at, own] = none << 8
            open_keys[at[more], own[more]] = self._ranks_of(part[at[more], some], part[follow[more], some]) << 8 | at[more]
            # The pair that ends here now.
            left = before[at, columns]
            more = left >= 0
            some, left = columns[more], left[more]
            open_keys[left, own[more]] = self._ranks_of(part[left, some], part[at[more], some]) << 8 | left
        ids = part.T[alive.T].tolist()
        ends = np.cumsum(alive.sum(0)).tolist()
        return [tuple(ids[a:b]) for a, b in zip([0, *ends], ends, strict=False)]

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same with a heap and linked places, for pieces of any length."""
        import heapq

        get = self.ranks.get
        n = len(piece)
        end = list(range(1, n + 1))  # of the part that begins here; 0: merged away
        back = list(range(-1, n))  # where the part before begins
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue  # one of the parts has changed since
            end[i], end[j] = stop, 0
            back[stop] = i
            if stop < n and (r := get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
            if i and (r := get(piece[back[i] : stop])) is not None:
                heapq.heappush(heap, (r, back[i], stop))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def encode(self, column: pa.Array, limit: int = 1 << 20) -> Iterator[list[int]]:
        """The ids of each text."""
        for _, data, offsets in blocks(column, limit):
            raw = data.tobytes()
            points = np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
            lead = np.flatnonzero((data & 0xC0) != 0x80)  # byte where each code point begins
            first = np.zeros(len(points), bool)
            begins = offsets[:-1][offsets[1:] > offsets[:-1]]
            first[np.searchsorted(lead, begins)] = True
            cuts = lead[boundaries(points, first)]
            of_text = np.searchsorted(cuts, offsets).tolist()
            cuts = np.append(cuts, len(data)).tolist()
            pieces = [raw[s:e] for s, e in zip(cuts, cuts[1:], strict=False)]
            long = self.learn(set(pieces))
            found = self.known.__getitem__
            for a, b in zip(of_text, of_text[1:], strict=False):
                yield list(chain.from_iterable(map(found, pieces[a:b])))
            for piece in long:
                del self.known[piece]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.pieces[i] for i in ids])


@cache
def encoder(path: str) -> Encoder:
    """One for each rank file and worker; the file is found on every machine."""
    with open(path, "rb") as file:
        return Encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, file)})


def encode(
    docs: DataFrame, ranks: str, text: str = "text", ids: str = "ids", lengths: str = "token_bytes"
) -> DataFrame:
    """``docs`` with the token ids of ``text`` and the bytes that each id stands for.

    ``ranks`` is the place of the rank file, the same on every machine. A null or
    empty text has no ids. Every other column is kept; the new ones replace columns of
    their names. Rows are encoded one by one, so repeated rows give repeated results.
    ``sum(token_bytes)`` is the text's length, and prefix sums are the offsets.
    """
    kept = [c for c in docs.columns if c not in (ids, lengths)]
    docs = docs.select(*[f"`{c}`" for c in kept])
    numbers = ArrayType(IntegerType())
    out = StructType([*docs.schema, StructField(ids, numbers), StructField(lengths, numbers)])
    k = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks)
        for batch in batches:
            # A few rows at a time: ids take more room than their text.
            for part in _parts(batch, k):
                rows = list(own.encode(part.column(k)))
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns,
                        pa.array(rows, pa.list_(pa.int32())),
                        pa.array([[own.lengths[i] for i in r] for r in rows], pa.list_(pa.int32())),
                    ],
                    names=[*part.schema.names, ids, lengths],
                )

    return docs.mapInArrow(run, out)


def decode(encoded: DataFrame, ranks: str, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of its ids; null ids give empty bytes."""
    kept = [c for c in encoded.columns if c != data]
    encoded = encoded.select(*[f"`{c}`" for c in kept])
    k = kept.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks)
        for batch in batches:
            rows = [own.decode(x or []) for x in batch.column(k).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.binary())], names=[*kept, data])

    return encoded.mapInArrow(run, StructType([*encoded.schema, StructField(data, BinaryType())]))


def digests(docs: DataFrame, ranks: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode, decode and digest in one pass: n_tokens and two SHA-256 for each row.

    The digests are those of ``encode`` and ``decode`` (decimal ids joined by blanks;
    decoded bytes), without moving the arrays to the JVM and back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(ranks)
        for batch in batches:
            n, of_ids, of_bytes = [], [], []
            for ids in own.encode(batch.column(1)):
                n.append(len(ids))
                of_ids.append(hashlib.sha256(" ".join([own.decimals[i] for i in ids]).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    docs = docs.select(key, text)
    kind = docs.schema[key].dataType.simpleString()
    return docs.mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    for row, _, offsets in blocks(batch.column(column)):
        yield batch.slice(row, len(offsets) - 1)


def default_ranks(spark: SparkSession, name: str = "byte_bpe_50k.tiktoken") -> str:
    """The public vocabulary's place, or the one that ``spark.llm.bpe.ranks`` names."""
    import public_tokenizers

    return spark.conf.get("spark.llm.bpe.ranks", None) or public_tokenizers.path(name)
