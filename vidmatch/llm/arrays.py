"""Texts as byte arrays: what the operators that count, compare or encode share.

The functions run inside ``mapInArrow`` tasks. A batch is taken in blocks of whole
texts of about ``BLOCK`` bytes, so that a task's arrays stay small whatever the
batch holds; a longer text is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20

# The white space of the contracts, [\x20\x09-\x0D].
SPACE_BYTES = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]
IS_SPACE = np.zeros(256, bool)
IS_SPACE[SPACE_BYTES] = True

#: ASCII letters to lower case, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

ONE = np.uint64(1)


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, bytes, offsets)`` of consecutive whole texts; a null is an empty text."""
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_binary())
    _, at, values = column.buffers()
    n = len(column)
    offsets = np.frombuffer(at, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block, and the first word of each text (one more at the end)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    space = IS_SPACE[data]
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = space[:-1]
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = space[1:]
    before[offsets[offsets < n]] = True
    after[offsets[offsets > 0] - 1] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2^64, or the powers of its inverse."""
    got = _powers.get((base, inverse))
    if got is None or len(got) < n:
        step = pow(base, -1, 1 << 64) if inverse else base
        got = np.full(max(n, 1 << 16), step, np.uint64)
        got[0] = 1
        np.multiply.accumulate(got, out=got)
        _powers[base, inverse] = got
    return got[:n]


# Any odd numbers do.
BASE_A, BASE_B = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def prefix_sums(values: np.ndarray, base: int = BASE_A) -> np.ndarray:
    """Sums of ``value[i] * base ** i`` before each place; one entry more than values."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE_A) -> np.ndarray:
    """64-bit hashes of the spans, equal for equal content wherever it stands."""
    return mixed((sums[ends] - sums[starts]) * powers(base, len(sums), True)[starts])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


#: A number of its own for each byte at each of the first places of a word.
PLACES = 64
PLACED = mixed(np.arange(1, PLACES * 256 + 1, dtype=np.uint64) * np.uint64(BASE_A))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words: sums of numbers that stand for a byte at a place of the word.

    The numbers have no structure, so that different words agree by chance only; powers
    of one base would agree for long words of a regular build.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    which = place << 8 | data[ragged(starts, lengths)]
    values = PLACED[np.minimum(which, len(PLACED) - 1)]
    beyond = np.flatnonzero(place >= PLACES)
    values[beyond] = mixed((which[beyond].astype(np.uint64) + ONE) * np.uint64(BASE_A))
    return mixed(np.add.reduceat(values, first) + lengths.astype(np.uint64))


def span_mask(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True where at least one of the spans covers the place."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``start, start + 1, ...`` of each span, joined."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(first - starts, lengths)


def free_name(name: str, columns: list[str]) -> str:
    """``name``, or the first variant of it that no column has (names ignore case)."""
    taken = {c.lower() for c in columns}
    return next(n for n in (name, *(f"{name}_{i}" for i in range(1, len(columns) + 2))) if n.lower() not in taken)
