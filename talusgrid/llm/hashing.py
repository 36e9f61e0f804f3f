"""Word and window hashes of whole batches of texts, as array operations.

Texts arrive as one byte buffer with offsets, as Arrow stores them, and are handled in pieces of about `PIECE` bytes
(a longer text makes a piece of its own). A word hash is a polynomial over its bytes, taken from one running sum;
a window hash is a polynomial over mixed word hashes. All arithmetic is modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

PIECE = 1 << 19
BLANKS = np.zeros(256, dtype=bool)
BLANKS[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _byte_values(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(2 * seed + 1))


@cache
def _base(seed: int) -> tuple[int, int]:
    base = int(mix(np.array([seed + 77], dtype=np.uint64))[0]) | 1
    return base, pow(base, -1, 1 << 64)


@cache
def _kept_powers(number: int, n: int) -> np.ndarray:
    powers = np.full(n, number, dtype=np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


def _powers(number: int, n: int) -> np.ndarray:
    """Powers of an odd number; only those for an ordinary piece are kept between calls."""
    return _kept_powers(number, 2 * PIECE)[:n] if n <= 2 * PIECE else _kept_powers.__wrapped__(number, n)


def pieces(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of rows) of consecutive rows; a null is an empty text."""
    for chunk in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        full = chunk.fill_null("").cast(pa.large_binary())
        if len(full) == 0:
            continue
        data = np.frombuffer(full.buffers()[2] or b"", dtype=np.uint8)
        at = np.frombuffer(full.buffers()[1], dtype=np.int64)[full.offset : full.offset + len(full) + 1]
        row = 0
        while row < len(full):
            end = max(row + 1, int(np.searchsorted(at, at[row] + PIECE, "right")) - 1)
            yield row, data[at[row] : at[end]], at[row : end + 1] - at[row]
            row = end


def words(data: np.ndarray, at: np.ndarray, blanks: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every run of other bytes than blanks; rows are counted from the start of the piece."""
    if len(data) == 0:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    full = at[:-1] < at[1:]
    blank = blanks[data]
    before = np.empty(len(data), dtype=bool)
    before[0], before[1:] = True, blank[:-1]
    before[at[:-1][full]] = True
    after = np.empty(len(data), dtype=bool)
    after[-1], after[:-1] = True, blank[1:]
    after[at[1:][full] - 1] = True
    start = np.flatnonzero(~blank & before)
    return start, np.flatnonzero(~blank & after) + 1, np.searchsorted(at, start, "right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    base, inverse = _base(seed)
    running = np.zeros(len(data) + 1, dtype=np.uint64)
    terms = _byte_values(seed)[data]
    terms *= _powers(base, len(data))
    np.cumsum(terms, out=running[1:])
    hashed = (running[end] - running[start]) * _powers(inverse, len(data) + 1)[start]
    return mix(hashed + (end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def window_hashes(hashed: np.ndarray, n: int, seed: int) -> np.ndarray:
    """One hash per n consecutive words, also across rows; callers drop those."""
    count = len(hashed) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    base, _ = _base(seed + 1000)
    # total covers `width` words; the binary digits of n say when to double it and when to take one word more.
    total, width = hashed, 1
    for digit in bin(n)[3:]:
        total = total[:-width] * np.uint64(pow(base, width, 1 << 64)) + total[width:]
        width *= 2
        if digit == "1":
            total = total[:-1] * np.uint64(base) + hashed[width:]
            width += 1
    return mix(total + np.uint64(n))
