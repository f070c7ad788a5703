"""Word and shingle hashes of whole Arrow string columns with numpy.

Words are runs of bytes other than space and 0x09-0x0D, A-Z lower-cased. A word's
hash is a polynomial over random byte values, taken from prefix sums, so no Python
loop runs over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INV = pow(BASE, -1, 1 << 64)
CHUNK_BYTES = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def byte_values() -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95))
    values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


def powers(base: int, n: int) -> np.ndarray:
    if n <= CHUNK_BYTES:
        return _first_powers(base)[:n]
    out = np.full(n, U(base), dtype=U)
    out[:1] = 1
    return np.multiply.accumulate(out)


@cache
def _first_powers(base: int) -> np.ndarray:
    out = np.full(CHUNK_BYTES, U(base), dtype=U)
    out[0] = 1
    return np.multiply.accumulate(out)


def chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets from 0) of about CHUNK_BYTES each; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, side="right")) - 1
        end = min(max(end, row + 1), len(column))
        own = offsets[row : end + 1]
        yield row, end, data[own[0] : own[-1]], own - own[0]
        row = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each row's words start (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(len(offsets), np.int64)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | first[1:n]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:] | first[1:n]
    begin, end = np.flatnonzero(start), np.flatnonzero(stop) + 1
    sums = np.zeros(n + 1, U)
    np.cumsum(byte_values()[data] * powers(BASE, n), out=sums[1:])
    hashes = (sums[end] - sums[begin]) * powers(BASE_INV, n)[begin]
    return mix(hashes + (end - begin).astype(U)), np.searchsorted(begin, offsets)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` words that follow each other; of fewer words, one of them all."""
    if len(hashes) == 0:
        return hashes
    take = min(width, len(hashes))
    total = np.full(len(hashes) - take + 1, U(take), dtype=U)
    for i in range(take):
        total = mix(total * U(0x9FB21C651E98DF25) + hashes[i : len(hashes) - take + 1 + i])
    return total


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of a row's ``width``-word shingles; fewer words make one shingle."""
    return np.unique(windows(hashes, width))


def shingle_sets(hashes: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """What shingles() gives for each row, joined, and where each row's begin (one more at the end)."""
    whole = windows(hashes, width)
    parts = [whole[a : b - width + 1] if b - a >= width else windows(hashes[a:b], width) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    begin = np.cumsum([0, *map(len, parts)])
    flat = np.concatenate([np.zeros(0, U), *parts])
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist()):
        flat[a:b].sort()
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    new[begin[begin < len(flat)]] = True
    return flat[new], np.append(0, np.cumsum(new))[begin]
