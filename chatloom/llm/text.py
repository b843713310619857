"""Vectorised text kernels shared by the operators of this subpackage.

Everything works on the raw UTF-8 buffers of an Arrow string column, so that no Python string
is made per row. A *chunk* is some consecutive rows of a batch: `data` (uint8) and `offs`
(row i is data[offs[i]:offs[i+1]]). A null text has no bytes, as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once; bounds the temporaries of a Python worker. A longer row is a chunk alone.
CHUNK_BYTES = 500_000

_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)

#: Letters, digits and all bytes of multi-byte characters form words; case and punctuation don't count.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Words by ASCII white space alone; every other byte counts.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_rng = np.random.Generator(np.random.Philox(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 64)
        for k, base in enumerate((_P, _P_INV)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[k] = np.cumprod(out)
    return _powers[0], _powers[1]


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply); wraps."""
    x = x + np.uint64((seed * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) & _MASK)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offs) of a string column, offs from 0; nulls as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offs[0] : offs[-1]], offs - offs[0]


def chunks(data: np.ndarray, offs: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, data, offs) for runs of rows of at most `most` bytes, or one longer row."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, "right")) - 1)
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def lower(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals as small letters; same length."""
    out = _LOWER[data]
    if len(out) > 1:
        after = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][after] += 0x20
    return out


def words(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the pointer of each row into them (row i has words ptr[i]:ptr[i+1])."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = table[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    filled = offs[1:] > offs[:-1]
    a, b = offs[:-1][filled], offs[1:][filled] - 1
    first[a] = inside[a]
    last[b] = inside[b]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes: a polynomial by prefix sums, finalised with its length."""
    power, inverse = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def owners(ptr: np.ndarray) -> np.ndarray:
    """The row of each word, of a pointer as words() gives."""
    return np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))


def ngrams(hashes: np.ndarray, ptr: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of consecutive words within rows, and their pointer; a row of fewer words has none."""
    count = np.maximum(np.diff(ptr) - (n - 1), 0)
    out_ptr = np.zeros(len(ptr), np.int64)
    np.cumsum(count, out=out_ptr[1:])
    at = np.arange(out_ptr[-1]) + np.repeat(ptr[:-1] - out_ptr[:-1], count)
    out = hashes[at].copy()
    for k in range(1, n):
        out = mix64(out * np.uint64(0x9FB21C651E98DF25) + hashes[at + k], k)
    return out, out_ptr
