"""Bytes, words and hashes of whole batches of texts as arrays.

Texts reach a Python worker as Arrow batches. They are cut into blocks of about a
megabyte, whole documents each, so the arrays stay in cache and memory stays bounded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
#: Slices of more bytes are digested instead of summed.
LONG_SLICE = 512
_RNG = np.random.Generator(np.random.PCG64(20240607))
_LETTER = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Tables(dict):
    """Tables of the process that makes them. Functions of this package travel with their
    modules' values, and the driver's tables would go along with each of them."""

    def __reduce__(self):
        return type(self), ()


_powers = _Tables()


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        step = np.full(max(n + 1, BLOCK + 1), base, dtype=np.uint64)
        step[0] = 1
        have = np.multiply.accumulate(step)
        if len(have) <= 4 * BLOCK:
            _powers[base] = have
    return have[: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of every value over the whole 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return bytes_[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes; a longer row is a block of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


class Sums:
    """Prefix sums from which the hash of any slice of bytes (or of 64-bit values) follows.

    Sums modulo 2 ** 64 have pairs of slices with the same hash whatever the constants, the
    shortest of which have a thousand places; longer slices of bytes get a digest of their own.
    """

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.data = data if data.dtype == np.uint8 else None
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((_LETTER[data] if data.dtype == np.uint8 else data) * _power(_BASE, n)[:n], out=self.sums[1:])
        self.back = _power(_INVERSE, n)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        value = (self.sums[ends] - self.sums[starts]) * self.back[starts]
        out = mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        if self.data is not None:
            for i in np.flatnonzero(ends - starts > LONG_SLICE).tolist():
                digest = hashlib.blake2b(self.data[starts[i] : ends[i]], digest_size=8).digest()
                out[i] = np.uint64(int.from_bytes(digest, "little"))
        return out

    def every(self, k: int) -> np.ndarray:
        """``of`` for every run of k, from views instead of gathered copies; k is a window or
        shorter and never a long slice."""
        value = (self.sums[k:] - self.sums[: len(self.sums) - k]) * self.back[: len(self.sums) - k]
        return mix(value + np.uint64(k * 0xD6E8FEB86659FD93 % 2**64))


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (maximal runs of ``is_word`` bytes that do not cross
    rows), and for each row the number of the first word, with the total at the end."""
    n = len(data)
    inside = is_word[data]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = inside[:-1]
        before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    if n:
        after[-1] = False
        after[:-1] = inside[1:]
        after[edges - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive words, whatever row they belong to."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = hashes[:n] * _PLACE[0]
    for j in range(1, k):
        total = total + hashes[j : j + n] * _PLACE[j]
    return mix(total + np.uint64(k))


def in_row(firsts: np.ndarray, k: int, n_words: int) -> np.ndarray:
    """Which starts have all of their k words in the same row."""
    n = n_words - k + 1
    if n <= 0:
        return np.empty(0, bool)
    row = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    return row[:n] == row[k - 1 :]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words between white space.
PLAIN = np.ones(256, bool)
PLAIN[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of letters, digits and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
