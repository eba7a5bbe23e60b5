"""Words of whole texts as flat numpy arrays, straight from Arrow buffers, and hashes of words and word runs.

A word is a maximal run of bytes of a class; both classes end words only at ASCII bytes, so UTF-8 texts need no decoding.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer single text is a chunk of its own.
CHUNK_BYTES = 1 << 20

SPACED = np.ones(256, dtype=bool)  # [^\x20\x09-\x0D]+
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)  # [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, after lower-casing
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LETTERS = np.zeros(256, dtype=bool)  # letters and non-ASCII, after lower-casing
LETTERS[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(20240229).integers(1, 2**63, size=(4, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = [int(x) | 1 for x in np.random.default_rng(77).integers(2**32, 2**63, size=4)]
_powers: dict[tuple[int, bool], np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _power(seed: int, inverse: bool, n: int) -> np.ndarray:
    """Powers 0..n-1 of the seed's odd base, or of its inverse modulo 2^64."""
    have = _powers.get((seed, inverse))
    if have is None or len(have) < n:
        base = pow(_BASE[seed], -1, 1 << 64) if inverse else _BASE[seed]
        have = np.full(max(n, CHUNK_BYTES + 1), base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 2 * CHUNK_BYTES:
            _powers[seed, inverse] = have
    return have[:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each ``data[start:end]``: a polynomial of random byte values modulo 2^64, mixed with the length."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + CHUNK_BYTES, side="right")))
        lo, hi = starts[i:j] - base, ends[i:j] - base
        n = int(hi[-1])
        total = np.empty(n + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(_BYTES[seed][data[base:base + n]] * _power(seed, False, n), out=total[1:])
        out[i:j] = (total[hi] - total[lo]) * _power(seed, True, n)[lo] + (hi - lo).astype(np.uint64) * _ODD
        i = j
    return mix(out)


def gram_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``k`` consecutive entries; ``len(words) - k + 1`` values (none if there are fewer words)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    factor, acc = np.uint64(_BASE[seed] ^ 0x5851F42D4C957F2C | 1), words[:n].copy()
    for j in range(1, k):
        acc *= factor
        acc += words[j:n + j]
    return mix(acc)


@dataclass
class Chunk:
    """Consecutive rows of a batch: their bytes and words.  ``row`` is the row of each word, counted from ``first``."""

    first: int
    rows: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray

    def bounds(self) -> np.ndarray:
        """``rows + 1`` positions: words of row i are ``bounds[i]:bounds[i + 1]``."""
        return np.searchsorted(self.row, np.arange(self.rows + 1))

    def hashes(self, seed: int = 0) -> np.ndarray:
        return word_hashes(self.data, self.starts, self.ends, seed)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (rows + 1) and bytes of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(1, dtype=np.int64), np.empty(0, dtype=np.uint8)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return offsets, np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)


def chunks(column: pa.Array, kind: np.ndarray = SPACED, lower: bool = False, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a batch's text column into chunks of about ``limit`` bytes and find their words."""
    offsets, data = text_buffers(column)
    rows, first = len(offsets) - 1, 0
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        last = min(last, rows)
        part, own = data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        part = LOWER[part] if lower else part
        inside = kind[part]
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        edge = own[:-1][own[:-1] < own[1:]]
        begin[edge] = inside[edge]
        edge = own[1:][own[:-1] < own[1:]] - 1
        end[edge] = inside[edge]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        yield Chunk(first, last - first, part, own, starts, ends, np.searchsorted(own, starts, side="right") - 1)
        first = last
