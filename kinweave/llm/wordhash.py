"""Words of many texts at once: byte classes and prefix hashes over Arrow buffers.

A word's hash is a polynomial over its bytes modulo 2**64, taken from prefix sums and mixed; equal
words have equal hashes in every process, as all constants come from a fixed seed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked off in blocks of so many bytes (a longer text is a block of its own).
BLOCK_BYTES = 1 << 20

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
#: Multipliers of the words of an n-gram.
GRAM = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _table(separators) -> np.ndarray:
    is_word = np.ones(256, dtype=bool)
    is_word[list(separators)] = False
    return is_word


#: Words are runs of other bytes than these (after A-Z are lower-cased).
NOT_SPACE = _table([0x20, *range(0x09, 0x0E)])
ALNUM = _table([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(BLOCK_BYTES, n) + 1
    if size not in _POWERS:
        _POWERS.clear()
        made = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _POWERS[size] = tuple(made)
    return _POWERS[size]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64, count=len(column) + 1, offset=column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:
        keep = np.where(np.asarray(column.is_valid()), np.diff(offsets), 0)
        if (keep != np.diff(offsets)).any():  # a null slot that still spans bytes
            return buffers(column.fill_null("" if pa.types.is_large_string(column.type) else b""))
    return raw, offsets


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end
        at = end


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int = BLOCK_BYTES) -> np.ndarray:
    """Hashes of ascending byte ranges that do not overlap, worked off in pieces of about ``limit`` bytes."""
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(ends, starts[at] + limit, side="right")))
        s, e = starts[at:end] - starts[at], ends[at:end] - starts[at]
        n = int(e[-1])
        up, down = _powers(n)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data[starts[at] : starts[at] + n]] * up[:n], out=sums[1:])
        out[at:end] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        at = end
    return out


class Words:
    """Words of a block of texts: byte ranges, hashes, and the first word of each text."""

    __slots__ = ("starts", "ends", "hashes", "first", "text")

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
        base = int(offsets[0])
        data = LOWER[raw[base : int(offsets[-1])]]
        n = len(data)
        inside = np.zeros(n + 1, dtype=bool)
        inside[:n] = is_word[data]
        cut = np.zeros(n + 1, dtype=bool)
        cut[offsets - base] = True
        before = np.zeros(n + 1, dtype=bool)
        before[1:] = inside[:n]
        self.starts = np.flatnonzero(inside & (~before | cut))
        self.ends = np.flatnonzero(before & (~inside | cut))
        up, down = _powers(n)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))
        #: word index at which each text begins; one more at the end
        self.first = np.searchsorted(self.starts, offsets - base)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.starts = self.starts + base
        self.ends = self.ends + base


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that start at each word (those that end within the array)."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.full(size, np.uint64(n), dtype=np.uint64)
    for j in range(n):
        h = (h + hashes[j : j + size]) * GRAM[j % len(GRAM)]
        h ^= h >> np.uint64(29)
    return h
