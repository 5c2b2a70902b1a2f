"""Vectorised word hashing over Arrow text columns, for use inside Spark tasks.

A block of texts is one byte array. A word's hash comes from two entries of a
prefix sum of byte codes times powers of an odd base, so that equal words have
equal hashes wherever they stand, and any substring of a word can be hashed in
the same way without a loop over characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once.
BLOCK_BYTES = 1 << 21
#: The same where many numbers are made for each byte.
SMALL_BLOCK = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


@lru_cache(maxsize=1)
def byte_codes() -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(11))
    return rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


#: Numbers of powers that a process keeps (for small blocks 16 MB). Longer rows of them are made when needed, so that no worker holds those of the longest text it met.
KEPT_POWERS = (2 * SMALL_BLOCK, BLOCK_BYTES + (1 << 12))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        out = np.empty(n, np.uint64)
        out[0] = 1
        done, step = 1, base
        while done < n:
            more = min(done, n - done)
            out[done:done + more] = out[:more] * np.uint64(step)
            done += more
            step = step * step & _MASK
        return out

    return run(_BASE), run(pow(_BASE, -1, 1 << 64))


_kept_powers = lru_cache(maxsize=len(KEPT_POWERS))(_powers)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    kept = next((k for k in KEPT_POWERS if n <= k), None)
    return _kept_powers(kept) if kept else _powers(n)


class Hasher:
    """Hashes of substrings of one byte array."""

    def __init__(self, data: np.ndarray):
        self.data = data
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(byte_codes()[data] * up[:len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, limit: int = SMALL_BLOCK) -> np.ndarray:
    """``Hasher(data)(start, end)`` of words in order that do not overlap, in about ``limit`` bytes of ``data`` at a time."""
    out, lo = np.empty(len(start), np.uint64), 0
    while lo < len(start):
        base = int(start[lo])
        hi = max(lo + 1, int(np.searchsorted(end, base + limit, "right")))
        out[lo:hi] = Hasher(data[base:int(end[hi - 1])])(start[lo:hi] - base, end[lo:hi] - base)
        lo = hi
    return out


def hash_bytes(word: bytes) -> int:
    h, step = 0, 1
    for c in word:
        h = (h + int(byte_codes()[c]) * step) & _MASK
        step = step * _BASE & _MASK
    return h


@lru_cache(maxsize=1)
def word_bytes() -> np.ndarray:
    """True for bytes that belong to words: ASCII letters and all bytes of other characters."""
    out = np.zeros(256, bool)
    out[ord("A"):ord("Z") + 1] = out[ord("a"):ord("z") + 1] = True
    out[128:] = True
    return out


def text_bytes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offsets of its rows; null rows are empty."""
    column = column.fill_null("").cast(pa.large_string())
    if lower:
        column = pc.utf8_lower(column)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def blocks(data: np.ndarray, offsets: np.ndarray, limit: int = BLOCK_BYTES, table: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets inside them) of pieces of about ``limit`` bytes.

    A text over the limit is cut at bytes that belong to no word (of ``table``), and gives
    several pieces with the same first row; so what is added up per row stays
    exact and memory stays bounded. A single word over the limit stays whole.
    """
    n, row = len(offsets) - 1, 0
    inside = word_bytes() if table is None else table
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        last = min(last, n)
        lo, hi = int(offsets[row]), int(offsets[last])
        if last == row + 1 and hi - lo > limit:
            at = lo
            while at < hi:
                end = min(hi, at + limit)
                while end < hi and inside[data[end]]:
                    end += 1
                yield row, data[at:end], np.array([0, end - at])
                at = end
        else:
            yield row, data[lo:hi], offsets[row:last + 1] - lo
        row = last


def word_bounds(data: np.ndarray, offsets: np.ndarray,
                table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the row (of ``offsets``) that each lies in. ``table``: which bytes belong to words."""
    inside = (word_bytes() if table is None else table)[data]
    if not inside.any():
        none = np.zeros(0, np.int64)
        return none, none, none
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    cuts = offsets[1:-1]
    before[cuts[cuts < len(data)]] = False
    after[cuts[cuts > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1
