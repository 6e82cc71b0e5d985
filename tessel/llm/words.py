"""Word positions and 64-bit word hashes of an Arrow string column, in numpy.

Words are runs of bytes other than space and 0x09-0x0D, as in the pattern
``[^\\x20\\x09-\\x0D]+``. The hash of a word is a polynomial over a byte table,
finished by a mixer: equal words hash alike everywhere, in any task.
"""

from __future__ import annotations

import gc
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20  # text handled at once inside a task (a longer document is handled alone)
HASH_BYTES = 256 << 10  # text whose words are hashed at once

_WS = np.zeros(256, bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_WORDY = np.zeros(256, bool)  # letters, digits and all bytes of other scripts
_WORDY[48:58] = _WORDY[65:91] = _WORDY[97:123] = _WORDY[128:] = True
_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (shift-xor-multiply)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D | 1


def worker_state() -> dict:
    """A dict that lives as long as the Python worker (shipped functions get
    fresh module globals with every task)."""
    return vars(sys.modules.setdefault("_tessel_worker_state", types.ModuleType("_tessel_worker_state")))


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse modulo 2**64 for ``i`` below at least ``n``."""
    kept = worker_state().setdefault("powers", {})  # one table per Python worker, not per task
    got = kept.get(base)
    if got is None or len(got[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            pair.append(np.cumprod(p))
        got = (pair[0], pair[1])
        if n <= 2 * SLICE_BYTES:  # tables for an exceptionally long text are not kept
            kept[base] = got
    return got


def ranged(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Polynomial hash of ``values[lo:hi]`` for each pair, from one prefix sum."""
    p, inv = powers(len(values) + 1, base)
    s = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * p[:len(values)], out=s[1:])
    return mix((s[hi] - s[lo]) * inv[lo])


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array (nulls as empty) and document offsets into them."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    kind = np.dtype(np.int64 if wide else np.int32)
    if off is None or not len(col):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    o = np.frombuffer(off, kind, len(col) + 1, col.offset * kind.itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[o[0]:o[-1]], o - o[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds at most ``limit`` bytes of ``column``, or one row."""
    gc.collect()  # what earlier tasks of this worker left behind: shipped functions hold cycles with their tables
    for b in batches:
        if not b.num_rows:
            continue
        _, off = buffers(b.column(column))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
            yield b.slice(i, j - i)
            i = j


def folded(col: pa.Array) -> pa.Array:
    """The column in lower case, letters of all scripts."""
    return pc.utf8_lower(col)


class Words:
    """Word boundaries of a string column: word ``k`` is ``data[start[k]:end[k]]``
    and document ``d`` owns words ``first[d]`` to ``first[d + 1]``."""

    def __init__(self, col: pa.Array, lower: bool = False):
        self.data, self.off = buffers(col)
        if lower:
            self.data = _ASCII_LOWER[self.data]
        inside = ~_WS[self.data]
        n = len(inside)
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
            edge = self.off[(self.off > 0) & (self.off < n)]
            before[edge] = False
            after[edge - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, self.off)

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A hash per word, taken over runs of about ``HASH_BYTES`` (or one longer word), so that the powers and sums stay small.
        Words may overlap; they are in order of their starts."""
        out = np.empty(len(self.start), np.uint64)
        a = 0
        while a < len(out):
            low = int(self.start[a])
            b = max(a + 1, int(np.searchsorted(self.start, low + HASH_BYTES)))
            out[a:b] = ranged(_BYTE[self.data[low:int(self.end[a:b].max())]], self.start[a:b] - low, self.end[a:b] - low)
            a = b
        return out

    def strip_signs(self) -> None:
        """Take the ASCII signs around each word away; a word of signs alone is dropped."""
        data, start, end = self.data, self.start.copy(), self.end.copy()
        todo = np.flatnonzero(~_WORDY[data[end - 1]]) if len(self) else np.zeros(0, np.int64)
        while len(todo):
            end[todo] -= 1
            todo = todo[end[todo] > start[todo]]
            todo = todo[~_WORDY[data[end[todo] - 1]]]
        todo = np.flatnonzero(end > start)
        todo = todo[~_WORDY[data[start[todo]]]]
        while len(todo):
            start[todo] += 1
            todo = todo[~_WORDY[data[start[todo]]]]
        keep = end > start
        self.start, self.end = start[keep], end[keep]
        self.first = np.searchsorted(self.start, self.off)

    def of(self, d: int) -> list[bytes]:
        """The words of document ``d``."""
        return self.data[self.off[d]:self.off[d + 1]].tobytes().split()


def gathered(flat: np.ndarray, lo: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``flat[lo[k]:lo[k] + count[k]]`` of every ``k``, one after another."""
    total = int(count.sum())
    if not total:
        return flat[:0]
    ends = np.cumsum(count)
    return flat[np.repeat(lo - (ends - count), count) + np.arange(total)]
