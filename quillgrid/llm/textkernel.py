"""Vectorised text kernels: words, hashes and n-grams of many texts at once, straight from Arrow buffers.

All functions work on *blocks*: consecutive rows of a string column whose UTF-8 bytes lie side by side. Blocks
hold about BLOCK_BYTES of text (one longer text makes a block of its own), which bounds a worker's memory.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_U = np.uint64


def release() -> None:
    """Give freed memory back to the system: a worker lives on after a task, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # glibc keeps what was freed otherwise
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers of a seed, the same on every machine."""
    with np.errstate(over="ignore"):
        return mix(_U(seed) * _U(0x9E3779B97F4A7C15) + np.arange(1, n + 1, dtype=np.uint64) * _U(0xD1B54A32D192ED03))


_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
#: What bytes count for in the hashes of words, of each of two kinds.
_BYTE = stream(7, 256), stream(8, 256)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE to the powers 0..n-1, and their inverses modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        size = 1 << max(21, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["up"][:n], _powers["down"][:n]


class Block:
    """Rows lo..hi of a column: `data` their bytes, `off` the rows' byte offsets in it."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lo: int, hi: int):
        self.data, self.off, self.lo, self.hi = data, off, lo, hi

    @property
    def n(self) -> int:
        return self.hi - self.lo


def blocks(column: pa.Array, max_bytes: int = BLOCK_BYTES, max_rows: int = 1 << 30) -> Iterator[Block]:
    """Blocks of some max_bytes of text, one text at least, and max_rows rows at most."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    wide = pa.types.is_large_string(column.type)
    off = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32, count=n + column.offset + 1)[column.offset :] if n else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, int(off[lo]) + max_bytes, side="right")) - 1)
        hi = min(hi, lo + max_rows)
        yield Block(data[off[lo] : off[hi]], (off[lo : hi + 1] - off[lo]).astype(np.int64), lo, hi)
        lo = hi


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Words:
    """The words of a block: byte spans, 64-bit hashes, and `first[i]:first[i+1]`, the words of row i."""

    def __init__(self, b: Block):
        n = len(b.data)
        word = ~_SPACE[b.data]
        brk = np.zeros(n + 1, dtype=bool)  # a row starts here
        brk[b.off] = True
        before = np.empty(n, dtype=bool)
        if n:
            before[0] = False
            before[1:] = word[:-1]
        after = np.empty(n, dtype=bool)
        if n:
            after[-1] = False
            after[:-1] = word[1:]
        self.start = np.flatnonzero(word & (~before | brk[:n]))
        self.end = np.flatnonzero(word & (~after | brk[1:])) + 1
        self.first = np.searchsorted(self.start, b.off)
        self.block = b

    def hashes(self, kind: int = 0) -> np.ndarray:
        """64-bit hashes of the words' bytes; those of the two kinds are independent."""
        b = self.block
        up, down = powers(len(b.data) + 1)
        sums = np.zeros(len(b.data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[kind][b.data] * up[:-1], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * down[self.start])

    def rows(self) -> np.ndarray:
        """The row, within the block, of each word."""
        return np.repeat(np.arange(self.block.n), np.diff(self.first))


def windows(hashes: np.ndarray, first: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of each run of k words within one row."""
    n = len(hashes)
    count = np.diff(first)
    last = np.repeat(first[1:] - k, count)  # the last start of the word's row
    start = np.flatnonzero(np.arange(n) <= last)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(mix(hashes + stream(seed, 1)[0]) * up[:-1], out=sums[1:])
    return start, mix((sums[start + k] - sums[start]) * down[start] + stream(seed, 2)[1])


def spans(first: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Row offsets for items at sorted word positions `start`."""
    return np.searchsorted(start, first)
