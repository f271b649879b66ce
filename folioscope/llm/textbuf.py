"""Whole texts of an Arrow batch as numpy arrays: word and line bounds and 64-bit hashes, without a loop over words.

Words are runs of bytes other than 0x20 and 0x09-0x0D. A null text counts as an empty one. Batches are worked on in
slices of about ``SLICE`` bytes, so the arrays stay small however many rows a batch has; a slice holds whole texts, so a
single text longer than that makes a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 21

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LUT = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POW: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n, grown on demand."""
    if not _POW or len(_POW[0]) < n:
        size = max(n, SLICE + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        _POW[:] = []
        for b in (_BASE, inverse):
            p = np.full(size, np.uint64(b))
            p[0] = 1
            np.multiply.accumulate(p, out=p)
            _POW.append(p)
    return _POW[0], _POW[1]


def slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first row, its bytes, offsets of its rows in them) for slices of whole texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    at, n = 0, len(texts)
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + SLICE, "right")) - 1)
        to = min(to, n)
        yield at, data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def lower(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    return _LOWER[buf]


def words(buf: np.ndarray, offs: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each row's first word (with the total at the end).

    cut: bytes within words at which another word begins."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    ink = ~_SPACE[buf]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    edge = offs[offs < n]
    first[edge] = ink[edge]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    edge = offs[offs > 0] - 1
    last[edge] = ink[edge]
    if cut is not None:
        first |= cut
        last[:-1] |= cut[1:]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def lines(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines between line feeds, and the index of each row's first line; an empty row has one."""
    cut = np.flatnonzero(buf == 10)
    starts = np.concatenate([offs[:-1], cut + 1])
    ends = np.concatenate([offs[1:], cut])
    row = np.concatenate([np.arange(len(offs) - 1), np.searchsorted(offs, cut, "right") - 1])
    starts = starts[np.lexsort((starts, row))]
    ends = ends[np.lexsort((ends, row))]
    return starts, ends, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(offs) - 1))]).astype(np.int64)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range (in ascending order): a polynomial over random byte values, then ``mix``.

    Long buffers are worked on a slice at a time; the hashes do not depend on that."""
    if len(buf) > 2 * SLICE and len(starts) > 1:
        out, i = np.empty(len(starts), np.uint64), 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + SLICE)))
            a, b = int(starts[i]), int(ends[i:j].max())
            out[i:j] = _hashed(buf[a:b], starts[i:j] - a, ends[i:j] - a)
            i = j
        return out
    return _hashed(buf, starts, ends)


def _hashed(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_LUT[buf] * up[: len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def grams(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words that lie in one row, and the index of each run's first word."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x100000001B3 * 2 + 1) + h[i : i + n]
    inside = np.ones(n, bool)
    for i in range(1, k):
        edge = first[1:-1] - i
        inside[edge[(edge >= 0) & (edge < n)]] = False
    at = np.flatnonzero(inside)
    return mix(out[at]), at


def per_row(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of flags over each row's range."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def any_in(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each range has a flag that is set; flags are few, so their places are searched and not all flags summed."""
    at = np.flatnonzero(flags)
    return np.searchsorted(at, ends) > np.searchsorted(at, starts)
