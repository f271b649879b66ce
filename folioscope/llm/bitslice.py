"""Hamming distances of 64-bit fingerprints in vertical bit planes, with carry-save counters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

FULL = np.uint64(2**64 - 1)


def majority(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A fingerprint of each row's hashes (row k: first[k] to first[k + 1], not empty): the bits that over half of them have."""
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = np.add.reduceat(bits, first[:-1], axis=0, dtype=np.int32)
    return np.packbits(2 * counts > np.diff(first)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def planes(fps: np.ndarray) -> np.ndarray:
    """(64, words): bit i of word w of plane p is bit p of fingerprint 64 * w + i."""
    n = len(fps)
    bits = np.zeros((-(-n // 64) * 64, 64), np.uint8)
    bits[:n] = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def within(layers: Iterator[np.ndarray], shape: tuple, radius: int) -> np.ndarray:
    """Lanes within the radius: each layer is a bit plane of differences. Ends early once all lanes are beyond it.

    The counters begin so far below their end that they overflow, into a sticky plane, when the radius is exceeded."""
    width = (radius + 1).bit_length()
    start = (1 << width) - 1 - radius
    x = [np.full(shape, FULL if start >> k & 1 else 0, np.uint64) for k in range(width)]
    beyond = np.zeros(shape, np.uint64)
    for k, carry in enumerate(layers):
        for c in x:
            c ^= carry  # sum
            carry = carry & ~c  # carry where both were set
        beyond |= carry
        if k % 8 == 7 and (beyond == FULL).all():
            return np.zeros(shape, np.uint64)
    return ~beyond


def close_pairs(fps: np.ndarray, radius: int, keep: Callable | None = None, lanes: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j within the radius; of these the ones that keep(i, j) holds for."""
    n = len(fps)
    p = planes(fps)
    live = [k for k in range(64) if p[k].any() and (np.unpackbits(p[k].view(np.uint8), bitorder="little")[:n] == 0).any()]
    step, found = max(1, lanes // p.shape[1]), ([], [])
    for at in range(0, n, step):
        own = fps[at : at + step]
        w = at // 64  # earlier ones have met these queries
        layers = (p[k, w:][None, :] ^ np.where(own >> np.uint64(k) & np.uint64(1), FULL, np.uint64(0))[:, None] for k in live)
        near = within(layers, (len(own), p.shape[1] - w), radius)
        rows, cols = np.nonzero(near)
        if len(rows):
            bits = np.unpackbits(near[rows, cols].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            r, b = np.nonzero(bits)
            i, j = rows[r] + at, (cols[r] + w) * 64 + b
            ok = (i < j) & (j < n)
            if keep is not None:
                ok[ok] = keep(i[ok], j[ok])
            found[0].append(i[ok])
            found[1].append(j[ok])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)


def listed_pairs(fps: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> np.ndarray:
    """Which of the listed pairs are within the radius; the lanes are pairs, for many small buckets at once."""
    out = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 15):
        a = fps[i[at : at + (1 << 15)]] ^ fps[j[at : at + (1 << 15)]]
        p = planes(a)
        near = within(iter(p), (p.shape[1],), radius)
        out[at : at + len(a)] = np.unpackbits(near.view(np.uint8), bitorder="little")[: len(a)]
    return out
