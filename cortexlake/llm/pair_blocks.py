"""Counts and places of word pairs as compressed blocks, dealt to buckets by the pair.

A pair of codes below 2 ** CODE is one number. ``mixed`` spreads these numbers evenly over their range, so that equal ranges hold about
equally many pairs and ascending numbers lie close together: a block keeps the steps between them, byte by byte, under zstd.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CODE = 19
BITS = 2 * CODE
_MASK = np.uint64((1 << BITS) - 1)
_ODD = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_ODD, -1, 1 << 64))
_HALF = np.uint64(CODE)


def mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    x = (first.astype(np.uint64) << _HALF) | second.astype(np.uint64)
    for _ in range(2):
        x = (x * np.uint64(_ODD)) & _MASK
        x ^= x >> _HALF
    return x


def parts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes of mixed numbers."""
    for _ in range(2):
        x = x ^ (x >> _HALF)
        x = (x * _BACK) & _MASK
    return (x >> _HALF).astype(np.int64), (x & np.uint64((1 << CODE) - 1)).astype(np.int64)


def packed(v: np.ndarray) -> bytes:
    """Whole numbers from 0, as many bytes of each as the largest needs."""
    wide = max(1, (int(v.max()).bit_length() + 7) // 8) if len(v) else 1
    planes = v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T
    return bytes([wide]) + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(blob: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    raw = pa.decompress(blob[1:], decompressed_size=blob[0] * n, codec="zstd", asbytes=True)
    out[:, : blob[0]] = np.frombuffer(raw, np.uint8).reshape(blob[0], n).T
    return out.view("<u8")[:, 0].astype(np.uint64)


def packed_steps(v: np.ndarray) -> bytes:
    """Ascending numbers."""
    return packed(np.diff(v, prepend=v.dtype.type(0)))


def unpacked_steps(blob: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpacked(blob, n), dtype=np.uint64)


def cut(x: np.ndarray, n_buckets: int) -> Iterator[tuple[int, slice]]:
    """The buckets of ascending mixed numbers, and where each one's lie."""
    bucket = ((x * np.uint64(n_buckets)) >> np.uint64(BITS)).astype(np.int64)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(x)]])
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if hi > lo:
            yield int(bucket[lo]), slice(lo, hi)
