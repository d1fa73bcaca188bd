"""Words and hashes of UTF-8 text columns, computed on whole Arrow buffers with NumPy.

Words are ``[^\\x20\\x09-\\x0D]+``. The separators are ASCII, so everything here works on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes hashed at a time; bounds the temporary arrays whatever a text's length.
STEP = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    h ^= h >> np.uint64(31)
    return h


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(STEP, _BASE, np.uint64))
        down = np.cumprod(np.full(STEP, pow(_BASE, -1, 1 << 64), np.uint64))
    one = np.ones(1, np.uint64)
    return np.concatenate([one, up[:-1]]), np.concatenate([one, down[:-1]])


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``data[starts[i]:ends[i]]``; both ascending. Equal bytes give equal hashes wherever they stand."""
    up, down = _powers()
    base_up, base_down = pow(_BASE, STEP, 1 << 64), pow(pow(_BASE, -1, 1 << 64), STEP, 1 << 64)
    at_start, at_end = np.empty(len(starts), np.uint64), np.empty(len(starts), np.uint64)
    scale = np.empty(len(starts), np.uint64)
    carry, far_up, far_down = np.uint64(0), 1, 1
    with np.errstate(over="ignore"):
        for lo in range(0, max(len(data), 1), STEP):
            part = data[lo : lo + STEP].astype(np.uint64)
            part += np.uint64(1)
            part *= up[: len(part)]
            np.cumsum(part, out=part)
            sums = np.empty(len(part) + 1, np.uint64)
            sums[0] = 0
            sums[1:] = part
            sums *= np.uint64(far_up)
            sums += carry
            last = lo + STEP >= len(data)
            a, b = np.searchsorted(starts, [lo, lo + STEP + last])
            at_start[a:b] = sums[starts[a:b] - lo]
            scale[a:b] = down[(starts[a:b] - lo) % STEP] * np.uint64(far_down)
            if b > a and last:
                over = starts[a:b] - lo == STEP
                scale[a:b][over] *= np.uint64(base_down)
            a, b = np.searchsorted(ends, [lo, lo + STEP + last])
            at_end[a:b] = sums[ends[a:b] - lo]
            carry = sums[-1]
            far_up, far_down = far_up * base_up % (1 << 64), far_down * base_down % (1 << 64)
        h = (at_end - at_start) * scale
        h ^= (ends - starts).astype(np.uint64) * _M2
        return mix(h)


@dataclass
class Chunk:
    """Some texts of a batch: ``rows`` into the batch, their bytes one after the other, and where each begins and ends."""

    rows: slice
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self, lower: bool = False) -> "Words":
        data = LOWER[self.data] if lower else self.data
        gap = SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[self.offsets] = True
        before = np.ones(len(data) + 1, bool)
        before[1:] = gap
        starts = np.flatnonzero(~gap & (before[:-1] | edge[:-1]))
        after = np.ones(len(data) + 1, bool)
        after[:-1] = gap
        ends = np.flatnonzero(~gap & (after[1:] | edge[1:])) + 1
        doc = np.searchsorted(self.offsets, starts, "right") - 1
        return Words(data, starts, ends, doc, np.searchsorted(doc, np.arange(len(self) + 1)))

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each text ``mask`` marks."""
        sums = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]


@dataclass
class Words:
    """Words of a chunk in order: byte spans, the text each is in, and the first word of each text (one more: the end)."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        return span_hash(self.data, self.starts, self.ends)


def chunks(column: pa.Array, at_most: int = 1 << 21) -> Iterator[Chunk]:
    """Runs of texts of about ``at_most`` bytes; a longer text comes alone and whole. Null counts as empty."""
    column = column.fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    kind = np.int64 if wide else np.int32
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + at_most, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield Chunk(slice(lo, hi), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def shingle_hashes(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``n`` words inside a text and the index of each run's first word.

    A text with fewer than ``n`` words, but at least one, has its whole sequence as its only run.
    """
    h = words.hashes()
    size = np.diff(words.first)
    last = words.first[1:][words.doc] if len(h) else np.zeros(0, np.int64)
    full = np.flatnonzero(np.arange(len(h)) + n <= last)
    with np.errstate(over="ignore"):
        out = np.zeros(len(full), np.uint64)
        for k in range(n):
            out = out * np.uint64(0xD6E8FEB86659FD93) + h[full + k]
        out = mix(out)
        short = np.flatnonzero((size > 0) & (size < n))
        if len(short):
            own = np.empty(len(short), np.uint64)
            for i, d in enumerate(short):
                x = np.uint64(size[d])
                for w in h[words.first[d] : words.first[d + 1]]:
                    x = x * np.uint64(0xA24BAED4963EE407) + w
                own[i] = x
            out, full = np.concatenate([out, mix(own)]), np.concatenate([full, words.first[short]])
            order = np.argsort(full, kind="stable")
            out, full = out[order], full[order]
    return out, full


def distinct_in_text(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes, ascending; ``doc`` ascending."""
    order = np.lexsort((h, doc))
    d, v = doc[order], h[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    return d[keep], v[keep]
