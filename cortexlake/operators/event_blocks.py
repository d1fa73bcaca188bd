"""Windows of all channels around events, cut from blocks of the recording.

A sample is one row with all its channels. It goes to the block that holds it, and to the next one if windows reach over from there;
an event goes to the block of its place. So the recording is shuffled about once, whatever the windows' length, and what is
computed of a window leaves the block instead of the window's samples.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Binary logarithm of the places in a block.
BITS = 10


@dataclass
class Windows:
    """The windows of a block's events: a row of samples ``x`` for each place, by event and offset.

    ``there`` tells which channels a sample has and ``known`` which of these aren't null; ``first`` tells where the rows of each of ``ev`` begin.
    """

    ev: np.ndarray
    first: np.ndarray
    off: np.ndarray
    x: np.ndarray
    there: np.ndarray
    known: np.ndarray

    def per_event(self, rows: np.ndarray, how: np.ufunc = np.add) -> np.ndarray:
        return how.reduceat(rows, self.first, axis=0) if len(self.first) else rows[:0]

    def counts(self, mask: np.ndarray) -> np.ndarray:
        return self.per_event(mask.astype(np.int64))

    def sums(self, mask: np.ndarray) -> np.ndarray:
        return self.per_event(np.where(mask, self.x, 0.0))


def _samples(xs: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The channels of each sample in a row, and which are there and known."""
    n = np.array(xs.combine_chunks().value_lengths().fill_null(0)) if len(xs) else np.zeros(0, np.int64)
    there = np.arange(n.max(initial=0)) < n[:, None]
    x, known = np.zeros(there.shape), np.zeros(there.shape, bool)
    if there.any():
        flat = xs.combine_chunks().flatten()
        known[there] = flat.is_valid().to_numpy(zero_copy_only=False)
        x[there] = flat.cast(pa.float64()).fill_null(0.0).to_numpy()
    return x, there, known


def _windows(samples: pa.Table, anchors: pa.Table, half: int) -> Windows:
    i, (x, there, known) = samples["i"].to_numpy(), _samples(samples["xs"])
    order = np.argsort(i, kind="stable")
    places = anchors["at"].to_numpy()[:, None] + np.arange(-half, half + 1)
    lo, hi = (np.searchsorted(i[order], places.ravel(), side) for side in ("left", "right"))
    n = hi - lo
    sample = order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
    ev = np.repeat(np.repeat(anchors["ev"].to_numpy(), 2 * half + 1), n)
    off = np.repeat(np.tile(np.arange(-half, half + 1), len(places)), n)
    by = np.lexsort((off, ev))
    ev, sample = ev[by], sample[by]
    first = np.flatnonzero(np.concatenate([[True], ev[1:] != ev[:-1]])) if len(ev) else np.zeros(0, np.int64)
    return Windows(ev[first], first, off[by], x[sample], there[sample], known[sample])


def over_windows(samples: DataFrame, anchors: DataFrame, half: int, each: Callable[[Windows], dict[str, pa.Array]], schema: str) -> DataFrame:
    """``each`` of the windows -half..half around the events of every block.

    Samples are ``i, xs``, events ``ev, at``: whole numbers, of which an event has one place (rows with the same one are one event).
    Null ones meet nothing.
    """
    reached = F.explode(F.sequence(F.shiftright(F.col("i").cast("long") - half, BITS), F.shiftright(F.col("i").cast("long") + half, BITS)))
    dealt = samples.filter("i is not null and xs is not null").select("i", "xs", reached.alias("block"))
    placed = anchors.filter("ev is not null and at is not null").select("ev", "at", F.shiftright(F.col("at").cast("long"), BITS).alias("block"))

    def run(a: pa.Table, s: pa.Table) -> pa.Table:
        return pa.table(each(_windows(s, a, half)))

    return placed.groupBy("block").cogroup(dealt.groupBy("block")).applyInArrow(run, schema)


def window_rows(samples: DataFrame, anchors: DataFrame, half: int) -> DataFrame:
    """``ev, off, ch, v`` of every sample in the windows; places outside the recording have no row."""

    def each(w: Windows) -> dict[str, pa.Array]:
        row, ch = np.nonzero(w.there)
        ev = np.repeat(w.ev, np.diff(np.append(w.first, len(w.off))))
        return {"ev": pa.array(ev[row], pa.int64()), "off": pa.array(w.off[row], pa.int32()), "ch": pa.array(ch + 1, pa.int32()), "v": pa.array(w.x[row, ch], pa.float64(), mask=~w.known[row, ch])}

    return over_windows(samples, anchors, half, each, "ev long, off int, ch int, v double")


def whole_windows(samples: DataFrame, anchors: DataFrame, half: int) -> DataFrame:
    """``ev, ch, total, first_v, last_v`` of windows that have every sample: the sum, first and last of those that aren't null."""

    def each(w: Windows) -> dict[str, pa.Array]:
        at, ch = np.nonzero(w.counts(w.there) == 2 * half + 1)
        row = np.arange(len(w.off))[:, None]
        ends = w.per_event(np.where(w.known, row, len(row)), np.minimum)[at, ch], w.per_event(np.where(w.known, row, -1), np.maximum)[at, ch]
        none = ends[1] < 0
        total = pa.array(w.sums(w.known)[at, ch], pa.float64(), mask=none)
        first, last = (pa.array(w.x[np.where(none, 0, e), ch], pa.float64(), mask=none) for e in ends)
        return {"ev": pa.array(w.ev[at], pa.int64()), "ch": pa.array(ch + 1, pa.int32()), "total": total, "first_v": first, "last_v": last}

    return over_windows(samples, anchors, half, each, "ev long, ch int, total double, first_v double, last_v double")


def mean_of_window_means(samples: DataFrame, anchors: DataFrame, half: int, parts: dict[str, tuple[int, int]]) -> DataFrame:
    """``ch`` and, for each part from one offset to another, the mean over events of each event's mean; null without a value."""

    def each(w: Windows) -> dict[str, pa.Array]:
        ch = np.flatnonzero(w.there.any(axis=0))
        out = {"ch": pa.array(ch + 1, pa.int32())}
        for name, (lo, hi) in parts.items():
            inside = w.known & ((w.off >= lo) & (w.off <= hi))[:, None]
            n, total = w.counts(inside), w.sums(inside)
            out[f"{name}_sum"] = pa.array((total / np.maximum(n, 1)).sum(axis=0)[ch], pa.float64())
            out[f"{name}_n"] = pa.array((n > 0).sum(axis=0)[ch], pa.int64())
        return out

    schema = ", ".join(["ch int", *(f"{p}_sum double, {p}_n long" for p in parts)])
    sums = over_windows(samples, anchors, half, each, schema)
    return sums.groupBy("ch").agg(*((F.sum(f"{p}_sum") / F.nullif(F.sum(f"{p}_n"), F.lit(0))).alias(p) for p in parts))


def windows_below(samples: DataFrame, anchors: DataFrame, half: int, limit: float) -> DataFrame:
    """``ev, ch`` of windows that have a value and none that isn't below the limit."""

    def each(w: Windows) -> dict[str, pa.Array]:
        at, ch = np.nonzero((w.counts(w.known) > 0) & (w.counts(w.known & ~(w.x < limit)) == 0))
        return {"ev": pa.array(w.ev[at], pa.int64()), "ch": pa.array(ch + 1, pa.int32())}

    return over_windows(samples, anchors, half, each, "ev long, ch int")
