"""Peaks of whole channels with their prominences and widths, and the detectors made of them, the same whatever the blocks.

A channel is a table of blocks, each one row with arrays. What a peak needs may lie far away: a plateau that runs over a border, the next
higher sample, the place where the signal falls below a level. Each block answers for itself; what is left open is settled over one
short row for each block (its least and greatest value), and the block that holds the answer is asked again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cortexlake.operators.recursive import BLOCK, in_blocks, regular
from cortexlake.operators.stages import settled


def block_rows(signal: DataFrame, columns: Sequence[str], block: int = BLOCK) -> DataFrame:
    """``ch, block, first`` and an array for each of ``columns``, at every place of the block; missing places are on the line between their neighbours."""

    def cut(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows, lo, hi = rows.sort_values("i"), int(key[2]), int(key[3])
        i = rows["i"].to_numpy()
        return pd.DataFrame({"ch": [int(key[0])], "block": [int(key[1])], "first": [lo], **{c: [regular(i, rows[c].to_numpy(float), lo, hi)[0].tolist()] for c in columns}})

    shape = "ch int, block long, first long, " + ", ".join(f"{c} array<double>" for c in columns)
    return settled(in_blocks(signal.select("ch", "i", *columns), block).groupBy("ch", "block", "lo", "hi").applyInPandas(cut, shape), "block-rows")


def _steps(blocks: DataFrame) -> DataFrame:
    """A row for each channel: its first place and last block, and how far blocks lie apart."""
    ends = blocks.groupBy("ch").agg(F.min("first").alias("_from"), F.max("block").alias("_last"), F.max("first").alias("_z"))
    return ends.withColumn("_step", F.when(F.col("_last") > 0, (F.col("_z") - F.col("_from")) / F.col("_last")).otherwise(1.0)).drop("_z")


def _block_of(i: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.floor((i - F.col("_from")) / F.col("_step")).cast("long"), F.col("_last")))


def _each(blocks: DataFrame, kernel: Callable[..., list[tuple]], shape: str) -> DataFrame:
    names = [x.split()[0] for x in shape.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                yield pd.DataFrame(kernel(row), columns=names)

    return blocks.mapInPandas(run, shape)


def local_peaks(blocks: DataFrame, column: str) -> DataFrame:
    """``ch, i, v``: local maxima, of a plateau the middle; the first and the last sample of a recording are none."""

    def inside(row) -> list[tuple]:
        v = np.asarray(getattr(row, column), float)
        start = np.flatnonzero(v[1:] != v[:-1]) + 1
        up = v[start] > v[start - 1]
        top = up[:-1] & (v[start[1:]] < v[start[:-1]])
        at = (start[:-1][top] + start[1:][top] - 1) // 2
        out = [(row.ch, 0, row.first + int(p), float(v[p]), None, None, None, None, None, None) for p in at]
        some = len(start) > 0
        return [*out, (row.ch, 1, row.first, float(v[0]), row.first + int(start[0]) if some else None, float(v[start[0]]) if some else None, row.first + int(start[-1]) if some else None, float(v[start[-1]]) if some else None, bool(up[-1]) if some else None, row.first + len(v))]

    found = settled(_each(blocks, inside, "ch int, kind int, i long, v double, change long, change_v double, last long, last_v double, rising boolean, next long"), "peaks-in-blocks")

    def over_borders(rows: pd.DataFrame) -> pd.DataFrame:
        out, run, end = [], None, None  # run: first place, value, whether the signal rose to it
        for r in rows.sort_values("i").itertuples():
            if run is None or r.i != end:
                run = (r.i, r.v, False)
            elif r.v != run[1]:
                if run[2] and r.v < run[1]:
                    out.append((r.ch, (run[0] + r.i - 1) // 2, run[1]))
                run = (r.i, r.v, r.v > run[1])
            if not pd.isna(r.change):
                if run[2] and r.change_v < run[1]:
                    out.append((r.ch, int(run[0] + r.change - 1) // 2, run[1]))
                run = (int(r.last), r.last_v, bool(r.rising))
            end = r.next
        return pd.DataFrame(out, columns=["ch", "i", "v"])

    across = found.filter("kind = 1").groupBy("ch").applyInPandas(over_borders, "ch int, i long, v double")
    return found.filter("kind = 0").select("ch", "i", "v").unionByName(across)


def thinned(peaks: DataFrame, distance: int) -> DataFrame:
    """The ``peaks`` (``ch, i, v``) that stay if, from the highest down, each one kept removes those nearer than ``distance``; of equal ones the later comes first.

    A stretch of the channel is decided from what lies around it; peaks whose fate hangs on others further away are decided with more around.
    """
    if distance <= 1:
        return peaks
    peaks = settled(peaks, "peaks")
    span, around, done = 256 * distance, 8 * distance, None
    ends = peaks.groupBy("ch").agg(F.min("i").alias("a"), F.max("i").alias("b"))
    todo = None

    def decider(around: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
        def decide(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("i")
            i, v, lo = rows["i"].to_numpy(), rows["v"].to_numpy(), int(key[1]) * span
            unseen_left, unseen_right = lo - around > int(rows["a"].iloc[0]), lo + span + around <= int(rows["b"].iloc[0])
            state = np.zeros(len(i), np.int8)  # 1 stays, 2 goes, 3 open
            for p in np.lexsort((i, v))[::-1]:
                near = state[np.searchsorted(i, i[p] - distance, "right") : np.searchsorted(i, i[p] + distance, "left")]
                if (near == 1).any():
                    state[p] = 2
                elif (near == 3).any() or (unseen_left and i[p] - distance < lo - around) or (unseen_right and i[p] + distance > lo + span + around):
                    state[p] = 3
                else:
                    state[p] = 1
            own = (i >= lo) & (i < lo + span) & (state != 2)
            return pd.DataFrame({"ch": int(key[0]), "i": i[own], "v": v[own], "stretch": int(key[1]), "open": state[own] == 3})

        return decide

    while True:
        seen = peaks.join(F.broadcast(ends), "ch").withColumn("stretch", F.explode(F.sequence(F.floor((F.col("i") - around) / span), F.floor((F.col("i") + around) / span))))
        seen = seen if todo is None else seen.join(todo, ["ch", "stretch"], "left_semi")
        found = settled(seen.groupBy("ch", "stretch").applyInPandas(decider(around), "ch int, i long, v double, stretch long, open boolean"), "thinned")
        todo = found.filter("open").select("ch", "stretch").distinct()
        sure = found.join(todo, ["ch", "stretch"], "left_anti").select("ch", "i", "v")
        done = sure if done is None else done.unionByName(sure)
        if not todo.take(1):
            return done
        around *= 8


def nearest(blocks: DataFrame, column: str, asked: DataFrame, above: bool) -> DataFrame:
    """``asked`` (``ch, i, side, level``) with the nearest place on that side (-1 or 1) where the signal is above the level, or not above it.

    Adds ``place`` (null: there is none), ``value`` there, ``inner``, the value one step nearer, and ``least``, the smallest value from
    ``i`` on before that place or the recording's end.
    """
    hit = (lambda x, level: x > level) if above else (lambda x, level: x <= level)
    table = settled(blocks.select("ch", "block", "first", F.size(column).alias("n"), F.array_max(column).alias("most"), F.array_min(column).alias("low"), F.get(column, F.lit(0)).alias("head"), F.element_at(column, -1).alias("tail")), "block-ends")
    answer = "ch int, i long, side int, level double, block long, place long, value double, inner double, least double, edge double"

    def seek(row, asks) -> list[tuple]:
        """From ``at`` on in this block; ``at`` before or behind it means the whole block, and ``edge`` is the value just before it on the way."""
        v, out = np.asarray(getattr(row, column), float), []
        for a in asks:
            k = min(max(a["i"] - row.first, -1), len(v))
            part = v[k + 1 :] if a["side"] > 0 else v[:k][::-1] if k > 0 else v[:0]
            here = 0 <= k < len(v)
            at = np.flatnonzero(hit(part, a["level"]))
            before = part[: at[0]] if len(at) else part
            least = min(before.min() if len(before) else np.inf, v[k] if here else a["least"])
            if len(at):
                j = int(at[0])
                inner = part[j - 1] if j else v[k] if here else a["edge"]
                place = row.first + (k + 1 + j if a["side"] > 0 else (k if k > 0 else 0) - 1 - j)
                out.append((row.ch, a["i"], a["side"], a["level"], row.block, place, float(part[j]), float(inner), float(least), None))
            else:
                out.append((row.ch, a["i"], a["side"], a["level"], row.block, None, None, None, float(least), None))
        return out

    def answered(asks: DataFrame) -> DataFrame:
        lists = asks.groupBy("ch", "block").agg(F.collect_list(F.struct("i", "side", "level", "least", "edge")).alias("asks"))
        return settled(_each(blocks.select("ch", "block", "first", column).join(lists, ["ch", "block"]), lambda row: seek(row, [a if isinstance(a, dict) else a.asDict() for a in row.asks]), answer), "nearest")

    home = asked.join(F.broadcast(_steps(blocks)), "ch")
    local = answered(home.select("ch", "i", "side", "level", _block_of(F.col("i")).alias("block"), F.lit(float("inf")).alias("least"), F.lit(None).cast("double").alias("edge")))

    def further(key: tuple, asks: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        """The block that holds each answer, found by halving steps over the blocks' extremes."""
        ends = ends.sort_values("block").reset_index(drop=True)
        number, out = ends["block"].to_numpy(), []
        for side in (-1, 1):
            mine = asks[asks["side"] == side]
            if not len(mine) or not len(ends):
                continue
            t = ends if side > 0 else ends.iloc[::-1]
            most, low = [t["most"].to_numpy()], [t["low"].to_numpy()]
            while 2 ** len(most) <= len(t):
                w = 2 ** (len(most) - 1)
                most.append(np.maximum(most[-1][:-w], most[-1][w:]))
                low.append(np.minimum(low[-1][:-w], low[-1][w:]))
            first, end = t["first"].to_numpy(), (t["first"] + t["n"]).to_numpy()
            joint = np.append(np.flatnonzero((first[1:] != end[:-1]) if side > 0 else (end[1:] != first[:-1])) + 1, len(t))  # where a recording ends
            at = np.searchsorted(number, mine["block"].to_numpy())
            pos = (at if side > 0 else len(t) - 1 - at) + 1
            stop = joint[np.searchsorted(joint, pos - 1, "right")]
            least, level = mine["least"].to_numpy(float).copy(), mine["level"].to_numpy()
            for j in range(len(most) - 1, -1, -1):
                can = pos + 2**j <= stop
                k = np.where(can, pos, 0)
                skip = can & ~(hit(most[j][k], level) if above else hit(low[j][k], level))
                least = np.where(skip, np.minimum(least, low[j][k]), least)
                pos = pos + np.where(skip, 2**j, 0)
            k = np.minimum(pos, len(t) - 1)
            there = pos < stop
            edge = (t["tail"] if side > 0 else t["head"]).to_numpy()[np.maximum(k - 1, 0)]
            out.append(pd.DataFrame({"ch": int(key[0]), "i": mine["i"].to_numpy(), "side": side, "level": level, "block": np.where(there, t["block"].to_numpy()[k], -1), "least": least, "edge": edge}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("ch", "i", "side", "level", "block", "least", "edge")})

    open_ = local.filter("place is null").select("ch", "i", "side", "level", "block", "least")
    sent = settled(open_.groupBy("ch").cogroup(table.groupBy("ch")).applyInPandas(further, "ch int, i long, side int, level double, block long, least double, edge double"), "nearest-blocks")
    columns = ["ch", "i", "side", "level", "place", "value", "inner", "least"]
    none = sent.filter("block < 0").select("ch", "i", "side", "level", *(F.lit(None).cast(k).alias(c) for c, k in (("place", "long"), ("value", "double"), ("inner", "double"))), "least")
    return local.filter("place is not null").select(columns).unionByName(answered(sent.filter("block >= 0")).select(columns)).unionByName(none)


def slices(blocks: DataFrame, columns: Sequence[str], events: DataFrame, before: int, after: int) -> DataFrame:
    """``ch, i`` of ``events``, ``start`` and the arrays of ``columns`` from ``i - before`` to ``i + after``, as far as the recording goes."""
    asks = events.join(F.broadcast(_steps(blocks)), "ch").select("ch", "i", F.explode(F.sequence(_block_of(F.col("i") - before), _block_of(F.col("i") + after))).alias("block"))
    asks = asks.groupBy("ch", "block").agg(F.collect_list("i").alias("asks"))

    def cut(row) -> list[tuple]:
        n, out = len(getattr(row, columns[0])), []
        for i in row.asks:
            a, b = max(i - before - row.first, 0), min(i + after + 1 - row.first, n)
            if a < b:
                out.append((row.ch, int(i), row.first + a, *(list(getattr(row, c)[a:b]) for c in columns)))
        return out

    parts = _each(blocks.select("ch", "block", "first", *columns).join(asks, ["ch", "block"]), cut, "ch int, i long, start long, " + ", ".join(f"{c} array<double>" for c in columns))
    whole = parts.groupBy("ch", "i").agg(F.sort_array(F.collect_list(F.struct("start", *columns))).alias("x"))
    return whole.select("ch", "i", F.col("x")[0]["start"].alias("start"), *(F.flatten(F.col(f"x.{c}")).alias(c) for c in columns))


def _both_sides(found: DataFrame, *extra: str) -> DataFrame:
    """One row for each peak from the answers of its two sides."""
    pick = lambda c, s: F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{c}_{'l' if s < 0 else 'r'}")
    return found.groupBy("ch", "i").agg(*(pick(c, s) for c in extra for s in (-1, 1)))


def _sides(peaks: DataFrame, level: str) -> DataFrame:
    return peaks.select("ch", "i", F.explode(F.array(F.lit(-1), F.lit(1))).alias("side"), F.col(level).alias("level"))


def prominences(blocks: DataFrame, column: str, peaks: DataFrame) -> DataFrame:
    """``peaks`` with ``base``, the higher of the lowest values towards the next higher sample on either side, and ``prominence`` above it."""
    both = _both_sides(nearest(blocks, column, _sides(peaks, "v"), True), "least")
    return peaks.join(both.select("ch", "i", F.greatest("least_l", "least_r").alias("base")), ["ch", "i"]).withColumn("prominence", F.col("v") - F.col("base"))


def crossings(blocks: DataFrame, column: str, peaks: DataFrame, level: str, least: str | None = None) -> DataFrame:
    """``peaks`` with ``start`` and ``stop``, the interpolated places nearest to them where the signal has fallen to ``level``; below ``least`` it counts as that."""
    both = _both_sides(nearest(blocks, column, _sides(peaks, level), False), "place", "value", "inner")
    joined = peaks.join(both, ["ch", "i"])
    for s in "lr" if least else "":
        joined = joined.withColumn(f"value_{s}", F.greatest(f"value_{s}", least))
    move = lambda s: F.when(F.col(f"value_{s}") < F.col(level), (F.col(level) - F.col(f"value_{s}")) / (F.col(f"inner_{s}") - F.col(f"value_{s}"))).otherwise(0.0)
    return joined.withColumn("start", F.col("place_l") + move("l")).withColumn("stop", F.col("place_r") - move("r")).drop(*(f"{c}_{s}" for c in ("place", "value", "inner") for s in "lr"))


def _argmax_in(windows: DataFrame, column: str) -> DataFrame:
    return windows.select("ch", "i", (F.col("start") + F.array_position(column, F.array_max(column)) - 1).alias("idx"))


def spikes(signal: DataFrame, fs: float, times_sd: float, least: float = 0.0, distance: float = 0.0, prominence: float = 0.0, raw: DataFrame | None = None, near: int = 10, block: int = BLOCK) -> DataFrame:
    """Positive peaks of a band-passed signal: ``ch, idx, idx_peak, amp, prom, half_width, width_height, asym, idx_start, idx_stop``.

    A peak is at least ``times_sd`` population deviations of its channel and ``least`` high, ``distance`` seconds from a higher one and
    stands out by ``prominence``. Widths (ms) are at half prominence. ``idx`` is the highest sample of ``raw`` from ``near`` before to
    ``near`` - 1 after the peak, the peak itself without ``raw``; asymmetry is null where a side has no width.
    """
    blocks = block_rows(signal, ["v"], block)
    limits = signal.groupBy("ch").agg(F.greatest(F.stddev_pop("v") * times_sd, F.lit(float(least))).alias("limit"))
    high = local_peaks(blocks, "v").join(F.broadcast(limits), "ch").filter("v >= limit").drop("limit")
    kept = settled(thinned(high, max(1, round(distance * fs))), "spike-peaks")
    stand = settled(prominences(blocks, "v", kept).filter(F.col("prominence") >= prominence).withColumn("half", F.col("v") - F.col("prominence") / 2), "spike-prominences")
    wide = crossings(blocks, "v", stand, "half")
    a, b = F.col("i") - F.floor("start"), F.floor("stop") - F.col("i")
    wide = wide.withColumn("asym", F.try_divide(b - a, F.least(a, b)) * 100).withColumn("half_width", (F.col("stop") - F.col("start")) / fs * 1000)
    if raw is not None:
        wide = wide.join(_argmax_in(slices(block_rows(raw, ["v"], block), ["v"], kept, near, near - 1), "v"), ["ch", "i"])
    else:
        wide = wide.withColumn("idx", F.col("i"))
    return wide.select("ch", "idx", F.col("i").alias("idx_peak"), F.col("v").alias("amp"), F.col("prominence").alias("prom"), "half_width", F.col("half").alias("width_height"), "asym", F.floor("start").alias("idx_start"), F.floor("stop").alias("idx_stop"))


def ripples(parts: DataFrame, fs: float, times_sd: float, edge_sd: float, distance: float = 0.0, least_ms: float = 0.0, least_hz: float = 0.0, guard: float = 1.0, hz_ms: float = 8.0, near_ms: float = 40.0, block: int = BLOCK) -> DataFrame:
    """Peaks of the envelope of a band-passed signal: ``ch, idx, idx_peak, amp, dur, freq, idx_start, idx_stop``.

    ``parts`` has ``ch, i, v, envelope, hz``. A peak is ``times_sd`` population deviations of the envelope high, ``distance`` seconds from a higher one
    and more than ``guard`` seconds from the channel's ends. It lasts (ms) from where the envelope has risen above ``edge_sd``
    deviations, or above the lowest value towards a higher peak, until it falls back. Those not longer than ``least_ms`` or, by the mean frequency within
    ``hz_ms``, not faster than ``least_hz`` go. ``idx`` is the highest sample within ``near_ms``.
    """
    blocks = block_rows(parts, ["v", "envelope", "hz"], block)
    sd = parts.groupBy("ch").agg(F.stddev_pop("envelope").alias("sd"), F.min("i").alias("a"), F.max("i").alias("b"))
    high = local_peaks(blocks, "envelope").join(F.broadcast(sd), "ch").filter(F.col("v") >= F.col("sd") * times_sd).select("ch", "i", "v")
    far = thinned(high, max(1, round(distance * fs))).join(F.broadcast(sd), "ch")
    kept = settled(far.filter((F.col("i") - F.col("a") > guard * fs) & (F.col("b") + 1 - F.col("i") > guard * fs)).select("ch", "i", "v", (F.col("sd") * edge_sd).alias("edge")), "ripple-peaks")
    stand = settled(prominences(blocks, "envelope", kept).withColumn("floor", F.greatest("base", "edge")).filter("v > floor"), "ripple-bases")
    wide = crossings(blocks, "envelope", stand, "floor", "edge")
    w, m = round(hz_ms / 1000 * fs), round(near_ms / 1000 * fs)
    mean = slices(blocks, ["hz"], kept, w - 1, w).select("ch", "i", F.expr("aggregate(hz, 0D, (s, x) -> s + x) / size(hz)").alias("freq"))
    top = _argmax_in(slices(blocks, ["v"], kept, m, m - 1), "v")
    out = wide.withColumn("dur", (F.col("stop") - F.col("start")) / fs * 1000).join(mean, ["ch", "i"]).join(top, ["ch", "i"])
    out = out.filter((F.col("dur") > least_ms) & (F.col("freq") > least_hz))
    return out.select("ch", "idx", F.col("i").alias("idx_peak"), F.col("v").alias("amp"), "dur", "freq", F.floor("start").alias("idx_start"), F.floor("stop").alias("idx_stop"))
