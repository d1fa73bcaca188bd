"""Zero-phase recursive filters over signals ``ch, i, v``, exact whatever the blocks that a channel is cut into.

A filter is a linear system of a few states. What a block does to the state it gets is a matrix for its length and what it adds is the state
it ends in from rest, so all blocks run side by side, the states are chained over one short row for each block, and the blocks run again
from their true states; the same backwards. Ends of a recording are padded as for one whole signal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cortexlake.functions import sections as sec
from cortexlake.operators.stages import settled

BLOCK = 1 << 16
_ROW = "ch int, block long, first long, v array<double>, absent array<int>, ends array<double>, begins array<double>"


def in_blocks(signal: DataFrame, block: int) -> DataFrame:
    """``signal`` with ``block`` and ``lo``, its first place; a channel's last block also takes what would be a short one after it."""
    spans = signal.groupBy("ch").agg(F.min("i").alias("_a"), F.max("i").alias("_b"))
    last = F.greatest(F.floor((F.col("_b") - F.col("_a") + 1) / block) - 1, F.lit(0))
    placed = signal.join(F.broadcast(spans), "ch").withColumn("block", F.least(F.floor((F.col("i") - F.col("_a")) / block), last))
    return placed.withColumn("lo", F.col("_a") + F.col("block") * block).withColumn("hi", F.when(F.col("block") == last, F.col("_b") + 1).otherwise(F.col("lo") + block)).drop("_a", "_b")


def regular(i: np.ndarray, v: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Values at every place from ``lo`` to ``hi`` - 1, missing ones on the line between their neighbours, and which places are missing."""
    known = np.isfinite(v)
    grid = np.arange(lo, hi)
    full = np.interp(grid, i[known], v[known]) if known.any() else np.zeros(len(grid))
    absent = np.ones(len(grid), bool)
    absent[i - lo] = False
    return full, np.flatnonzero(absent)


def _chained(blocks: DataFrame, systems: list[np.ndarray], back: bool) -> DataFrame:
    """``ch, block, state, alone``: the state each block begins with; ``alone`` tells a block behind which (backwards: before which) none follows at once."""

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block", ascending=not back)
        at, out = rows["block"].to_numpy(), []
        sizes = [2 * len(s) for s in systems]
        edges = np.cumsum([0, *sizes])
        state, cache = None, {}
        for k, (n, ends, begins) in enumerate(zip(rows["n"], rows["ends"], rows["begins"])):
            state = state if k and abs(at[k] - at[k - 1]) == 1 else np.asarray(begins, float)
            out.append(state)
            if n not in cache:
                cache[n] = [sec.system(s).after(int(n)) for s in systems]
            state = np.concatenate([m @ state[a:b] for m, a, b in zip(cache[n], edges, edges[1:])]) + np.asarray(ends, float)
        gap = np.append(np.abs(np.diff(at)) != 1, True)
        return pd.DataFrame({"ch": rows["ch"], "block": at, "state": [s.tolist() for s in out], "alone": gap})

    small = blocks.select("ch", "block", (F.size("v") / len(systems)).cast("long").alias("n") if back else F.size("v").cast("long").alias("n"), "ends", "begins")
    return small.groupBy("ch").applyInPandas(chain, "ch int, block long, state array<double>, alone boolean")


def filtered(signal: DataFrame, filters: dict[str, np.ndarray], block: int = BLOCK) -> DataFrame:
    """``ch, i`` and a column for each of ``filters`` (its sections): the signal through it forwards and backwards.

    All filters share the passes over the data. A missing or non-finite sample counts as the line between its neighbours in its block,
    and has no row or its row like any other; where a whole block is missing, a new recording begins. A channel of one sample
    gives what its constant gives. An empty signal gives no rows.
    """
    names, systems = list(filters), [np.asarray(s, float) for s in filters.values()]
    known = [sec.system(s) for s in systems]
    rest = lambda: [np.zeros(len(s.F)) for s in known]

    def cut(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        lo = int(key[2])
        v, absent = regular(rows["i"].to_numpy(), rows["v"].to_numpy(float), lo, int(key[3]))
        ends, begins = [], []
        for s, k, z in zip(systems, known, rest()):
            pad = sec.left_pad(v, k.pad)
            first = pad[0] if len(pad) else v[0]
            ends.append(sec.run(s, v, z)[1])
            begins.append(sec.run(s, pad, k.rest * first)[1])
        return pd.DataFrame({"ch": [int(key[0])], "block": [int(key[1])], "first": [lo], "v": [v.tolist()], "absent": [absent.tolist()], "ends": [np.concatenate(ends).tolist()], "begins": [np.concatenate(begins).tolist()]})

    def forwards(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for row in part.itertuples():
                v, state, at = np.asarray(row.v, float), np.asarray(row.state, float), 0
                ys, ends, begins = [], [], []
                for s, k, z in zip(systems, known, rest()):
                    y, after = sec.run(s, v, state[at : at + len(k.F)])
                    at += len(k.F)
                    tail = sec.run(s, sec.left_pad(v[::-1], k.pad)[::-1], after)[0] if row.alone else y[:0]
                    last = tail[-1] if len(tail) else y[-1]
                    begins.append(sec.run(s, tail[::-1], k.rest * last)[1])
                    ends.append(sec.run(s, y[::-1], z)[1])
                    ys.append(y)
                out.append((row.ch, row.block, row.first, np.concatenate(ys).tolist(), row.absent, np.concatenate(ends).tolist(), np.concatenate(begins).tolist()))
            yield pd.DataFrame(out, columns=["ch", "block", "first", "v", "absent", "ends", "begins"])

    def backwards(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                ys, state, at = np.asarray(row.v, float).reshape(len(systems), -1), np.asarray(row.state, float), 0
                keep = np.ones(ys.shape[1], bool)
                keep[np.asarray(row.absent, int)] = False
                out = {"ch": row.ch, "i": (row.first + np.arange(len(keep)))[keep]}
                for name, s, k, y in zip(names, systems, known, ys):
                    out[name] = sec.run(s, y[::-1], state[at : at + len(k.F)])[0][::-1][keep]
                    at += len(k.F)
                yield pd.DataFrame(out)

    cut_ = settled(in_blocks(signal.select("ch", "i", "v"), block).groupBy("ch", "block", "lo", "hi").applyInPandas(cut, _ROW), "filter-blocks")
    there = settled(cut_.join(_chained(cut_, systems, False), ["ch", "block"]).mapInPandas(forwards, _ROW), "filter-forwards")
    columns = ", ".join(f"{n} double" for n in names)
    return there.join(_chained(there, systems, True), ["ch", "block"]).mapInPandas(backwards, f"ch int, i long, {columns}")
