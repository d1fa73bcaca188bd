"""Peaks of short traces: where they are, how high, how wide. Traces are rows ``keys, off, v``, a window's length each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def peak_of(trace: DataFrame, keys: Sequence[str], by: str = "abs") -> DataFrame:
    """``keys, p, a``: place and value of each trace's peak, the first of equal ones; ``by`` is ``abs``, ``max`` or ``min``."""
    height = {"abs": F.abs("v"), "max": F.col("v"), "min": -F.col("v")}[by]
    top = trace.filter("v is not null").groupBy(*keys).agg(F.max(F.struct(height.alias("h"), (-F.col("off")).alias("back"), "v")).alias("x"))
    return top.select(*keys, (-F.col("x.back")).alias("p"), F.col("x.v").alias("a"))


def peak_widths(trace: DataFrame, keys: Sequence[str], by: str = "abs", level: str = "height") -> DataFrame:
    """``keys, p, a, level, width``: interpolated width of each trace's peak at half its height, or at half its prominence.

    The crossings are the nearest places on both sides below the level; without one on either side there is no width. A trace with a
    negative peak is turned over first. The traces are bounded by their window, so each is held in one row.
    """
    p = peak_of(trace, keys, by)
    whole = trace.filter("v is not null").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("off", "v"))).alias("xs"))
    both = p.join(whole, list(keys)).withColumn("s", F.when(F.col("a") < 0, -1.0).otherwise(1.0))
    xs = F.transform("xs", lambda x: F.struct(x.off.alias("off"), (x.v * F.col("s")).alias("v")))
    both = both.withColumn("xs", xs).withColumn("h", F.col("a") * F.col("s"))
    before, after = F.filter("xs", lambda x: x.off <= F.col("p")), F.filter("xs", lambda x: x.off >= F.col("p"))
    least = lambda xs: F.array_min(F.transform(xs, lambda x: x.v))
    at = F.col("h") / 2 if level == "height" else F.col("h") - (F.col("h") - F.greatest(least(before), least(after))) / 2
    both = both.withColumn("level", at)
    left = F.element_at(F.filter("xs", lambda x: (x.off < F.col("p")) & (x.v < F.col("level"))), -1)
    right = F.get(F.filter("xs", lambda x: (x.off > F.col("p")) & (x.v < F.col("level"))), 0)
    left = F.when(F.exists("xs", lambda x: (x.off < F.col("p")) & (x.v < F.col("level"))), left)
    both = both.withColumn("l", left).withColumn("r", right)
    next_to = lambda end, step: F.get(F.filter("xs", lambda x: x.off == F.col(f"{end}.off") + step), 0)["v"]
    cross = lambda end, step: F.col(f"{end}.off") + step * (F.col("level") - F.col(f"{end}.v")) / (next_to(end, step) - F.col(f"{end}.v"))
    return both.select(*keys, "p", "a", (F.col("level") * F.col("s")).alias("level"), (cross("r", -1) - cross("l", 1)).alias("width"))


def anchors_at_peaks(signal: DataFrame, anchors: DataFrame, half: int, channel: int | Column, by: str = "abs") -> DataFrame:
    """``ev, at``: each event moved to the peak of one channel within ``half`` samples of it; events with no samples there stay."""
    from cortexlake.operators.signals import event_windows

    seen = event_windows(signal.filter(F.col("ch") == channel), anchors, half).filter("ch is not null")
    moved = anchors.join(peak_of(seen, ["ev"], by), "ev", "left")
    return moved.select("ev", (F.col("at") + F.coalesce("p", F.lit(0))).alias("at"))
