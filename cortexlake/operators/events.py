"""Timed events: debouncing, gaps, pairing, islands and intervals. Times are integers (microseconds or samples)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Samples or microseconds whose events are chained in one task.
BLOCK = 1 << 20


def _all_before(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def with_island(df: DataFrame, keys: Sequence[str], t: str, gap: int, tie: str | None = None, name: str = "island") -> DataFrame:
    """Numbers the runs of rows in which each follows the one before by at most ``gap``."""
    w = _all_before(keys, [t, *([tie] if tie else [])])
    new = F.when(F.col(t) - F.lag(t).over(w) <= gap, 0).otherwise(1)
    return df.withColumn(name, F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def debounce(df: DataFrame, keys: Sequence[str], t: str, gap: int) -> DataFrame:
    """Folds a row into the one before of the same keys if it follows by at most ``gap``: first time, last time and repeats of each run."""
    runs = with_island(df, keys, t, gap)
    return runs.groupBy(*keys, "island").agg(F.min(t).alias("start_us"), F.max(t).alias("last_us"), (F.count(F.lit(1)) - 1).alias("repeats")).drop("island")


def gap_to_next(df: DataFrame, keys: Sequence[str], t: str, tie: str, name: str = "gap_us") -> DataFrame:
    """Time to the next row of the same keys; 0 for the last."""
    return df.withColumn(name, F.coalesce(F.lead(t).over(_all_before(keys, [t, tie])) - F.col(t), F.lit(0)))


def merge_intervals(df: DataFrame, keys: Sequence[str], on: str, off: str, gap: int) -> DataFrame:
    """Merges an interval into the one before if it begins less than ``gap`` after that one's end; the last one's end closes the chain."""
    w = _all_before(keys, [on, off])
    new = F.when(F.col(on) - F.lag(off).over(w) < gap, 0).otherwise(1)
    runs = df.withColumn("island", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "island").agg(F.min(on).alias(on), F.max_by(off, F.struct(on, off)).alias(off), F.count(F.lit(1)).alias("n_merged")).drop("island")


def chained(intervals: DataFrame, keys: Sequence[str], on: str, off: str, gap: int, block: int) -> DataFrame:
    """``keys, on, off, n_merged`` as merge_intervals(), for keys that hold very many intervals: no task sees more than a block's of a key.

    Intervals are chained inside blocks of ``block`` by their start. Only each block's first and last chain can go on across a border,
    so what is sorted per key is one row per block.
    """
    own = intervals.select(*keys, F.col(on).alias("_on"), F.col(off).alias("_off"), F.floor(F.col(on) / block).alias("_block"))
    w = Window.partitionBy(*keys, "_block").orderBy("_on", "_off")
    new = F.when(F.col("_on") - F.lag("_off").over(w) < gap, 0).otherwise(1)
    inside = own.withColumn("_chain", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    chains = inside.groupBy(*keys, "_block", "_chain").agg(F.min("_on").alias("_on"), F.max(F.struct("_on", "_off")).alias("_last"), F.count(F.lit(1)).alias("_n"))
    blocks = chains.groupBy(*keys, "_block").agg(F.min("_on").alias("_first"), F.max("_last").alias("_end"), F.max("_chain").alias("_chains"))
    by = Window.partitionBy(*keys).orderBy("_block")
    apart = F.coalesce(F.col("_first") - F.lag("_end._off").over(by) >= gap, F.lit(True))
    back = F.struct(F.lag("_block").over(by).alias("block"), F.lag("_chains").over(by).alias("chain"))
    begins = F.when(apart, F.struct(F.col("_block").alias("block"), F.lit(1).cast("long").alias("chain"))).when(back["chain"] > 1, back)
    heads = blocks.withColumn("_begins", begins).select(*keys, "_block", F.last("_begins", True).over(by).alias("_head"), F.lit(1).cast("long").alias("_chain"))
    named = chains.join(heads, [*keys, "_block", "_chain"], "left")
    head = F.coalesce("_head", F.struct(F.col("_block").alias("block"), F.col("_chain").alias("chain")))
    whole = named.groupBy(*keys, head.alias("_h")).agg(F.min("_on").alias(on), F.max("_last").alias("_last"), F.sum("_n").alias("n_merged"))
    return whole.select(*keys, on, F.col("_last._off").alias(off), "n_merged")


def overlap_join(a: DataFrame, b: DataFrame, keys: Sequence[str], a_on: str, a_off: str, b_on: str, b_off: str, width: int) -> DataFrame:
    """Pairs of intervals that overlap (ends included), by an equi-join on buckets of ``width``; each pair comes from the bucket where its later start lies."""
    bucket = lambda on, off: F.explode(F.sequence(F.floor(F.col(on) / width), F.floor(F.col(off) / width)))
    x = a.withColumn("_bucket", bucket(a_on, a_off))
    y = b.withColumn("_bucket", bucket(b_on, b_off))
    both = x.join(y, [*keys, "_bucket"]).filter((F.col(a_on) <= F.col(b_off)) & (F.col(b_on) <= F.col(a_off)))
    return both.filter(F.col("_bucket") == F.floor(F.greatest(a_on, b_on) / width)).drop("_bucket")


def next_and_previous(points: DataFrame, probes: DataFrame, keys: Sequence[str], t: str) -> DataFrame:
    """For each probe, the next point after it and the last one before it: no range join, and frames that only grow: one sort up, one down."""
    both = probes.select(*keys, t, F.lit(True).alias("is_probe")).unionByName(points.select(*keys, t, F.lit(False).alias("is_probe")))
    own = F.when(~F.col("is_probe"), F.col(t))
    before = F.max(own).over(Window.partitionBy(*keys).orderBy(t).rangeBetween(Window.unboundedPreceding, -1))
    after = F.min(own).over(Window.partitionBy(*keys).orderBy(F.desc(t)).rangeBetween(Window.unboundedPreceding, -1))
    return both.select(*keys, t, "is_probe", before.alias("previous_us"), after.alias("next_us")).filter("is_probe").drop("is_probe")


def line_length_events(signal: DataFrame, fs: float, window_ms: float, percent: float, merge_ms: float, least_ms: float) -> DataFrame:
    """Line-length events of ``signal(ch, i, v)``: ``on_i, off_i, duration, n_channels``, all in samples.

    Line length is the sum of absolute first differences over the next ``window`` - 1 steps, null for the last ``window`` samples. Samples
    at or above the percentile of all channels' values are marked; runs with a mark in any channel become events, shifted by half
    a window, merged when less than ``merge_ms`` apart, and dropped when shorter than ``least_ms``.
    """
    from cortexlake.operators.stats import prctile

    n = int(round(window_ms * fs / 1000))
    by_channel = Window.partitionBy("ch").orderBy("i")
    step = signal.withColumn("d", F.abs(F.lead("v").over(by_channel) - F.col("v")))
    length = step.withColumn("ll", F.sum("d").over(by_channel.rowsBetween(0, n - 2))).withColumn("far", F.lead("i", n).over(by_channel))
    length = length.select("ch", "i", F.when(F.col("far").isNotNull(), F.round("ll", 6)).alias("ll"))
    high = length.join(F.broadcast(prctile(length, [], "ll", percent, "limit")), F.col("ll") >= F.col("limit")).select("ch", "i")
    marked = high.select(F.lit(1).alias("one"), F.col("i").alias("lo"), F.col("i").alias("hi")).distinct()
    runs = chained(marked, ["one"], "lo", "hi", 2, BLOCK).drop("n_merged")
    half = int(n / 2 + 0.5)
    channels = overlap_join(runs, high.select(F.lit(1).alias("one"), "ch", F.col("i").alias("s"), F.col("i").alias("e")), ["one"], "lo", "hi", "s", "e", 4096)
    events = runs.select("one", (F.col("lo") + half).alias("on_i"), (F.col("hi") + half).alias("off_i"))
    merged = chained(events, ["one"], "on_i", "off_i", int(merge_ms * fs / 1000), BLOCK)
    kept = merged.filter((F.col("off_i") - F.col("on_i")) >= int(least_ms * fs / 1000))
    of = overlap_join(kept, channels.select("one", "ch", (F.col("s") + half).alias("s"), (F.col("e") + half).alias("e")), ["one"], "on_i", "off_i", "s", "e", 4096)
    return of.groupBy("on_i", "off_i").agg(F.countDistinct("ch").alias("n_channels")).withColumn("duration", F.col("off_i") - F.col("on_i"))
