"""Signals as rows ``ch, i, v``: windows around events, averages, current source density, template warps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def event_windows(signal: DataFrame, anchors: DataFrame, half: int) -> DataFrame:
    """Samples ``off`` = -half..half around each anchor ``ev, at``; places outside the recording are null.

    The offsets are generated from the anchors, so the signal meets them in an equi-join on the sample.
    """
    placed = anchors.select("ev", "at", F.explode(F.sequence(F.lit(-half), F.lit(half))).alias("off")).withColumn("i", F.col("at") + F.col("off"))
    return placed.join(signal, "i", "left").select("ev", "off", "ch", "v")


def padded_windows(signal: DataFrame, anchors: DataFrame, before: int, after: int, channels: DataFrame) -> DataFrame:
    """Samples ``off`` = -before..after - 1 around each anchor for each of ``channels``; places outside the recording are rows with null ``v``.

    ``channels`` (``ch``) are those of the probe, so there are as many rows as windows hold places.
    """
    every = channels.agg(F.array_sort(F.collect_set("ch")).alias("chs"))
    offsets = F.explode(F.sequence(F.lit(-before), F.lit(after - 1))).alias("off")
    placed = anchors.select("ev", "at", offsets).withColumn("i", F.col("at") + F.col("off")).join(F.broadcast(every)).select("ev", "off", "i", F.explode("chs").alias("ch"))
    return placed.join(signal, ["ch", "i"], "left").select("ev", "off", "ch", "v")


def filled_gaps(grid: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, ch, v, status``: values with status 2 filled along ``ch``, linearly between known ones and with the nearest at the ends; status 1 gives null."""
    known = F.when(F.col("status") == 0, F.struct("ch", "v"))
    w = Window.partitionBy(*keys).orderBy("ch")
    lo, hi = F.last(known, True).over(w), F.last(known, True).over(Window.partitionBy(*keys).orderBy(F.desc("ch")))
    both = grid.withColumn("lo", lo).withColumn("hi", hi)
    share = (F.col("ch") - F.col("lo.ch")) / (F.col("hi.ch") - F.col("lo.ch"))
    between = F.col("lo.v") + (F.col("hi.v") - F.col("lo.v")) * share
    filled = F.when(F.col("lo").isNull(), F.col("hi.v")).when(F.col("hi").isNull(), F.col("lo.v")).otherwise(between)
    return both.select(*keys, "ch", F.when(F.col("status") == 0, F.col("v")).when(F.col("status") == 2, filled).alias("v"), "status")


def average_windows(windows: DataFrame) -> DataFrame:
    """Mean, population deviation and count over events for each channel and offset."""
    return windows.filter("ch is not null").groupBy("ch", "off").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), F.count("v").alias("n"))


def source_density(signal: DataFrame, keys: list[str], edge: str = "null") -> DataFrame:
    """Minus the second difference over channels: ``csd``. At the ends null, or with the end channel repeated (``edge='replicate'``)."""
    w = Window.partitionBy(*keys).orderBy("ch")
    below, above = F.lag("v").over(w), F.lead("v").over(w)
    if edge == "replicate":
        below, above = F.coalesce(below, F.col("v")), F.coalesce(above, F.col("v"))
    return signal.withColumn("csd", -(below - 2 * F.col("v") + above))


def bin_means(signal: DataFrame, size: int) -> DataFrame:
    """Means of whole bins of ``size`` samples; a last bin that isn't full goes."""
    return signal.groupBy("ch", F.floor(F.col("i") / size).alias("bin")).agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == size).drop("n")


def warp_to_template(profile: DataFrame, template: DataFrame) -> DataFrame:
    """Stretches each region's rows ``session, region, pos (1..n), v`` to the template's ``region, target`` rows by linear interpolation.

    One row is repeated; a region that a session lacks gives nulls with status 1.
    """
    sizes = profile.groupBy("session", "region").agg(F.max("pos").alias("n"))
    grid = profile.select("session").distinct().join(F.broadcast(template.select("region", F.explode(F.sequence(F.lit(1), "target")).alias("row"), "target")))
    at = F.when(F.col("target") > 1, 1 + (F.col("row") - 1) * (F.col("n") - 1) / (F.col("target") - 1)).otherwise((F.col("n") + 1) / 2)
    placed = grid.join(sizes, ["session", "region"], "left").withColumn("x", at)
    placed = placed.withColumn("lo", F.floor("x")).withColumn("hi", F.ceil("x"))
    a = profile.select("session", "region", F.col("pos").alias("lo"), F.col("v").alias("va"))
    b = profile.select("session", "region", F.col("pos").alias("hi"), F.col("v").alias("vb"))
    both = placed.join(a, ["session", "region", "lo"], "left").join(b, ["session", "region", "hi"], "left")
    return both.select("session", "region", "row", (F.col("va") + (F.col("vb") - F.col("va")) * (F.col("x") - F.col("lo"))).alias("v"), F.when(F.col("n").isNull(), 1).otherwise(0).alias("status"))
