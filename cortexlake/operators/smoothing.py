"""Short filters as weighted sums over neighbouring samples: the offsets are generated, so each is an equi-join and a sum."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gaussian(sigma: float, radius: int) -> list[tuple[int, float]]:
    return [(k, math.exp(-k * k / (2 * sigma * sigma))) for k in range(-radius, radius + 1)]


def weighted(signal: DataFrame, along: str, weights: list[tuple[int, float]], every: int = 1) -> DataFrame:
    """``ch, i, v``: weighted means along ``i`` or ``ch``, at every ``every``-th place; at the ends over the weights that fall on samples.

    Each sample goes to the places that it bears on, so the sums are built before the shuffle; the work is that of the weights per place.
    """
    taps = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(w).alias("w")) for k, w in weights))
    spread = signal.select("ch", "i", "v", F.explode(taps).alias("t")).withColumn(along, F.col(along) - F.col("t.k"))
    spread = spread.filter(F.pmod(F.col(along), F.lit(every)) == 0) if every > 1 else spread
    sums = spread.groupBy("ch", "i").agg(F.sum(F.col("v") * F.col("t.w")).alias("s"), F.sum("t.w").alias("w"), F.max(F.when(F.col("t.k") == 0, F.lit(True))).alias("own"))
    return sums.filter("own").select("ch", "i", (F.col("s") / F.col("w")).alias("v"))


def resampled(signal: DataFrame, up: int, down: int, lobes: int = 4) -> DataFrame:
    """``ch, i, v``: the signal at ``up / down`` of its rate, by a windowed sinc with its cutoff at the lower of the two rates.

    Sample ``i`` of the result stands at place ``i * down / up`` of the signal. ``lobes`` zero crossings are used on each side.
    """
    g = math.gcd(up, down)
    up, down = up // g, down // g
    cut = min(1.0, up / down)
    reach = lobes / cut
    # The places that a sample bears on: those with |i * down / up - sample| < reach.
    low, high = F.ceil((F.col("i") - F.lit(reach)) * up / down), F.floor((F.col("i") + F.lit(reach)) * up / down)
    ends = signal.groupBy("ch").agg(F.min("i").alias("first"), F.max("i").alias("last"))
    spread = signal.join(ends, "ch").select("ch", "v", F.col("i").alias("k"), "first", "last", F.explode(F.sequence(low, high)).alias("i"))
    spread = spread.filter((F.col("i") * down >= F.col("first") * up) & (F.col("i") * down <= F.col("last") * up))
    d = (F.col("i") * down / up - F.col("k")) * cut
    sinc = F.when(F.abs(d) < 1e-12, 1.0).otherwise(F.sin(d * math.pi) / (d * math.pi))
    w = F.when(F.abs(d) < lobes, sinc * (0.5 + 0.5 * F.cos(d * math.pi / lobes))).otherwise(0.0)
    return spread.withColumn("w", w).groupBy("ch", "i").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("v"))


def repeated_and_binned(signal: DataFrame, up: int, down: int) -> DataFrame:
    """``ch, i, v``: every sample ``up`` times, then means of ``down`` at a time; a last bin that isn't full goes."""
    each = signal.select("ch", "v", F.explode(F.sequence(F.col("i") * up, F.col("i") * up + up - 1)).alias("j"))
    bins = each.groupBy("ch", F.floor(F.col("j") / down).alias("i")).agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("n"))
    return bins.filter(F.col("n") == down).select("ch", "i", "v")
