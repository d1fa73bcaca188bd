"""Grouped statistics with the semantics that laboratory scripts expect: NaN and null are missing, null keys go."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cortexlake.operators.stages import settled

#: Ranges that a group's values are cut into when they are ranked.
RANGES = 64


def missing(x: Column) -> Column:
    """NaN as null."""
    return F.when(F.isnan(x), None).otherwise(x)


def grouped_means(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Mean of each measure; rows with a null key go."""
    return df.na.drop(subset=list(keys)).groupBy(*keys).agg(*(F.avg(missing(F.col(m).cast("double"))).alias(f"mean_{m}") for m in measures))


def mean_sem(df: DataFrame, keys: Sequence[str], measure: str) -> DataFrame:
    """Mean, standard error (sample deviation) and count of what isn't missing."""
    x = missing(F.col(measure).cast("double"))
    return df.na.drop(subset=list(keys)).groupBy(*keys).agg(F.avg(x).alias("mean"), (F.stddev_samp(x) / F.sqrt(F.count(x))).alias("sem"), F.count(x).alias("n"))


def _at_rank(df: DataFrame, keys: Sequence[str], value: str, place, name: str) -> DataFrame:
    """The value at the real-valued rank ``place(n)`` (from 1) of each group's n values, linear between whole ranks.

    Exact and without gathering a group: values are counted and cut into RANGES ranges per group by approximate quantiles; ranks are
    running sums inside a range, and only the ranges' sizes are summed over a group. Just the two neighbouring ranks are kept.
    The cuts depend on the order in which values come, so they are written once for both of their uses.
    """
    counts = df.select(*keys, F.col(value).alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v")).groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n"))
    keyed = counts.withColumn("_one", F.lit(1))
    by = [*keys, "_one"]
    cuts = settled(keyed.groupBy(*by).agg(F.percentile_approx("_v", [k / RANGES for k in range(1, RANGES)], 4 * RANGES).alias("_cuts")), "rank-cuts")
    ranged = keyed.join(cuts, by) if keys else keyed.join(F.broadcast(cuts), "_one").select(*keyed.columns, "_cuts")
    ranged = ranged.withColumn("_range", F.size(F.filter("_cuts", lambda c: c <= F.col("_v")))).drop("_cuts")
    inside = ranged.withColumn("_in", F.sum("_n").over(Window.partitionBy(*by, "_range").orderBy("_v")))
    sizes = ranged.groupBy(*by, "_range").agg(F.sum("_n").alias("_size"))
    w = Window.partitionBy(*by)
    before = sizes.withColumn("_before", F.sum("_size").over(w.orderBy("_range")) - F.col("_size")).withColumn("_all", F.sum("_size").over(w)).drop("_size")
    ranked = inside.join(before, [*by, "_range"]).withColumn("_hi", F.col("_in") + F.col("_before"))
    at = place(F.col("_all"))
    low, high = F.floor(at), F.ceil(at)
    holds = lambda r: (F.col("_hi") >= r) & (F.col("_hi") - F.col("_n") < r)
    ends = ranked.filter(holds(low) | holds(high)).groupBy(*by).agg(F.max(F.when(holds(low), F.col("_v"))).alias("_a"), F.max(F.when(holds(high), F.col("_v"))).alias("_b"), F.max(at - low).alias("_f"))
    return ends.select(*keys, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).alias(name))


def prctile(df: DataFrame, keys: Sequence[str], value: str, percent: float, name: str = "p") -> DataFrame:
    """Percentile with midpoint ranks: the k-th of n values is the 100 * (k - 0.5) / n percentile, linear between, flat outside."""
    return _at_rank(df, keys, value, lambda n: F.least(F.greatest(n * F.lit(percent / 100) + 0.5, F.lit(1.0)), n.cast("double")), name)


def quantile(df: DataFrame, keys: Sequence[str], value: str, q: float, name: str = "p") -> DataFrame:
    """Quantile with the first value at 0 and the last at 1, linear between."""
    return _at_rank(df, keys, value, lambda n: (n - 1) * F.lit(q) + 1.0, name)


def place_descending(df: DataFrame, value: str, tie: str, name: str = "place") -> DataFrame:
    """Each row's place from 1 by falling ``value``, equal ones by rising numeric ``tie``, a null one last; ``value`` may not be null.

    No task sorts all rows: rows of equal value are cut into RANGES ranges of the tie and numbered inside them, and only the
    ranges' sizes, RANGES for each distinct value, are summed over the whole. The cuts depend on the order in which rows come,
    so they are written once for both of their uses.
    """
    cuts = settled(df.groupBy(value).agg(F.percentile_approx(tie, [k / RANGES for k in range(1, RANGES)], 4 * RANGES).alias("_cuts")), "place-cuts")
    place = F.when(F.col(tie).isNull(), RANGES).otherwise(F.size(F.filter(F.coalesce("_cuts", F.array()), lambda c: c <= F.col(tie))))
    ranged = df.join(cuts, value).withColumn("_range", place).drop("_cuts")
    sizes = ranged.groupBy(value, "_range").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.withColumn("_before", F.sum("_size").over(Window.orderBy(F.desc(value), "_range")) - F.col("_size")).drop("_size")
    inside = ranged.withColumn("_in", F.row_number().over(Window.partitionBy(value, "_range").orderBy(tie)))
    return inside.join(before, [value, "_range"]).withColumn(name, F.col("_in") + F.col("_before")).select(*df.columns, name)


def circular_mean(df: DataFrame, keys: Sequence[str], degrees: str, weight: str | None = None) -> DataFrame:
    """Mean angle in degrees (0 to 360), resultant length and count, of unit vectors or of vectors as long as ``weight``."""
    a = F.radians(F.col(degrees))
    r = F.col(weight) if weight else F.lit(1.0)
    sums = df.groupBy(*keys).agg(F.avg(r * F.cos(a)).alias("x"), F.avg(r * F.sin(a)).alias("y"), F.count(degrees).alias("n"))
    return sums.select(*keys, F.pmod(F.degrees(F.atan2("y", "x")), F.lit(360.0)).alias("mean_deg"), F.hypot("x", "y").alias("r"), "n")


def rayleigh_p(r: Column, n: Column) -> Column:
    """Approximate p of the Rayleigh test, kept within 0 and 1; null without observations."""
    z = n * r * r
    series = F.exp(-z) * (1 + (2 * z - z * z) / (4 * n) - (24 * z - 132 * z * z + 76 * F.pow(z, 3) - 9 * F.pow(z, 4)) / (288 * n * n))
    return F.when(n > 0, F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))


def min_max_scaled(x: Column, keys: Sequence[str]) -> Column:
    """To 0 to 1 within the group; a constant group gives 0."""
    w = Window.partitionBy(*keys)
    low, span = F.min(x).over(w), F.max(x).over(w) - F.min(x).over(w)
    return F.when(span == 0, 0.0).otherwise((x - low) / span)


def vote(status: Column) -> Column:
    """1 if all are 1, else 0 if any is 0, else 2."""
    return F.when(F.min(status == 1), 1).when(F.max(status == 0), 0).otherwise(2)
