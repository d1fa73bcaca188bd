"""A template of region thicknesses from labelled channels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Regions from top to bottom, the pads above and below them, and the probe's channels.
REGIONS = ("CA1 SLM", "DG OML1", "DG MML1", "DG GCL1", "HIL", "DG GCL2", "DG MML2", "DG OML2")
ABOVE, BELOW = "ABOVE CA1 SLM", "BELOW DG OML2"
CHANNELS = 64


def region_status(labels: DataFrame, channels: int = CHANNELS) -> DataFrame:
    """``session, region, thickness, status`` of the regions of ``session, row, region`` and of the pads around them.

    The first region is cut off ('edge') where it begins at the session's first row, the last one where it ends at its last. A pad is
    what lies beyond these two regions; a session that lacks the region has no such pad, and one of thickness 0 is 'zero'.
    """
    bounds = labels.groupBy("session").agg(F.min("row").alias("first_row"), F.max("row").alias("last_row"))
    extent = labels.filter(F.col("region").isin(*REGIONS)).groupBy("session", "region").agg(F.count(F.lit(1)).alias("thickness"), F.min("row").alias("top"), F.max("row").alias("bottom"))
    first, last = F.col("region") == REGIONS[0], F.col("region") == REGIONS[-1]
    cut = first & (F.col("top") == F.col("first_row")) | last & (F.col("bottom") == F.col("last_row"))
    inner = extent.join(bounds, "session").select("session", "region", "thickness", F.when(cut, "edge").otherwise("kept").alias("status"))
    pad = F.when(first, F.struct(F.lit(ABOVE).alias("region"), F.greatest(F.col("top") - 1, F.lit(0)).cast("long").alias("thickness")))
    pad = pad.when(last, F.struct(F.lit(BELOW).alias("region"), F.greatest(F.lit(channels) - F.col("bottom"), F.lit(0)).cast("long").alias("thickness")))
    pads = extent.filter(first | last).select("session", pad.alias("p")).select("session", "p.region", "p.thickness", F.when(F.col("p.thickness") == 0, "zero").otherwise("kept").alias("status"))
    return inner.unionByName(pads)


def golden_template(labels: DataFrame, channels: int = CHANNELS) -> DataFrame:
    """``place, region, mean_thickness, target``: mean thickness of what is kept, rounded half to even.

    What the sum lacks of ``channels``, or has too much, goes to the larger pad, to the upper one if they are equal; without both
    pads nothing is changed. The result has a row for each region, ten at most.
    """
    names = (ABOVE, *REGIONS, BELOW)
    order = labels.sparkSession.createDataFrame([(k, r) for k, r in enumerate(names)], "place int, region string")
    kept = region_status(labels, channels).filter("status = 'kept'").groupBy("region").agg(F.avg("thickness").alias("mean_thickness"))
    rounded = kept.join(F.broadcast(order), "region").withColumn("target", F.bround("mean_thickness").cast("int"))
    of = lambda pad: F.max(F.when(F.col("region") == pad, F.col("target")))
    sums = rounded.agg((F.lit(channels) - F.sum("target")).cast("int").alias("lack"), of(ABOVE).alias("above"), of(BELOW).alias("below"))
    larger = F.when(F.col("above") >= F.col("below"), ABOVE).when(F.col("above") < F.col("below"), BELOW)
    mended = F.col("target") + F.when(F.col("region") == larger, F.col("lack")).otherwise(0)
    return rounded.join(F.broadcast(sums)).select("place", "region", "mean_thickness", mended.alias("target"))


def crop(template: DataFrame) -> DataFrame:
    """Row range of each region but the pads, from the running sum of thicknesses. A template has ten rows at most."""
    end = F.sum("target").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return template.withColumn("last_row", end).withColumn("first_row", F.col("last_row") - F.col("target") + 1).filter(~F.col("region").isin(ABOVE, BELOW, "ABOVE", "BELOW"))
