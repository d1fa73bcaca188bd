"""Two principal components and clusters of vectors, with labels that don't depend on the seed; clusters by density in the plane."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cortexlake.operators.graph import components
from cortexlake.operators.stages import settled

#: Points of a cell that are tried first against those of a neighbouring cell.
TRIED = 32


def pca_clusters(df: DataFrame, key: str, vector: str, k: int = 2, seed: int = 1) -> DataFrame:
    """``key, pc1, pc2, k_type``: components of the centred vectors; clusters are numbered by their mean position of the largest entry, from 1."""
    v = df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("raw"), F.array_position(vector, F.array_max(vector)).alias("depth"))
    centred = StandardScaler(inputCol="raw", outputCol="x", withMean=True, withStd=False).fit(v).transform(v)
    pcs = PCA(k=2, inputCol="x", outputCol="pc").fit(centred).transform(centred)
    found = KMeans(k=k, seed=seed, featuresCol="pc", predictionCol="cluster").fit(pcs).transform(pcs)
    order = found.groupBy("cluster").agg(F.avg("depth").alias("d")).selectExpr("cluster", "row_number() OVER (ORDER BY d, cluster) AS k_type")
    pc = vector_to_array("pc")
    return found.join(F.broadcast(order), "cluster").select(key, pc[0].alias("pc1"), pc[1].alias("pc2"), "k_type")


def dbscan(points: DataFrame, eps: float, least: int) -> DataFrame:
    """``id, cluster, core`` of ``points`` (``id, x, y``): a core point has ``least`` points within ``eps``, itself included.

    Core points within ``eps`` of each other are one cluster, named by its smallest core id; another point belongs to the smallest
    named of the clusters with a core point within ``eps``, else to none (null), and so does a point without coordinates.

    The plane is cut into cells whose points all lie within ``eps`` of each other, so a cell of ``least`` points is all core without a
    look at its neighbours, and a cell's core points are one node when clusters are linked. Equal points count as one with a
    number. Two crowded cells are linked by some of their points where these suffice; only pairs of cells still apart meet in full.
    """
    side = eps / 2**0.5 * (1 - 1e-9)
    known = points.filter(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    cell = [F.floor(F.col("x") / side).alias("cx"), F.floor(F.col("y") / side).alias("cy")]
    places = settled(known.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).select("*", *cell), "places")
    crowded = places.groupBy("cx", "cy").agg(F.sum("n").alias("inside")).filter(F.col("inside") >= least).select("cx", "cy", F.lit(True).alias("crowded"))
    marked = settled(places.join(crowded, ["cx", "cy"], "left").withColumn("crowded", F.col("crowded").isNotNull()), "marked-places")

    around = [(a, b) for a in range(-2, 3) for b in range(-2, 3) if abs(a) + abs(b) < 4]
    offsets = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in around))
    within = (F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy")) <= eps * eps

    def spread(df: DataFrame) -> DataFrame:
        """``df`` at each cell that its points may reach, as ``cx, cy`` of that cell."""
        return df.withColumn("o", F.explode(offsets)).withColumn("cx", F.col("cx") + F.col("o.a")).withColumn("cy", F.col("cy") + F.col("o.b")).drop("o")

    sparse = marked.filter("not crowded").select("x", "y", "cx", "cy")
    others = lambda df: df.withColumnRenamed("x", "ox").withColumnRenamed("y", "oy")
    counted = spread(sparse).join(others(places.select("x", "y", "cx", "cy", "n")), ["cx", "cy"]).filter(within).groupBy("x", "y").agg(F.sum("n").alias("near"))
    alone = counted.filter(F.col("near") >= least).select("x", "y")
    core = settled(marked.filter("crowded").select("x", "y", "cx", "cy", "first").unionByName(marked.join(alone, ["x", "y"], "left_semi").select("x", "y", "cx", "cy", "first")), "core-places")

    node = lambda x, y: F.struct(F.col(x).alias("cx"), F.col(y).alias("cy"))
    forward = [(a, b) for a, b in around if (a, b) > (0, 0)]

    def linked(a: DataFrame, b: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
        """Pairs of neighbouring cells with core points within ``eps``."""
        out = a.select("x", "y", node("cx", "cy").alias("a"), F.explode(F.array(*(F.struct((F.col("cx") + p).alias("cx"), (F.col("cy") + q).alias("cy")) for p, q in forward))).alias("b"))
        out = out if pairs is None else out.join(pairs, ["a", "b"], "left_semi")
        return out.join(b.select(F.col("x").alias("ox"), F.col("y").alias("oy"), node("cx", "cy").alias("b")), "b").filter(within).select("a", "b").distinct()

    order = Window.partitionBy("cx", "cy").orderBy(F.xxhash64("x", "y"))
    some = settled(core.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= TRIED), "tried-places")
    roots = settled(components(settled(linked(some, some), "cell-links")), "cell-roots")
    cells = settled(core.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("many")).select(node("cx", "cy").alias("node"), "many").join(roots, "node", "left").select("node", "many", F.coalesce("root", "node").alias("root")), "cells")
    pairs = cells.select(F.col("node").alias("a"), F.col("many").alias("many_a"), F.col("root").alias("root_a"), F.explode(F.array(*(F.struct((F.col("node.cx") + p).alias("cx"), (F.col("node.cy") + q).alias("cy")) for p, q in forward))).alias("b"))
    pairs = pairs.join(cells.select(F.col("node").alias("b"), F.col("many").alias("many_b"), F.col("root").alias("root_b")), "b")
    apart = pairs.filter((F.col("root_a") != F.col("root_b")) & (F.greatest("many_a", "many_b") > TRIED)).select("a", "b")
    more = linked(core, core, settled(apart, "cells-apart"))
    again = components(settled(more.join(cells.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a").join(cells.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).filter("a <> b"), "more-links"))
    named = cells.join(again.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    placed = core.select("x", "y", "cx", "cy", "first", node("cx", "cy").alias("node")).join(named, "node")
    placed = placed.join(placed.groupBy("root").agg(F.min("first").alias("cluster")), "root").select("x", "y", "cx", "cy", "cluster")
    placed = settled(placed, "core-clusters")
    border = spread(sparse.join(core.select("x", "y"), ["x", "y"], "left_anti")).join(others(placed), ["cx", "cy"]).filter(within).groupBy("x", "y").agg(F.min("cluster").alias("cluster"))
    found = placed.select("x", "y", "cluster", F.lit(True).alias("core")).unionByName(border.withColumn("core", F.lit(False)))
    return points.select("id", "x", "y").join(found, ["x", "y"], "left").select("id", "cluster", F.coalesce("core", F.lit(False)).alias("core"))
