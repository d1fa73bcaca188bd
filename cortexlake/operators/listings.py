"""Listings of paths as trees: every node on the way to a file, as deep as the paths go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nodes(paths: DataFrame, separator: str = "/") -> DataFrame:
    """``name, parent, depth, is_file`` of each node, once for each path through it; empty parts of a path don't count."""
    parts = F.filter(F.split("path", f"\\Q{separator}\\E"), lambda x: x != "")
    up_to = lambda k: F.array_join(F.slice("parts", 1, k), separator)
    of = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda k: F.struct(up_to(k).alias("name"), F.when(k > 1, up_to(k - 1)).alias("parent"), k.alias("depth"), (k == F.size("parts")).alias("is_file")))
    return paths.select(parts.alias("parts")).filter(F.size("parts") > 0).select(F.explode(of).alias("x")).select("x.*")


def tree(paths: DataFrame, separator: str = "/") -> DataFrame:
    """``name, parent, depth, n_files`` of each node of a listing: its whole name, that of the node above (null at the top), and the files at or below it."""
    return nodes(paths, separator).groupBy("name", "parent", "depth").agg(F.count(F.lit(1)).alias("n_files"))


def directories(paths: DataFrame, pattern: str, deepest: int, separator: str = "/") -> DataFrame:
    """``name, depth`` of the directories on the way to files whose last part matches ``pattern``, nearest to the top first, down to ``deepest``."""
    last = F.element_at(F.split("name", f"\\Q{separator}\\E"), -1)
    found = nodes(paths, separator).filter(~F.col("is_file") & (F.col("depth") <= deepest) & last.rlike(pattern))
    return found.select("name", "depth").distinct().orderBy("depth", "name")
