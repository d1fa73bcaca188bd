"""Shared steps of the pairwise operators: texts of the documents in a pair, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cortexlake.llm.scratch import written


def pack(texts: list[str | None]) -> list[bytes]:
    squeeze = zstandard.ZstdCompressor(level=1).compress
    return [squeeze((t or "").encode()) for t in texts]


def unpack(packed: pa.Array) -> pa.Array:
    """The texts again, null where there is none."""
    back = zstandard.ZstdDecompressor().decompress
    return pa.array([None if p is None else back(p).decode() for p in packed.to_pylist()], pa.large_string())


def packed_texts(docs: DataFrame, key: str) -> DataFrame:
    """``key`` and the text of each row, compressed to keep shuffles small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(pack(b.column("text").to_pylist()), pa.binary())], [key, "packed"])

    return docs.select(key, "text").mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, packed binary")


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """The rows again, cut so that rows with equal ``key`` stay together; they are sorted by it, and such groups are short."""
    rest: pa.RecordBatch | None = None
    for b in batches:
        if not len(b):
            continue
        if rest is not None:
            b = pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
        k = b.column(key).to_numpy()
        cut = int(np.searchsorted(k, k[-1], "left"))
        if cut:
            yield b.slice(0, cut)
        rest = b.slice(cut)
    if rest is not None:
        yield rest


def lists_of(first: np.ndarray, values: np.ndarray) -> pa.Array:
    """Lists of longs; ``first`` tells where each begins (one more: the end)."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values, pa.int64()))


def _is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def components(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame | None:
    """``node, root`` of every node that isn't its component's smallest, from links ``a < b``; None without links.

    With ``labels`` of earlier links, the links are between their roots; the labels themselves come back if there are none.

    Each round hooks every node to its smallest neighbour, follows the pointers to their ends by doubling, and
    carries the links on to the ends until no link joins two components. Ids only; every round is a written table.
    """
    live = edges
    while True:
        hook = written(live.groupBy("b").agg(F.min("a").alias("a")), "hooks")
        if _is_empty(hook):
            return labels
        while True:
            p = hook.select(F.col("b").alias("p_b"), F.col("a").alias("p_a"))
            if _is_empty(hook.join(p, hook.a == p.p_b, "left_semi")):
                break
            hook = written(hook.join(p, hook.a == p.p_b, "left").select("b", F.coalesce("p_a", "a").alias("a")), "hooks")
        ends = hook.select(F.col("b").alias("p_b"), F.col("a").alias("p_a"))
        here = hook.select(F.col("b").alias("node"), F.col("a").alias("root"))
        if labels is not None:
            here = labels.join(ends, labels.root == ends.p_b, "left").select("node", F.coalesce("p_a", "root").alias("root")).unionByName(here)
        labels = written(here, "labels")
        live = written(between(live, ends), "cross-links")


def between(pairs: DataFrame, ends: DataFrame) -> DataFrame:
    """Distinct pairs of different ends; ``ends`` leads from ``p_b`` to ``p_a``."""
    q = ends.select(F.col("p_b").alias("q_b"), F.col("p_a").alias("q_a"))
    moved = pairs.join(ends, pairs.a == ends.p_b, "left").join(q, pairs.b == q.q_b, "left").select(F.coalesce("p_a", "a").alias("x"), F.coalesce("q_a", "b").alias("y"))
    return moved.filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
