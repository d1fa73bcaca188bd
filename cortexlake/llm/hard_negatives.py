"""Hard negatives: rows of another label that score just below an anchor's positives.

Rows are dealt by their nearest of PIVOTS sampled vectors and their closeness to it, so that a tree holds a neighbourhood, and a
crowded neighbourhood becomes several trees. Anchors come to every tree in blocks. They first search the tree they lie in;
the k-th score found there is the floor under which no other tree has to offer rows, so that little is left to be merged. The search for
positives gives each anchor its windows of scores, and the search for negatives runs with those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cortexlake.llm.ball_tree import NONE, BallTree, whole
from cortexlake.llm.scratch import written

#: Rows of a tree, at most and at least on average; sampled vectors; anchors of a block.
TREE_ROWS, LEAST_ROWS, PIVOTS, BLOCK = 65_536, 2_048, 64, 256
_BLOCK = pa.schema([("row", pa.int64()), ("label", pa.int64()), ("vector", pa.list_(pa.int64())), ("tree", pa.int32()), *((x, pa.list_(pa.int64())) for x in ("low", "high", "floor"))])
_FOUND = "anchor long, w int, row long, id long, score long"
_MOST = (1 << 63) - 1


def points(vectors: DataFrame) -> DataFrame:
    """``row, id, label, vector``: the rows that take part, labels changed and components as whole numbers, and a number for each row."""
    x = F.col("embedding")
    sound = F.col("label").isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    q = F.transform(x, lambda c: F.floor(F.lit(256.0) * c.cast("double")).cast("long"))
    return vectors.filter(sound).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("id"), label.alias("label"), q.alias("vector"))


def _lists(b: pa.RecordBatch, name: str) -> list[np.ndarray]:
    column = b.column(name)
    values, ends = column.flatten().to_numpy(), np.cumsum(np.asarray(column.value_lengths()))
    return np.split(values, ends[:-1]) if len(ends) else []


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows`` with the ``tree`` that each belongs to; trees are numbered from 0."""
    sample = rows.orderBy(F.xxhash64("row")).limit(PIVOTS).select("vector").collect()
    dim = max((len(r.vector) for r in sample), default=0)
    pivots = np.zeros((len(sample), dim))
    for i, r in enumerate(sample):
        pivots[i, : len(r.vector)] = r.vector
    half = (pivots**2).sum(1) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.zeros((len(b), dim))
            for i, x in enumerate(_lists(b, "vector")):
                v[i, : len(x[:dim])] = x[:dim]
            away = half - v @ pivots.T  # half the squared distance, but for what is the same for all pivots
            near = away.argmin(1) if len(b) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(away[np.arange(len(b)), near])], [*b.schema.names, "pivot", "away"])

    count = rows.count()
    n = max(1, -(-count // TREE_ROWS), min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), count // LEAST_ROWS))

    def tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(np.full(len(b), part, np.int32))], ["row", "id", "label", "vector", "tree"])

    shape = "row long, id long, label long, vector array<long>"
    near = written(rows.mapInArrow(run, f"{shape}, pivot int, away double"), "near-pivots") if sample else rows.withColumn("pivot", F.lit(0)).withColumn("away", F.lit(0.0))
    return written(near.repartitionByRange(n, "pivot", "away", "row").select("row", "id", "label", "vector").mapInArrow(tree, f"{shape}, tree int"), "trees")


def _blocks(anchors: DataFrame, at_home: bool, n_trees: int) -> DataFrame:
    """Anchors in blocks: ``tree, kind, block``, for the trees they come to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            home = b.column("tree").to_numpy()
            for t in np.unique(home) if at_home else (-1,):
                mine = b.filter(pa.array(home == t)) if at_home else b
                parts = [mine.slice(lo, BLOCK).cast(_BLOCK).serialize().to_pybytes() for lo in range(0, len(mine), BLOCK)]
                yield pa.RecordBatch.from_arrays([pa.array([t] * len(parts), pa.int32()), pa.array(parts, pa.binary())], ["tree", "block"])

    blocks = anchors.select(*_BLOCK.names).mapInArrow(run, "tree int, block binary")
    return blocks if at_home else blocks.select(F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1))).alias("tree"), "block")


def _search(trees: DataFrame, anchors: DataFrame, at_home: bool, n_trees: int, same: bool, k: int) -> DataFrame:
    """What the trees offer each anchor's windows: ``anchor, w, row, id, score``. The home tree of an anchor is searched at home only."""
    none = lambda kind: F.lit(None).cast(kind)
    rows = trees.select("tree", F.lit(0).alias("kind"), "row", "id", "label", "vector", none("binary").alias("block"))
    asks = _blocks(anchors, at_home, n_trees).select("tree", F.lit(1).alias("kind"), none("long").alias("row"), none("long").alias("id"), none("long").alias("label"), none("array<long>").alias("vector"), "block")

    def ask(tree: BallTree, ids: pa.Array, t: int, block: bytes, dim: int) -> pa.RecordBatch:
        b = pa.ipc.read_record_batch(pa.py_buffer(block), _BLOCK)
        b = b if at_home else b.filter(pa.array(b.column("tree").to_numpy() != t))
        width = len(b.column("low")[0]) if len(b) else 1
        vectors, bound = _lists(b, "vector"), {x: np.array(b.column(x).to_pylist(), np.int64).reshape(len(b), width) for x in ("low", "high", "floor")}
        row = b.column("row").to_numpy()
        wide = max([dim, *map(len, vectors)])
        at, w, place, score = tree.best(whole(vectors, wide)[:, :dim], b.column("label").to_numpy(), row, bound["low"], bound["high"], bound["floor"], same, k)
        score = pa.array(np.clip(score, -_MOST, _MOST).astype(np.int64), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(row[at]), pa.array(w.astype(np.int32)), pa.array(tree.rows[place]), ids.take(pa.array(place)), score], ["anchor", "w", "row", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now, tree, ids, dim = -1, None, None, 0
        for b in batches:
            t, kind = b.column("tree").to_numpy(), b.column("kind").to_numpy()
            cuts = np.flatnonzero((t[1:] != t[:-1]) | (kind[1:] != kind[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(b)]):
                if lo == hi:
                    continue
                if t[lo] != now:
                    now, tree, held = t[lo], None, []
                if kind[lo] == 0:
                    held.append(b.slice(lo, hi - lo))
                    continue
                if tree is None and held:
                    all_ = pa.Table.from_batches(held)
                    ids = all_.column("id").combine_chunks()
                    vectors, row = [v for x in held for v in _lists(x, "vector")], all_.column("row").to_numpy()
                    dim, last = max(map(len, vectors)), np.asarray(ids.is_null())
                    rank = np.empty(len(row), np.int64)
                    rank[np.lexsort((row, ids.fill_null(0).to_numpy(), last))] = np.arange(len(row))
                    tree = BallTree(whole(vectors, dim), all_.column("label").to_numpy(), row, rank)
                for block in b.column("block").slice(lo, hi - lo).to_pylist() if tree is not None else ():
                    yield ask(tree, ids, int(now), block, dim)

    return rows.unionByName(asks).repartition("tree").sortWithinPartitions("tree", "kind").mapInArrow(run, _FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` first of each anchor's window, with their ``rank`` from 1."""
    order = Window.partitionBy("anchor", "w").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _searched(trees: DataFrame, anchors: DataFrame, n_trees: int, same: bool, k: int, name: str) -> DataFrame:
    """The ``k`` first rows of all trees for each window: at home first, then wherever a tree may add to what was found there."""
    home = written(_search(trees, anchors, True, n_trees, same, k), f"{name}-at-home")
    kth = home.groupBy("anchor", "w").agg(F.count("*").alias("c"), F.min("score").alias("s")).filter(F.col("c") >= k)
    kth = kth.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("w", "s"))).alias("kth"))
    floored = anchors.join(kth, anchors.row == kth.anchor, "left").withColumn("floor", F.expr(f"transform(low, (x, i) -> coalesce(try_element_at(kth, CAST(i AS INT)), {NONE}))"))
    return _first(home.unionByName(_search(trees, floored, False, n_trees, same, k)), k)


def hard_negatives(vectors: DataFrame, is_anchor: Column | None = None, n_positives: int = 5, n_negatives: int = 5, low: int = 80) -> DataFrame:
    """One row for each anchor, positive and negative: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Needs ``vec_id``, ``embedding`` and ``label``; more columns are ignored. Anchors are rows where ``is_anchor`` holds for ``id``,
    without it those whose id is divisible by 100. A negative's score is from ``low`` per cent of its positive's score up to
    that score, so a negative score of a positive leaves an empty window, and a score of 0 only 0.

    Rows with a null label, a null vector, or any null or non-finite component take no part. A null id is no anchor, keeps its label and comes
    last among equal scores. Repeated rows take part one by one, anchors too. Of vectors of different lengths the shorter one counts as
    filled with zeros, an empty one scores 0. Components and scores beyond a long are cut to its range. An anchor without a
    positive or without negatives has no rows, and an empty table gives an empty one.
    """
    rows = written(points(vectors), "points")
    trees = _dealt(rows)
    n_trees = (trees.agg(F.max("tree")).first()[0] or 0) + 1
    chosen = trees.filter((F.col("id") % 100 == 0) if is_anchor is None else is_anchor)
    whole_range = {"low": NONE, "high": -NONE, "floor": NONE}
    asks = chosen.select("*", *(F.array(F.lit(v).cast("long")).alias(c) for c, v in whole_range.items()))
    positives = written(_searched(trees, asks, n_trees, True, n_positives, "positives").select("anchor", F.col("rank").alias("p"), "row", "id", "score"), "positives")

    windows = positives.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("p", "score"))).alias("of"))
    asks = chosen.join(windows, chosen.row == windows.anchor).select(
        *(chosen[c] for c in ("row", "id", "label", "vector", "tree")),
        F.expr(f"transform(sequence(0, {n_positives - 1}), i -> coalesce(CAST(ceil({low} * CAST(get(of, i).score AS decimal(25, 0)) / 100) AS long), {-NONE}))").alias("low"),
        F.expr(f"transform(sequence(0, {n_positives - 1}), i -> coalesce(get(of, i).score, {NONE}))").alias("high"),
        F.expr(f"transform(sequence(0, {n_positives - 1}), i -> CAST({NONE} AS long))").alias("floor"),
    )
    found = _searched(trees, written(asks, "windows"), n_trees, False, n_negatives, "negatives").select("anchor", (F.col("w") + 1).alias("p"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = positives.select("anchor", "p", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).join(chosen.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return named.join(found, ["anchor", "p"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


ORACLE = """
WITH sound AS (SELECT vec_id, embedding::DOUBLE[] AS e, label::BIGINT AS label FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(e, lambda x: floor(256 * x)) AS v FROM sound),
s AS MATERIALIZED (SELECT a.id AS anchor, b.id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM p a, p b WHERE a.id % 100 = 0 AND a.id <> b.id),
pos AS (SELECT anchor, id AS positive, score AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5)
SELECT pos.anchor AS anchor_id, positive AS positive_id, (row_number() OVER (PARTITION BY pos.anchor, positive ORDER BY score DESC, s.id))::INT AS rank,
  s.id AS negative_id, ps AS positive_score, score AS negative_score
FROM pos JOIN s ON s.anchor = pos.anchor AND NOT s.same AND 80 * ps <= 100 * score AND score <= ps
QUALIFY rank <= 5
"""
