import math
import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from cortexlake.llm import hard_negatives as module
from cortexlake.llm.ball_tree import NONE, BallTree, whole
from cortexlake.llm.hard_negatives import ORACLE, hard_negatives

from tests.llm.helpers import DATA, none_of

SHAPE = "vec_id long, embedding array<float>, label int, row string, score double"


def brute(rows, every=100):
    kept = []
    for r in rows:
        v, label = r["embedding"], r["label"]
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        i = r["vec_id"]
        kept.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out = []
    place = lambda x: (-x[0], x[1] is None, x[1] or 0)
    for n, (a, label, v) in enumerate(kept):
        if a is None or a % every:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), i, other) for m, (i, other, w) in enumerate(kept) if m != n]
        for score, p, _ in sorted((x for x in scored if x[2] == label), key=place)[:5]:
            fits = sorted((x for x in scored if x[2] != label and 80 * score <= 100 * x[0] <= 100 * score), key=place)[:5]
            out += [(a, p, k + 1, x[1], score, x[0]) for k, x in enumerate(fits)]
    return sorted(out, key=str)


def check(df):
    want = brute([r.asDict() for r in df.collect()])
    assert sorted(map(tuple, hard_negatives(df).collect()), key=str) == want
    return want


def test_embeddings_match_brute_force_and_sql(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    want = check(df)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    assert want and sorted(con.execute(ORACLE).fetchall(), key=str) == want


def test_several_trees_ties_and_a_crowd_of_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(module, "LEAST_ROWS", 40)
    r = random.Random(4)
    base = [[r.gauss(0, 0.1) for _ in range(8)] for _ in range(20)]
    rows = [(i, base[0] if i % 3 == 0 else [x + r.choice((0.0, 0.004, 0.05)) for x in r.choice(base)], r.randrange(4), "x", 1.0) for i in range(600)]
    assert len(check(spark.createDataFrame(rows, SHAPE).repartition(6))) > 60


def test_odd_rows_and_nothing(spark):
    nan, inf = float("nan"), float("inf")
    v = [0.5, 0.25, -0.125]
    rows = [(0, v, 1), (100, v, None), (200, None, 1), (300, [nan, 0.1, 0.1], 1), (400, [inf, 0.1, 0.1], 2), (500, [None, 0.1, 0.1], 2), (None, v, 1), (None, v, 2), (7, v, 9)]
    rows += [(100, v, 1), (100, v, 1), (100, v, 2), (600, [], 1), (700, [0.5], 2), (800, [0.5, 0.25, -0.125, 4.0], 2), (900, [-0.5, -0.25, 0.1], 3), (901, [-0.4, -0.25, 0.1], 3), (902, v, 3)]
    df = spark.createDataFrame([(*x, "a", 2.0) for x in rows], SHAPE)
    assert check(df)
    assert hard_negatives(none_of(df)).count() == 0
    assert hard_negatives(df.filter("vec_id = 0")).count() == 0


def test_numbers_beyond_exact_doubles(spark):
    rows = [(i, [1000003.5 + i, -70001.25 * i, 3.0], i % 2, "a", 2.0) for i in range(40)]
    df = spark.createDataFrame(rows, SHAPE.replace("float", "double"))
    want = brute([r.asDict() for r in df.collect()], 4)
    assert want and sorted(map(tuple, hard_negatives(df, F.col("id") % 4 == 0).collect()), key=str) == want


def test_pruned_search_finds_what_a_full_one_finds():
    r = np.random.default_rng(2)
    x = np.concatenate([c + r.normal(0, 3, (300, 6)) for c in r.normal(0, 80, (8, 6))]).round().astype(np.int64)
    labels, rows = r.integers(0, 3, len(x)), np.arange(len(x))
    tree = BallTree(whole(list(x), 6), labels, rows, rows)
    q = x[::50]
    score = q @ x.T
    low, high = np.stack([np.full(len(q), NONE), score.max(1) // 2], 1), np.stack([np.full(len(q), -NONE), score.max(1) * 9 // 10], 1)
    for same in (True, False):
        at, w, place, s = tree.best(whole(list(q), 6), labels[::50], rows[::50], low, high, np.full(low.shape, NONE), same, 4)
        got = {(i, j): [] for i in range(len(q)) for j in range(2)}
        for i, j, p, v in zip(at, w, place, s):
            got[i, j].append((-v, p))
        for (i, j), found in got.items():
            ok = ((labels == labels[50 * i]) == same) & (score[i] >= low[i, j]) & (score[i] <= high[i, j]) & ~(same & (rows == 50 * i))
            assert sorted(found) == sorted((-score[i][p], p) for p in np.flatnonzero(ok))[:4]
