"""What SQL can't tell: kernels on known signals, pairing and detectors against plain loops, files, streams."""

import os
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from cortexlake import plans
from cortexlake.operators import spectral as sp
from cortexlake.operators import stats
from cortexlake.operators.sources_density import forward_matrix
from cortexlake.plans.registry import HOUR, Tables
from cortexlake.sources import recordings as rec
from cortexlake.streaming.timelines import debounced_stream

from tests.brute import find_peaks

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_greedy_pairs(spark):
    by = defaultdict(list)
    for r in Tables(spark, DATA).timeline.filter("code in ('click', 'view')").orderBy("session", "t").collect():
        by[r.session].append((r.t, r.code))
    want = set()
    for s, events in by.items():
        used = set()
        for t, code in events:
            if code == "click":
                later = [u for u, c in events if c == "view" and t < u <= t + 6 * HOUR and u not in used]
                if later:
                    used.add(later[0])
                    want.add((s, t, later[0]))
    assert {tuple(r) for r in plans.QUERIES["J08_greedy_pairs"](spark, DATA).collect()} == want and want


def test_line_length_events(spark):
    rows = Tables(spark, DATA).signal.select("ch", "i", "v").collect()
    d = np.zeros((64, max(r.i for r in rows) + 1))
    for r in rows:
        d[r.ch - 1, r.i] = r.v
    n, length = 5, np.full(d.shape, np.nan)
    step = np.abs(np.diff(d, axis=1))
    for i in range(d.shape[1] - n):
        length[:, i] = step[:, i : i + n - 1].sum(1)
    x = np.sort(np.round(length[~np.isnan(length)], 6))
    at = min(max(len(x) * 0.995 + 0.5, 1), len(x))
    limit = x[int(at) - 1] + (x[min(int(at), len(x) - 1)] - x[int(at) - 1]) * (at - int(at))
    mask = (np.round(length, 6) >= limit).any(0)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(int), [0]])))
    merged = []
    for on, off in zip(edge[::2] + 3, edge[1::2] - 1 + 3):
        if merged and on - merged[-1][1] < 10:
            merged[-1][1] = off
        else:
            merged.append([on, off])
    want = [(a, b) for a, b in merged if b - a >= 2]
    assert sorted((r.on_i, r.off_i) for r in plans.QUERIES["D19_line_length_events"](spark, DATA).collect()) == want and want


def test_filters_and_peaks(spark):
    fs, t = 1000, np.arange(20000) / 1000
    x = np.sin(2 * np.pi * 8 * t) + np.sin(2 * np.pi * 40 * t)
    df = spark.createDataFrame(pd.DataFrame({"ch": 1, "i": np.arange(len(x)), "v": x})).withColumn("ch", F.col("ch").cast("int"))
    got = sp.band_passed(df, fs, 30, 50, block=5000).orderBy("i").toPandas()
    assert len(got) == len(x) and np.abs(got["v"] - np.sin(2 * np.pi * 40 * t)).iloc[500:-500].max() < 0.01
    assert abs(got["envelope"].iloc[1000:-1000] - 1).max() < 0.02
    y = np.zeros(3000)
    y[1000:1021] = np.concatenate([np.arange(11), np.arange(9, -1, -1)])
    peaks = sp.detected_peaks(spark.createDataFrame(pd.DataFrame({"ch": 1, "i": np.arange(3000), "v": y})).withColumn("ch", F.col("ch").cast("int")), "v", 3.0, 5, block=1005).collect()
    assert [(r.i, round(r.height, 6), round(r.half_width, 6), round(r.asymmetry, 6)) for r in peaks] == [(1010, 10.0, 10.0, 0.0)]
    assert find_peaks(np.array([0, 2, 2, 2, 0, 1, 0.0]), 0.5).tolist() == [2, 5]


def test_spectra_and_lags(spark):
    r, t = np.random.default_rng(0), np.arange(8192) / 1000
    a = np.sin(2 * np.pi * 50 * t) + 0.3 * r.normal(size=8192)
    df = spark.createDataFrame(pd.concat(pd.DataFrame({"ch": c, "i": np.arange(8192), "v": v}) for c, v in ((1, a), (2, np.roll(a, 7))))).withColumn("ch", F.col("ch").cast("int"))
    power = sp.mean_psd(df, 1000, 256).filter("ch = 1").orderBy(F.desc("power")).first()
    assert abs(power.hz - 50) < 4
    assert sp.cross_correlation(df, 1, 2, 20).orderBy(F.desc("r")).first().lag in (7, -13)
    coh = sp.coherence(df, 1, 2, 1000, 256).collect()
    assert all(0 <= x.coherence <= 1 + 1e-9 for x in coh) and max(coh, key=lambda x: x.coherence).coherence > 0.95


def test_inverse_source_density_recovers_its_sources(spark):
    truth = np.zeros(64)
    truth[20:25], truth[30:35] = 1.0, -1.0
    from cortexlake.operators.sources_density import inverse_source_density

    for method in ("delta", "step"):
        v = forward_matrix(64, method) @ truth
        df = spark.createDataFrame([(0, k + 1, float(x)) for k, x in enumerate(v)], "i long, ch int, v double")
        got = [r.csd for r in inverse_source_density(df, ["i"], 64, method).orderBy("ch").collect()]
        assert np.allclose(got, truth, atol=1e-6)


def test_template_fills_the_probe(spark):
    rows = plans.QUERIES["D36_golden_template"](spark, DATA).collect()
    assert sum(r.target for r in rows) == 64 and len(rows) == 10


def test_clusters_are_numbered_by_depth(spark):
    vectors = [(k, [float(5 * (j == (5 if k % 3 else 40))) + 0.01 * ((k * j) % 7) for j in range(64)]) for k in range(60)]
    from cortexlake.operators.clusters import pca_clusters

    got = {r.vec_id: r.k_type for r in pca_clusters(spark.createDataFrame(vectors, "vec_id long, e array<double>"), "vec_id", "e").collect()}
    assert {got[k] for k, _ in vectors if k % 3} == {1} and {got[k] for k, _ in vectors if k % 3 == 0} == {2}


def test_recordings_round_trip(spark, tmp_path):
    x = (np.arange(1300) % 200 - 100) * 0.01
    df = spark.createDataFrame(pd.DataFrame({"ch": 3, "i": np.arange(1300), "mv": x}))
    for r in rec.continuous_files(df, 32000, 1e-7).collect():
        (tmp_path / f"CSC{r.ch}.ncs").write_bytes(bytes(r.content))
    records = rec.read_continuous(spark, str(tmp_path))
    assert [(r.rec_no, r.ts_us, r.ch, r.fs, r.n_valid) for r in records.orderBy("rec_no").collect()] == [(0, 0, 3, 32000, 512), (1, 16000, 3, 32000, 512), (2, 32000, 3, 32000, 276)]
    back = rec.to_samples(records).orderBy("i").toPandas()
    assert len(back) == 1300 and np.abs(back["mv"] - x).max() < 1e-4
    assert rec.to_samples(records, drop_partial=True).count() == 1024
    e = np.zeros(2, rec.EVENT)
    e["ts"], e["ttl"] = [5, 9], [118, -1]
    (tmp_path / "Events.nev").write_bytes(bytes(rec.HEADER) + e.tobytes())
    assert [(r.ts_us, r.ttl) for r in rec.read_events(spark, str(tmp_path)).orderBy("ts_us").collect()] == [(5, 118), (9, -1)]
    (tmp_path / "p.txt").write_text("# no\nlfp_fs = 1000; # yes\nname = a b;\n")
    assert {tuple(r) for r in rec.read_parameters(spark, str(tmp_path / "p.txt")).collect()} == {("lfp_fs", "1000"), ("name", "a b")}


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    events.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = debounced_stream(stream, ["user_id", "event_type"], "ts", "24 hours", "1 hour").writeStream.format("memory").queryName("debounced").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.user_id, r.event_type, r.repeats) for r in spark.table("debounced").collect())
    batch = sorted((r.session, r.code, r.repeats) for r in plans.QUERIES["W02_debounce"](spark, DATA).collect())
    assert got == batch


def test_places_by_falling_value_with_ties(spark):
    rows = [(k, 3 if k % 3 else k % 7) for k in range(500)]
    got = stats.place_descending(spark.createDataFrame(rows, "id long, n long"), "n", "id").collect()
    want = {k: i + 1 for i, (k, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert {r.id: r.place for r in got} == want


def test_places_do_not_depend_on_the_order_in_which_rows_come(spark):
    """Rows come in a new order whenever they are read, as they do over a network; ids may be null."""
    import pyarrow as pa

    def shuffled(batches):
        for b in batches:
            yield b.take(pa.array(np.random.default_rng().permutation(len(b))))

    rows = spark.range(60_000, numPartitions=6).select(F.when(F.col("id") > 2, F.col("id")).alias("id"), F.lit(1).alias("n")).filter("id is not null")
    rows = rows.unionByName(spark.createDataFrame([(None, 1), (7, 2)], "id long, n int")).mapInArrow(shuffled, "id long, n int")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = stats.place_descending(rows, "n", "id").collect()
        middle = stats.quantile(rows.withColumn("v", F.col("id") * 1.0), ["n"], "v", 0.37).collect()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert sorted((r.place, r.id, r.n) for r in got if r.id) == [(1, 7, 2), *((k - 1, k, 1) for k in range(3, 60_000))] and [r.place for r in got if r.id is None] == [59_999]
    assert all(abs(r.p - {1: 3 + 0.37 * 59_996, 2: 7.0}[r.n]) < 1e-6 for r in middle) and len(middle) == 2
