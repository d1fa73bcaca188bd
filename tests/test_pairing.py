"""Greedy pairs in batch and on a stream against a plain loop; listings of any depth."""

import datetime
import random
from collections import defaultdict

import pandas as pd
from pyspark.sql import functions as F

from cortexlake.operators.listings import directories, tree
from cortexlake.operators.pairing import greedy_pairs
from cortexlake.streaming.timelines import paired_stream

START = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def plain(rows, within):
    by = defaultdict(list)
    for s, t, code in rows:
        by[s].append((t, code))
    out = []
    for s, events in by.items():
        seconds = sorted(t for t, c in events if c == "B")
        used = [False] * len(seconds)
        for t in sorted(t for t, c in events if c == "A"):
            for k, u in enumerate(seconds):
                if t < u <= t + within and not used[k]:
                    used[k] = True
                    out.append((s, t, u))
                    break
    return sorted(out)


def events(seed, n=3000):
    r = random.Random(seed)
    return [("hot" if r.random() < 0.7 else f"s{r.randrange(5)}", r.randrange(400_000) * 1000, r.choice("AAABBC")) for _ in range(n)]


def test_pairs_with_ties_and_a_session_that_holds_most_rows(spark):
    rows = events(1) + [(None, 5000, "A"), ("s1", None, "B")]
    df = spark.createDataFrame(rows, "s string, t long, code string").repartition(5)
    for within in (1500, 11_000, 2_000_000):
        got = sorted(map(tuple, greedy_pairs(df, "s", "t", F.col("code") == "A", F.col("code") == "B", within).collect()))
        assert got == plain([x for x in rows if None not in x], within) and got
    assert greedy_pairs(df.filter("false"), "s", "t", F.col("code") == "A", F.col("code") == "B", 5).count() == 0


def test_stream_of_shuffled_batches_gives_the_batch_result_and_keeps_no_state(spark, tmp_path):
    rows = sorted(events(2, 1200), key=lambda x: x[1])
    r, late = random.Random(3), 8_000_000
    batches = [rows[k : k + 150] for k in range(0, len(rows), 150)]
    to_frame = lambda part: spark.createDataFrame(pd.DataFrame([(s, START + datetime.timedelta(microseconds=t), c) for s, t, c in part], columns=["s", "ts", "code"])).coalesce(1)
    end = [("end", 10**9, "C"), ("end", 10**9 + 1, "A"), ("hot", 10**9, "A")]
    too_late = [("hot", 1000, "A"), ("hot", 2000, "B")]
    for k, part in enumerate([*batches, end, [("end", 2 * 10**9, "A")], too_late, [("end", 3 * 10**9, "A")]]):
        part = [*part]
        r.shuffle(part)
        to_frame(part).write.mode("append").parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema("s string, ts timestamp, code string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = paired_stream(stream, "s", "ts", F.col("code") == "A", F.col("code") == "B", 11_000_000, "400 seconds")
        q = out.writeStream.format("memory").queryName("pairs").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(240) and q.exception() is None
        got = sorted(map(tuple, spark.table("pairs").collect()))
        state = spark.read.format("statestore").option("stateVarName", "events").load(str(tmp_path / "c"))
        left = [x.key.session for x in state.collect()]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    micros = int(START.timestamp() * 10**6)
    assert got == sorted((s, micros + a, micros + b) for s, a, b in plain([x for x in rows if x[2] != "C"], 11_000_000)) and len(got) > 50
    assert set(left) <= {"end"} and late


def test_tree_and_directories_of_any_depth(spark):
    deep = "/".join(f"d{k}" for k in range(12))
    paths = [f"/{deep}/a.txt", f"{deep}/b.txt", "d0/x/c.txt", "top.txt", "", "//"]
    got = {r.name: (r.parent, r.depth, r.n_files) for r in tree(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert got["d0"] == (None, 1, 3) and got[deep] == ("/".join(deep.split("/")[:-1]), 12, 2) and got["top.txt"] == (None, 1, 1) and len(got) == 12 + 2 + 3
    found = directories(spark.createDataFrame([(p,) for p in paths], "path string"), "^(d1|x)", 3).collect()
    assert [tuple(r) for r in found] == [("d0/d1", 2), ("d0/x", 2)]
