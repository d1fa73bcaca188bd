"""Windows cut from blocks of the recording: odd tables against the SQL, and what is shuffled."""

import math

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from cortexlake import plans

DATA = "/root/testdata/sf0.001"
SHARED = ["D24_whole_snippets", "D31_window_means", "J12_event_windows", "R31_strict_windows", "A10_window_averages"]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Ids below 0, at block borders, twice, null and far apart; null, short and empty vectors; null components."""
    ids = [*range(-30, 40), *range(1000, 1100), *range(2040, 2060), 5, 5, 1024, 900_000, None]
    vectors = []
    for k in range(len(ids)):
        v = [math.sin(k * 7 + j) * 3.2 for j in range(6)]
        if k % 17 == 3:
            v[k % 6] = None
        vectors.append(None if k % 41 == 40 else [] if k % 53 == 50 else v[: 3 + k % 4] if k % 11 == 5 else v)
    where = tmp_path_factory.mktemp("odd")
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([k % 10 for k in range(len(ids))], pa.int32())}), f"{where}/embeddings.parquet")
    return str(where)


@pytest.mark.parametrize("name", SHARED)
def test_odd_tables_give_what_the_sql_gives(spark, odd, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS FROM '{odd}/embeddings.parquet'")
    want = con.sql(plans.SQL[name])
    got = plans.QUERIES[name](spark, odd)
    assert want.columns == got.columns
    key = lambda r: [(x is None, x or 0) for x in r]
    a, b = sorted(map(tuple, want.fetchall()), key=key), sorted(map(tuple, got.collect()), key=key)
    assert len(a) == len(b) > 0
    assert all(x == y or x is not None and y is not None and math.isclose(x, y, abs_tol=2e-5) for r, s in zip(a, b) for x, y in zip(r, s))


@pytest.mark.parametrize("name", SHARED)
def test_samples_are_shuffled_whole(spark, name):
    """No row for each channel of a sample is made before the windows are cut."""
    plan = plans.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan and "FlatMapCoGroupsInArrow" in plan
