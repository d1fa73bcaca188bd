"""Every query with SQL must give the same rows as DuckDB; the others are held against plain Python elsewhere."""

import math
import os

import duckdb
import pytest

from cortexlake import plans

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in TABLES:
        c.sql(f"CREATE VIEW {name} AS FROM '{DATA}/{name}.parquet'")
    return c


def cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    return float(x) if type(x).__name__ == "Decimal" else x


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted((tuple(cell(v[k]) for k in order) for v in values), key=str)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, con, name):
    want = con.sql(plans.SQL[name])
    got = plans.QUERIES[name](spark, DATA)
    expected, found = rows(want.columns, want.fetchall()), rows(got.columns, got.collect())
    assert found[0] == expected[0]
    assert len(found[1]) == len(expected[1])
    assert all(a == b or all(x == y or isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-6) for x, y in zip(a, b)) for a, b in zip(found[1], expected[1])), [(a, b) for a, b in zip(found[1], expected[1]) if a != b][:5]
