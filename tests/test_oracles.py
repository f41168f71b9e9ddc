"""Every query with SQL beside it gives DuckDB's rows at the smallest scale."""

import math
import os

import pytest

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")

from pedalspark.plans import registry  # noqa: E402


def norm(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "None"
    return repr(round(x, 9) + 0.0) if isinstance(x, float) else str(x)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    result = con.execute(registry.ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == cols
    theirs = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in result.fetchall())
    assert sorted(tuple(norm(r[c]) for c in cols) for r in df.collect()) == theirs


def test_entry_works(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
