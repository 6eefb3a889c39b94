"""Every query with SQL gives DuckDB's rows at sf0.01."""

import math
import os

import duckdb
import pytest

from tidewell.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, duck, name):
    df, sql = QUERIES[name](spark, SF), duck.sql(ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(sql.columns)
    order = [sql.columns.index(c) for c in df.columns]
    mine = sorted((tuple(plain(v) for v in r) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i]) for i in order) for r in sql.fetchall()), key=repr)
    assert mine == theirs


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
