"""Operators over literal inputs give what is stated beside them."""

import cases
import duckdb
import pytest
from test_queries import plain


@pytest.mark.parametrize("name", sorted(cases.QUERIES))
def test_case(spark, name):
    df, sql = cases.QUERIES[name](spark, ""), duckdb.sql(cases.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(sql.columns)
    mine = sorted((tuple(plain(v) for v in r) for r in df.collect()), key=repr)
    assert mine == sorted((tuple(plain(r[sql.columns.index(c)]) for c in df.columns) for r in sql.fetchall()), key=repr)
