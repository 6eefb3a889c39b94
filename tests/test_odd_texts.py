"""Hashes of documents equal SQL's also where texts or languages are null, blank or end in separators."""

import duckdb
import pytest

from tidewell.functions.strings import strip
from tidewell.queries import ORACLE_SQL, QUERIES

TEXTS = (None, "", " \n\t", "a", " a\x0b", "a \u2028", "a  \u2029", "a\t\x85", "a \r\n", "a\nb ", "\u2028 a", "\xa0a")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    rows = [(t, lang) for t in TEXTS for lang in (None, "", " ", "en", " en")] * 2
    spark.createDataFrame([(i, t, lang, "s", 0) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", ["content_hash_documents", "dup_content_documents", "backfilled_hashes_of_documents"])
def test_hashes_of_odd_texts(spark, odd, name):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{odd}/documents.parquet/*.parquet'")
    sql = c.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, odd).select(*sql.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(sql.fetchall(), key=repr)


def test_strip_leaves_separators(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    assert [r[0] for r in df.select(strip("t")).collect()] == [t and t.strip(" \t\n\r\f\x0b") for t in TEXTS]
