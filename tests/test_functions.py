"""Expressions against expectations that were worked out by hand."""

import hashlib

import pytest
from pyspark.sql import functions as F

from tidewell.functions import content, hashing, messages, naming, strings


def values(spark, column, inputs):
    rows = [(i, x) for i, x in enumerate(inputs)]
    df = spark.createDataFrame(rows, "i int, v string")
    return [r["o"] for r in df.select("i", column(F.col("v")).alias("o")).orderBy("i").collect()]


def test_numbers(spark):
    inputs = ["$1,234.50", "12.5", "(500)", "50%", "1e5", "abc", "1-2", " ", None, "-7", "."]
    assert values(spark, content.to_number, inputs) == [1234.5, 12.5, 500.0, 50.0, 15.0, 0.0, None, None, None, -7.0, None]
    assert values(spark, lambda c: content.to_number(c, legacy=False), ["abc"]) == [None]
    assert values(spark, lambda c: content.to_number(c, paren_negative=True), ["(500)"]) == [-500.0]
    assert values(spark, content.to_integer, ["12.5", "1_000", "x", "", "5-"]) == [125, 1000, 0, None, None]
    assert values(spark, lambda c: content.to_integer(c, legacy=False), ["12.5", "12"]) == [None, 12]


def test_predicates(spark):
    assert values(spark, content.is_number, ["$ 1,000", "(12)", "5%", "1e5", "abc", "1-2", "nan"]) == [True, True, True, True, False, False, False]
    assert values(spark, content.is_currency, ["$5", "INR 5", "5 USD", "€1"]) == [True, True, False, True]
    assert values(spark, content.is_date, ["2024-01-02x", "1/2/2024", "2024/1/2", "01-02-2024"]) == [True, True, False, True]
    assert values(spark, content.is_email, ["a@b.co", "a@b", "x y@b.co"]) == [True, False, False]
    assert values(spark, content.is_phone, ["+1234567890", "123 456 7890", "12345", "(123) 4567890"]) == [True, True, False, True]
    assert values(spark, content.is_boolean, ["Yes", "0", "inactive", "maybe"]) == [True, True, True, False]


def test_dates(spark):
    inputs = ["2024-03-05", "03/05/2024", "3-5-2024", "2024/03/05", "2024-03-05 10:00:00", "soon", ""]
    assert [str(d) if d else None for d in values(spark, content.to_date, inputs)] == ["2024-03-05"] * 5 + [None, None]
    assert str(values(spark, lambda c: content.to_date(c, day_first=True), ["03/05/2024"])[0]) == "2024-05-03"


def test_strings(spark):
    assert values(spark, strings.strip, [" a\t\n", "b c"]) == ["a", "b c"]
    assert values(spark, strings.blank, [" ", None, "x"]) == [True, True, False]
    assert values(spark, strings.null_or_empty, [" ", None, ""]) == [False, True, True]
    assert values(spark, lambda c: strings.truthy(c), ["", "0"]) == [None, "0"]


@pytest.mark.parametrize(("x", "want"), [("2nd Col", "field_2nd_col"), ("class", "class_field"), ("name", "custom_name"), ("x", "field_x"), ("A--B", "a_b"), ("", "field"), ("É", "field")])
def test_field_names(spark, x, want):
    assert naming.field_name(x) == want
    assert values(spark, naming.field_name_column, [x]) == [want]


def test_cleaners_differ(spark):
    x = " E-Mail (Work) "
    assert (naming.snake(x), naming.identifier(x), naming.plain(x)) == ("e_mail_work", "e_mail_work", "_e_mail_(work)_")
    for f, c in ((naming.snake, naming.snake_column), (naming.identifier, naming.identifier_column), (naming.plain, naming.plain_column)):
        assert values(spark, c, [x]) == [f(x)]
    assert naming.label("first_name-x") == "First Name X"


def test_table_names():
    assert naming.table_name("/in/customer_data.csv") == "Customer"
    assert naming.table_name("vendors.csv", ("Supplier",)) == "Supplier"
    assert naming.table_name("vendors.csv") == "Vendors"
    assert naming.table_name("2024_orders_final.csv") == "Import 2024 Orders"
    assert naming.table_name("__.csv") == "Custom Import Data"
    assert naming.table_name_errors("Good Name") == [] and naming.table_name_errors("1x") and naming.table_name_errors("select")


def test_record_names(spark):
    got = values(spark, lambda c: naming.record_name(c, "Customer", F.lit("new")), ["1234567890", "A 1/2", "", "12345678"])
    assert got == ["CUST-34567890", "A12", "new", "12345678"]
    assert naming.naming_score("Item Code") == 100 and naming.naming_score("email") == 95 and naming.naming_score("zzz") == 0


def test_headers_and_files():
    assert naming.normal_headers(["﻿E-Mail", " Email ", "cust_id"]) == ["email", "email_2", "customer_id"]
    assert naming.file_name("/a/b<c>.csv") == "b_c_.csv" and len(naming.file_name("x" * 300 + ".csv")) <= 255


def test_row_hash(spark):
    df = spark.createDataFrame([(0, " a ", "", None), (1, "a", "b", None)], "n int, y string, x string, z string")
    got = [tuple(r) for r in df.select(hashing.row_hash(["y", "x", "z"]), hashing.row_hash(["y", "x", "z"], F.col("n"))).collect()]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()[:16]
    assert got == [(sha("y:a"), sha("ROW_0|y:a")), (sha("x:b|y:a"), sha("ROW_1|x:b|y:a"))]
    assert hashing.schema_fingerprint([" B", "a "]) == hashlib.md5(b"a|b").hexdigest()
    assert hashing.schema_fingerprint(["B", "a"], {"a": "int"}) == hashlib.md5(b"a|b||a:int|b:string").hexdigest()


def test_messages(spark):
    assert values(spark, messages.error_category, ["Permission denied", "bad URL", "Missing x", "?"]) == ["security", "network", "validation", "system"]
    assert values(spark, messages.business_context, ["Client Name", "sku of item", "zip"]) == ["Customer", "Item", "General"]
    e = messages.ImportFailure("the csv is bad")
    assert (e.category, e.severity) == ("file_processing", "medium")


def test_variants(spark):
    from tidewell.functions import variants

    df = spark.createDataFrame([(1, '{"a": 1, "b": [true]}'), (2, '{"a": "x"}'), (3, "{"), (4, None), (5, "")], "i int, t string")
    got = {r["i"]: tuple(r)[2:] for r in variants.shredded(df, "t", {"a": ("$.a", "bigint"), "b": ("$.b[0]", "boolean")}).collect()}
    assert got == {1: (1, True, None), 2: (None, None, None), 3: (None, None, "{"), 4: (None, None, None), 5: (None, None, "")}
    assert tuple(variants.schema_of(df, "t").first()) == (2, 2, "OBJECT<a: VARIANT, b: ARRAY<BOOLEAN>>")
    assert variants.schema_of(df.limit(0), "t").first()["parsed"] == 0
