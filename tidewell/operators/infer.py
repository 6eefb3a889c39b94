"""Types of columns from what their first values look like, and field definitions from types."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.content import EMAIL, bare_number, is_boolean, is_currency, is_date, is_email, is_number, is_phone
from tidewell.functions.strings import strip
from tidewell.operators.profile import first_values

SAMPLES, SHARE = 20, 0.8

#: Fixed values of the scored inference, in the order in which equal scores win.
SCORED = (
    ("Currency", (r"^\$?[0-9,]+\.?[0-9]{0,2}$", r"^INR\s*[0-9,]+\.?[0-9]{0,2}$", r"^[0-9,]+\.?[0-9]{0,2}\s*(USD|EUR|GBP|INR)$")),
    ("ID", (r"^[A-Z]{2,4}-[0-9]{4,}$", r"^[0-9]{8,}$", r"^[A-Z]+[0-9]+$")),
    ("Date", (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}", r"^[0-9]{2}/[0-9]{2}/[0-9]{4}", r"^[0-9]{2}-[0-9]{2}-[0-9]{4}")),
    ("Email", (r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",)),
    ("Phone", (r"^[+]?[1-9][0-9\s()-]{7,15}$",)),
)
#: Fixed values.
FIELD_TYPES = {"Currency": "Currency", "Date": "Date", "Email": "Data", "Phone": "Phone", "ID": "Data", "Float": "Float", "Text": "Data"}
SYSTEM_FIELDS = {"row_hash": "Data", "migration_source": "Data", "migration_batch": "Data", "last_import_date": "Datetime"}


def votes(values: DataFrame) -> DataFrame:
    """(column_name, field_type) of rows (column_name, value): a type needs four fifths of the values."""
    v = F.col("value")
    share = lambda p: F.avg(p.cast("double"))
    counted = values.groupBy("column_name").agg(
        F.max(is_currency(v)).alias("any_currency"),
        share(is_currency(v)).alias("currency"),
        share(is_number(v)).alias("number"),
        F.max(is_number(v) & bare_number(v).contains(".")).alias("any_point"),
        share(is_date(v)).alias("date"),
        share(is_email(v)).alias("email"),
        share(is_phone(v)).alias("phone"),
        share(is_boolean(v)).alias("boolean"),
        F.max(F.length(v)).alias("longest"),
    )
    kind = (
        F.when(F.col("currency") >= SHARE, "Currency")
        .when((F.col("number") >= SHARE) & F.col("any_point"), "Float")
        .when(F.col("number") >= SHARE, "Int")
        .when(F.col("date") >= SHARE, "Date")
        .when(F.col("email") >= SHARE, "Email")
        .when(F.col("phone") >= SHARE, "Phone")
        .when(F.col("boolean") >= SHARE, "Check")
        .when(F.col("longest") > 140, "Text")
        .otherwise("Data")
    )
    return counted.select("column_name", kind.alias("field_type"))


def infer_types(df: DataFrame, order: str, columns: list[str] | None = None) -> DataFrame:
    """(column_name, field_type) by the vote of the first filled values by ``order``; columns without any are Data."""
    columns = columns or [c for c in df.columns if c != order]
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "n string")
    voted = votes(first_values(df, order, columns, SAMPLES))
    return names.join(voted, F.col("n") == F.col("column_name"), "left").select(F.col("n").alias("column_name"), F.coalesce("field_type", F.lit("Data")).alias("field_type"))


def pattern_scores(values: DataFrame) -> DataFrame:
    """(column_name, and a share for each kind) of rows (column_name, value): the best pattern's share."""
    v = strip(F.col("value"))
    share = lambda p: F.avg(p.cast("double"))
    scores = [F.greatest(F.lit(0.0), *[share(v.rlike(p)) for p in patterns]).alias(kind) for kind, patterns in SCORED]
    number = F.regexp_replace(v, ",", "").rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    return values.groupBy("column_name").agg(*scores, share(number).alias("Float"), F.lit(0.3).alias("Text"))


def scored_types(values: DataFrame) -> DataFrame:
    """(column_name, detected, field_type, confidence): the kind with the highest score, the first of equals."""
    scored = pattern_scores(values)
    kinds = [*[k for k, _ in SCORED], "Float", "Text"]
    best = F.greatest(*kinds)
    detected = F
    for k in kinds:
        detected = detected.when(F.col(k) == best, F.lit(k))
    kind = F.create_map(*[F.lit(x) for pair in FIELD_TYPES.items() for x in pair])
    return scored.select("column_name", detected.alias("detected"), best.alias("confidence")).withColumn("field_type", kind[F.col("detected")])


def value_type(value: str) -> str:
    """Of a single value, number first."""
    x = value.strip()
    if re.match(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$", x):
        return "Float" if "." in x else "Int"
    if re.match(r"\d{4}-\d{2}-\d{2}|\d{1,2}[/-]\d{1,2}[/-]\d{4}|\d{4}/\d{2}/\d{2}", x):
        return "Date"
    if re.match(r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$", x):
        return "Email"
    if x.lower() in ("true", "false", "yes", "no", "y", "n", "on", "off"):
        return "Check"
    return "Text" if len(x) > 140 else "Data"


def value_type_column(c: Column) -> Column:
    """The same of a column."""
    x = strip(c)
    return (
        F.when(x.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), F.when(x.contains("."), "Float").otherwise("Int"))
        .when(x.rlike(r"^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{4}|[0-9]{4}/[0-9]{2}/[0-9]{2})"), "Date")
        .when(x.rlike(EMAIL), "Email")
        .when(F.lower(x).isin("true", "false", "yes", "no", "y", "n", "on", "off"), "Check")
        .when(F.length(x) > 140, "Text")
        .otherwise("Data")
    )


def record_structure(rows: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """(key, field, value, field_type, is_empty): the fields of each record; values are cut after 100 characters."""
    columns = columns or [c for c in rows.columns if c != key]
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias("value")) for c in columns])
    return rows.select(key, F.inline(fields)).select(key, "field", F.substring("value", 1, 100).alias("value"), value_type_column(F.col("value")).alias("field_type"), (strip(F.col("value")) == "").alias("is_empty"))


def field_definition(header: str, kind: str, longest: int, by_name: bool = True) -> tuple[str, int | None]:
    """(field type, length): text types by length, then by words in the header (``by_name``)."""
    length: int | None = None
    if kind == "Data":
        kind, length = ("Long Text", None) if longest > 255 else ("Text", None) if longest > 140 else ("Data", max(30, min(longest + 10, 140)))
    elif kind == "Text":
        kind = "Long Text"
    if by_name:
        low = header.lower()
        for words, named in ((("id",), ("Data", 140)), (("email",), ("Data", 140)), (("phone", "mobile"), ("Data", 20)), (("description", "details", "notes"), ("Long Text", None)), (("address",), ("Long Text", None))):
            if any(w in low for w in words):
                return named
    return kind, length


def unique_field(rows: list[tuple[str, int, int]]) -> str | None:
    """Of (header, different values, rows) the first identifier-like header whose values are mostly different."""
    return next((h for h, k, n in rows if n and k / n > 0.8 and any(w in h.lower() for w in ("id", "code", "reference", "key"))), None)


def table_fields(definitions: dict[str, tuple[str, int | None]], most_data: int = 30) -> dict[str, tuple[str, int | None]]:
    """Definitions with the system fields; Data fields beyond ``most_data`` become Long Text."""
    out, n = {}, 0
    for h, (kind, length) in definitions.items():
        n += kind == "Data"
        out[h] = ("Long Text", None) if kind == "Data" and n > most_data else (kind, length)
    return out | {h: (k, 140 if k == "Data" else None) for h, k in SYSTEM_FIELDS.items()}


def narrow_fields(headers: list[str], matched: int = 15, most: int = 20) -> dict[str, tuple[str, int | None]]:
    """A fallback table: headers with telling words first, all Long Text."""
    telling = [h for h in headers if any(w in h.lower() for w in ("id", "name", "code", "email", "phone", "date", "amount", "price", "status", "type"))][:matched]
    return {h: ("Long Text", None) for h in [*telling, *[h for h in headers if h not in telling]][:most]}
