"""Row validation with readable messages, and existence of linked records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.content import EMAIL, converted
from tidewell.functions.strings import blank, strip
from tidewell.operators.identity import Field

MESSAGE_CHARS = 1000


def messages(fields: list[Field], legacy: bool = True, truthy_required: bool = True, zero: bool | None = None) -> Column:
    """Array of messages of a row of raw strings; with ``truthy_required`` a value of 0 counts as missing."""
    tests = []
    for f in fields:
        raw = F.col(f"`{f.name}`")
        there = ~blank(raw)
        if f.required:
            missing = ~there
            if truthy_required and f.kind in ("Int", "Float", "Currency"):
                missing = missing | F.coalesce(converted(raw, f.kind, legacy=legacy, zero=zero) == 0, F.lit(False))
            tests.append(F.when(missing, F.lit(f"Missing required field: {f.name}")))
        if f.kind == "Email":
            tests.append(F.when(there & ~strip(raw).rlike(EMAIL), F.concat(F.lit(f"Invalid email in {f.name}: "), strip(raw))))
        if f.kind == "Phone":
            tests.append(F.when(there & (F.length(F.regexp_replace(raw, "[^0-9]", "")) < 10), F.concat(F.lit(f"Invalid phone in {f.name}: "), strip(raw))))
        if f.kind in ("Int", "Float", "Currency", "Date", "Datetime"):
            word = {"Int": "integer", "Date": "date", "Datetime": "date"}.get(f.kind, "float")
            tests.append(F.when(there & converted(raw, f.kind, legacy=legacy, zero=zero).isNull(), F.concat(F.lit(f"Invalid {word} in {f.name}: "), strip(raw))))
        if f.length and f.kind == "Data":
            tests.append(F.when(F.length(strip(raw)) > f.length, F.lit(f"Value of {f.name} is longer than {f.length}")))
    return F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")


def missing_links(rows: DataFrame, key: str, field: str, parent: DataFrame, parent_key: str = "name") -> DataFrame:
    """The rows whose (filled) link has no parent."""
    known = parent.select(strip(F.col(parent_key).cast("string")).alias("_p")).distinct()
    return rows.filter(~blank(F.col(field).cast("string"))).join(known, strip(F.col(field).cast("string")) == F.col("_p"), "left_anti")


def validate(rows: DataFrame, fields: list[Field], parents: dict[str, DataFrame] | None = None, legacy: bool = True, zero: bool | None = None) -> DataFrame:
    """``rows`` with ``errors`` (array) and ``error_log`` (joined, cut)."""
    out = rows.withColumn("errors", messages(fields, legacy, zero=zero))
    for f in fields:
        if f.link and parents and f.link in parents:
            known = parents[f.link].select(strip(F.col("name").cast("string")).alias("_p")).distinct()
            out = out.join(known, strip(F.col(f"`{f.name}`")) == F.col("_p"), "left")
            lost = F.when(~blank(F.col(f"`{f.name}`")) & F.col("_p").isNull(), F.lit(f"{f.link} in {f.name} doesn't exist"))
            out = out.withColumn("errors", F.array_compact(F.array_append("errors", lost))).drop("_p")
    return out.withColumn("error_log", F.substring(F.array_join("errors", "; "), 1, MESSAGE_CHARS))
