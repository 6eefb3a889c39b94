"""Semi-structured texts as variants: parsed once, shredded into columns, with a branch for what can't be parsed.

Defined cases: a null text is no failure and has no fields; a text that isn't JSON is a failure and keeps its raw form; a field
that is missing or doesn't fit its type is null; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shredded(df: DataFrame, column: str, fields: dict[str, tuple[str, str]], failed: str = "failed_text") -> DataFrame:
    """``df`` with a column for each of ``fields`` (name: (path, type)) of the JSON texts, and ``failed``: the text where it isn't JSON."""
    value = F.try_parse_json(F.col(f"`{column}`"))
    out = [F.try_variant_get(value, path, kind).alias(name) for name, (path, kind) in fields.items()]
    return df.select("*", *out, F.when(F.col(f"`{column}`").isNotNull() & value.isNull(), F.col(f"`{column}`")).alias(failed))


def schema_of(df: DataFrame, column: str, *by: str) -> DataFrame:
    """(by..., parsed, failed, schema): how many texts are JSON and how many aren't, and the type that holds all of them; partial types of tasks are merged."""
    text = F.col(f"`{column}`")
    value = F.try_parse_json(text)
    return df.groupBy(*by).agg(F.count(value).alias("parsed"), F.count_if(text.isNotNull() & value.isNull()).alias("failed"), F.schema_of_variant_agg(value).alias("schema"))
