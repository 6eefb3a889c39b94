"""Spreadsheets: the first sheet as strings.  Needs an Excel reader of pandas (openpyxl or xlrd) on the executors."""

from __future__ import annotations

import io

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.messages import ImportFailure


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_strings``; a sheet is parsed whole by one task."""
    try:
        import openpyxl  # noqa: F401
    except ImportError:
        raise ImportFailure("excel files need the package openpyxl") from None
    from tidewell.sources.delimited import unique

    def parse(content: bytes) -> pd.DataFrame:
        return pd.read_excel(io.BytesIO(content), dtype=str, keep_default_na=False)

    files = spark.read.format("binaryFile").load(path).select("content")

    def names(batches):
        for batch in batches:
            for content in batch["content"]:
                yield pd.DataFrame({"h": [str(c).strip() for c in parse(content).columns]})

    columns = unique([r["h"] for r in files.mapInPandas(names, "h string").collect()])  # headers of one sheet

    def rows(batches):
        for batch in batches:
            for content in batch["content"]:
                table = parse(content).fillna("").astype(str)
                table.columns = columns
                table = table.assign(_row_index=range(len(table)))
                yield table[(table[columns] != "").any(axis=1)]

    return files.mapInPandas(rows, ", ".join(f"`{c}` string" for c in columns) + ", _row_index long").withColumn("_source_file", F.lit(path))
