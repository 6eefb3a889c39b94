"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.workspace import Workspace, shared_dir  # noqa: F401

#: Rows that a task turns into Python objects at a time; bounds its memory.
SLICE_ROWS = 512


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The named columns of the documents table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the column as text, modulo ``modulus``; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def map_slices(df: DataFrame, start: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over slices of at most :data:`SLICE_ROWS` rows.

    ``start`` runs once for each task and returns the function of one slice.
    """
    rows = SLICE_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = start()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield step(batch.slice(at, rows))

    return df.mapInArrow(run, schema)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that ``df`` has (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def quoted(df: DataFrame, *names: str) -> str:
    """Names and types as DDL."""
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def texts(column: pa.Array) -> list[str]:
    """Python strings; null is the empty text."""
    return [x or "" for x in column.to_pylist()]
