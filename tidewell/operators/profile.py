"""Column profiles: one pass over the rows for all columns, then one row for each column.

A task keeps for each column its counts, its least and greatest value, the hashes of its different
values and its first values; what tasks give is written, so the rows are read once whatever is asked, and no row is copied for
each column.  Different values are counted by 64-bit hashes.  Where a count only decides between scores, sketches of
fixed size do (:func:`sketches`, kept by parts of a table and merged); only columns whose score a sketch leaves open are counted.

Defined cases: null and '' are empty; a column without a filled value has no least, greatest or first
value; values at equal places come in any order; a table without rows gives zeros.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.content import is_currency, is_email, is_phone
from tidewell.workspace import Workspace

#: Hashes that a task holds before it gives them, and gives at a time; groups in which first values are merged before they meet.
HELD, GIVEN, SALTS = 1 << 20, 1 << 16, 256
#: Size of a sketch (2 ** LG values), and the relative error that its estimate stays within (four standard errors).
LG = 14
ERROR = 4 * 1.04 / 2 ** (LG / 2)


def _text(c: str) -> Column:
    return F.col(f"`{c}`").cast("string")


def _full(c: str) -> Column:
    return F.when(_text(c) != "", _text(c))


def summaries(df: DataFrame, columns: list[str], order: str | None = None, n: int = 0) -> DataFrame:
    """column_name, total_rows, non_empty_rows, unique_values, min_value, max_value, max_length and, with ``order``, the ``n`` first filled values as (position, value)."""
    values = [c for i, name in enumerate(columns) for c in (_text(name).alias(f"v{i}"), F.xxhash64(_text(name)).alias(f"h{i}"))]
    rows = df.select(F.spark_partition_id().alias("salt"), (F.col(order) if order else F.lit(0)).alias("o"), *values)
    kind = rows.schema["o"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, told = [[] for _ in columns], [[0, None, None, 0] for _ in columns]
        held, limit = 0, HELD
        first: list = [None] * len(columns)
        total, salt, o_type = 0, 0, pa.int32()

        def thinned() -> int:
            """Every hash once, as packed numbers; how many there are."""
            for i, x in enumerate(hashes):
                hashes[i] = [np.unique(np.concatenate(x))] if x else []
            return sum(len(x) for h in hashes for x in h)

        def given() -> Iterator[pa.RecordBatch]:
            thinned()
            c = np.concatenate([np.full(len(x), i, np.int32) for i, h in enumerate(hashes) for x in h] or [np.zeros(0, np.int32)])
            h = np.concatenate([x for h in hashes for x in h] or [np.zeros(0, np.int64)])
            for x in hashes:
                x.clear()
            names = ["c", "h", "salt", "total", "filled", "lo", "hi", "longest", "first"]
            for at in range(0, len(c), GIVEN):
                k = len(c[at : at + GIVEN])
                blank = [pa.nulls(k, t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.struct([("position", o_type), ("value", pa.string())])))]
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + GIVEN]), pa.array(h[at : at + GIVEN]), *blank], names)

        for batch in batches:
            total, o_type = total + batch.num_rows, batch.column(1).type
            if batch.num_rows:
                salt = batch.column(0)[0].as_py() % SALTS
            for i, t in enumerate(told):
                v = batch.column(2 + 2 * i)
                full = pc.fill_null(pc.not_equal(v, ""), False)
                v = v.filter(full)
                if not len(v):
                    continue
                hashes[i].append(pc.unique(batch.column(3 + 2 * i).filter(full)).to_numpy())
                held += len(hashes[i][-1])
                ends = pc.min_max(v).as_py()
                t[0] += len(v)
                t[1] = ends["min"] if t[1] is None else min(t[1], ends["min"], key=str.encode)
                t[2] = ends["max"] if t[2] is None else max(t[2], ends["max"], key=str.encode)
                t[3] = max(t[3], pc.max(pc.utf8_length(v)).as_py())
                if n:
                    some = pa.table({"position": batch.column(1).filter(full), "value": v})
                    some = pa.concat_tables([first[i], some]) if first[i] is not None else some
                    first[i] = some.take(pc.select_k_unstable(some, n, [("position", "ascending")]))
            if held >= limit:
                held = thinned()
                if held >= HELD:
                    yield from given()
                    held = 0
                limit = max(HELD, 2 * held)
        yield from given()
        firsts = pa.array([None if t is None else t.to_pylist() for t in first], pa.list_(pa.struct([("position", o_type), ("value", pa.string())])))
        k = len(columns)
        stats = [pa.array(range(k), pa.int32()), pa.nulls(k, pa.int64()), pa.array([salt] * k, pa.int32()), pa.array([total] * k, pa.int64()), pa.array([t[0] for t in told], pa.int64()), *[pa.array([t[j] for t in told], pa.string()) for j in (1, 2)], pa.array([t[3] for t in told], pa.int64()), firsts]
        yield pa.RecordBatch.from_arrays(stats, ["c", "h", "salt", "total", "filled", "lo", "hi", "longest", "first"])

    schema = f"c int, h long, salt int, total long, filled long, lo string, hi string, longest long, first array<struct<position: {kind}, value: string>>"
    told = Workspace(df.sparkSession, "profile").write(rows.mapInArrow(run, schema), "told")
    different = told.filter("h is not null").select("c", "h").distinct().groupBy(F.col("c").alias("d")).agg(F.count("*").alias("unique_values"))

    def merged(by: DataFrame, *keys: str) -> DataFrame:
        some = F.slice(F.array_sort(F.flatten(F.collect_list("first"))), 1, n) if n else F.first("first")
        return by.groupBy(*keys).agg(F.sum("total").alias("total"), F.sum("filled").alias("filled"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("longest").alias("longest"), some.alias("first"))

    one = merged(merged(told.filter("h is null"), "c", "salt"), "c")
    names = df.sparkSession.createDataFrame(list(enumerate(columns)), "n int, column_name string")
    out = names.join(one, F.col("n") == F.col("c"), "left").join(different, F.col("n") == F.col("d"), "left")
    zero = F.lit(0).cast("bigint")
    return out.select("column_name", F.coalesce("total", zero).alias("total_rows"), F.coalesce("filled", zero).alias("non_empty_rows"), F.coalesce("unique_values", zero).alias("unique_values"), F.col("lo").alias("min_value"), F.col("hi").alias("max_value"), F.coalesce("longest", zero).alias("max_length"), "first")


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows, filled and empty values, different values, least and greatest value as samples, longest value, completeness."""
    out = summaries(df, columns or df.columns)
    share = F.when(F.col("total_rows") > 0, F.col("non_empty_rows") * 100.0 / F.col("total_rows")).otherwise(0.0)
    return out.select("column_name", "total_rows", "non_empty_rows", (F.col("total_rows") - F.col("non_empty_rows")).alias("empty_rows"), "unique_values", "min_value", "max_value", "max_length", F.format_string("%.1f%%", share).alias("completeness"))


def uniqueness(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Different filled values, filled values, their ratio and its score."""
    out = summaries(df, columns or df.columns).select("column_name", "total_rows", "non_empty_rows", "unique_values")
    ratio = F.coalesce(F.col("unique_values") / F.nullif(F.col("non_empty_rows"), F.lit(0)), F.lit(0.0))
    return out.withColumn("uniqueness_ratio", F.round(ratio, 6)).withColumn("score", uniqueness_score(ratio, F.col("non_empty_rows")))


def uniqueness_score(ratio: Column, filled_rows: Column) -> Column:
    return F.when(filled_rows == 0, 0).when(ratio >= 0.98, 90).when(ratio >= 0.90, 70).when(ratio >= 0.75, 40).when(ratio < 0.30, -50).otherwise(20)


def sketches(df: DataFrame, columns: list[str], part: Column | None = None) -> DataFrame:
    """(part, column_name, non_empty_rows, sketch): mergeable sketches of the filled values of each part of a table, in one aggregate."""
    one = df.groupBy((F.lit("") if part is None else part).alias("part")).agg(*[F.struct(F.lit(c).alias("column_name"), F.count(_full(c)).alias("non_empty_rows"), F.hll_sketch_agg(_full(c), LG).alias("sketch")).alias(f"m{i}") for i, c in enumerate(columns)])
    return one.select("part", F.inline(F.array(*[f"m{i}" for i in range(len(columns))])))


def estimated_scores(kept: DataFrame) -> DataFrame:
    """(column_name, non_empty_rows, score) of sketches of all parts; a null score is one that the sketch leaves open."""
    merged = kept.groupBy("column_name").agg(F.sum("non_empty_rows").alias("non_empty_rows"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("about"))
    filled = F.col("non_empty_rows")
    low, high = (uniqueness_score(F.coalesce(F.col("about") * x / F.nullif(filled, F.lit(0)), F.lit(0.0)), filled) for x in (1 / (1 + ERROR), 1 / (1 - ERROR)))
    return merged.select("column_name", "non_empty_rows", F.when(low == high, low).alias("score"))


def counted_score(df: DataFrame, column: str) -> int:
    """The score of one column, counted."""
    full = _full(column)
    ratio = F.coalesce(F.count_distinct(full) / F.nullif(F.count(full), F.lit(0)), F.lit(0.0))
    return df.agg(uniqueness_score(ratio, F.count(full)).alias("score")).first()["score"]


def structure(df: DataFrame, order: str, columns: list[str] | None = None, samples: int = 20) -> DataFrame:
    """Nulls, different values (an empty one counts), and flags and lengths over the first ``samples`` filled values by ``order``."""
    columns = columns or [c for c in df.columns if c != order]
    out, empty = summaries(df, columns, order, samples), F.col("total_rows") - F.col("non_empty_rows")
    values = F.coalesce(F.transform("first", lambda x: x["value"]), F.array().cast("array<string>"))
    found = out.select("column_name", empty.alias("null_count"), (F.col("unique_values") + (empty > 0).cast("int")).alias("unique_count"), values.alias("s"))

    def any_of(test) -> Column:
        return F.when(F.size("s") > 0, F.exists("s", test))

    return found.select("column_name", "null_count", "unique_count", F.array_max(F.transform("s", F.length)).cast("bigint").alias("sample_max_length"), any_of(is_currency).alias("any_currency"), any_of(is_phone).alias("any_phone"), any_of(is_email).alias("any_email"), F.when(F.size("s") > 0, F.slice("s", 1, 5)).alias("samples"))


def first_values(df: DataFrame, order: str, columns: list[str], n: int = 20) -> DataFrame:
    """(column_name, position, value): the first ``n`` filled values of each column by ``order``, of all columns in one pass."""
    return summaries(df, columns, order, n).select("column_name", F.inline("first"))
