"""Delimited files as plain strings.

The encoding is UTF-8 where the bytes are valid, else Latin-1, which never fails.
Rows with too many fields are dropped, short ones filled with empty texts; rows
with nothing but empty fields go after rows were numbered, so numbers have gaps.

One file is read by as many tasks as it has splits, though a split may begin within quotes: a first
pass says for each split what becomes of either starting state (within quotes or not), a prefix scan over
one row a split settles which holds and the number of its first row, and a second pass gives the rows.  Rows
that reach over a split's end are put together from their pieces.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.messages import ImportFailure

SUFFIXES = (".csv", ".xlsx", ".xls")


def encoding(spark: SparkSession, path: str) -> str:
    """Of one file of any size: lines come as raw bytes and are checked by tasks, none is read on the driver."""
    lines = spark.read.text(path).select(F.expr("is_valid_utf8(value)").alias("ok"))
    return "UTF-8" if lines.agg(F.coalesce(F.min(F.col("ok").cast("int")), F.lit(1))).first()[0] else "ISO-8859-1"


def headers(spark: SparkSession, path: str, enc: str = "UTF-8", sep: str = ",") -> list[str]:
    return [h.strip().lstrip("﻿") for h in spark.read.option("header", True).option("encoding", enc).option("sep", sep).csv(path).limit(0).columns]


def end_of_line(line: bytes, inside: bool, sep: bytes) -> tuple[bool, int]:
    """(whether the line ends within quotes, its separators outside of them), if it begins within quotes or not.

    A quote opens a field only at its beginning; two in a row stand for one; what follows a closing quote up to the separator is text.
    """
    at, found, fresh = 0, 0, not inside  # fresh: a field begins here
    while True:
        if fresh and line[at : at + 1] == b'"':
            inside, at = True, at + 1
        fresh = False
        if inside:
            q = line.find(b'"', at)
            if q < 0:
                return True, found
            if line[q + 1 : q + 2] == b'"':
                at = q + 2
                continue
            inside, at = False, q + 1
        c = line.find(sep, at)
        if c < 0:
            return False, found
        at, found, fresh = c + len(sep), found + 1, True


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(block, line, valid): lines come in order within a split, and belong to the split in which they begin."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"), F.expr("is_valid_utf8(value)").alias("valid"))


def _runs(batch: pa.RecordBatch, sep: bytes) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray, bool]]:
    """(block, first line, end, separators, blanks, whether there is a quote): lines without a quote together, others alone."""
    blocks, column = batch.column(0).to_numpy(), batch.column(1)
    quote = pc.match_substring(column, b'"').to_numpy(zero_copy_only=False)
    separators, length = pc.count_substring(column, sep).to_numpy(), pc.binary_length(column).to_numpy()
    blank = length == 0
    for i in np.flatnonzero(length == 1).tolist():
        blank[i] = column[i].as_py() == b"\r"
    cuts = np.unique(np.concatenate([[0, len(blocks)], np.flatnonzero(quote), np.flatnonzero(quote) + 1, np.flatnonzero(np.diff(blocks)) + 1])).tolist()
    for a, b in itertools.pairwise(cuts):
        yield int(blocks[a]), a, b, separators[a:b], blank[a:b], bool(quote[a])


class _Course:
    """What a split's lines make of one starting state."""

    def __init__(self, inside: bool, width: int):
        self.inside, self.width, self.rows = inside, width, 0
        self.own = not inside  # whether the row that is open, or the next one, begins in this split
        self.open = 0  # separators of the open row
        self.head: int | None = None  # separators of the piece that ends a row of an earlier split

    def plain(self, separators: np.ndarray, blank: np.ndarray) -> np.ndarray | None:
        """Lines without a quote: which of them are rows; None if they are all within quotes."""
        if self.inside:
            return None
        ok = (separators < self.width) & ~blank
        self.rows += int(ok.sum())
        return ok

    def quoted(self, line: bytes, sep: bytes) -> bool:
        """A line with a quote: whether it ends a row of this split that isn't too long."""
        self.inside, found = end_of_line(line, self.inside, sep)
        self.open += found
        if self.inside:
            return False
        whole = self.own and self.open < self.width
        if not self.own:
            self.head = self.open
        self.rows, self.open, self.own = self.rows + whole, 0, True
        return whole


def _survey(lines: DataFrame, sep: bytes, width: int) -> list:
    """One row a split, in order: what becomes of either starting state, and whether all is UTF-8."""
    parts = (("inside", T.BooleanType()), ("rows", T.LongType()), ("head", T.LongType()), ("open", T.LongType()))
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("valid", T.BooleanType())] + [T.StructField(f"{n}{i}", t) for i in (0, 1) for n, t in parts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, valid, both, rows = None, True, [], []

        def told() -> tuple:
            return (at, valid, *[x for r in both for x in (r.inside, r.rows, r.head, r.open)])

        for batch in batches:
            for block, a, b, separators, blank, quote in _runs(batch, sep) if batch.num_rows else ():
                if block != at:
                    if at is not None:
                        rows.append(told())
                    at, valid, both = block, True, [_Course(False, width), _Course(True, width)]
                valid = valid and pc.all(batch.column(2).slice(a, b - a)).as_py()
                for r in both:
                    if quote:
                        r.quoted(batch.column(1)[a].as_py(), sep)
                    else:
                        r.plain(separators, blank)
        if at is not None:
            rows.append(told())
            types = [pa.int64(), pa.bool_(), *[pa.bool_(), pa.int64(), pa.int64(), pa.int64()] * 2]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], schema.names)

    return sorted(lines.mapInArrow(run, schema).collect(), key=lambda r: r["block"])  # a row a split


def _settled(survey: list, width: int) -> tuple[dict[int, tuple[bool, int]], dict[tuple[int, bool], int]]:
    """For each split its starting state and the number of its first own row; for rows over several splits, the number of a split's (block, first) piece.

    The header has the number -1.
    """
    starts, pieces = {}, {}
    inside, number, separators, held = False, -1, 0, []

    def ended() -> int:
        if separators < width:
            pieces.update(dict.fromkeys(held, number))
            return number + 1
        return number

    for r in survey:
        i, block = int(inside), r["block"]
        if inside:
            held.append((block, True))
            separators += r["open1"] if r["head1"] is None else r["head1"]
            if r["head1"] is None:  # the row goes on beyond this split
                starts[block] = True, number
                continue
            number = ended()
        starts[block] = inside, number
        number += r[f"rows{i}"]
        inside, separators, held = r[f"inside{i}"], r[f"open{i}"], [(block, False)]
    if inside:  # the last quote is never closed
        ended()
    return starts, pieces


def _whole(lines: DataFrame, starts: dict, sep: bytes, width: int) -> DataFrame:
    """(number, row) of the rows that end in the split in which they begin."""
    held = lines.sparkSession.sparkContext.broadcast(starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, course, number, open_ = None, None, 0, []
        for batch in batches:
            numbers, rows = [], []
            for block, a, b, separators, blank, quote in _runs(batch, sep) if batch.num_rows else ():
                if block != at:
                    at, (inside, number) = block, held.value[block]
                    course, open_ = _Course(inside, width), []
                column = batch.column(1).slice(a, b - a)
                if quote:
                    if course.own:
                        open_.append(column[0].as_py())
                    if course.quoted(column[0].as_py(), sep):
                        numbers.append(pa.array([number]))
                        rows.append(pa.array([b"\n".join(open_)], pa.binary()))
                        number += 1
                    if not course.inside:
                        open_ = []
                elif (ok := course.plain(separators, blank)) is not None:
                    n = int(ok.sum())
                    numbers.append(pa.array(np.arange(number, number + n)))
                    rows.append(column.filter(pa.array(ok)))
                    number += n
                elif course.own:
                    open_ += column.to_pylist()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(numbers), pa.concat_arrays(rows)], ["number", "row"])

    return lines.select("block", "line").mapInArrow(run, "number long, row binary")


def _spanning(lines: DataFrame, starts: dict, pieces: dict, sep: bytes, width: int) -> DataFrame:
    """(number, row) of the rows that reach over a split's end: a split has two pieces at most."""
    held, blocks = lines.sparkSession.sparkContext.broadcast((starts, pieces)), sorted({b for b, _ in pieces})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, pieces = held.value
        at, course, open_, first, found = None, None, [], True, []

        def piece() -> None:
            if open_ and (at, first) in pieces:
                found.append((pieces[at, first], at, b"\n".join(open_)))

        for batch in batches:
            for block, a, b, separators, blank, quote in _runs(batch, sep) if batch.num_rows else ():
                if block != at:
                    piece()
                    at, course, open_, first = block, _Course(starts[block][0], width), [], starts[block][0]
                column = batch.column(1).slice(a, b - a)
                if quote:
                    open_.append(column[0].as_py())
                    course.quoted(column[0].as_py(), sep)
                    if not course.inside:
                        if first:
                            piece()
                        open_, first = [], False
                elif course.plain(separators, blank) is None:
                    open_ += column.to_pylist()
        piece()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["number", "block", "piece"])

    some = lines.filter(F.col("block").isin(blocks)) if len(blocks) <= 1000 else lines.join(F.broadcast(lines.sparkSession.createDataFrame([(b,) for b in blocks], "b long")), F.col("block") == F.col("b"), "left_semi")
    cut = some.select("block", "line").mapInArrow(run, "number long, block long, piece binary")
    joined = F.aggregate(F.array_sort(F.collect_list(F.struct("block", "piece"))), F.lit(None).cast("binary"), lambda x, y: F.when(x.isNull(), y["piece"]).otherwise(F.concat(x, F.lit(b"\n"), y["piece"])))
    return cut.groupBy("number").agg(joined.alias("row"))


def read_strings(spark: SparkSession, path: str, sep: str = ",", enc: str | None = None, max_bytes: int | None = None) -> DataFrame:
    """Every column a string, ``''`` for missing, with ``_row_index`` and ``_source_file``.

    One file a call: its row numbers follow the file's order.  Files over
    ``max_bytes`` are refused (None: no limit).
    """
    if not path.lower().endswith(SUFFIXES):
        raise ImportFailure(f"unsupported file format: {path}")
    if path.lower().endswith((".xlsx", ".xls")):
        from tidewell.sources.excel import read_excel

        return read_excel(spark, path)
    if max_bytes is not None and (size := spark.read.format("binaryFile").load(path).agg(F.max("length")).first()[0]) and size > max_bytes:
        raise ImportFailure(f"file {path} has {size} bytes; the limit is {max_bytes}")
    names = headers(spark, path, enc or "UTF-8", sep)
    if not names:
        raise ImportFailure(f"csv file {path} is empty")
    width, mark, lines = len(names), sep.encode(), _lines(spark, path)
    survey = _survey(lines, mark, width)
    enc = enc or ("UTF-8" if all(r["valid"] for r in survey) else "ISO-8859-1")
    if enc != "UTF-8":
        names = headers(spark, path, enc, sep)
    starts, pieces = _settled(survey, width)
    rows = _whole(lines, starts, mark, width)
    if pieces:
        rows = rows.unionByName(_spanning(lines, starts, pieces, mark, width))
    text = F.regexp_replace(F.decode("row", enc) if enc != "UTF-8" else F.col("row").cast("string"), "\\r\\z", "")
    fields = [f"_c{i}" for i in range(width)]
    # What Spark couldn't take would go into a column of its own.
    parsed = F.from_csv(text, ", ".join(f"`{c}` string" for c in [*fields, "_corrupt"]), {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    split = rows.filter("number >= 0").select(parsed.alias("r"), F.col("number").alias("_row_index"))
    indexed = split.select(*[F.coalesce(F.col(f"r.{c}"), F.lit("")).alias(c) for c in fields], "_row_index")
    full = indexed.filter(F.exists(F.array(*fields), lambda x: x != ""))
    if full.isEmpty():
        raise ImportFailure(f"csv file {path} has no rows")
    return full.toDF(*unique(names), "_row_index").withColumn("_source_file", F.lit(path))


def unique(names: list[str]) -> list[str]:
    """Empty names get their place, repeated ones a number."""
    out: list[str] = []
    for i, n in enumerate(names):
        n = n or f"Unnamed: {i}"
        k, base = 0, n
        while n in out:
            k += 1
            n = f"{base}.{k}"
        out.append(n)
    return out
