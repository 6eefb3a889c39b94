"""One delimited file read by many tasks, against one task and Python's own reader."""

import csv
import io
import random

import pytest

from tidewell.sources import delimited


@pytest.fixture
def small_splits(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    for k, v in held.items():
        spark.conf.set(k, v)


def expected(text, width):
    rows, n = [], -1
    for r in csv.reader(io.StringIO(text, newline="")):
        if not r:
            continue
        if len(r) > width:
            continue
        r = [*r, *[""] * (width - len(r))]
        if n >= 0 and any(r):
            rows.append((n, *r))
        n += 1
    return rows


def read(spark, path):
    df = delimited.read_strings(spark, str(path))
    return df, sorted((r["_row_index"], *r[: len(df.columns) - 2]) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
def test_splits(spark, small_splits, tmp_path, seed):
    rng, out = random.Random(seed), io.StringIO(newline="")
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(["a", "b", "c"])
    pieces = ["x", "", "two words", 'say "hi"', "line\nbreak", ",", '"', "\n\n", "é" * 5, "long " * 30]
    for _ in range(60):
        kind = rng.random()
        writer.writerow([rng.choice(pieces) for _ in range(3 if kind < 0.8 else rng.choice([1, 2, 4, 5]))])
        if kind > 0.95:
            out.write("\n")
    text = out.getvalue()
    (tmp_path / "f.csv").write_text(text, encoding="utf-8", newline="")
    want = expected(text, 3)
    for n in (1 << 30, 311, 97):
        small_splits(n)
        df, got = read(spark, tmp_path / "f.csv")
        assert got == want, n
        if n < 1000:
            assert spark.read.option("lineSep", "\n").text(str(tmp_path / "f.csv")).rdd.getNumPartitions() >= 4


def test_rows_over_many_splits(spark, small_splits, tmp_path):
    """A row that is longer than several splits, one with too many fields, and a last quote that is never closed."""
    long = "\n".join(f'line "" {i},' for i in range(60))
    text = f'a,b\n1,"{long}"\n"{long}",2,3\n3,4\n5,"open\nend'
    (tmp_path / "f.csv").write_text(text, newline="")
    small_splits(50)
    _, got = read(spark, tmp_path / "f.csv")
    assert got == [(0, "1", long.replace('""', '"')), (1, "3", "4"), (2, "5", "open\nend")]


def test_quotes_within_fields(spark, small_splits, tmp_path):
    """A quote that doesn't open its field is text and hides no line break; carriage returns end lines, within quotes they stay."""
    (tmp_path / "f.csv").write_bytes(b'a,b\r\n5" pipe,x\r\n"in\r\nside",y"z\r\n ,"q"\r\n\r\n')
    for n in (1 << 30, 16):
        small_splits(n)
        _, got = read(spark, tmp_path / "f.csv")
        assert got == [(0, '5" pipe', "x"), (1, "in\r\nside", 'y"z'), (2, " ", "q")], n


def test_latin(spark, small_splits, tmp_path):
    (tmp_path / "f.csv").write_bytes("näme,b\n".encode("latin-1") + b"ok,1\n" * 50 + "café,2\n".encode("latin-1"))
    small_splits(40)
    df, got = read(spark, tmp_path / "f.csv")
    assert df.columns[0] == "näme"
    assert got[-1] == (50, "café", "2")


def test_scan_reads_each_byte_once_a_pass(spark, small_splits, tmp_path):
    """No shuffle where no row reaches over a split's end."""
    (tmp_path / "f.csv").write_text("a,b\n" + "1,2\n" * 100)
    small_splits(300)
    df = delimited.read_strings(spark, str(tmp_path / "f.csv"))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 100


def test_one_file_is_not_sorted_by_its_writer(spark):
    from tidewell.queries import _in_order

    df = _in_order(spark.range(2000).selectExpr("(id * 7919) % 2000 as k").repartition(7), "k")
    assert df.rdd.getNumPartitions() == 1 and [r["k"] for r in df.collect()] == list(range(2000))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" in plan and "Sort" not in plan
