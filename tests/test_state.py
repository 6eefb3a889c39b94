"""Parts, buckets and the log's filters."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import upsert
from tidewell.plans import membership, state
from tidewell.plans.config import Settings
from tidewell.plans.importing import Importer
from tidewell.operators.identity import Field


def files(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def test_a_batch_of_one_key_leaves_other_buckets_alone(spark, tmp_path):
    imp = Importer(spark, str(tmp_path / "store"), Settings(buckets=8))
    imp.create_table("Thing", [Field("code", unique=True), Field("price", "Currency")])
    (tmp_path / "a.csv").write_text("code,price\n" + "".join(f"c{i},{i}\n" for i in range(200)))
    assert imp.import_file(str(tmp_path / "a.csv"), "Thing").counts == {"INSERT": 200}
    before = imp.store.parts("records_thing")
    assert len(before) == 8
    kept = files(tmp_path / "store" / "records_thing")
    (tmp_path / "b.csv").write_text("code,price\nc7,99\n")
    assert imp.import_file(str(tmp_path / "b.csv"), "Thing").counts == {"UPDATE": 1}
    after = imp.store.parts("records_thing")
    changed = [k for k in before if before[k] != after[k]]
    assert len(changed) == 1 and set(before) == set(after)
    now = files(tmp_path / "store" / "records_thing")
    assert all(now[f] == t for f, t in kept.items())  # the old version's files stay for its readers
    records = {r["code"]: r["price"] for r in imp.records("Thing").collect()}
    assert len(records) == 200 and records["c7"] == 99.0 and records["c8"] == 8.0
    # Every record lies in the bucket of its name.
    for k in after:
        assert {r[0] for r in imp.records("Thing", k.__eq__).select(state.bucket(F.col("name"), 8)).distinct().collect()} == {k}


def test_an_old_file_again_changes_nothing(spark, tmp_path):
    """1.csv, 2.csv, 1.csv: the record keeps what 2.csv gave it."""
    imp = Importer(spark, str(tmp_path / "store"))
    imp.create_table("Thing", [Field("code", unique=True), Field("title")])
    for name, title in (("1", "old"), ("2", "new"), ("1", "old")):
        (tmp_path / f"{name}.csv").write_text(f"code,title\nA,{title}\n")
        got = imp.import_file(str(tmp_path / f"{name}.csv"), "Thing").counts
    assert got == {"SKIP": 1}
    assert [r["title"] for r in imp.records("Thing").collect()] == ["new"]
    assert imp.store.read("import_log").count() == 2


def test_parts(spark, tmp_path):
    store = state.Store(spark, str(tmp_path))
    df = spark.createDataFrame([(i, f"k/{i % 3} é") for i in range(9)], "v int, k string")
    store.replace("t", df, F.col("k"))
    assert set(store.parts("t")) == {"k/0 é", "k/1 é", "k/2 é"}
    store.replace_parts("t", df.filter("k like 'k/1%'").withColumn("v", F.col("v") + 100), F.col("k"))
    store.append("t", spark.createDataFrame([(50, "k/2 é")], "v int, k string"), F.col("k"))
    assert sorted(r["v"] for r in store.read("t").collect()) == [0, 2, 3, 5, 6, 8, 50, 101, 104, 107]
    assert sorted(r["v"] for r in store.read("t", parts="k/2 é".__eq__).collect()) == [2, 5, 8, 50]
    # A part that loses all its rows goes.
    store.replace_parts("t", df.limit(0), F.col("k"), {"k/0 é"})
    assert set(store.parts("t")) == {"k/1 é", "k/2 é"}
    # What a writer that died left goes when it is old.
    df.write.parquet(f"{tmp_path}/t/left")
    assert store.sweep("t", 2**62) == 2 and store.read("t").count() == 7


def test_outcomes_survive_a_crash(spark, tmp_path, monkeypatch):
    """A writer that dies while the outcomes of staged rows are written leaves staging as it was."""
    imp = Importer(spark, str(tmp_path / "store"))
    imp.create_table("Thing", [Field("code", unique=True)])
    (tmp_path / "a.csv").write_text("code\nA\nB\n")
    commit = imp.store._commit

    def dies(name, schema, parts, pointers, drop=True):
        if name == "staging" and pointers:
            raise OSError("gone")
        return commit(name, schema, parts, pointers, drop)

    monkeypatch.setattr(imp.store, "_commit", dies)
    with pytest.raises(OSError):
        imp.import_file(str(tmp_path / "a.csv"), "Thing")
    monkeypatch.undo()
    assert [(r["status"], r["n"]) for r in imp.store.read("staging").groupBy("status").agg(F.count("*").alias("n")).collect()] == [("Pending", 2)]


def test_only_parts_that_may_hold_a_row_are_read(spark, tmp_path):
    store = state.Store(spark, str(tmp_path))
    log = spark.createDataFrame([], state.IMPORT_LOG)
    hashes = spark.range(3000).select(F.md5(F.col("id").cast("string")).alias("row_hash"), F.lit("T").alias("target"), (F.col("id") % 5).alias("p"))
    for p in range(5):
        entries = log.select(*[c for c in log.columns if c not in ("row_hash", "target")]).unionByName(hashes.filter(F.col("p") == p).select("row_hash", "target"), allowMissingColumns=True)
        membership.append_log(store, entries.select(*log.columns))
    assert len(store.parts("import_log")) == 5
    some = hashes.filter("p = 3").limit(7).select("row_hash", "target")
    hit = membership.may_hold(store, some)
    assert hit == {k for k in store.parts("import_log") if store.read("import_log", parts=k.__eq__).join(some, "row_hash", "left_semi").count()}
    assert len(hit) == 1
    assert membership.read_log(store, some).join(some, ["row_hash", "target"], "left_semi").count() == 7
    assert membership.may_hold(store, some.withColumn("target", F.lit("U"))) == set()
    assert membership.may_hold(store, some.limit(0)) == set()
    # No filter misses a row.
    assert membership.may_hold(store, hashes.select("row_hash", "target")) == set(store.parts("import_log"))


def test_filter_positions():
    x = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 1000)
    at = membership.positions(x, 1 << 14)
    assert at.shape == (1000, membership.HASHES) and at.max() < 1 << 14
    assert np.array_equal(at, membership.positions(x, 1 << 14))


def test_counts_come_with_the_write(spark, tmp_path):
    from pyspark.sql import Observation

    decided = spark.createDataFrame([("INSERT",), ("SKIP",), ("INSERT",)], "action string")
    seen = Observation()
    upsert.observed(decided, seen).write.parquet(str(tmp_path / "d"))
    assert upsert.observed_counts(seen) == {"INSERT": 2, "SKIP": 1}
