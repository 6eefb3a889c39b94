"""Files to tables, end to end."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from tidewell.functions.messages import ImportFailure
from tidewell.operators.identity import Field
from tidewell.plans import state
from tidewell.plans.config import RemoteModule, Settings
from tidewell.plans.importing import Importer
from tidewell.sources import delimited, files
from tidewell.sources.rest import PagedRest
from tidewell.streaming import watch

HEAD = "Item Code,Title,E-Mail,Price,Since\n"


def rows(n, **changed):
    return HEAD + "".join(changed.get(f"r{i}", f"SKU-{i:04d},Thing {i},t{i}@x.org,\"$1,{i:03d}.50\",2024-01-{i % 28 + 1:02d}\n") for i in range(n))


def test_read_strings(spark, tmp_path):
    p = tmp_path / "ragged.csv"
    p.write_bytes("id , n,x\n1,2,3\n4\n5,6,7,8\n,,\n \t, ,\n9,\"a\nb\",c\n".encode())
    got = [(r["_row_index"], r["id"], r["n"], r["x"]) for r in delimited.read_strings(spark, str(p)).collect()]
    assert got == [(0, "1", "2", "3"), (1, "4", "", ""), (3, " \t", " ", ""), (4, "9", "a\nb", "c")]
    latin = tmp_path / "latin.csv"
    latin.write_bytes(b"id,name\n1,caf\xe9\n")
    assert delimited.encoding(spark, str(latin)) == "ISO-8859-1"
    assert delimited.read_strings(spark, str(latin)).first()["name"] == "café"
    with pytest.raises(ImportFailure):
        delimited.read_strings(spark, str(tmp_path / "x.txt"))
    with pytest.raises(ImportFailure):
        delimited.read_strings(spark, str(latin), max_bytes=3)
    assert delimited.unique(["a", "", "a"]) == ["a", "Unnamed: 1", "a.1"]


def test_import_cycle(spark, tmp_path):
    imp = Importer(spark, str(tmp_path / "store"))
    path = tmp_path / "things_data.csv"
    path.write_text(rows(25))
    asked = imp.import_file(str(path))
    assert (asked.status, asked.target) == ("approval_requested", "Things")
    assert state.request_summaries(imp.store.read("requests")).first()["field_count"] == 5
    imp.respond(asked.message, "Approved", "me")
    with pytest.raises(ValueError):
        imp.respond(asked.message, "Rejected")
    done = imp.drain_requests()
    assert done[0].counts == {"INSERT": 25} and done[0].success_rate == 100.0
    records = imp.records("Things")
    assert records.count() == 25 and dict(records.dtypes)["price"] == "double"
    assert records.agg(F.max("price")).first()[0] == 1024.5
    # The same again: all skipped.
    assert imp.import_file(str(path)).counts == {"SKIP": 25}
    # Two changed, two new rows.
    path.write_text(rows(27, r3="SKU-0003,Thing 3,,$9.00,2024-01-04\n", r4="SKU-0004,Renamed,t4@x.org,,2024-01-05\n"))
    assert imp.import_file(str(path)).counts == {"SKIP": 23, "UPDATE": 2, "INSERT": 2}
    after = {r["item_code"]: r for r in imp.records("Things").collect()}
    assert (after["SKU-0003"]["price"], after["SKU-0003"]["e_mail"], after["SKU-0004"]["title"], after["SKU-0004"]["price"]) == (9.0, "t3@x.org", "Renamed", 1004.5)
    staging = imp.store.read("staging")
    assert staging.filter("status = 'Pending'").count() == 0 and staging.count() == 25 + 25 + 27
    assert imp.store.read("import_log").count() == 25 + 4
    assert imp.store.read("registry").select("usage_count").first()[0] == 3
    imp.clean(F.lit(datetime.datetime.now() + datetime.timedelta(days=1)))
    assert imp.store.read("staging").count() == 0


def test_failed_rows(spark, tmp_path):
    imp = Importer(spark, str(tmp_path / "store"), Settings(nonnumeric_as_zero=False, int_strip_point=False))
    imp.create_table("Thing", [Field("code", unique=True, required=True), Field("price", "Currency")])
    path = tmp_path / "t.csv"
    path.write_text("code,price\na,5\n,6\nb,1-2\n")
    result = imp.import_file(str(path), "Thing")
    assert result.counts == {"INSERT": 1, "FAILED": 2}
    failed = [r["error_type"] for r in imp.store.read("staging").filter("status = 'Failed'").collect()]
    assert failed == ["validation", "validation"]


def test_folder(spark, tmp_path):
    watched = tmp_path / "in"
    watched.mkdir()
    (watched / "things.csv").write_text(rows(3))
    (watched / "empty.csv").write_text("")
    (watched / ".hidden.csv").write_text(rows(3))
    imp = Importer(spark, str(tmp_path / "store"), Settings(approval_required=False))
    assert sorted(r.status for r in imp.import_folder(str(watched))) == ["completed", "failed"]
    folder = files.Folder(spark, str(watched))
    assert folder.statistics() == {"main": 1, "processed": 1, "errors": 1, "pending": 0}
    assert folder.find("things.csv").endswith("processed/things.csv") and folder.writable()
    assert files.listing(spark, str(watched), 10_000).count() >= 1
    assert folder.remove_old(2**62) == 2
    assert files.connection_problems(spark, "csv", path=str(watched)) == []
    assert files.connection_problems(spark, "rest", url="http://x", module="Leads", transport="fake_transport:FakeTransport") == []
    assert files.connection_problems(spark, "ftp")


def test_store_survives_a_crash(spark, tmp_path, monkeypatch):
    """A writer that dies before its version has a pointer leaves the table as it was; a second writer of one version fails."""
    store = state.Store(spark, str(tmp_path / "store"))
    one = lambda v: spark.createDataFrame([(v,)], "v int")
    read = lambda: [r["v"] for r in store.read("t").collect()]
    store.replace("t", one(1))
    fs = store._fs

    class Dies:
        def __getattr__(self, name):
            return (lambda *a: (_ for _ in ()).throw(OSError("gone"))) if name == "rename" else getattr(fs, name)

    monkeypatch.setattr(store, "_fs", Dies())
    with pytest.raises(OSError):
        store.replace("t", one(2))
    monkeypatch.setattr(store, "_fs", fs)
    assert read() == [1]
    other = state.Store(spark, str(tmp_path / "store"))
    seen = other._pointers("t")
    store.replace("t", one(3))
    monkeypatch.setattr(other, "_pointers", lambda name: seen)
    with pytest.raises(RuntimeError):
        other.replace("t", one(4))
    assert read() == [3]
    for v in (5, 6, 7):
        store.replace("t", one(v))
    assert read() == [7] and len(store._pointers("t")) == 2


def test_staging_of_earlier_runs_is_not_read(spark, tmp_path):
    imp = Importer(spark, str(tmp_path / "store"), Settings(approval_required=False))
    path = tmp_path / "things.csv"
    for n in (3, 4):
        path.write_text(rows(n))
        imp.import_file(str(path))
    runs = [r["run_id"] for r in imp.store.read("staging").select("run_id").distinct().collect()]
    mine = imp.store.read("staging", parts=f"{runs[0]}/Things".__eq__)
    assert len(runs) == 2 and len(mine.inputFiles()) < len(imp.store.read("staging").inputFiles())
    with pytest.raises(ValueError):
        state.register_schema(imp.store.read("registry"), "", "f", [], "T", 1.0)


def test_settings():
    assert Settings.load({"chunk_size": 500}, {"TIDEWELL_MATCH_THRESHOLD": "70", "TIDEWELL_AUTO_CREATE": "no"}) == Settings(chunk_size=500, match_threshold=70.0, auto_create=False)
    for bad in ({"chunk_size": 50}, {"match_threshold": 99}, {"max_jobs": 0}, {"watch_dir": "x/y"}):
        with pytest.raises(ValueError):
            Settings(**bad)
    assert RemoteModule("", "T").problems([])[0]


def test_paged_rest(spark):
    spark.dataSource.register(PagedRest)
    read = spark.read.format("paged_rest").schema("id string, owner string").option("url", "http://x").option("module", "Leads").option("transport", "fake_transport:FakeTransport")
    got = read.load().collect()
    assert [r["id"] for r in got] == ["10", "11", "20", "21", "30", "31"] and got[0]["owner"] == '{"name": "x"}'
    assert read.option("modified_since", "2024-01-02").load().count() == 2
    stream = spark.readStream.format("paged_rest").schema("id string").option("url", "http://x").option("module", "Leads").option("transport", "fake_transport:FakeTransport").load()
    q = stream.writeStream.format("memory").queryName("rest_stream").trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            if spark.sql("SELECT * FROM rest_stream").count() >= 6:
                break
            time.sleep(0.5)
        assert spark.sql("SELECT * FROM rest_stream").count() == 6
    finally:
        q.stop()


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "src"
    source.mkdir()
    for k in range(3):
        (source / f"f{k}.csv").write_text("code,v\n" + "".join(f"{k}-{i},{i}\n" for i in range(10)))
    seen = []
    stream = watch.raw_stream(spark, str(source), ["code", "v"], max_files=1)
    watch.watch(stream, str(tmp_path / "cp"), lambda df, _: seen.extend(r["code"] for r in df.collect())).awaitTermination(120)
    assert sorted(seen) == sorted(f"{k}-{i}" for k in range(3) for i in range(10))
