"""A watched folder as a stream."""

from tidewell.operators.identity import Field
from tidewell.plans.importing import Importer
from tidewell.sources.files import Folder
from tidewell.streaming import watch


def test_a_bad_file_goes_to_errors_and_the_others_go_on(spark, tmp_path):
    imp, source = Importer(spark, str(tmp_path / "store")), tmp_path / "in"
    source.mkdir()
    imp.create_table("Thing", [Field("code", unique=True), Field("title")])
    (source / "1.csv").write_text("code,title\nA,old\n")
    (source / "2.csv").write_text("")
    (source / "3.csv").write_text("code,title\nA,new\nB,b\n")

    def run():
        watch.import_stream(imp, str(source), str(tmp_path / "cp"), "Thing").awaitTermination(300)

    run()
    folder = Folder(spark, str(source))
    assert folder.statistics() == {"main": 0, "processed": 2, "errors": 1, "pending": 0}
    titles = lambda: {r["code"]: r["title"] for r in imp.records("Thing").collect()}
    assert titles() == {"A": "new", "B": "b"}
    # An old file comes again, under its old name, with a later one: nothing goes back, and no archived file is lost.
    (source / "1.csv").write_text("code,title\nA,old\n")
    (source / "4.csv").write_text("code,title\nC,c\n")
    run()
    assert titles() == {"A": "new", "B": "b", "C": "c"}
    assert folder.statistics() == {"main": 0, "processed": 4, "errors": 1, "pending": 0}
    assert sorted(p.name for p in (source / "processed").glob("1*.csv")) == ["1-1.csv", "1.csv"]


def test_moved_files_never_replace_others(spark, tmp_path):
    folder = Folder(spark, str(tmp_path))
    for text in "abc":
        (tmp_path / "x.csv").write_text(text)
        folder.move(str(tmp_path / "x.csv"), "processed")
    assert sorted(p.read_text() for p in (tmp_path / "processed").glob("*.csv")) == ["a", "b", "c"]
    (tmp_path / "noname").write_text("1")
    assert folder.move(str(tmp_path / "noname"), "errors").endswith("errors/noname")


def test_a_lookup_lives_between_batches(spark, tmp_path):
    """Later batches, and a second run from the checkpoint, update what earlier ones have inserted."""
    from tidewell.streaming.lookup import decide_stream

    source, schema = tmp_path / "src", "code string, row_index long, new_name string"
    batches = [[("a", 2, "N2"), (" a", 1, "N1"), (None, 3, "N3"), ("", 4, "N4")], [("a", 5, "N5"), ("b", 6, "N6")], [("b", 7, "N7"), ("c", 8, "N8")]]

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        decide_stream(stream, "code", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        return {r["row_index"]: (r["action"], r["record_name"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    for b in batches[:2]:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(source))
    run()
    spark.createDataFrame(batches[2], schema).coalesce(1).write.mode("append").parquet(str(source))
    assert run() == {1: ("INSERT", "N1"), 2: ("UPDATE", "N1"), 3: ("INSERT", "N3"), 4: ("INSERT", "N4"), 5: ("UPDATE", "N1"), 6: ("INSERT", "N6"), 7: ("UPDATE", "N6"), 8: ("INSERT", "N8")}


def test_a_batch_takes_a_call_for_each_bucket(spark, tmp_path, monkeypatch):
    """Not one for each value; names of many batches are packed into one table."""
    import pandas as pd

    from tidewell.streaming import lookup

    class Held:
        def __init__(self):
            self.rows, self.puts, self.calls = [], 0, 0

        def exists(self):
            return bool(self.rows)

        def get(self):
            return iter(self.rows)

        def appendValue(self, row):
            self.rows, self.calls = [*self.rows, row], self.calls + 1

        def put(self, rows):
            self.rows, self.puts = list(rows), self.puts + 1

    monkeypatch.setattr(lookup, "MOST_TABLES", 4)
    one, seen = lookup.FirstInserts(), {}
    one.names = held = Held()
    for b in range(12):
        batch = pd.DataFrame({"value": [f"v{i % 40 + 10 * b}" for i in range(80)], "row_index": range(79, -1, -1), "new_name": [f"b{b}-{i}" for i in range(80)]})
        (out,) = one.handleInputRows((0,), iter([batch[:50], batch[50:]]), None)
        for r in out.sort_values("row_index").itertuples():
            first = seen.setdefault(r.value, f"b{b}-{79 - r.row_index}")
            assert (r.action, r.record_name) == ("INSERT" if first == f"b{b}-{79 - r.row_index}" else "UPDATE", first)
    assert held.calls <= 12 and held.puts >= 2 and len(held.rows) <= 5
    plan = lookup.first_inserts(spark.range(5).selectExpr("cast(id as string) as code", "id as row_index", "'n' as new_name"), "code")
    assert "bucket" in plan._jdf.queryExecution().logical().toString()
