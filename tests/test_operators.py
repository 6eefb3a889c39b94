import random

from pyspark.sql import functions as F

from tidewell.functions.hashing import row_hash
from tidewell.functions.naming import field_name
from tidewell.operators import identity, infer, matching, profile, proposals, reports, upsert, validation
from tidewell.operators.identity import Field


def test_profile(spark):
    df = spark.createDataFrame([("a", ""), ("bb", None), ("a", "x")], "u string, v string")
    got = {r["column_name"]: r for r in profile.profile(df).collect()}
    assert (got["u"]["unique_values"], got["u"]["max_length"], got["v"]["non_empty_rows"], got["v"]["completeness"]) == (2, 2, 1, "33.3%")
    empty = profile.profile(df.limit(0)).collect()
    assert [r["completeness"] for r in empty] == ["0.0%", "0.0%"]


def test_votes_need_four_fifths(spark):
    yes16 = [(i, "5" if i < 16 else "x") for i in range(20)]
    yes15 = [(i, "5" if i < 15 else "x") for i in range(20)]
    for rows, want in ((yes16, "Int"), (yes15, "Data")):
        assert infer.infer_types(spark.createDataFrame(rows, "i long, v string"), "i").first()["field_type"] == want
    cols = {"a": "$5.5", "b": "yes", "c": "a@b.org", "d": "2024-01-01", "e": "(123) 4567890", "f": "x" * 141, "g": "1234567890"}
    df = spark.createDataFrame([(1, *cols.values())], "i long, " + ", ".join(f"{c} string" for c in cols))
    assert {r["column_name"]: r["field_type"] for r in infer.infer_types(df, "i").collect()} == {"a": "Currency", "b": "Check", "c": "Email", "d": "Date", "e": "Phone", "f": "Text", "g": "Int"}


def test_scored_types(spark):
    rows = [("n", "100"), ("n", "200"), ("m", "a@b.org"), ("t", "hello")]
    got = {r["column_name"]: (r["detected"], r["field_type"]) for r in infer.scored_types(spark.createDataFrame(rows, "column_name string, value string")).collect()}
    assert got == {"n": ("Currency", "Currency"), "m": ("Email", "Data"), "t": ("Text", "Data")}


def test_definitions():
    assert infer.field_definition("total", "Data", 10) == ("Data", 30)
    assert infer.field_definition("total", "Data", 200) == ("Text", None)
    assert infer.field_definition("paid_amount", "Currency", 10) == ("Data", 140)
    assert infer.field_definition("paid_amount", "Currency", 10, by_name=False) == ("Currency", None)
    assert infer.unique_field([("name", 10, 10), ("item_code", 9, 10)]) == "item_code"
    assert sum(k == "Data" for k, _ in infer.table_fields({f"c{i}": ("Data", 30) for i in range(40)}).values()) == 30 + 3


def test_matching():
    assert matching.map_headers(["E Mail", "Qty", "zz"], ["email", "quantity", "other"]) == {"E Mail": "email", "Qty": "quantity"}
    assert matching.semantic_similarity("unit_price", "total_cost") == 0.8
    assert (matching.threshold(None), matching.threshold(20), matching.threshold(99), matching.threshold(70)) == (0.8, 0.5, 0.95, 0.7)
    got = matching.layered_mapping(["Service Name", "unit price", "Customer ID", "mail"], "Service", ["email", "price"], custom={"mail": "email"}, named=(*matching.RULES, (r"(.+)_id", r"\1_id")))
    assert got == {"Service Name": "service_name", "unit price": "price", "Customer ID": "customer_id", "mail": "email"}
    assert matching.add_columns_statement("t", [("a", "string")]) == "ALTER TABLE t ADD COLUMNS (`a` STRING)"
    patterns = {"Customer": {"required": ("customer",), "optional": ("email",)}, "Item": {"required": ("item",), "exclude": ("customer",)}}
    kind, confidence, approve = matching.keyword_type(["customer_id", "email"], patterns, *matching.CLASSIFIER_A)
    assert (kind, confidence, approve) == ("Customer", 100.0, False)


def test_schema_scores(spark):
    one = spark.createDataFrame([("f", "a"), ("f", "b-c")], "source string, header string")
    two = spark.createDataFrame([("t", "a"), ("t", "b_c"), ("t", "d"), ("u", "a")], "target string, field string")
    best = matching.best_schema(matching.schema_scores(one, two), 0.5).first()
    assert (best["target"], best["score"]) == ("t", round(0.3 * 2 / 3 + 0.5 + 0.1, 6))


def test_key_scores(spark):
    assert [identity.name_score(x) for x in ("customer_id", "company_name", "company", "item_code", "invoice_no", "email", "notes")] == [-100, -100, 85, 80, 90, 85, 0]
    df = spark.createDataFrame([(str(i), str(i % 2), f"n{i}") for i in range(10)], "item_code string, email string, notes string")
    fields = [Field("item_code"), Field("email"), Field("notes", indexed=True), Field("parent", "Link")]
    assert identity.key_scores(df, fields) == [("item_code", 125.0), ("email", 60.0), ("notes", 55.0)]
    assert identity.matching_keys(df, fields) == ["item_code"]
    assert identity.matching_keys(df, [Field("notes", unique=True)]) == ["notes"]


def test_validation(spark):
    df = spark.createDataFrame([("", "x", "0", "12345"), ("a", "5", "3", "123-456-7890")], "s string, n string, q string, p string")
    fields = [Field("s", required=True), Field("n", "Float"), Field("q", "Int", required=True), Field("p", "Phone")]
    got = [r["error_log"] for r in validation.validate(df, fields, legacy=False).collect()]
    assert got == ["Missing required field: s; Invalid float in n: x; Missing required field: q; Invalid phone in p: 12345", ""]
    parents = {"P": spark.createDataFrame([("a",)], "name string")}
    linked = validation.validate(df, [Field("n", "Link", link="P")], parents).select("error_log").collect()
    assert all("doesn't exist" in r["error_log"] for r in linked)


def batch(spark, rows):
    df = spark.createDataFrame(rows, "row_index long, code string, email string, note string")
    return df.withColumns({"row_hash": row_hash(["code", "email", "note"]), "errors": F.array().cast("array<string>"), "new_name": F.concat(F.lit("N"), F.col("row_index").cast("string"))})


def known(spark, rows):
    df = spark.createDataFrame(rows, "name string, code string, email string, note string")
    return df.withColumns({"row_hash": row_hash(["code", "email", "note"]), "last_import_date": F.lit(None).cast("timestamp")})


def decided(df):
    return sorted((r["row_index"], r["action"], r["record_name"]) for r in df.select("row_index", "action", "record_name").collect())


def test_upsert_equals_the_fold(spark):
    r = random.Random(3)
    pick = lambda p, n: f"{p}{r.randrange(n)}" if r.random() < 0.8 else ""
    table = known(spark, [(f"R{i}", f"c{i}", "", f"x{i}") for i in range(5)])
    # One key that fills in chains: code decides, e-mail only where the code is blank.
    rows = []
    for i in range(60):
        code = pick("c", 15)
        rows.append((i, code, "" if code else pick("e", 5), f"x{r.randrange(6)}"))
    b = batch(spark, rows)
    assert decided(upsert.decide(b, table, ["code", "email"])) == [(a, x, n) for a, x, n in decided(upsert.strict(b, table, ["code", "email"]))]


def test_chains_over_two_keys_equal_the_fold(spark):
    table = known(spark, [("R1", "c900", "e900", "")])
    # Row i + 1 shares its e-mail or its code with row i in turn; one chain starts at a record, one at an insert.
    chain = [(i, f"c{(i + 1) // 2}", f"e{i // 2}", f"x{i}") for i in range(20)]
    known_chain = [(100 + i, f"c{900 + (i + 1) // 2}", f"e{901 + i // 2}", f"y{i}") for i in range(20)]
    r = random.Random(8)
    mixed = [(200 + i, f"m{r.randrange(30)}" if r.random() < 0.7 else "", f"n{r.randrange(30)}" if r.random() < 0.7 else "", f"z{i}") for i in range(80)]
    b = batch(spark, chain + known_chain + mixed)
    got = decided(upsert.decide(b, table, ["code", "email"]))
    assert got == decided(upsert.strict(b, table, ["code", "email"]))
    assert {n for i, _, n in got if i < 20} == {"N0"} and {n for i, _, n in got if 100 <= i < 120} == {"R1"}


def test_merge(spark):
    table = known(spark, [("R1", "c1", "old@x.org", "keep"), ("R2", "c2", "", "same")])
    b = batch(spark, [(0, "c1", "new@x.org", ""), (1, "c1", "", "later"), (2, "c9", "n@x.org", "first"), (3, "c9", "", "second"), (4, "c2", "", "same")])
    d = upsert.decide(b, table, ["code"])
    assert {r["action"]: r["rows"] for r in upsert.counts(d).collect()} == {"UPDATE": 3, "INSERT": 1, "SKIP": 1}
    merged = {r["name"]: (r["email"], r["note"]) for r in upsert.merge(d, table, ["code", "email", "note"], F.current_timestamp()).collect()}
    assert merged == {"R1": ("new@x.org", "later"), "R2": ("", "same"), "N2": ("n@x.org", "second")}


def test_second_run_skips(spark):
    b = batch(spark, [(i, f"c{i}", "", "n") for i in range(10)])
    empty = known(spark, [("R", "r", "", "")]).filter("false")
    after = upsert.merge(upsert.decide(b, empty, ["code"]), empty, ["code", "email", "note"], F.current_timestamp())
    again = upsert.decide(b, after, ["code"])
    assert {r["action"] for r in again.select("action").collect()} == {"SKIP"}
    assert after.select("row_hash").distinct().count() == after.count() == 10


def test_numbered_names(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "i int, b string")
    taken = spark.createDataFrame([("a",), ("a-4",)], "name string")
    assert {r["i"]: r["unique_name"] for r in upsert.numbered_names(df, "b", "i", taken).collect()} == {1: "a-1", 2: "a-2", 3: "b"}


def fold_names(rows, taken):
    used, out = set(taken), {}
    for i, b in sorted(rows):
        out[i] = next(x for x in (b if n == 0 else f"{b}-{n}" for n in range(99)) if x not in used)
        used.add(out[i])
    return out


def test_names_never_collide(spark):
    get = lambda rows, taken: {r["i"]: r["unique_name"] for r in upsert.numbered_names(spark.createDataFrame(rows, "i int, b string"), "b", "i", spark.createDataFrame([(t,) for t in taken], "name string")).collect()}
    for rows, taken in (([(1, "a"), (2, "a"), (3, "a-1")], []), ([(1, "SKU-0003")], ["SKU-0003"]), ([(1, "a"), (2, "a-1"), (3, "a")], ["a", "a-2"]), ([(1, "x-7"), (2, "x-7")], ["x", "x-7", "x-7-1"])):
        assert get(rows, taken) == fold_names(rows, taken)
    assert get([(1, None), (2, "a")], ["a"]) == {1: None, 2: "a-1"} and get([], ["a"]) == {}
    r = random.Random(2)
    rows, taken = [(i, r.choice(("a", "a-1", "a-2", "b", "b-1-1"))) for i in range(40)], ["a", "a-3", "b-1", "a-1-1"]
    got = get(rows, taken)
    assert len(set(got.values())) == 40 and not set(got.values()) & set(taken)


def test_equal_rows_and_written_keys(spark):
    table = known(spark, [("R0", "k0", "", "")])
    b = batch(spark, [(0, "k0", "new@x", "n"), (1, "", "new@x", "m"), (2, "q", "", "same"), (3, "q", "", "same"), (4, "z", "e1", ""), (5, "y", "e2", ""), (6, "y", "e1", "b"), (7, " ", None, "blank"), (8, None, "", "other")])
    got = decided(upsert.decide(b, table, ["code", "email"]))
    assert got == decided(upsert.strict(b, table, ["code", "email"]))
    assert got == [(0, "UPDATE", "R0"), (1, "UPDATE", "R0"), (2, "INSERT", "N2"), (3, "SKIP", "N2"), (4, "INSERT", "N4"), (5, "INSERT", "N5"), (6, "UPDATE", "N5"), (7, "INSERT", "N7"), (8, "INSERT", "N8")]
    r = random.Random(4)
    pick = lambda p, n: f"{p}{r.randrange(n)}" if r.random() < 0.7 else ""
    for n in (8, 25):
        b = batch(spark, [(i, pick("c", n), pick("e", n), pick("x", 2)) for i in range(80)])
        table = known(spark, [(f"R{i}", f"c{i}", f"e{i + 2}", "x0") for i in range(4)])
        assert decided(upsert.decide(b, table, ["code", "email"])) == decided(upsert.strict(b, table, ["code", "email"]))
    assert upsert.decide(b.filter("false"), table, ["code"]).count() == 0
    assert {a for _, a, _ in decided(upsert.decide(b, table.filter("false"), []))} == {"INSERT", "SKIP"}


def test_changed_fields(spark):
    df = spark.createDataFrame([(("a", "b", "n"), ("a ", "", "m"))], "old struct<x:string,y:string,name:string>, new struct<x:string,y:string,name:string>")
    assert df.select(identity.changed_fields(["x", "y", "name"]).alias("c")).first()["c"] == []


def test_reports(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",)], "v string")
    assert reports.most_frequent(df, "v").first()["v"] == "a"
    empty = spark.createDataFrame([(0, 0, 0, 0)], "success int, updated int, skipped int, failed int")
    assert reports.rates(empty).first()["success_rate"] is None
    assert upsert.recommendations(0, 0, 0, 0) and upsert.recommendations(1, 2, 9, 1)


def test_proposals():
    assert proposals.propose_target("vendor_list.csv", ["a", "b"]) == ("General", 1.0, False)
    assert proposals.propose_target("vendor_list.csv", ["client", "item", "zip"]) == ("Supplier", 0.8, False)
    assert proposals.propose_target("my_things.csv", []) == ("My Things", 0.5, True)
    assert proposals.propose_mapping(["E Mail", "Phone No", "zz"], ["e_mail"], field_name) == {"E Mail": "e_mail", "Phone No": "mobile_no", "zz": "zz"}
    assert proposals.similar_field("colour", ["color", "x_colour_y"]) == "x_colour_y" and proposals.similar_field("abcdefgx", ["abcdefgh"]) == "abcdefgh"
    assert proposals.map_record(["Item Code", "??"], ["item_code"], field_name) == {"Item Code": "item_code"}
    assert proposals.table_name_warnings("Orders final") == ([], ["the ending may confuse"]) and proposals.table_name_warnings("Role")[0]


def test_backfill(spark):
    df = spark.createDataFrame([("b", "x", None), ("a", "x", None), ("c", "x", "kept")], "name string, v string, row_hash string")
    got = {r["name"]: r["row_hash"] for r in identity.backfill_hashes(df, ["v"]).collect()}
    assert got["c"] == "kept" and len(set(got.values())) == 3


def test_one_base_is_numbered_by_ranges(spark, monkeypatch):
    from tidewell.workspace import Workspace

    written = {}
    write = Workspace.write
    monkeypatch.setattr(Workspace, "write", lambda self, df, name: written.setdefault(self.path, write(self, df, name)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would come to one range
    rng = random.Random(3)
    data = [("hot", i) for i in range(4000)] + [(None, i) for i in range(50)] + [(f"b{i % 30}", i) for i in range(300)]
    rng.shuffle(data)
    got = {(r["b"], r["o"]): r["n"] for r in upsert.numbered(spark.createDataFrame(data, "b string, o int"), ["b"], ["o"], "n").collect()}
    for base in {b for b, _ in data}:
        for n, o in enumerate(sorted(o for b, o in data if b == base)):
            assert got[base, o] == n
    (held,) = written.values()
    sizes = [r["count"] for r in held.groupBy("_range").count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    # The base that nine tenths of the rows share lies in all ranges.
    assert len(sizes) >= 4 and max(sizes) < 0.5 * len(data)
    assert upsert.numbered(spark.createDataFrame([], "b string, o int"), ["b"], ["o"], "n").count() == 0


def test_similar_sets(spark, monkeypatch):
    from tidewell.workspace import Workspace

    written = {}
    write = Workspace.write
    monkeypatch.setattr(Workspace, "write", lambda self, df, name: written.setdefault(name, write(self, df, name)))
    rng = random.Random(6)
    sets = {k: {"common", "all"} | {f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, 9))} for k in range(300)}
    for k in range(300, 340):
        near = set(sets[k - 300])
        near.add(f"x{k}")
        sets[k] = near
    rows = [(k, w) for k, s in sets.items() for w in s] + [(0, None), (None, "common"), (1, "common")]
    df = spark.createDataFrame(rows, "k int, w string")
    for percent in (50, 80):
        written.clear()
        got = {(r["a"], r["b"], r["matching"]) for r in matching.similar_sets(df, "k", "w", percent).collect()}
        want = {(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}
        assert got == want and len(want) > 10
    # Two words that all sets share would join all 57630 pairs.
    assert written["candidates"].count() < 3 * len(want) + 200


def test_similar_sets_of_copies(spark, monkeypatch):
    """Copies meet as one set, also where a set is large or an item common."""
    from tidewell.workspace import Workspace

    written = {}
    write = Workspace.write
    monkeypatch.setattr(Workspace, "write", lambda self, df, name: written.setdefault(name, write(self, df, name)))
    monkeypatch.setattr(matching, "CELL", 4)
    kinds = [{f"w{i}" for i in range(80)}, {f"w{i}" for i in range(72)}, {"w0", "x", "y", "z"}, {"w0", "x", "y", "z", "q"}, {"alone"}]
    kinds += [{"x", "y", "z", f"n{i}"} for i in range(20)]
    sets = {k: kinds[k % len(kinds)] for k in range(6 * len(kinds))}
    df = spark.createDataFrame([(k, w) for k, s in sets.items() for w in s], "k int, w string")
    got = sorted(map(tuple, matching.similar_sets(df, "k", "w", 60).collect()))
    want = sorted((a, b, len(sets[a] & sets[b]), round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6)) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 60 * len(sets[a] | sets[b]))
    assert got == want
    assert written["candidates"].count() < len(kinds) ** 2 / 2 < len(want) / 20


def test_rows_of_a_batch_have_places_of_their_own(spark, tmp_path, monkeypatch):
    """Lines of different orders don't share a row_index, by which decide joins."""
    from tidewell import queries

    spark.createDataFrame([(o, n, 1, 1, 1.0, 1.0) for o in range(30) for n in range(4)], "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    seen, decide = [], upsert.decide
    monkeypatch.setattr(upsert, "decide", lambda rows, *a: seen.append(rows) or decide(rows, *a))
    got = {(r["n"], r["action"], r["rows"]) for r in queries.intra_batch_first_insert(spark, str(tmp_path)).collect()}
    assert got == {(o, a, n) for o in range(30) for a, n in (("INSERT", 1), ("UPDATE", 3))}
    assert seen[0].select("row_index").distinct().count() == 120


def test_names_beside_none_are_sorted_once(spark, monkeypatch):
    calls, numbered = [], upsert.numbered
    monkeypatch.setattr(upsert, "numbered", lambda *a: calls.append(a) or numbered(*a))
    df = spark.createDataFrame([("x", i) for i in range(50)] + [(None, 60)], "b string, o int")
    got = {r["o"]: r["unique_name"] for r in upsert.numbered_names(df, "b", "o").collect()}
    assert got == {i: f"x-{i}" if i else "x" for i in range(50)} | {60: None}
    assert len(calls) == 1


def test_closest_values(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    rng = random.Random(8)
    known = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(0, 12))) for _ in range(150)} | {"", "a", "aaaaaaaa"})
    typed = ["".join(c for c in k if rng.random() > 0.15) + rng.choice(["", "z", "ab"]) for k in known] + ["", "a", "zzzzzzzz", "zz", "aaaaaa"]
    df = spark.createDataFrame([(t,) for t in typed] + [(None,), ("a",)], "t string")
    got = {(r["typed"], r["value"], r["distance"]) for r in matching.closest_values(df, "t", spark.createDataFrame([(k,) for k in known] + [(None,)], "v string"), "v").collect()}
    best = {t: min((distance(t, k), k.encode(), k) for k in known) for t in typed}
    assert got == {(t, k, d) for t, (d, _, k) in best.items() if d <= 2}
