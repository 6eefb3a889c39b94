"""Cases of operators over metadata, files and state: literal inputs whose results are known, as SQL values.

A case has its inputs and the expected outputs side by side; the query computes the outputs from the inputs with the
operator, the SQL states them.  Files and stores are made in the folder that driver and executors share.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import content, messages, naming
from tidewell.functions.hashing import row_hash, schema_fingerprint
from tidewell.operators import identity, infer, matching, profile, proposals, reports, upsert, validation
from tidewell.operators.identity import Field
from tidewell.plans import config, state
from tidewell.plans.importing import Importer
from tidewell.sources import delimited, files
from tidewell.sources.rest import PagedRest, modules
from tidewell.streaming import watch
from tidewell.workspace import Workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

SQL_TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def _sql(value, kind: str) -> str:
    text = "NULL" if value is None else f"'{value.replace(chr(39), chr(39) * 2)}'" if isinstance(value, str) else str(value)
    return f"CAST({text} AS {SQL_TYPES[kind]})"


def columns_of(schema: str) -> list[tuple[str, str]]:
    """(name, type) of each column."""
    return [tuple(c.split(" ")) for c in schema.split(", ")]


def values_sql(schema: str, rows: list[tuple]) -> str:
    names, kinds = zip(*columns_of(schema), strict=True)
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(_sql(v, k) for v, k in zip(r, kinds, strict=True)) + ")" for r in rows) + f") AS v({', '.join(names)})"


def stated(schema: str, rows: list[tuple]):
    """Register a query whose rows are these."""

    def add(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, values_sql(schema, rows)
        return f

    return add


def case(name: str, schema: str, f: Callable, rows: list[tuple], outputs: int = 1) -> None:
    """Register a query of a function over metadata: the last ``outputs`` columns are computed from the others."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = []
        for r in rows:
            got = f(*r[: len(r) - outputs])
            out.append((*r[: len(r) - outputs], *(got if outputs > 1 else [got])))
        return spark.createDataFrame(out, schema)

    QUERIES[name], ORACLE_SQL[name] = query, values_sql(schema, rows)


def column_case(name: str, schema: str, columns: Callable[[], dict], rows: list[tuple]) -> None:
    """The same of column expressions, which take the input columns by name."""
    fields = columns_of(schema)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        new = columns()
        at = [i for i, (c, _) in enumerate(fields) if c not in new]
        df = spark.createDataFrame([tuple(r[i] for i in at) for r in rows], ", ".join(" ".join(fields[i]) for i in at))
        return df.select(*[new[c].cast(kind).alias(c) if c in new else F.col(c) for c, kind in fields])

    QUERIES[name], ORACLE_SQL[name] = query, values_sql(schema, rows)


def joined(x) -> str:
    return "; ".join(f"{k}={v}" for k, v in x.items()) if isinstance(x, dict) else "; ".join(map(str, x))


# ---- names

column_case("field_names", "header string, field string", lambda: {"field": naming.field_name_column(F.col("header"))}, [("Customer ID", "customer_id"), ("2nd Col", "field_2nd_col"), ("class", "class_field"), ("owner", "custom_owner"), ("x", "field_x"), ("--", "field"), ("  A  B ", "a_b"), (None, "field")])
case("labels_of_names", "name string, label string", naming.label, [("first_name", "First Name"), ("e-mail  address", "E Mail Address"), ("ID", "Id")])
case("table_names", "path string, table_name string", lambda p: naming.table_name(p, ("Supplier",)), [("/in/customer_data.csv", "Customer"), ("vendors.csv", "Supplier"), ("2024_orders_final.csv", "Import 2024 Orders"), ("--.csv", "Custom Import Data"), ("price list new.xlsx", "Price List"), ("new.csv", "New")])
case("table_name_rules", "name string, errors bigint", lambda n: len(naming.table_name_errors(n)), [("Good Name", 0), ("1st", 1), ("user", 1), ("User", 1), ("table", 0), ("x" * 62, 1), ("", 2), ("semi;colon", 1)])
case("table_name_advice", "name string, errors bigint, warnings string", lambda n: (len((x := proposals.table_name_warnings(n))[0]), joined(x[1])), [("Orders final", 0, "the ending may confuse"), ("Role", 1, ""), ("Price & Cost", 0, "characters that aren't safe will be replaced; the name isn't safe in addresses")], 2)
case("file_names", "path string, safe string", naming.file_name, [("/a/b<c>.csv", "b_c_.csv"), ("..\\up\\x?.csv", "x_.csv"), ("plain.csv", "plain.csv")])
case("header_variants", "headers string, normal string", lambda h: joined(naming.normal_headers(h.split("|"))), [("E-Mail| Email |cust_id", "email; email_2; customer_id"), ("\ufeffID|Organization|comp_name", "id; company_name; company_name_2")])
column_case("numbered_bases", "base string, long_form string, short_form string", lambda: {"long_form": naming.numbered_base(F.col("base")), "short_form": naming.short_base(F.col("base"))}, [("A/B 1", "A-B-1", "AB 1"), ("???", "---", "Record"), ("", "", "Unnamed"), ("y" * 60, "y" * 60, "y" * 50)])
column_case("record_name_column", "value string, name string", lambda: {"name": naming.record_name(F.col("value"), "Customer", F.lit("new"))}, [("1234567890", "CUST-34567890"), ("A 1/2", "A12"), (" ", "new"), (None, "new"), ("12345678", "12345678")])
case("naming_scores", "field string, score bigint", naming.naming_score, [("Item Code", 100), ("code", 110), ("email", 95), ("invoice_total", 90), ("Title", 80), ("zzz", 0)])

# ---- values

column_case("phone_values", "value string, is_phone boolean", lambda: {"is_phone": content.is_phone(F.col("value"))}, [("+1234567890", True), ("123 456 7890", True), ("12345", False), ("(123) 4567890", True), ("+12-34567890123", True), ("none", False)])
column_case("currency_values", "value string, is_currency boolean, number double", lambda: {"is_currency": content.is_currency(F.col("value")), "number": content.to_number(F.col("value"), paren_negative=True)}, [("$1,234.50", True, 1234.5), ("INR 5", True, 5.0), ("5 USD", False, 5.0), ("(500)", False, -500.0), ("abc", False, 0.0), ("1-2", False, None), (" ", False, None)])
column_case("integer_switches", "value string, kept bigint, exact bigint, as_zero bigint", lambda: {"kept": content.to_integer(F.col("value")), "exact": content.to_integer(F.col("value"), False), "as_zero": content.to_integer(F.col("value"), False, True)}, [("12.5", 125, None, None), ("7", 7, 7, 7), ("abc", 0, None, 0), ("", None, None, None), ("-3", -3, -3, -3)])
column_case("boolean_values", "value string, flag boolean", lambda: {"flag": content.to_boolean(F.col("value"))}, [("Yes", True), ("off", False), (" ACTIVE ", True), ("0", False), ("maybe", None), (None, None)])
column_case("text_values", "value string, whole string, cut string", lambda: {"whole": content.to_text(F.col("value")), "cut": content.to_text(F.col("value"), 3)}, [(" abcdef ", "abcdef", "abc"), (" ", None, None), (None, None, None)])
column_case("value_types", "value string, field_type string", lambda: {"field_type": infer.value_type_column(F.col("value"))}, [("12", "Int"), ("-1.5", "Float"), ("2024-01-02", "Date"), ("1/2/2024", "Date"), ("a@b.org", "Email"), ("Yes", "Check"), ("word", "Data"), ("w" * 141, "Text")])
case("value_types_plain", "value string, field_type string", infer.value_type, [("12", "Int"), ("1.", "Float"), ("2024/01/02", "Date"), ("a@b.org", "Email"), ("n", "Check"), ("word", "Data"), ("w" * 141, "Text")])
column_case("error_texts", "message string, category string, severity string, advice string", lambda: {"category": messages.error_category(F.col("message")), "severity": messages.error_severity(F.col("message")), "advice": messages.error_advice(F.col("message"))}, [("Permission denied", "security", "high", "Check the permissions of the user and of the target."), ("?", "system", "medium", "See the log.")])
case("failures", "message string, category string, severity string", lambda m: ((e := messages.ImportFailure(m)).category, e.severity), [("the csv is bad", "file_processing", "medium"), ("duplicate entry", "database", "high"), ("x", "system", "medium")], 2)

# ---- definitions of fields and tables


def _definition(header: str, kind: str, longest: int) -> tuple:
    return infer.field_definition(header, kind, longest)


case("field_definitions", "header string, kind string, longest bigint, field_type string, length bigint", _definition, [("title", "Data", 5, "Data", 30), ("title", "Data", 100, "Data", 110), ("title", "Data", 200, "Text", None), ("title", "Data", 300, "Long Text", None), ("title", "Text", 10, "Long Text", None), ("paid_amount", "Currency", 5, "Data", 140), ("mobile", "Int", 9, "Data", 20), ("notes", "Data", 9, "Long Text", None), ("amount", "Currency", 5, "Currency", None)], 2)
case("unique_fields", "headers string, counts string, total bigint, found string", lambda h, n, t: infer.unique_field([(x, int(k), t) for x, k in zip(h.split("|"), n.split("|"), strict=True)]), [("title|item_code|order_id", "10|9|10", 10, "item_code"), ("title|item_code", "10|8", 10, None), ("reference", "0", 0, None)])


def _wide(n: int) -> tuple:
    fields = infer.table_fields({f"c{i}": ("Data", 140) for i in range(n)})
    own = [d for h, d in fields.items() if h not in infer.SYSTEM_FIELDS]
    return sum(k == "Data" for k, _ in own), sum(k == "Long Text" for k, _ in own), len(fields) - len(own)


case("wide_tables", "n bigint, data bigint, long_text bigint, system_fields bigint", _wide, [(3, 3, 0, 4), (40, 30, 10, 4)], 3)
case("narrow_tables", "headers string, fields string", lambda h: joined(infer.narrow_fields(h.split("|"), 2, 3)), [("color|item_code|weight|total amount|status", "item_code=('Long Text', None); total amount=('Long Text', None); color=('Long Text', None)")])


@stated("column_name string, detected string, field_type string, confidence double", [("price", "Currency", "Currency", 1.0), ("code", "ID", "Data", 1.0), ("day", "Date", "Date", 1.0), ("mail", "Email", "Data", 1.0), ("tel", "Phone", "Phone", 1.0), ("word", "Text", "Data", 0.3), ("half", "Float", "Float", 0.5)])
def scored_types(spark, sf_dir):
    given = {"price": ("$5.00", "7"), "code": ("AB-1234", "XY-99999"), "day": ("2024-01-02", "2025-03-04"), "mail": ("a@b.org", "c@d.org"), "tel": ("+49 170 123456", "+1 (555) 1234"), "word": ("red", "blue"), "half": ("1e5", "x y")}
    return infer.scored_types(spark.createDataFrame([(c, v) for c, vs in given.items() for v in vs], "column_name string, value string"))


@stated("id bigint, field string, value string, field_type string, is_empty boolean", [(1, "a", "x" * 100, "Text", False), (1, "b", "", "Data", True), (2, "a", "3.5", "Float", False), (2, "b", "on", "Check", False)])
def record_fields(spark, sf_dir):
    return infer.record_structure(spark.createDataFrame([(1, "x" * 150, None), (2, "3.5", "on")], "id bigint, a string, b string"), "id")


# ---- matching

case("semantic_similarities", "a string, b string, score double", matching.semantic_similarity, [("item_code", "ref_number", 0.8), ("mobile", "tel", 0.8), ("color", "weight", 0.0)])
case("field_similarities", "a string, b string, score double", lambda a, b: round(matching.field_similarity(a, b), 4), [("code", "code", 1.0), ("city", "city_name", 0.6154), ("zip", "zap", 0.6667), ("item_code", "ref_number", 0.8)])
case("header_mappings", "headers string, fields string, mapping string", lambda h, f: joined(matching.map_headers(h.split("|"), f.split("|"))), [("Item Code|Colour|zzz", "item_code|color", "Item Code=item_code; Colour=color"), ("E-Mail", "email_id|title", "E-Mail=email_id")])
case("primary_columns", "headers string, found string", lambda h: matching.primary_column(h.split("|")), [("Colour|Item Code|Name", "Item Code"), ("colour", None)])
case("layered_mappings", "headers string, mapping string", lambda h: joined(matching.layered_mapping(h.split("|"), "Plan", ["plan_id", "price", "notes"], {"memo": "notes"}, {"fee": "price"})), [("plan id|Cost|Memo|fee|xyz", "plan id=plan_id; Cost=price; Memo=notes; fee=price; xyz=None")])
case("alike_fields", "a string, b string, alike boolean", matching.fields_alike, [("item_name", "item_code", True), ("cost", "price", True), ("color", "price", False)])
case("target_fields", "name string, found string", lambda n: matching.target_field(n, ["email_id", "phone_no", "total"]), [("total_due", "total"), ("work_email", "email_id"), ("phone", "phone_no"), ("totl", "total"), ("zzz", None)])
case("missing_columns", "headers string, statement string", lambda h: matching.add_columns_statement("t", matching.missing_fields(dict.fromkeys(h.split("|")), {"Unit Price": "Currency"})), [("Unit Price|Memo", "ALTER TABLE t ADD COLUMNS (`unit_price` DOUBLE, `memo` STRING)")])
case("mapping_rates", "mapped bigint, unmapped bigint, rate double", lambda m, u: matching.success_rate({**{f"m{i}": "f" for i in range(m)}, **{f"u{i}": None for i in range(u)}}), [(3, 1, 75.0), (0, 0, 0.0)])
case("match_thresholds", "setting double, threshold double", matching.threshold, [(None, 0.8), (80.0, 0.8), (10.0, 0.5), (99.0, 0.95)])
case("domain_mappings", "target string, mapping string", lambda t: joined(matching.domain_mapping(t, {"Order": {"qty": "quantity"}, "Item": {"sku": "item_code"}})), [("Sales Order", "qty=quantity"), ("Item", "sku=item_code"), ("Lead", "")])
PATTERNS = {"Customer": {"required": ("customer",), "optional": ("phone",), "keywords": ("client",), "exclude": ("invoice",)}, "Invoice": {"required": ("invoice",), "optional": ("total",), "keywords": ("bill",), "exclude": ()}}
case("keyword_types_a", "headers string, found string, confidence double, approve boolean", lambda h: matching.keyword_type(h.split("|"), PATTERNS, *matching.CLASSIFIER_A), [("customer_id|phone", "Customer", 100.0, False), ("invoice_no|customer|color|size", "Invoice", 87.5, False), ("color", None, 0.0, True)], 3)
case("keyword_types_b", "headers string, found string, confidence double, approve boolean", lambda h: matching.keyword_type(h.split("|"), PATTERNS, *matching.CLASSIFIER_B), [("customer_id|phone", "Customer", 100.0, False), ("invoice_no|total|a|b", "Invoice", 50.0, True)], 3)
case("proposed_targets", "file string, headers string, target string, confidence double, confirm boolean", lambda f, h: proposals.propose_target(f, h.split("|") if h else []), [("vendor_list.csv", "client|item|zip", "Supplier", 0.8, False), ("my_things.csv", "", "My Things", 0.5, True), ("x.csv", "client|buyer|city|state", "Customer", 0.5, True)], 3)
case("proposed_mappings", "headers string, fields string, mapping string", lambda h, f: joined(proposals.propose_mapping(h.split("|"), f.split("|"), naming.field_name)), [("E Mail|Phone No|zz", "e_mail|zz", "E Mail=e_mail; Phone No=mobile_no; zz=zz")])
case("usual_fields", "header string, field string", proposals.usual_field, [("Customer", "customer_name"), ("Total Amount", "grand_total"), ("Colour", None)])
case("similar_fields", "name string, fields string, found string", lambda n, f: proposals.similar_field(n, f.split("|")), [("Color", "x|color", "color"), ("colour", "color|x_colour_y", "x_colour_y"), ("abcdefgx", "abcdefgh", "abcdefgh"), ("q", "zz", None)])
case("mapped_records", "keys string, mapping string", lambda k: joined(proposals.map_record(k.split("|"), ["item_code", "email"], naming.field_name)), [("Item Code|E-mail 2|??", "Item Code=item_code")])
case("registry_mappings", "stored string, headers string, mapping string", lambda s, h: joined(proposals.registry_mapping(json.loads(s) if s else None, h.split("|"))), [("{\"A\": \"b\"}", "A", "A=b"), (None, "A B|c-d", "A B=a_b; c-d=c_d")])
case("header_contexts", "header string, context string", proposals.context, [("Client Name", "Customer"), ("Stock Item", "Item"), ("zip", "General")])


@stated("source string, target string, score double", [("f", "alpha", 0.5), ("g", "alpha", 1.0)])
def best_schemas(spark, sf_dir):
    """Equal scores go to the least name."""
    headers = spark.createDataFrame([("f", "a"), ("f", "b"), ("g", "a")], "source string, header string")
    fields = spark.createDataFrame([(t, "a") for t in ("delta", "beta", "alpha")], "target string, field string")
    return matching.best_schema(matching.schema_scores(headers, fields), 0.4)


@stated("fingerprint string, target string, similarity double", [("f2", "B", round(4 / 5, 6)), ("f1", "A", round(1 / 5, 6))])
def registry_matches(spark, sf_dir):
    registry = spark.createDataFrame([("f1", ["a"], "A"), ("f2", ["a", "b", "c", " D "], "B"), ("f3", ["x"], "C")], "schema_fingerprint string, headers array<string>, target string")
    found = matching.registry_match(["A", "b", "c", "d", "e"], registry, "f1")
    return found.select(F.col("schema_fingerprint").alias("fingerprint"), "target", F.round("similarity", 6).alias("similarity"))


@stated("file string, schema_fingerprint string, target string", [("x.csv", "p", "A"), ("y.csv", "q", None), ("z.csv", "p", "A")])
def known_patterns(spark, sf_dir):
    seen = spark.createDataFrame([("x.csv", "p"), ("y.csv", "q"), ("z.csv", "p")], "file string, schema_fingerprint string")
    return matching.known_patterns(seen, spark.createDataFrame([("p", "A"), ("r", "B")], "schema_fingerprint string, target string")).select("file", "schema_fingerprint", "target")


@stated("missing string, extra string", [("a; b", "d")])
def header_differences(spark, sf_dir):
    one = spark.createDataFrame([(["a", "b", "c"], ["c", "d"])], "x array<string>, y array<string>")
    missing, extra = matching.differences(F.col("x"), F.col("y"))
    return one.select(F.array_join(missing, "; ").alias("missing"), F.array_join(extra, "; ").alias("extra"))


@stated("target string, custom boolean", [("Mine", True), ("Item", False), ("Item", True)])
def all_types(spark, sf_dir):
    return matching.all_types(spark.createDataFrame([("Mine",), ("Item",)], "target string"), spark.createDataFrame([("Item",)], "target string"))


# ---- keys and identity

case("key_name_scores", "field string, score bigint", identity.name_score, [("customer_id", -100), ("company_name", -100), ("item_code", 80), ("invoice_no", 90), ("email", 85), ("notes", 0)])
case("identifier_fields", "fields string, found string", lambda f: identity.identifier_field([Field(x) for x in f.split("|")]), [("title|code|email", "code"), ("title", None)])


def _kept_fields():
    return [Field("item_code"), Field("email"), Field("notes", indexed=True), Field("parent", "Link"), Field("serial", unique=True), Field("name")]


def _scored_rows(spark):
    return spark.createDataFrame([(str(i), str(i % 2), f"n{i}", f"s{i}") for i in range(10)], "item_code string, email string, notes string, serial string")


@stated("field string, score double", [("item_code", 125.0), ("serial", 100.0), ("email", 60.0), ("notes", 55.0)])
def key_totals(spark, sf_dir):
    return spark.createDataFrame(identity.key_scores(_scored_rows(spark), _kept_fields()), "field string, score double")


@stated("rank bigint, field string", [(0, "item_code"), (1, "serial")])
def matching_keys(spark, sf_dir):
    return spark.createDataFrame(list(enumerate(identity.matching_keys(_scored_rows(spark), _kept_fields()))), "rank bigint, field string")


@stated("name string, kept boolean, n bigint", [("a", False, 1), ("b", False, 1), ("c", True, 1)])
def backfilled_hashes(spark, sf_dir):
    """Equal records get hashes of their own, the same in every run."""
    df = spark.createDataFrame([("b", "x", None), ("a", "x", None), ("c", "x", "kept")], "name string, v string, row_hash string")
    hashed = identity.backfill_hashes(df, ["v"])
    n = hashed.groupBy(F.col("row_hash").alias("h")).agg(F.count("*").alias("n"))
    return hashed.join(n, F.col("row_hash") == F.col("h")).select("name", (F.col("row_hash") == "kept").alias("kept"), "n")


case("fingerprints_with_types", "headers string, same boolean", lambda h: schema_fingerprint(h.split("|"), {"A": "Int"}) == schema_fingerprint(["b", "a"], {"a": "Int"}), [("A| B", True), ("b|a", True), ("a|c", False)])

# ---- merge

_KNOWN = [("R0", "k0", ""), ("R1", "k1", "one@x")]
_BATCH = [(0, "k0", "new@x"), (1, "", "new@x"), (2, "a", "e1"), (3, "b", "e2"), (4, "b", "e1"), (5, "zz", "one@x"), (6, "", ""), (7, "c", "e1"), (8, "c", "e9"), (9, "", "e9")]


def _merge_input(spark, rows):
    df = spark.createDataFrame(rows, "row_index bigint, code string, email string")
    batch = df.withColumns({"row_hash": row_hash(["code", "email"]), "errors": F.array().cast("array<string>"), "new_name": F.concat(F.lit("N"), F.col("row_index").cast("string"))})
    table = spark.createDataFrame(_KNOWN, "name string, code string, email string")
    return batch, table.withColumns({"row_hash": row_hash(["code", "email"]), "last_import_date": F.lit(None).cast("timestamp")})


@stated("row_index bigint, action string, record_name string", [(0, "UPDATE", "R0"), (1, "UPDATE", "R0"), (2, "INSERT", "N2"), (3, "INSERT", "N3"), (4, "UPDATE", "N3"), (5, "UPDATE", "R1"), (6, "INSERT", "N6"), (7, "UPDATE", "N2"), (8, "UPDATE", "N2"), (9, "UPDATE", "N2")])
def upsert_two_keys(spark, sf_dir):
    """The first ranked key decides; values that updates wrote are keys for later rows; chains end at their record."""
    return upsert.decide(*_merge_input(spark, _BATCH), ["code", "email"]).select("row_index", "action", "record_name")


@stated("row_index bigint, action string, record_name string", [(0, "INSERT", "N0"), (1, "SKIP", "N0"), (2, "UPDATE", "N0"), (3, "SKIP", "N0"), (4, "SKIP", "R1")])
def upsert_equal_rows(spark, sf_dir):
    rows = [(0, "a", "e"), (1, "a", "e"), (2, "a", "f"), (3, "a", "f"), (4, "k1", "one@x")]
    return upsert.decide(*_merge_input(spark, rows), ["code", "email"]).select("row_index", "action", "record_name")


@stated("row_index bigint, action string, record_name string", [(0, "INSERT", "N0"), (1, "SKIP", "N0"), (2, "UPDATE", "N0")])
def upsert_strict(spark, sf_dir):
    return upsert.strict(*_merge_input(spark, [(0, "a", "e"), (1, "a", "e"), (2, "a", "f")]), ["code", "email"])


@stated("i bigint, unique_name string", [(1, "a-1"), (2, "a-3"), (3, "a-1-1"), (4, "SKU-0003-1"), (5, None)])
def names_among_taken(spark, sf_dir):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a-1"), (4, "SKU-0003"), (5, None)], "i bigint, base string")
    taken = spark.createDataFrame([("a",), ("a-2",), ("SKU-0003",)], "name string")
    return upsert.numbered_names(rows, "base", "i", taken).select("i", "unique_name")


case("import_advice", "success bigint, updated bigint, skipped bigint, failed bigint, advice string", lambda *n: joined(upsert.recommendations(*n)), [(0, 0, 0, 0, "No rows were processed."), (5, 0, 0, 0, "All rows were imported."), (0, 0, 4, 0, "All rows were imported before."), (1, 2, 0, 1, "1 of 4 rows failed; see their error log.; More records were updated than inserted; check the keys.")])

# ---- state

case("settings_values", "name string, value string, errors bigint", lambda n, v: len(_settings_errors(n, v)), [("chunk_size", "500", 0), ("chunk_size", "50", 1), ("match_threshold", "99", 1), ("max_jobs", "0", 1), ("watch_dir", "x/y", 1), ("watch_dir", "/in", 0), ("auto_create", "no", 0)])


def _settings_errors(name: str, value: str) -> list[str]:
    try:
        config.Settings.load({}, {f"TIDEWELL_{name.upper()}": value})
        return []
    except ValueError as e:
        return str(e).split("; ")


case("remote_modules", "module string, target string, errors bigint, warnings bigint", lambda m, t: tuple(map(len, config.RemoteModule(m, t).problems(["Lead"]))), [("Leads", "Lead", 0, 0), ("Suppliers", "Lead", 0, 0), ("Cases", "Lead", 0, 1), ("", "X", 2, 1)], 2)
case("urls", "value string, is_url boolean", config.is_url, [("https://x.org/a", True), ("http://", False), ("ftp://x", False), ("https://ab c", False)])
case("preflight_checks", "least_disk bigint, problems bigint", lambda n: len(config.preflight("/", n, 0)), [(0, 0), (1 << 62, 1)])


@stated("schema_fingerprint string, source_file string, usage_count bigint", [("p", "a.csv", 2), ("q", "c.csv", 1)])
def registered_schemas(spark, sf_dir):
    registry = spark.createDataFrame([], state.REGISTRY)
    for day, (file, fingerprint) in enumerate((("a.csv", "p"), ("b.csv", "p"), ("c.csv", "q"))):
        registry = state.register_schema(registry, file, fingerprint, ["x"], "T", 1.0, F.lit(f"2024-01-0{day + 1}").cast("timestamp"))
    return registry.select("schema_fingerprint", "source_file", "usage_count")


def _requests(spark):
    at = F.lit("2024-01-02").cast("timestamp")
    schema = spark.createDataFrame([], state.REQUESTS).schema
    made = [state.request(f"{n}.csv", n.title(), {"fields": {c: ["Data", 140] for c in "abcdefg"[:k]}}, 10 * k) | {"request_id": n} for k, n in enumerate(("one", "two", "six"), 1)]
    df = spark.createDataFrame([tuple(m.get(f.name) for f in schema) for m in made], schema)
    df = state.respond(df, "one", "Approved", "me", at=at)
    df = state.respond(df, "one", "Completed", results={"INSERT": 3}, at=at)
    return state.respond(df, "two", "Rejected", "me", reason="no", at=at)


@stated("request_id string, status string, responded_by string, reason string, results string, answered boolean, processed boolean", [("one", "Completed", "me", None, "{\"INSERT\": 3}", True, True), ("two", "Rejected", "me", "no", None, True, False), ("six", "Pending", None, None, None, False, False)])
def request_states(spark, sf_dir):
    return _requests(spark).select("request_id", "status", "responded_by", "reason", "results", F.col("responded_at").isNotNull().alias("answered"), F.col("processed_at").isNotNull().alias("processed"))


@stated("request_id string, status string, field_count int, first_fields string, total_records bigint", [("one", "Completed", 1, "a", 10), ("two", "Rejected", 2, "a; b", 20), ("six", "Pending", 3, "a; b; c", 30)])
def request_lines(spark, sf_dir):
    found = state.request_summaries(_requests(spark))
    return found.select("request_id", "status", "field_count", F.array_join("first_fields", "; ").alias("first_fields"), "total_records")


def _move(before: str, after: str) -> bool:
    return after in state.MOVES[before]


case("request_moves", "before string, after string, allowed boolean", _move, [("Pending", "Approved", True), ("Pending", "Completed", False), ("Approved", "Failed", True), ("Failed", "Approved", True), ("Rejected", "Approved", False), ("Completed", "Failed", False)])


@stated("record_name string, action string, new boolean", [("R1", "Inserted", True), ("R2", "Updated", False)])
def logged_rows(spark, sf_dir):
    decided = spark.createDataFrame([("f", "R1", "h1", "INSERT", {"a": "1"}), ("f", "R2", "h2", "UPDATE", {"a": "2"}), ("f", None, "h3", "FAILED", {})], "source_file string, record_name string, row_hash string, action string, raw map<string,string>")
    entries = state.log_entries(decided, "s", "T")
    fresh = state.new_log_entries(entries, entries.filter("row_hash = 'h2'")).select("row_hash").withColumn("new", F.lit(True))
    return entries.join(fresh, "row_hash", "left").select("record_name", "action", F.coalesce("new", F.lit(False)).alias("new"))


@stated("version bigint, v string", [(1, "first"), (2, "second"), (3, "second"), (3, "third")])
def store_versions(spark, sf_dir):
    """What a table holds after a first version, a replacement and an append."""
    store, out = state.Store(spark, Workspace(spark, "store").path), []
    one = lambda v: spark.createDataFrame([(v,)], "v string")
    store.replace("t", one("first"))
    held = store.read("t")
    out.append(held.withColumn("version", F.lit(1)))
    store.replace("t", one("second"))
    kept = Workspace(spark, "kept")
    out.append(kept.write(store.read("t"), "two").withColumn("version", F.lit(2)))
    store.append("t", one("third"))
    return out[0].unionByName(out[1]).unionByName(store.read("t").withColumn("version", F.lit(3))).select(F.col("version").cast("bigint").alias("version"), "v")


# ---- reports


@stated("files bigint, imported bigint, waiting bigint, failed bigint, automation_rate double", [(4, 2, 1, 1, 50.0)])
def automation_of_files(spark, sf_dir):
    return reports.automation(spark.createDataFrame([("a", "completed"), ("b", "completed"), ("c", "approval_requested"), ("d", "failed")], "file string, status string"))


@stated("target string", [("Item",), ("Lead",)])
def open_catalog(spark, sf_dir):
    types = spark.createDataFrame([("Item", 1), ("Lead", 1), ("Role", 1), ("Old", 0), ("Odd", None)], "target string, is_active int")
    return reports.catalog(types, ("Role", "User")).select("target")


@stated("folder string, files bigint", [("main", 3), ("processed", 1), ("errors", 0), ("pending", 0)])
def folder_statistics(spark, sf_dir):
    folder = _folder(spark)
    folder.move(f"{folder.path}/b.csv", "processed")
    return spark.createDataFrame(list(folder.statistics().items()), "folder string, files bigint")


# ---- files


def _write(spark: SparkSession, path: str, data: bytes) -> str:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    stream.write(bytearray(data))
    stream.close()
    return path


def _folder(spark: SparkSession) -> files.Folder:
    folder = files.Folder(spark, f"{Workspace(spark, 'folder').path}/in")
    folder.create()
    for name in ("b.csv", "a.csv", ".hidden.csv", "notes.txt", "c.CSV"):
        _write(spark, f"{folder.path}/{name}", b"code,v\n1,2\n")
    return folder


@stated("file string", [("a.csv",), ("b.csv",), ("c.CSV",)])
def folder_inputs(spark, sf_dir):
    return spark.createDataFrame([(p.rsplit("/", 1)[-1],) for p in _folder(spark).inputs()], "file string")


@stated("step string, found string", [("lookup", "a.csv"), ("moved", "errors/a.csv"), ("writable", "True"), ("removed", "1"), ("gone", None)])
def folder_life_cycle(spark, sf_dir):
    folder = _folder(spark)
    tail = lambda p: p and p[len(folder.path) + 1 :]
    out = [("lookup", tail(folder.find("a.csv")))]
    folder.move(f"{folder.path}/a.csv", "errors")
    out += [("moved", tail(folder.find("a.csv"))), ("writable", str(folder.writable())), ("removed", str(folder.remove_old(2**62))), ("gone", folder.find("a.csv"))]
    return spark.createDataFrame(out, "step string, found string")


@stated("folder string, file string, length bigint", [("in", "a.csv", 11), ("in", "b.csv", 11), ("in", "c.CSV", 11), ("in", "notes.txt", 11)])
def folder_listing(spark, sf_dir):
    return files.listing(spark, _folder(spark).path, 100).select("folder", "file", "length")


@stated("source string, problems bigint", [("csv", 0), ("rest", 0), ("ftp", 1)])
def connection_checks(spark, sf_dir):
    path = _folder(spark).path
    rest = {"module": "Leads", "transport": "tidewell.sources.rest:ListTransport", "documents": '{"Leads": []}'}
    return spark.createDataFrame([(s, len(files.connection_problems(spark, s, **o))) for s, o in (("csv", {"path": path}), ("rest", rest), ("ftp", {}))], "source string, problems bigint")


@stated("row_index bigint, id string, n string, x string", [(0, "1", "2", "3"), (1, "4", "", ""), (3, " \t", " ", ""), (4, "9", "a\nb", "café")])
def csv_edge_cases(spark, sf_dir):
    """Latin-1 bytes, short, long, empty and blank rows, and a quoted line break."""
    path = _write(spark, f"{Workspace(spark, 'csv').path}/edge.csv", "id , n,x\n1,2,3\n4\n5,6,7,8\n,,\n \t, ,\n9,\"a\nb\",café\n".encode("latin-1"))
    return delimited.read_strings(spark, path).select(F.col("_row_index").alias("row_index"), "id", "n", "x")


case("unique_headers", "headers string, unique_headers string", lambda h: joined(delimited.unique(h.split("|"))), [("a||a", "a; Unnamed: 1; a.1"), ("x|y", "x; y")])


@stated("given string, refused boolean", [("nothing", True), ("a header alone", True), ("another format", True), ("rows", False)])
def csv_failures(spark, sf_dir):
    out, path = [], Workspace(spark, "csv").path
    for given, file, text in (("nothing", "a.csv", ""), ("a header alone", "b.csv", "a,b\n,\n"), ("another format", "c.txt", "a\n1\n"), ("rows", "d.csv", "a\n1\n")):
        try:
            delimited.read_strings(spark, _write(spark, f"{path}/{file}", text.encode()))
            out.append((given, False))
        except messages.ImportFailure:
            out.append((given, True))
    return spark.createDataFrame(out, "given string, refused boolean")


def _documents() -> str:
    return json.dumps({"Leads": [{"id": str(i), "owner": {"n": i}, "modified_time": f"2024-01-0{i}"} for i in range(1, 8)], "Deals": []})


@stated("id string, owner string", [(str(i), f'{{"n": {i}}}') for i in range(1, 8)])
def rest_paged_scan(spark, sf_dir):
    spark.dataSource.register(PagedRest)
    read = spark.read.format("paged_rest").schema("id string, owner string").option("module", "Leads,Deals").option("page_size", "3")
    return read.option("transport", "tidewell.sources.rest:ListTransport").option("documents", _documents()).load()


@stated("id string", [("6",), ("7",)])
def rest_modified_since(spark, sf_dir):
    spark.dataSource.register(PagedRest)
    read = spark.read.format("paged_rest").schema("id string").option("module", "Leads").option("modified_since", "2024-01-06")
    return read.option("transport", "tidewell.sources.rest:ListTransport").option("documents", _documents()).load()


@stated("module string", [("Leads",), ("Deals",)])
def rest_modules(spark, sf_dir):
    found = modules({"transport": "tidewell.sources.rest:ListTransport", "documents": _documents()})
    return spark.createDataFrame([(m,) for m in found], "module string")


# ---- whole imports


def _csv(n: int, **changed: str) -> bytes:
    return ("Item Code,Title,Price,Since\n" + "".join(changed.get(f"r{i}", f"SKU-{i:04d},Thing {i},\"$1,{i:03d}.50\",2024-01-{i + 1:02d}\n") for i in range(n))).encode()


def _importer(spark: SparkSession) -> tuple[Importer, str]:
    path = Workspace(spark, "import").path
    return Importer(spark, f"{path}/store", config.Settings(approval_required=False)), path


def _two_imports(spark: SparkSession) -> tuple[Importer, list]:
    imp, path = _importer(spark)
    file = f"{path}/things_data.csv"
    done = [imp.import_file(_write(spark, file, _csv(4)))]
    done.append(imp.import_file(_write(spark, file, _csv(5, r1="SKU-0001,Renamed,,2024-01-02\n", r2="SKU-0002,Bad,abc,2024-01-03\n"))))
    return imp, done


_HELD: dict[str, tuple] = {}


def _imported(spark: SparkSession) -> tuple[Importer, list]:
    """The same store for all queries of a session that only read it."""
    key = spark.sparkContext.applicationId
    if key not in _HELD:
        _HELD[key] = _two_imports(spark)
    return _HELD[key]


@stated("run bigint, action string, n bigint", [(0, "INSERT", 4), (1, "SKIP", 2), (1, "UPDATE", 1), (1, "FAILED", 1), (1, "INSERT", 1)])
def import_counts(spark, sf_dir):
    return spark.createDataFrame([(i, a, n) for i, r in enumerate(_imported(spark)[1]) for a, n in r.counts.items()], "run bigint, action string, n bigint")


@stated("item_code string, title string, price double, since string, stamped boolean", [("SKU-0000", "Thing 0", 1000.5, "2024-01-01", True), ("SKU-0001", "Renamed", 1001.5, "2024-01-02", True), ("SKU-0002", "Thing 2", 1002.5, "2024-01-03", True), ("SKU-0003", "Thing 3", 1003.5, "2024-01-04", True), ("SKU-0004", "Thing 4", 1004.5, "2024-01-05", True)])
def imported_records(spark, sf_dir):
    records = _imported(spark)[0].records("Things")
    return records.select("item_code", "title", "price", F.col("since").cast("string").alias("since"), (F.col("migration_source").endswith("things_data.csv") & F.col("migration_batch").isNotNull()).alias("stamped"))


@stated("status string, error_type string, n bigint", [("Processed", None, 6), ("Skipped", None, 2), ("Failed", "validation", 1)])
def staging_after_imports(spark, sf_dir):
    return _imported(spark)[0].store.read("staging").groupBy("status", "error_type").agg(F.count("*").alias("n"))


@stated("action string, n bigint", [("Inserted", 5), ("Updated", 1)])
def log_after_imports(spark, sf_dir):
    return _imported(spark)[0].store.read("import_log").groupBy("action").agg(F.count("*").alias("n"))


@stated("column_name string, field_type string, length bigint, is_unique boolean", [("item_code", "Data", 30, True), ("title", "Data", 30, False), ("price", "Currency", None, False), ("since", "Date", None, False)])
def new_table_fields(spark, sf_dir):
    imp, path = _importer(spark)
    analysis = imp.analyse(delimited.read_strings(spark, _write(spark, f"{path}/t.csv", _csv(20))))
    return spark.createDataFrame([(f.name, f.kind, f.length, f.unique) for f in imp.fields_of(analysis)], "column_name string, field_type string, length bigint, is_unique boolean")


@stated("status string, target string", [("approval_requested", "Things"), ("completed", "Things")])
def approved_request(spark, sf_dir):
    path = Workspace(spark, "import").path
    imp = Importer(spark, f"{path}/store")
    asked = imp.import_file(_write(spark, f"{path}/things_data.csv", _csv(3)))
    imp.respond(asked.message, "Approved", "me")
    return spark.createDataFrame([(r.status, r.target) for r in (asked, *imp.drain_requests())], "status string, target string")


@stated("status string, left_in bigint, processed bigint, errors bigint", [("completed", 0, 2, 1), ("completed", 0, 2, 1), ("failed", 0, 2, 1)])
def import_folder(spark, sf_dir):
    imp, path = _importer(spark)
    for name, data in (("a.csv", _csv(2)), ("b.csv", _csv(3)), ("c.csv", b"")):
        _write(spark, f"{path}/in/{name}", data)
    found = imp.import_folder(f"{path}/in")
    n = files.Folder(spark, f"{path}/in").statistics()
    return spark.createDataFrame([(r.status, n["main"], n["processed"], n["errors"]) for r in found], "status string, left_in bigint, processed bigint, errors bigint")


@stated("item_code string, title string", [("SKU-0000", "Thing 0"), ("SKU-0001", "Renamed"), ("SKU-0002", "Thing 2"), ("SKU-0003", "Thing 3")])
def stream_import(spark, sf_dir):
    """Two files that a stream brings, one after the other, and once more the same checkpoint, which brings nothing."""
    imp, path = _importer(spark)
    imp.create_table("Thing", [Field("item_code", unique=True), Field("title"), Field("price", "Currency"), Field("since", "Date")])
    _write(spark, f"{path}/in/1.csv", _csv(3))
    for k in range(3):
        if k == 1:
            _write(spark, f"{path}/in/2.csv", _csv(4, r1="SKU-0001,Renamed,,2024-01-02\n"))
        watch.import_stream(imp, f"{path}/in", f"{path}/checkpoint", "Thing").awaitTermination(300)
    return imp.records("Thing").select("item_code", "title")


@stated("left_over bigint, requests bigint", [(0, 0)])
def cleaned_store(spark, sf_dir):
    imp = _two_imports(spark)[0]
    imp.store.replace("requests", _requests(spark).filter("status = 'Rejected'"))
    imp.clean(F.lit("2999-01-01").cast("timestamp"))
    left = imp.store.read("staging").filter("status != 'Failed'").count(), imp.store.read("requests").count()
    return spark.createDataFrame([left], "left_over bigint, requests bigint")


# ---- validation and profiles of small tables


@stated("row bigint, error_log string", [(0, "Missing required field: s; Invalid float in n: x; Missing required field: q; Invalid phone in p: 12345"), (1, "Value of s is longer than 3; Customer in c doesn't exist"), (2, "")])
def validation_messages(spark, sf_dir):
    rows = spark.createDataFrame([(0, "", "x", "0", "12345", ""), (1, "abcd", "5", "3", "", "nobody"), (2, "a", "5", "3", "123-456-7890", " c1 ")], "row bigint, s string, n string, q string, p string, c string")
    fields = [Field("s", required=True, length=3), Field("n", "Float"), Field("q", "Int", required=True), Field("p", "Phone"), Field("c", "Link", link="Customer")]
    return validation.validate(rows, fields, {"Customer": spark.createDataFrame([("c1 ",)], "name string")}, legacy=False).select("row", "error_log")


@stated("column_name string, null_count bigint, unique_count bigint, sample_max_length bigint, any_currency boolean, any_phone boolean, any_email boolean, samples string", [("a", 1, 3, 7, True, False, True, "$5; a@b.org; $5"), ("b", 4, 1, None, None, None, None, None)])
def column_structure(spark, sf_dir):
    df = spark.createDataFrame([(0, "$5", ""), (1, None, ""), (2, "a@b.org", ""), (3, "$5", None)], "at bigint, a string, b string")
    return profile.structure(df, "at").withColumn("samples", F.array_join("samples", "; ")).select("column_name", "null_count", "unique_count", "sample_max_length", "any_currency", "any_phone", "any_email", "samples")
