"""Which fields identify a record, and which record a row belongs to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.hashing import row_hash
from tidewell.functions.strings import filled, strip
from tidewell.operators.profile import counted_score, estimated_scores, sketches

#: Fixed values.
EXCLUDED = ("customer_id", "supplier_id", "user_id", "contact_id", "company_id", "parent_id", "owner_id", "created_by", "modified_by")
FOREIGN = (("customer", "supplier", "contact", "user", "company", "parent", "owner"), ("_id", "_name"))
KEY_WORDS = (
    (80, ("_code", "_number", "_id", "sku", "barcode", "serial", "_no", "item_code")),
    (90, ("reference", "invoice_no", "po_number", "transaction_id", "order_id", "voucher_no", "receipt_no", "bill_no")),
    (85, ("email", "phone", "mobile", "tax_id", "registration_no", "pan", "gstin", "ein", "ssn")),
)
MATCH_FROM, BEST_UNIQUENESS = 70.0, 90


@dataclass(frozen=True)
class Field:
    """What is known of a target's column."""

    name: str
    kind: str = "Data"
    unique: bool = False
    indexed: bool = False
    required: bool = False
    link: str | None = None
    length: int | None = None


def name_score(field: str) -> int:
    """-100 for references to other records, else the best of the key words' scores, 0 without any."""
    low = field.lower()
    if low in EXCLUDED or (low.endswith(FOREIGN[1]) and any(w in low for w in FOREIGN[0])):
        return -100
    return max((s for s, words in KEY_WORDS if any(w in low for w in words)), default=0)


def key_scores(target: DataFrame, fields: list[Field], kept: DataFrame | None = None) -> list[tuple[str, float]]:
    """(field, score) of the candidates, best first, frozen for a whole batch.

    Values aren't counted but sketched, all columns in one aggregate, or by sketches that are ``kept`` of the target's
    parts; only a column whose score the sketch leaves open is counted.
    """
    open_ = [f.name for f in fields if not f.unique and f.kind not in ("Link", "Dynamic Link", "Table") and f.name != "name"]
    data: dict[str, int] = {}
    if open_:
        known = sketches(target, open_) if kept is None else kept.filter(F.col("column_name").isin(open_))
        data = {c: 0 for c in open_} | {r["column_name"]: r["score"] for r in estimated_scores(known).collect()}  # a row a column
        data = {c: counted_score(target, c) if s is None else s for c, s in data.items()}
    out = []
    for f in fields:
        if f.name == "name" or f.kind in ("Link", "Dynamic Link", "Table") and not f.unique:
            continue
        score = 100.0 if f.unique else name_score(f.name) + 0.5 * data[f.name] + 10 * f.indexed
        if score > 0:
            out.append((f.name, score))
    return sorted(out, key=lambda x: -x[1])  # stable: equal scores keep the order of the fields


def key_candidates(fields: list[Field]) -> list[Field]:
    """The fields that could reach the score of a key."""
    return [f for f in fields if f.unique or name_score(f.name) + 0.5 * BEST_UNIQUENESS + 10 * f.indexed >= MATCH_FROM]


def matching_keys(target: DataFrame, fields: list[Field], kept: DataFrame | None = None) -> list[str]:
    """The fields that rows are matched by; only those that could reach the score are looked at."""
    return [name for name, score in key_scores(target, key_candidates(fields), kept) if score >= MATCH_FROM]


def match_by_hash(rows: DataFrame, target: DataFrame) -> DataFrame:
    """``rows`` with ``hash_match``: the record with their row_hash."""
    build = target.filter("row_hash is not null").groupBy(F.col("row_hash").alias("_h")).agg(F.min("name").alias("hash_match"))
    return rows.join(build, F.col("row_hash") == F.col("_h"), "left").drop("_h")


def match_by_keys(rows: DataFrame, target: DataFrame, keys: list[str], each: bool = False) -> DataFrame:
    """``rows`` with ``key_match``: the record that the first of the ranked keys finds; the least name of equals.

    With ``each``, what every key finds stays as ``_m0``, ``_m1`` and so on.
    """
    found: list[Column] = []
    for i, k in enumerate(keys):
        build = target.select(filled(F.col(f"`{k}`").cast("string")).alias(f"_k{i}"), "name").filter(f"_k{i} is not null").groupBy(f"_k{i}").agg(F.min("name").alias(f"_m{i}"))
        rows = rows.join(build, filled(F.col(f"`{k}`").cast("string")) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
        found.append(F.col(f"_m{i}"))
    out = rows.withColumn("key_match", F.coalesce(*found, F.lit(None).cast("string")) if found else F.lit(None).cast("string"))
    return out if each else out.drop(*[f"_m{i}" for i in range(len(keys))])


def match_by_identifier(rows: DataFrame, target: DataFrame, row_key: str, target_key: str) -> DataFrame:
    """``rows`` with ``identifier_match``: case-insensitive on the stripped identifier; the greatest name of equals."""
    build = target.select(F.lower(strip(F.col(target_key).cast("string"))).alias("_i"), "name").filter("_i != ''").groupBy("_i").agg(F.max("name").alias("identifier_match"))
    return rows.join(build, F.lower(strip(F.col(row_key).cast("string"))) == F.col("_i"), "left").drop("_i")


def identifier_field(fields: list[Field]) -> str | None:
    """The first field that is unique or called like an identifier."""
    return next((f.name for f in fields if f.unique or f.name in ("name", "id", "code", "email", "email_id")), None)


def already_imported(rows: DataFrame, log: DataFrame) -> DataFrame:
    """The rows whose (row_hash, target) is in the import log."""
    return rows.join(log.select("row_hash", "target").distinct(), ["row_hash", "target"], "left_semi")


def changed_fields(columns: list[str], old: str = "old", new: str = "new") -> Column:
    """Array of the fields with a new value that isn't empty and differs from the old one, stripped."""
    tests = []
    for c in columns:
        if c != "name":
            o, n = strip(F.coalesce(F.col(f"{old}.`{c}`").cast("string"), F.lit(""))), strip(F.coalesce(F.col(f"{new}.`{c}`").cast("string"), F.lit("")))
            tests.append(F.when((n != "") & (n != o), F.lit(c)))
    return F.array_compact(F.array(*tests))


def backfill_hashes(table: DataFrame, columns: list[str], exact: bool = False) -> DataFrame:
    """``table`` with a row_hash for records that lack one.

    Equal records get different hashes by their number in the order of names, so hashes are the same in every run.
    With ``exact`` values count as they are, and a record with a null gets none.
    """
    own = row_hash(columns, exact=exact)
    # Records that get no hash need no number, so they aren't one group.
    place = F.row_number().over(Window.partitionBy(own, F.when(own.isNull(), F.col("name"))).orderBy("name")) - 1
    return table.withColumn("_at", place).withColumn("row_hash", F.coalesce("row_hash", row_hash(columns, F.col("_at"), exact))).drop("_at")
