"""Idempotent merge of a batch of rows into a table of records.

Each row is skipped (its hash is known), updates a record (a ranked key finds
one), inserts one, or fails validation.  Within a batch, order counts: the first
row of a new key inserts and later ones update that record, and of rows with one
hash all but the first are skipped.  Keys are ranked once for a batch, and a value
keeps finding the record that had it first.

Defined cases: a null or blank key finds nothing; rows without a hash are never
skipped; ``row_index`` and ``new_name`` are unique within the batch; an empty batch
or table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidewell.functions.strings import filled
from tidewell.operators.identity import match_by_hash, match_by_keys
from tidewell.workspace import Workspace

ACTIONS = ("INSERT", "UPDATE", "SKIP", "FAILED")
SYSTEM = ("row_hash", "last_import_date")


def decide(rows: DataFrame, target: DataFrame, keys: list[str], log: DataFrame | None = None) -> DataFrame:
    """``rows`` (with row_index, row_hash, errors and new_name) with ``action`` and ``record_name``, as a fold over them in order gives.

    ``log`` (row_hash, record_name) holds rows that were imported at some time: they are skipped too, though a later row may have changed
    their record since.

    A join a key with the target; then, for each key, the first row of every value that the target lacks, by one
    aggregate over narrow rows that is joined back.  The first ranked key that finds a record or an earlier row decides.
    """
    work = Workspace(rows.sparkSession, "upsert")
    hashes = target.select("name", "row_hash")
    if log is not None:
        hashes = hashes.unionByName(log.select(F.col("record_name").alias("name"), "row_hash"))
    matched = work.write(match_by_keys(match_by_hash(rows, hashes), target, keys, each=True), "matched")
    row = F.struct(F.col("row_index").cast("bigint").alias("row_index"), F.col("new_name").cast("string").alias("new_name"))
    sound = matched.filter((F.size("errors") == 0) & F.col("hash_match").isNull())
    first = sound.filter("row_hash is not null").groupBy("row_hash").agg(F.min(row).alias("_first"))
    twins = sound.select("row_index", "row_hash").join(first, "row_hash").filter(F.col("_first.row_index") < F.col("row_index")).select(F.col("row_index").alias("_t"), F.col("_first.new_name").alias("_twin"))
    out = work.write(matched.join(twins, F.col("row_index") == F.col("_t"), "left").drop("_t"), "rows")
    live = out.filter((F.size("errors") == 0) & F.col("hash_match").isNull() & F.col("_twin").isNull())
    hits = []
    for i, k in enumerate(keys if len(keys) > 1 else []):
        own = live.filter(F.col(f"_m{i}").isNull()).withColumn("_value", filled(F.col(f"`{k}`").cast("string"))).filter("_value is not null")
        leads = own.groupBy("_value").agg(F.min(row).alias("_lead"))
        hits.append(own.select("row_index", "_value").join(leads, "_value").filter(F.col("_lead.row_index") < F.col("row_index")).select("row_index", F.struct(F.lit(i).alias("rank"), F.col("_lead.new_name").alias("name")).alias("hit")))
    found = F.lit(None).cast("string")
    if len(keys) == 1:
        # One key decides alone, so rows meet the first of their value at once. Rows without a value are dealt by their place.
        value = filled(F.col(f"`{keys[0]}`").cast("string"))
        open_ = live.filter("_m0 is null").withColumn("_value", value)
        leads = open_.filter("_value is not null").groupBy("_value").agg(F.min(row).alias("_lead")).select("_value", F.lit(0).cast("bigint").alias("_salt"), "_lead")
        valued = out.withColumn("_value", value).withColumn("_salt", F.when(F.col("_value").isNull(), F.col("row_index")).otherwise(0).cast("bigint"))
        out = valued.join(leads, ["_value", "_salt"], "left").drop("_value", "_salt")
        found = F.coalesce("_m0", F.when(F.col("_lead.row_index") < F.col("row_index"), F.col("_lead.new_name")))
    elif keys:
        best = reduce(DataFrame.unionByName, hits).groupBy(F.col("row_index").alias("_t")).agg(F.min("hit").alias("_hit"))
        out = out.join(best, F.col("row_index") == F.col("_t"), "left").drop("_t")
        found = F.coalesce(*[x for i in range(len(keys)) for x in (F.col(f"_m{i}"), F.when(F.col("_hit.rank") == i, F.col("_hit.name")))])
    action = F.when(F.size("errors") > 0, "FAILED").when(F.coalesce("hash_match", "_twin").isNotNull(), "SKIP").when(found.isNotNull(), "UPDATE").otherwise("INSERT")
    name = F.when(F.size("errors") > 0, F.lit(None)).otherwise(F.coalesce("hash_match", "_twin", found, "new_name"))
    out = out.withColumns({"action": action, "record_name": name})
    out = out.drop("hash_match", "key_match", "_twin", "_hit", "_lead", *[f"_m{i}" for i in range(len(keys))])
    # A row that others follow may itself follow another one by another key; with one key it is the first of its value, and inserted.
    return _followed(out, work) if len(keys) > 1 else out


def _followed(decided: DataFrame, work: Workspace) -> DataFrame:
    """Rows that follow a row which became an update get the record that was inserted or found.

    The links are written and doubled in reach until none moves, so chains of any length end at their record.
    """
    decided, i = work.write(decided, "decided"), 0
    updates = decided.filter("action = 'UPDATE' and new_name != record_name")
    if updates.join(decided.filter("action != 'FAILED'").select(F.col("new_name").alias("_n")), F.col("record_name") == F.col("_n"), "left_semi").isEmpty():
        return decided  # all updates are of records that were there before
    links = work.write(updates.select(F.col("new_name").alias("_n"), F.col("record_name").alias("_to")), "links-0")
    while True:
        hops = links.select(F.col("_n").alias("_m"), F.col("_to").alias("_next"))
        longer = work.write(links.select("_n", "_to").join(hops, F.col("_to") == F.col("_m"), "left").select("_n", F.coalesce("_next", "_to").alias("_to"), F.col("_next").isNotNull().alias("_moved")), f"links-{i + 1}")
        work.drop(f"links-{i}")
        links, i = longer, i + 1
        if links.filter("_moved").isEmpty():
            break
        if i > 64:  # rows only follow earlier ones
            raise ValueError("rows follow each other in a circle; new_name must be unique")
    work.drop("matched")
    work.drop("rows")
    return decided.join(links.drop("_moved"), F.col("record_name") == F.col("_n"), "left").withColumn("record_name", F.coalesce("_to", "record_name")).drop("_n", "_to")


def merge(decided: DataFrame, target: DataFrame, columns: list[str], imported_at, **stamps: Column) -> DataFrame:
    """The table after the batch: untouched, updated and inserted records.

    Per record and field the last filled value wins; an empty value never overwrites.  ``stamps`` are further
    columns of the target that records of the batch get.
    """
    changes = decided.filter(F.col("action").isin("INSERT", "UPDATE")).groupBy(F.col("record_name").alias("_name"))
    newest = [F.max(F.when(filled(F.col(f"`{c}`").cast("string")).isNotNull(), F.struct("row_index", F.col(f"`{c}`").alias("v")))).getField("v").alias(f"_{c}") for c in columns]
    last = changes.agg(*newest, F.max_by("row_hash", "row_index").alias("_row_hash"))
    both = target.join(last, F.col("name") == F.col("_name"), "full_outer")
    values = [F.coalesce(F.col(f"`_{c}`"), F.col(f"`{c}`")).alias(c) for c in columns]
    date = F.when(F.col("_name").isNotNull(), imported_at).otherwise(F.col("last_import_date"))
    stamped = [F.when(F.col("_name").isNotNull(), v).otherwise(F.col(c)).alias(c) for c, v in stamps.items()]
    return both.select(F.coalesce("name", "_name").alias("name"), *values, F.coalesce("_row_hash", "row_hash").alias("row_hash"), date.alias("last_import_date"), *stamped)


def observed(decided: DataFrame, seen: Observation) -> DataFrame:
    """``decided``; the job that writes it counts its rows by action."""
    return decided.observe(seen, *[F.count(F.when(F.col("action") == a, 1)).alias(a) for a in ACTIONS])


def observed_counts(seen: Observation) -> dict[str, int]:
    """Rows by action, of those that occur."""
    return {a: n for a, n in seen.get.items() if n}


def counts(decided: DataFrame) -> DataFrame:
    """(action, rows) of the batch."""
    return decided.groupBy("action").agg(F.count("*").alias("rows"))


def strict(rows: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """(row_index, action, record_name) by a fold over the rows in order, in one task: exact for any chain of keys.

    For small batches and as the yardstick of :func:`decide`; a large batch doesn't fit.
    """
    known = target.select("name", "row_hash", *[F.col(f"`{k}`").cast("string").alias(k) for k in keys]).toPandas()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = dict(zip(known["row_hash"], known["name"], strict=True))
        by: list[dict] = [{} for _ in keys]
        for _, r in known.sort_values("name", ascending=False).iterrows():
            for i, k in enumerate(keys):
                if isinstance(r[k], str) and r[k].strip():
                    by[i][r[k].strip()] = r["name"]
        table = pd.concat(list(batches)).sort_values("row_index")
        out = []
        for _, r in table.iterrows():
            values = [r[k].strip() if isinstance(r[k], str) else "" for k in keys]
            hit = next((by[i][v] for i, v in enumerate(values) if v and v in by[i]), None)
            if len(r["errors"]):
                out.append((r["row_index"], "FAILED", None))
                continue
            if r["row_hash"] in hashes:
                out.append((r["row_index"], "SKIP", hashes[r["row_hash"]]))
                continue
            name = hit or r["new_name"]
            if isinstance(r["row_hash"], str):
                hashes[r["row_hash"]] = name
            for i, v in enumerate(values):
                if v:
                    by[i].setdefault(v, name)
            out.append((r["row_index"], "UPDATE" if hit else "INSERT", name))
        yield pd.DataFrame(out, columns=["row_index", "action", "record_name"])

    wanted = rows.select("row_index", "row_hash", "new_name", "errors", *[F.col(f"`{k}`").cast("string").alias(k) for k in keys])
    return wanted.repartition(1).mapInPandas(fold, "row_index long, action string, record_name string")


def numbered(rows: DataFrame, keys: list[str], order: list[str], into: str) -> DataFrame:
    """``rows`` with their number (from 0) among those with equal ``keys``, by ``order``.

    Rows are dealt to ranges of (keys, order), numbered within a range and key, and get the counts of the ranges before added, so a
    key that most rows share takes as many tasks as others.  Rows at equal places are numbered in any order.
    """
    work = Workspace(rows.sparkSession, "numbered")
    dealt = rows.repartitionByRange(*keys, *order) if keys or order else rows
    held = work.write(dealt.sortWithinPartitions(*keys, *order).withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "rows")
    counts = held.groupBy("_range", *keys).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    # One row for each range, and for each key within it: the least place of a key in its range is its first.
    before = counts.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), "_first", (F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range")) - F.col("_n")).alias("_before"))
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}"))
    return held.join(before, same).select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias(into))


def numbered_names(rows: DataFrame, base: str, order: str, taken: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``unique_name``: base, base-1, base-2 ... in order, each the first that is free among taken names (name).

    Where two bases come to one name, the earlier row has it and the other takes its next one, until none
    collides.  A null base has no name.
    """
    work, i = Workspace(rows.sparkSession, "names"), 0
    rows = work.write(rows.withColumn("_id", F.monotonically_increasing_id()), "rows")
    open_ = rows.select("_id", F.col(base).alias("_b"), F.col(order).alias("_o")).filter("_b is not null")
    names = taken.select("name").filter("name is not null").distinct() if taken is not None else rows.sparkSession.createDataFrame([], "name string")
    done = None
    while True:
        named = work.write(_first_free(open_, names), f"named-{i}")
        firsts = named.groupBy(F.col("_name").alias("_f")).agg(F.min(F.struct("_o", "_id")).alias("_w"))
        judged = work.write(named.join(firsts, F.col("_name") == F.col("_f")).select("_id", "_b", "_o", "_name", (F.col("_id") == F.col("_w._id")).alias("_won")), f"judged-{i}")
        won, open_ = judged.filter("_won").select("_id", F.col("_name").alias("unique_name")), judged.filter("not _won").select("_id", "_b", "_o")
        done = won if done is None else done.unionByName(won)
        if open_.isEmpty():
            return rows.join(done, "_id", "left").drop("_id")
        names, i = names.unionByName(won.select(F.col("unique_name").alias("name"))), i + 1


def _first_free(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``rows`` (_id, _b, _o) with _name: the n-th row of a base gets its n-th number that isn't taken (0: the base alone)."""
    split = names.filter(F.col("name").rlike("-[1-9][0-9]{0,17}$")).select(F.regexp_extract("name", "^(.*)-[0-9]+$", 1).alias("_b"), F.regexp_extract("name", "-([0-9]+)$", 1).cast("bigint").alias("_n"))
    used = names.select(F.col("name").alias("_b"), F.lit(0).cast("bigint").alias("_n")).unionByName(split).distinct().join(rows.select("_b").distinct(), "_b", "left_semi")
    wanted = numbered(rows, ["_b"], ["_o", "_id"], "_p")
    used = Workspace(rows.sparkSession, "used").write(used, "used")
    if used.isEmpty():  # no base has a taken name
        return _named(wanted.withColumn("_n", F.col("_p")))
    # The j-th taken number t stands before t - j free ones; so many taken numbers precede the n-th free one as have t - j <= n.
    # Both are numbered by ranges, so a base that most rows share isn't one task; then the gaps before a row are those among both, in their order.
    gaps = numbered(used, ["_b"], ["_n"], "_j").select("_b", (F.col("_n") - F.col("_j")).alias("_p"), F.lit(0).alias("_kind"))
    both = numbered(wanted.withColumn("_kind", F.lit(1)).unionByName(gaps, allowMissingColumns=True), ["_b"], ["_p", "_kind"], "_place")
    # Of the rows at places up to its own, p come before a row; the rest are gaps.
    return _named(both.filter("_kind = 1").withColumn("_n", F.col("_place")))


def _named(found: DataFrame) -> DataFrame:
    """(_id, _b, _o, _name) of rows with their number _n."""
    return found.select("_id", "_b", "_o", F.when(F.col("_n") == 0, F.col("_b")).otherwise(F.concat("_b", F.lit("-"), F.col("_n").cast("string"))).alias("_name"))


def recommendations(success: int, updated: int, skipped: int, failed: int) -> list[str]:
    total = success + updated + skipped + failed
    out = []
    if not total:
        return ["No rows were processed."]
    if failed:
        out.append(f"{failed} of {total} rows failed; see their error log.")
    if skipped == total:
        out.append("All rows were imported before.")
    elif skipped > total / 2:
        out.append("Most rows were imported before; import only what is new.")
    if updated > success:
        out.append("More records were updated than inserted; check the keys.")
    return out or ["All rows were imported."]
