"""Reports over staging, audit and request tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.strings import like_escaped


def where(conditions: dict) -> Column:
    """The conjunction of equalities; None values don't restrict, lists mean any of."""
    tests = [F.col(k).isin(v) if isinstance(v, list | tuple) else F.col(k) == v for k, v in conditions.items() if v is not None]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def staging_status(staging: DataFrame) -> DataFrame:
    """Rows, first creation and last processing by status and target."""
    return staging.groupBy("status", "target").agg(F.count("*").alias("rows"), F.min("created_at").alias("first_created"), F.max("processed_at").alias("last_processed")).orderBy("target", "status")


def staging_marginals(staging: DataFrame) -> DataFrame:
    """Rows in all, by status, and by target and status, in one pass; ``level`` tells them apart (0: target and status, 2: status, 3: all)."""
    staging.createOrReplaceTempView("_staging_marginals")
    return staging.sparkSession.sql("SELECT target, status, CAST(2 * grouping(target) + grouping(status) AS INT) AS level, count(*) AS rows FROM _staging_marginals GROUP BY GROUPING SETS ((), (status), (target, status))")


def status_of(staging: DataFrame, target: str) -> DataFrame:
    """Rows by status of one target, and their total (null status)."""
    return staging.filter(F.col("target") == target).rollup("status").agg(F.count("*").alias("rows"))


def import_statistics(log: DataFrame, target: str | None = None, source: str | None = None) -> DataFrame:
    """Imports, different rows, first and latest import by target and source."""
    kept = log.filter(where({"target": target, "source_file": source}))
    return kept.groupBy("target", "source_file").agg(F.count("*").alias("imports"), F.count_distinct("row_hash").alias("unique_rows"), F.min("import_timestamp").alias("first_import"), F.max("import_timestamp").alias("latest_import"))


def import_totals(statistics: DataFrame) -> DataFrame:
    """By target: imports, sources and the latest import."""
    return statistics.groupBy("target").agg(F.sum("imports").alias("imports"), F.count_distinct("source_file").alias("sources"), F.max("latest_import").alias("latest_import"))


def recent(df: DataFrame, time: str, n: int = 10) -> DataFrame:
    return df.orderBy(F.desc(time)).limit(n)


def rates(counters: DataFrame) -> DataFrame:
    """Of (success, updated, skipped, failed): total and success rate in percent (null without rows)."""
    total = F.col("success") + F.col("updated") + F.col("skipped") + F.col("failed")
    return counters.withColumn("total", total).withColumn("success_rate", F.round((F.col("success") + F.col("updated") + F.col("skipped")) * 100.0 / F.nullif(total, F.lit(0)), 2))


def most_frequent(df: DataFrame, column: str) -> DataFrame:
    """The value with most rows, the least of equals, and its share."""
    by = df.groupBy(column).agg(F.count("*").alias("n"))
    return by.agg(F.min_by(column, F.struct(-F.col("n"), column)).alias(column), F.max("n").alias("n"), F.sum("n").alias("total")).withColumn("share", F.round(F.col("n") / F.col("total"), 6))


def search(df: DataFrame, columns: list[str], text: str, order: list[Column], n: int = 100) -> DataFrame:
    """Rows with ``text`` in any of the columns (nulls count as empty)."""
    found = reduce(lambda a, b: a | b, [like_escaped(F.coalesce(F.col(c).cast("string"), F.lit("")), text) for c in columns])
    return df.filter(found).orderBy(*order).limit(n)


def catalog(types: DataFrame, excluded: tuple[str, ...] = (), active_only: bool = True) -> DataFrame:
    """The types (target, is_active) that a user may choose: active ones, without those that are excluded."""
    kept = types.filter(F.coalesce(F.col("is_active").cast("boolean"), F.lit(False))) if active_only else types
    return kept.filter(~F.col("target").isin(list(excluded))) if excluded else kept


def automation(files: DataFrame) -> DataFrame:
    """Of files (file, status): how many there are, were imported, wait for approval and failed, and the share imported, in percent (0 without files)."""
    n = lambda *s: F.count(F.when(F.col("status").isin(*s), 1))
    counted = files.agg(F.count("*").alias("files"), n("completed").alias("imported"), n("approval_requested").alias("waiting"), n("failed").alias("failed"))
    return counted.withColumn("automation_rate", F.round(F.coalesce(F.col("imported") * 100.0 / F.nullif(F.col("files"), F.lit(0)), F.lit(0.0)), 2))


def users_with_roles(users: DataFrame, roles: DataFrame, wanted: tuple[str, ...] = ()) -> DataFrame:
    """The different (user, role) pairs of users (user, enabled) that are enabled, of the wanted roles if any are given."""
    held = roles.filter(F.col("role").isin(list(wanted))) if wanted else roles
    return users.filter(F.col("enabled").cast("boolean")).select("user").join(held.select("user", "role"), "user").distinct()


def users_of_roles(users: DataFrame, roles: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """The users (user, ...) with any of the roles, each once."""
    return users.join(roles.filter(F.col("role").isin(list(wanted))).select("user").distinct(), "user", "left_semi")


def record_counts(types: DataFrame, records: DataFrame) -> DataFrame:
    """Each type (target) with the number of its records."""
    by = records.groupBy("target").agg(F.count("*").alias("records"))
    return types.join(by, "target", "left").withColumn("records", F.coalesce("records", F.lit(0)))
