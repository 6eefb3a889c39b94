"""State as Parquet tables: staging, import log, schema registry, creation requests, records.

A table is a set of parts, folders of files that are never changed.  A small numbered manifest names the
parts (the highest number holds) and appears by one rename, so readers never see half a write and a lost
executor costs a task, not the table.  Replacing some parts, appending or replacing all is the same: new folders and
a new manifest; other parts' files are neither read nor written.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Collection
from datetime import UTC, datetime
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewell.functions.strings import strip

STAGING = "run_id string, source_file string, target string, row_index long, raw map<string,string>, status string, retry_count int, priority string, error_log string, error_type string, created_at timestamp, processed_at timestamp"
IMPORT_LOG = "import_session string, source_file string, target string, record_name string, row_hash string, import_timestamp timestamp, action string, raw_data_preview string, error_message string"
REGISTRY = "source_file string, schema_fingerprint string, headers array<string>, target string, confidence double, usage_count long, created_date timestamp, last_used timestamp"
REQUESTS = "request_id string, source_file string, suggested string, analysis string, field_count int, total_records long, status string, user_response string, final string, results string, reason string, created_at timestamp, responded_at timestamp, processed_at timestamp, created_by string, responded_by string"
PREVIEW_CHARS = 1000
MOVES = {
    "Pending": ("Approved", "Rejected", "Redirected"),
    "Approved": ("Completed", "Failed"),
    "Redirected": ("Completed", "Failed"),
    "Failed": ("Approved", "Redirected"),
    "Rejected": (),
    "Completed": (),
}


class Store:
    """Tables below one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _pointers(self, name: str) -> list[str]:
        """Names of the pointer files, oldest first."""
        folder = self._at(name)
        return sorted(x for s in self._fs.listStatus(folder) if (x := s.getPath().getName()).startswith("_V-")) if self._fs.exists(folder) else []

    def _pointed(self, name: str, pointer: str) -> dict:
        stream = self._fs.open(self._at(name, pointer))
        try:
            return json.loads(self._jvm.java.io.BufferedReader(self._jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine())
        finally:
            stream.close()

    def current(self, name: str) -> dict | None:
        """The manifest: the schema, and the folders of each part by its key."""
        found = self._pointers(name)
        return self._pointed(name, found[-1]) if found else None

    def parts(self, name: str) -> dict[str, list[str]]:
        """Key to folders."""
        return (self.current(name) or {"parts": {}})["parts"]

    def read(self, name: str, schema: str | None = None, parts: Callable[[str], bool] | None = None) -> DataFrame | None:
        """The table, or the parts whose keys are wanted; an empty one of ``schema`` where there is none yet."""
        now = self.current(name)
        if now is None:
            return self.spark.createDataFrame([], schema) if schema else None
        kept = StructType.fromJson(now["schema"])
        folders = [f"{self.path}/{name}/{f}" for k, fs in now["parts"].items() if parts is None or parts(k) for f in fs]
        return self.spark.read.schema(kept).parquet(*folders) if folders else self.spark.createDataFrame([], kept)

    def _written(self, name: str, df: DataFrame, by: Column | None) -> dict[str, list[str]]:
        """New folders: one, or one for each value of ``by`` (a text)."""
        version = uuid.uuid4().hex
        if by is None:
            df.write.parquet(f"{self.path}/{name}/{version}")
            return {version: [version]}
        df.withColumn("_part", by).write.partitionBy("_part").parquet(f"{self.path}/{name}/{version}")
        folders = [x.getPath().getName() for x in self._fs.listStatus(self._at(name, version)) if x.isDirectory()]
        return {unquote(f.removeprefix("_part=")): [f"{version}/{f}"] for f in folders}

    def _commit(self, name: str, schema: StructType, parts: dict[str, list[str]], pointers: list[str], drop: bool = True) -> None:
        """The table is these parts from the moment when the manifest has its name, by one rename; a writer that comes second fails.

        The version before stays for readers that hold it; folders that only older ones name go (``drop``).
        """
        pending, pointer = self._at(name, f"_pending-{uuid.uuid4().hex}"), f"_V-{int(pointers[-1][3:]) + 1 if pointers else 0:012d}"
        stream = self._fs.create(pending, True)
        stream.write(bytearray(json.dumps({"schema": json.loads(schema.json()), "parts": parts}) + "\n", "utf-8"))
        stream.close()
        if self._fs.exists(self._at(name, pointer)) or not self._fs.rename(pending, self._at(name, pointer)):
            raise RuntimeError(f"table {name} was replaced by another writer")
        held = {f for fs in [*parts.values(), *(self._pointed(name, pointers[-1])["parts"].values() if pointers else ())] for f in fs}
        for p in pointers[:-1]:
            old = {f for fs in self._pointed(name, p)["parts"].values() for f in fs} - held
            if old and not drop:
                continue
            for f in old:
                self._fs.delete(self._at(name, f), True)
            self._fs.delete(self._at(name, p), False)

    def replace(self, name: str, df: DataFrame, by: Column | None = None) -> DataFrame:
        """The table is ``df`` from now on, in parts by the text ``by``."""
        pointers = self._pointers(name)
        self._commit(name, df.schema, self._written(name, df, by), pointers)
        return self.read(name)

    def replace_parts(self, name: str, df: DataFrame, by: Column, keys: Collection[str] | None = None) -> None:
        """``df`` takes the place of the parts that it has rows of, or of those with ``keys``; the others' files stay as they are."""
        pointers = self._pointers(name)
        old = self._pointed(name, pointers[-1])["parts"] if pointers else {}
        new = self._written(name, df, by)
        self._commit(name, df.schema, {k: v for k, v in old.items() if k not in (new if keys is None else keys)} | new, pointers)

    def append(self, name: str, df: DataFrame, by: Column | None = None) -> list[str]:
        """Add rows; returns the keys of the parts that got some."""
        pointers = self._pointers(name)
        old = self._pointed(name, pointers[-1])["parts"] if pointers else {}
        new = self._written(name, df, by)
        self._commit(name, df.schema, old | {k: old.get(k, []) + v for k, v in new.items()}, pointers, drop=False)
        return list(new)

    def sweep(self, name: str, before_ms: int) -> int:
        """Folders go that no manifest names and that were made before ``before_ms``: what writers that died left."""
        held = {f.split("/")[0] for p in self._pointers(name) for fs in self._pointed(name, p)["parts"].values() for f in fs}
        old = [x for x in self._fs.listStatus(self._at(name)) if x.isDirectory() and x.getPath().getName() not in held and x.getModificationTime() < before_ms]
        for x in old:
            self._fs.delete(x.getPath(), True)
        return len(old)


def bucket(name: Column, buckets: int) -> Column:
    """The key of a record's part: its bucket by the hash of its name."""
    return F.pmod(F.xxhash64(name), F.lit(buckets)).cast("string")


def now():
    return F.lit(datetime.now(UTC).replace(tzinfo=None)).cast("timestamp")


def staged(rows: DataFrame, target: str, run_id: str, mapping: dict[str, str] | None = None, at=None) -> DataFrame:
    """Staging rows of raw rows; columns are renamed by ``mapping`` (others pass), values stripped."""
    columns = [c for c in rows.columns if not c.startswith("_")]
    items = [x for c in columns for x in (F.lit((mapping or {}).get(c, c)), F.coalesce(strip(F.col(f"`{c}`")), F.lit("")))]
    at = now() if at is None else at
    return rows.select(F.lit(run_id).alias("run_id"), F.col("_source_file").alias("source_file"), F.lit(target).alias("target"), F.col("_row_index").cast("long").alias("row_index"), F.create_map(*items).alias("raw"), F.lit("Pending").alias("status"), F.lit(0).alias("retry_count"), F.lit("Medium").alias("priority"), F.lit(None).cast("string").alias("error_log"), F.lit(None).cast("string").alias("error_type"), at.alias("created_at"), F.lit(None).cast("timestamp").alias("processed_at"))


def pending(staging: DataFrame, target: str, limit: int | None = None, run_id: str | None = None) -> DataFrame:
    """Rows to be processed, in their order."""
    found = staging.filter((F.col("target") == target) & (F.col("status") == "Pending"))
    found = found.filter(F.col("run_id") == run_id) if run_id else found
    return found.orderBy("row_index").limit(limit) if limit else found


def cleaned(staging: DataFrame, cutoff) -> DataFrame:
    """What stays of staging when finished rows from before ``cutoff`` go."""
    old = F.col("status").isin("Processed", "Skipped") & (F.col("processed_at") < cutoff)
    return staging.filter(~F.coalesce(old, F.lit(False)))


def log_entries(decided: DataFrame, session: str, target: str, raw: str = "raw", at=None) -> DataFrame:
    """Import-log rows of decided rows."""
    action = F.create_map(*[F.lit(x) for x in ("INSERT", "Inserted", "UPDATE", "Updated", "SKIP", "Skipped")])
    at = now() if at is None else at
    return decided.filter("action != 'FAILED'").select(F.lit(session).alias("import_session"), "source_file", F.lit(target).alias("target"), "record_name", "row_hash", at.alias("import_timestamp"), action[F.col("action")].alias("action"), F.substring(F.to_json(raw), 1, PREVIEW_CHARS).alias("raw_data_preview"), F.lit(None).cast("string").alias("error_message"))


def new_log_entries(entries: DataFrame, log: DataFrame) -> DataFrame:
    """Those whose row isn't in the log for this target; a row that comes twice in a batch is logged once."""
    return entries.dropDuplicates(["row_hash", "target"]).join(log.select("row_hash", "target").distinct(), ["row_hash", "target"], "left_anti").select(*entries.columns)


def register_schema(registry: DataFrame, source_file: str, fingerprint: str, headers: list[str], target: str, confidence: float, at=None) -> DataFrame:
    """The registry with this schema: a new entry, or one more use of the old one; its file, fingerprint and target are required."""
    if not (source_file and fingerprint and target):
        raise ValueError("a registered schema has a file, a fingerprint and a target")
    at = now() if at is None else at
    one = registry.sparkSession.createDataFrame([(source_file, fingerprint, headers, target, float(confidence), 1)], "source_file string, schema_fingerprint string, headers array<string>, target string, confidence double, usage_count long").withColumns({"created_date": at, "last_used": at})
    both = registry.unionByName(one)
    first = [F.min_by(c, "created_date").alias(c) for c in ("source_file", "headers", "target", "confidence")]
    return both.groupBy("schema_fingerprint").agg(*first, F.sum("usage_count").alias("usage_count"), F.min("created_date").alias("created_date"), F.max("last_used").alias("last_used")).select(*registry.columns)


def request(source_file: str, suggested: str, analysis: dict, total: int, user: str = "") -> dict:
    """A new creation request; there is one schema for all ways it may come about."""
    if not source_file:
        raise ValueError("source_file is required")
    return {"request_id": uuid.uuid4().hex, "source_file": source_file, "suggested": suggested, "analysis": json.dumps(analysis), "field_count": len(analysis.get("fields", {})), "total_records": total, "status": "Pending", "created_at": datetime.now(UTC).replace(tzinfo=None), "created_by": user}


def respond(requests: DataFrame, request_id: str, status: str, user: str = "", final: str | None = None, reason: str | None = None, results: dict | None = None, at=None) -> DataFrame:
    """The request table after one transition; one that isn't allowed from the request's status raises ValueError."""
    row = requests.filter(F.col("request_id") == request_id).select("status").first()
    if row is None or status not in MOVES[row["status"]]:
        raise ValueError(f"invalid transition of {request_id} from {row and row['status']} to {status}")
    if status == "Redirected" and not final:
        raise ValueError("a redirected request needs a table")
    at, mine = now() if at is None else at, F.col("request_id") == request_id
    done = status in ("Completed", "Failed")
    change = {"status": F.lit(status), "user_response": F.lit(status) if not done else F.col("user_response"), "final": F.coalesce(F.lit(final), F.col("final")), "reason": F.coalesce(F.lit(reason), F.col("reason")), "results": F.coalesce(F.lit(json.dumps(results) if results else None), F.col("results")), "responded_by": F.col("responded_by") if done else F.lit(user), ("processed_at" if done else "responded_at"): at}
    return requests.withColumns({c: F.when(mine, v).otherwise(F.col(c)) for c, v in change.items()})


def request_summaries(requests: DataFrame, n: int = 10) -> DataFrame:
    """The newest requests with the number of fields, the first five of them, and the records."""
    fields = F.map_keys(F.from_json(F.get_json_object("analysis", "$.fields"), "map<string,string>"))
    return requests.withColumn("fields", F.coalesce(fields, F.array().cast("array<string>"))).select("request_id", "source_file", "status", F.size("fields").alias("field_count"), F.slice("fields", 1, 5).alias("first_fields"), F.coalesce("total_records", F.lit(0)).alias("total_records"), "created_at").orderBy(F.desc("created_at")).limit(n)
