"""The import of a file: read, match or infer, stage, convert, validate, decide, merge, log, report."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidewell.functions import naming
from tidewell.functions.content import SPARK_TYPES, converted
from tidewell.functions.hashing import row_hash, schema_fingerprint
from tidewell.functions.messages import ImportFailure, error_category
from tidewell.operators import infer, matching, upsert
from tidewell.operators.identity import Field, key_candidates, matching_keys
from tidewell.operators.profile import sketches, structure
from tidewell.operators.validation import validate
from tidewell.plans import membership, state
from tidewell.plans.config import Settings
from tidewell.sources.delimited import read_strings
from tidewell.sources.files import Folder


def staged_by() -> Column:
    """Parts of staging: an import reads and writes its own run only."""
    return F.concat_ws("/", "run_id", "target")


@dataclass
class Result:
    """What became of a file; ``target`` is always set."""

    status: str
    target: str
    session: str
    counts: dict[str, int] = field(default_factory=dict)
    message: str = ""

    @property
    def success_rate(self) -> float:
        total = sum(self.counts.values())
        return 100.0 * (total - self.counts.get("FAILED", 0)) / total if total else 0.0


class Importer:
    """Imports into a store of tables; ``tables`` holds the fields of each known target."""

    def __init__(self, spark: SparkSession, path: str, settings: Settings | None = None):
        self.spark, self.settings, self.store = spark, settings or Settings(), state.Store(spark, path)

    # ---- known tables

    def tables(self) -> dict[str, list[Field]]:
        known = self.store.read("tables", "target string, fields string")
        return {r["target"]: [Field(**f) for f in json.loads(r["fields"])] for r in known.collect()}  # metadata

    def create_table(self, target: str, fields: list[Field]) -> None:
        if errors := naming.table_name_errors(target):
            raise ImportFailure("invalid name: " + "; ".join(errors))
        known = self.store.read("tables", "target string, fields string").filter(F.col("target") != target)
        self.store.replace("tables", known.unionByName(self.spark.createDataFrame([(target, json.dumps([asdict(f) for f in fields]))], "target string, fields string")))

    def records(self, target: str, parts: Callable[[str], bool] | None = None) -> DataFrame:
        """The records, or those of some buckets."""
        fields = self.tables()[target]
        schema = ", ".join(["name string", *(f"`{f.name}` {SPARK_TYPES.get(f.kind, 'string')}" for f in fields), "row_hash string", "last_import_date timestamp", "migration_source string", "migration_batch string"])
        return self.store.read(self._table(target), schema, parts)

    def _table(self, target: str) -> str:
        return f"records_{naming.snake(target)}"

    # ---- steps

    def analyse(self, rows: DataFrame) -> dict:
        """Field definitions from the first values of each column."""
        columns = [c for c in rows.columns if not c.startswith("_")]
        kinds = {r["column_name"]: r["field_type"] for r in infer.infer_types(rows, "_row_index", columns).collect()}  # a row a column
        found = {r["column_name"]: r for r in structure(rows, "_row_index", columns).collect()}
        fields = {c: infer.field_definition(c, kinds[c], found[c]["sample_max_length"] or 0, self.settings.type_by_name) for c in columns}
        total = rows.count()
        key = infer.unique_field([(c, found[c]["unique_count"], total) for c in columns])
        return {"fields": {c: list(d) for c, d in fields.items()}, "unique": key, "total": total}

    def fields_of(self, analysis: dict) -> list[Field]:
        """Fields of a new table; the system's own columns are added by :meth:`records`."""
        fields = {c: d for c, d in infer.table_fields({c: tuple(d) for c, d in analysis["fields"].items()}).items() if c in analysis["fields"]}
        return [Field(naming.field_name(c), kind, unique=c == analysis["unique"], length=length) for c, (kind, length) in fields.items()]

    def match(self, headers: list[str]) -> tuple[str | None, float]:
        """The known table whose fields fit the headers best, and its score."""
        known = self.tables()
        if not known:
            return None, 0.0
        mine = self.spark.createDataFrame([("file", h) for h in headers], "source string, header string")
        theirs = self.spark.createDataFrame([(t, f.name) for t, fs in known.items() for f in fs], "target string, field string")
        best = matching.best_schema(matching.schema_scores(mine, theirs), 0.0).first()
        return (best["target"], best["score"]) if best else (None, 0.0)

    def import_file(self, path: str, target: str | None = None, approve: bool = False) -> Result:
        """Into ``target``, or the best known table, or a new one; a new one needs approval unless the settings or ``approve`` say otherwise."""
        session = uuid.uuid4().hex
        rows = read_strings(self.spark, path, max_bytes=self.settings.max_file_bytes or None)
        headers = [c for c in rows.columns if not c.startswith("_")]
        score = 1.0
        if target is None:
            target, score = self.match(headers)
            if target is None or score < matching.threshold(self.settings.match_threshold):
                analysis = self.analyse(rows)
                target, score = naming.table_name(path, tuple(self.tables())), 1.0
                if self.settings.approval_required and not approve or not self.settings.auto_create:
                    made = state.request(path, target, analysis, analysis["total"])
                    schema = self.spark.createDataFrame([], state.REQUESTS).schema
                    row = self.spark.createDataFrame([tuple(made.get(f.name) for f in schema)], schema)
                    self.store.replace("requests", self.store.read("requests", state.REQUESTS).unionByName(row))
                    return Result("approval_requested", target, session, message=made["request_id"])
                self.create_table(target, self.fields_of(analysis))
        counts = self.load(rows, target, session)
        registry = self.store.read("registry", state.REGISTRY)
        self.store.replace("registry", state.register_schema(registry, path, schema_fingerprint(headers), headers, target, score))
        return Result("completed", target, session, counts)

    def load(self, rows: DataFrame, target: str, session: str) -> dict[str, int]:
        """Stage, convert, validate, decide and merge; returns the counts by action."""
        fields = self.tables()[target]
        by = {f.name: f for f in fields}
        headers = [c for c in rows.columns if not c.startswith("_")]
        mapping = matching.map_headers(headers, list(by))
        self.store.append("staging", state.staged(rows, target, session), staged_by())
        staging = self.store.read("staging", parts=f"{session}/{target}".__eq__)
        if self.settings.max_rows_per_file:
            staging = state.pending(staging, target, self.settings.max_rows_per_file)

        number = F.col("row_index") if self.settings.hash_with_row_number else None
        raw = staging.select("row_index", "source_file", "raw", *[F.col("raw")[h].alias(f"_raw_{i}") for i, h in enumerate(headers)])
        hashed = raw.toDF("row_index", "source_file", "raw", *[f"h{i}" for i in range(len(headers))])
        # Hashes are of the file's own columns, so a changed mapping doesn't make all rows new.
        renamed = hashed.select("*", *[F.col(f"h{i}").alias(f"raw {h}") for i, h in enumerate(headers)])
        rows_ = renamed.withColumn("row_hash", row_hash([f"raw {h}" for h in headers], number))
        last = {f: h for h, f in mapping.items()}  # two columns of one field: the last in the file wins
        mapped = rows_.select("row_index", "source_file", "raw", "row_hash", *[(F.col(f"raw {last[f]}") if f in last else F.lit(None).cast("string")).alias(f) for f in by])
        legacy, zero = self.settings.int_strip_point, self.settings.nonnumeric_as_zero
        checked = validate(mapped, fields, legacy=legacy, zero=zero)
        values = [converted(F.col(f"`{f.name}`"), f.kind, f.length, legacy, self.settings.check_as_string, zero).alias(f.name) for f in fields]
        primary = matching.primary_column(list(last)) if last else None
        fallback = F.concat(F.lit(naming.snake(target)[:5] + "-"), F.col("row_hash"))
        name = naming.record_name(F.col(f"`{primary}`"), target, fallback) if primary else fallback
        typed = checked.select("row_index", "source_file", "raw", "row_hash", "errors", "error_log", name.alias("_base"), *values)
        table = self.records(target)
        typed = upsert.numbered_names(typed, "_base", "row_index", table.select("name")).withColumnRenamed("unique_name", "new_name").drop("_base")
        # Only the parts of the log that may hold one of these rows are read; a row that was ever imported is known by it.
        log = membership.read_log(self.store, typed.select("row_hash", F.lit(target).alias("target")))
        # The merge, the log and staging read what is written here; the counts come with the write.
        seen = Observation()
        outcome = upsert.observed(upsert.decide(typed, table, matching_keys(table, fields, self._sketches(target)), log.filter(F.col("target") == target)), seen)
        decided = self.store.replace("decided", outcome)
        source = rows.select("_source_file").first()
        changed = decided.filter(F.col("action").isin("INSERT", "UPDATE"))
        touched = {r[0] for r in changed.select(state.bucket(F.col("record_name"), self.settings.buckets)).distinct().collect()}  # buckets at most
        if touched:
            part = self.records(target, touched.__contains__)
            merged = upsert.merge(decided, part, list(by), state.now(), migration_source=F.lit(source[0] if source else None).cast("string"), migration_batch=F.lit(session))
            # A bucket is one task's and one file; staging stays dealt as it was read.
            key = state.bucket(F.col("name"), self.settings.buckets)
            self.store.replace_parts(self._table(target), merged.repartition(key), key, touched)
            self._sketch(target, touched)
        membership.append_log(self.store, state.new_log_entries(state.log_entries(decided, session, target), log))
        self._finish(decided, session, target)
        return upsert.observed_counts(seen)

    def _sketches(self, target: str) -> DataFrame | None:
        """Sketches of the values of a table's possible keys, by bucket; None where there are none yet."""
        return self.store.read(f"{self._table(target)}_sketches")

    def _sketch(self, target: str, buckets: set[str]) -> None:
        """The buckets that a batch has changed are sketched anew."""
        names = [f.name for f in key_candidates(self.tables()[target]) if not f.unique]
        if names:
            made = sketches(self.records(target, buckets.__contains__), names, state.bucket(F.col("name"), self.settings.buckets))
            self.store.replace_parts(f"{self._table(target)}_sketches", made, F.col("part"), buckets)

    def _finish(self, decided: DataFrame, session: str, target: str) -> None:
        """Staged rows get their status and messages."""
        status = F.create_map(*[F.lit(x) for x in ("INSERT", "Processed", "UPDATE", "Processed", "SKIP", "Skipped", "FAILED", "Failed")])
        done = decided.select(F.col("row_index").alias("_i"), status[F.col("action")].alias("_status"), F.nullif("error_log", F.lit("")).alias("_log"))
        # Earlier runs are neither read nor written.
        staging = self.store.read("staging", state.STAGING, f"{session}/{target}".__eq__)
        joined = staging.join(done, F.col("row_index") == F.col("_i"), "left")
        kind = F.when(F.col("_log").isNotNull(), error_category(F.col("_log")))
        out = joined.withColumns({"status": F.coalesce("_status", "status"), "error_log": F.coalesce("_log", "error_log"), "error_type": F.coalesce(kind, "error_type"), "processed_at": F.when(F.col("_status").isNotNull(), state.now()).otherwise(F.col("processed_at"))})
        self.store.replace_parts("staging", out.select(*staging.columns), staged_by())

    # ---- requests and folders

    def respond(self, request_id: str, status: str, user: str = "", final: str | None = None, reason: str | None = None) -> None:
        self.store.replace("requests", state.respond(self.store.read("requests", state.REQUESTS), request_id, status, user, final, reason))

    def drain_requests(self) -> list[Result]:
        """Process approved and redirected requests, oldest first."""
        waiting = self.store.read("requests", state.REQUESTS).filter(F.col("status").isin("Approved", "Redirected")).orderBy("created_at").collect()  # a few requests
        out = []
        for r in waiting:
            try:
                target = r["final"] or r["suggested"]
                if r["status"] == "Approved":
                    self.create_table(target, self.fields_of(json.loads(r["analysis"])))
                elif target not in self.tables():
                    raise ImportFailure(f"table {target} doesn't exist")
                result = self.import_file(r["source_file"], target)
                done = ("Completed", None, result.counts)
            except Exception as e:  # one request that fails mustn't stop the others
                result, done = Result("failed", r["final"] or r["suggested"], "", message=str(e)), ("Failed", str(e)[:1000], None)
            requests = self.store.read("requests", state.REQUESTS)
            self.store.replace("requests", state.respond(requests, r["request_id"], done[0], final=result.target, reason=done[1], results=done[2]))
            out.append(result)
        return out

    def import_folder(self, path: str) -> list[Result]:
        """Each input of the folder; files go to processed, pending (approval) or errors."""
        folder, out = Folder(self.spark, path), []
        folder.create()
        for file in folder.inputs():
            out.append(self.import_and_move(folder, file))
        return out

    def import_and_move(self, folder: Folder, file: str, target: str | None = None) -> Result:
        """One file of the folder; a failure is its result and mustn't stop others."""
        try:
            result = self.import_file(file, target)
            to = "pending" if result.status == "approval_requested" else "processed"
        except Exception as e:  # whatever is wrong with the file is its result
            result, to = Result("failed", target or "", "", message=str(e)), "errors"
        moved = folder.move(file, to)
        if to == "pending":
            requests = self.store.read("requests", state.REQUESTS)
            self.store.replace("requests", requests.withColumn("source_file", F.when(F.col("request_id") == result.message, F.lit(moved)).otherwise(F.col("source_file"))))
        return result

    def clean(self, cutoff) -> None:
        """Finished staging rows and requests from before ``cutoff`` (a timestamp column) go."""
        self.store.replace("staging", state.cleaned(self.store.read("staging", state.STAGING), cutoff), staged_by())
        requests = self.store.read("requests", state.REQUESTS)
        old = F.col("status").isin("Completed", "Rejected", "Failed") & (F.col("created_at") < cutoff)
        self.store.replace("requests", requests.filter(~F.coalesce(old, F.lit(False))))
