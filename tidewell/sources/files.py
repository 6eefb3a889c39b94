"""Folders of input files: listing, lookup, life cycle and checks, through Hadoop's file systems."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.sources.delimited import SUFFIXES

FOLDERS = ("processed", "errors", "pending", "backup")


class Folder:
    """A watched folder; paths may be of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self.fs = self._path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def create(self) -> None:
        for f in ("", *FOLDERS):
            self.fs.mkdirs(self._path(f"{self.path}/{f}"))

    def _files(self, folder: str) -> list:
        p = self._path(f"{self.path}/{folder}")
        return [s for s in self.fs.listStatus(p) if s.isFile()] if self.fs.exists(p) else []

    def inputs(self) -> list[str]:
        """Supported files that aren't hidden, by name."""
        return sorted(s.getPath().toString() for s in self._files("") if s.getPath().getName().lower().endswith(SUFFIXES) and not s.getPath().getName().startswith((".", "_")))

    def find(self, name: str, folders: tuple[str, ...] = ("", "pending", "processed", "errors")) -> str | None:
        return next((f"{self.path}/{f}/{name}".replace("//", "/") if not f else f"{self.path}/{f}/{name}" for f in folders if self.fs.exists(self._path(f"{self.path}/{f}/{name}"))), None)

    def move(self, path: str, folder: str) -> str:
        """Move a file into a folder below; a file of that name there stays, and the moved one gets the first free number."""
        self.fs.mkdirs(self._path(f"{self.path}/{folder}"))
        name = path.rsplit("/", 1)[-1]
        stem, dot, suffix = name.rpartition(".")
        for n in itertools.count():
            to = f"{self.path}/{folder}/{name if not n else f'{stem}-{n}{dot}{suffix}' if stem else f'{name}-{n}'}"
            if self.fs.exists(self._path(to)):
                continue
            if self.fs.rename(self._path(path), self._path(to)):
                return to
            if not self.fs.exists(self._path(to)):  # else another mover was first
                raise OSError(f"file {path} can't be moved to {to}")

    def statistics(self) -> dict[str, int]:
        return {f or "main": sum(s.getPath().getName().lower().endswith(SUFFIXES) for s in self._files(f)) for f in ("", "processed", "errors", "pending")}

    def remove_old(self, before_ms: int, folders: tuple[str, ...] = ("processed", "errors")) -> int:
        old = [s for f in folders for s in self._files(f) if s.getModificationTime() < before_ms]
        for s in old:
            self.fs.delete(s.getPath(), False)
        return len(old)

    def writable(self) -> bool:
        probe = self._path(f"{self.path}/.probe")
        try:
            self.fs.create(probe, True).close()
            return bool(self.fs.delete(probe, False))
        except Exception:  # any failure of the store means no
            return False


def listing(spark: SparkSession, path: str, max_bytes: int | None = None) -> DataFrame:
    """(folder, file, length, modified) of all files below ``path``, as a table."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    out = files.select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "length", F.col("modificationTime").alias("modified"))
    return out.filter(F.col("length") <= max_bytes) if max_bytes is not None else out


def connection_problems(spark: SparkSession, source: str, **options: str) -> list[str]:
    """What keeps a source (``csv`` with ``path``, ``rest`` with the options of the REST source) from being read."""
    if source == "csv":
        try:
            return [] if Folder(spark, options["path"]).writable() else [f"{options['path']} can't be written"]
        except Exception as e:  # any failure of the store is the answer
            return [str(e)[:200]]
    if source == "rest":
        from tidewell.sources.rest import pages

        try:
            next(pages(options), None)
            return []
        except Exception as e:  # any failure of the service is the answer
            return [str(e)[:200]]
    return [f"unknown source {source}"]
