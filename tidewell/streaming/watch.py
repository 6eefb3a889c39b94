"""A watched folder as a stream: new files are staged as they come, each micro-batch is merged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.sources.files import Folder


def raw_stream(spark: SparkSession, path: str, columns: list[str], archive: str | None = None, max_files: int | None = None) -> DataFrame:
    """Rows of CSV files as strings with ``_source_file``; finished files go to ``archive``."""
    reader = spark.readStream.schema(", ".join(f"`{c}` string" for c in columns)).option("header", True)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    rows = reader.csv(path)
    return rows.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in columns], F.col("_metadata.file_path").alias("_source_file"))


def watch(stream: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None], minutes: int | None = None):
    """Start the stream: every ``minutes``, or once over all that is there."""
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=f"{minutes} minutes").start() if minutes else writer.trigger(availableNow=True).start()


def import_stream(importer, path: str, checkpoint: str, target: str | None = None, minutes: int | None = None):
    """Import each file of a folder once, in the order of their names, as :meth:`Importer.import_file` does, when new ones come.

    The stream only tells of new files; rows are read and numbered by the import itself.  A file that was imported goes to
    ``processed``, one that waits for approval to ``pending``, one that can't be imported to ``errors``, and the others go on.  Rows that were ever imported are known by the log, so a file that comes again, or a batch that is
    repeated, changes nothing.
    """
    names = importer.spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.csv").load(path)
    names = names.select("path")  # no content is read

    def batch(rows: DataFrame, _: int) -> None:
        folder = Folder(importer.spark, path)
        folder.create()
        # The source passes over files without a byte and such as come again under a name that it has seen; the folder has them.
        for file in folder.inputs():
            importer.import_and_move(folder, file, target)

    return watch(names, checkpoint, batch, minutes)


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows by window of event time and keys; works on streams (late rows go) and tables.  Times without a zone are UTC."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    counted = timed.groupBy(F.window(time, width), *keys).agg(F.count("*").alias("rows"))
    return counted.select(F.col("window.start").alias("window_start"), *keys, "rows")
