"""A lookup of key values that lives between the batches of a stream.

The first row of a new value inserts a record, all later ones, of this batch or of another, update it.  State holds
one name for each value, in RocksDB, so it outlives restarts and needn't fit in memory.  Values are dealt to buckets: a call
takes a batch's rows of one bucket together, and adds the new values' names as one packed table to those of the batches before;
tables of many batches are packed into one.

Defined cases: rows without a value insert records of their own; within a batch the rows of a value go by
row_index; batches go in the order in which the stream brings them; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewell.functions.strings import filled

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PARTITIONS = "spark.sql.shuffle.partitions"
DECIDED = "value string, row_index long, action string, record_name string"
NAMES = pa.schema([("value", pa.string()), ("new_name", pa.string())])
#: Buckets of the values (fixed for a checkpoint: a bucket's names are in memory together); tables of a bucket before they are packed.
BUCKETS, MOST_TABLES = 256, 32


def _packed(names: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, NAMES) as out:
        out.write_table(pa.Table.from_pandas(names, NAMES, preserve_index=False))
    return sink.getvalue().to_pybytes()


class FirstInserts(StatefulProcessor):
    """The names of the records that the first rows of a bucket's values made."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.names = handle.getListState("names", "names binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("row_index", kind="stable", ignore_index=True)  # the narrow rows of one bucket and batch
        tables = [pa.ipc.open_stream(bytes(r[0])).read_all() for r in self.names.get()] if self.names.exists() else []
        known = pa.concat_tables(tables).to_pandas() if tables else pd.DataFrame({"value": [], "new_name": []}, dtype=object)
        valued = batch["value"].notna()
        firsts = valued & ~batch["value"].duplicated() & ~batch["value"].isin(known["value"])
        added = batch.loc[firsts, ["value", "new_name"]]
        known = pd.concat([known, added], ignore_index=True)
        if len(tables) >= MOST_TABLES:
            self.names.put([(_packed(known),)])
        elif len(added):
            self.names.appendValue((_packed(added),))
        names = batch["value"].map(known.set_index("value")["new_name"]).where(valued, batch["new_name"])
        yield pd.DataFrame({"value": batch["value"], "row_index": batch["row_index"], "action": (firsts | ~valued).map({True: "INSERT", False: "UPDATE"}), "record_name": names})

    def close(self) -> None:
        pass


def first_inserts(rows: DataFrame, key: str) -> DataFrame:
    """(value, row_index, action, record_name) of a stream of rows with row_index and new_name."""
    narrow = rows.select(filled(F.col(f"`{key}`").cast("string")).alias("value"), F.col("row_index").cast("long").alias("row_index"), F.col("new_name").cast("string").alias("new_name"))
    # Rows without a value are alone, so any bucket may have them.
    bucket = F.pmod(F.xxhash64(F.coalesce("value", F.col("row_index").cast("string"))), F.lit(BUCKETS)).cast("int")
    return narrow.withColumn("bucket", bucket).groupBy("bucket").transformWithStateInPandas(FirstInserts(), DECIDED, "Append", "None")


def decide_stream(rows: DataFrame, key: str, out: str, checkpoint: str):
    """Start the stream into Parquet files at ``out``, over all that is there."""
    spark: SparkSession = rows.sparkSession
    held = {k: spark.conf.get(k) for k in (PROVIDER, PARTITIONS)}
    spark.conf.set(PROVIDER, ROCKS)
    # A store is opened and committed for each partition and batch, so there aren't many more than tasks at a time.
    spark.conf.set(PARTITIONS, str(min(int(held[PARTITIONS]), BUCKETS, max(8, 2 * spark.sparkContext.defaultParallelism))))
    try:
        return first_inserts(rows, key).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
