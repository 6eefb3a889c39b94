"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where it is unset and the master is local (tests), a temporary folder is set instead.
    """
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        held = tempfile.mkdtemp(prefix="tidewell-")
        spark.conf.set("spark.checkpoint.dir", held)
    return held


class Workspace:
    """Written intermediate tables in the shared folder.

    A written table cuts the lineage and survives the loss of executors.  Tables
    go when :meth:`drop` is called, the rest when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        self._top = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._top)
        self._fs.deleteOnExit(self._top)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        self._fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)
