"""Small tables that a stream keeps from batch to batch: detector states, admitted series, the ring.

A batch writes the whole table as it is after it, into a folder of its stream and number;
a batch that is run again reads the same table before it and replaces its folder. Tables
older than the last two are deleted, so work and space are those of one table, whatever
the history. A stream with a new checkpoint goes on from the newest table of the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def located(spark: SparkSession, path: str):
    """Hadoop's path and the file system that it is on."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    found, files = located(spark, path)
    return files.exists(found)


class Kept:
    def __init__(self, spark: SparkSession, folder: str, schema: str) -> None:
        self.spark, self.folder, self.schema = spark, folder, schema
        self.columns = spark.createDataFrame([], schema).columns

    def place(self, stream: str, batch_id: int) -> str:
        return f"{self.folder}/stream_id={stream}/batch_id={batch_id}"

    def at(self, stream: str, batch_id: int) -> DataFrame:
        """The table after a batch."""
        return self.spark.read.schema(self.schema).parquet(self.place(stream, batch_id))

    def _newest(self, without: str | None = None) -> DataFrame:
        if not exists(self.spark, self.folder):
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(f"{self.schema}, written_at timestamp, stream_id string, batch_id long").option("basePath", self.folder).parquet(self.folder)
        if without is not None:
            rows = rows.filter(F.col("stream_id") != without)
        place = F.struct("written_at", "stream_id", "batch_id")
        last = rows.agg(F.max(place).alias("last")).first()["last"]
        if last is None:
            return self.spark.createDataFrame([], self.schema)
        return self.at(last["stream_id"], last["batch_id"])

    def before(self, stream: str, batch_id: int) -> DataFrame:
        """The table as a batch finds it."""
        if exists(self.spark, self.place(stream, batch_id - 1)):
            return self.at(stream, batch_id - 1)
        return self._newest(without=stream)

    def put(self, table: DataFrame, stream: str, batch_id: int) -> DataFrame:
        """Keeps ``table`` as the one after a batch and returns it as written."""
        table.select(*self.columns, F.current_timestamp().alias("written_at")).coalesce(1).write.mode("overwrite").parquet(self.place(stream, batch_id))
        path, files = located(self.spark, self.place(stream, batch_id - 2))
        files.delete(path, True)
        return self.at(stream, batch_id)

    def latest(self) -> DataFrame:
        """The newest table with any row, for readers."""
        return self._newest()
