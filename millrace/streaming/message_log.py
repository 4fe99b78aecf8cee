"""Message logs as files, read between two times.

The index is sparse: one row for each file and partition, with the first and last offset and time in it. "The first
offset at or after a time" is searched in the index; only the files that may hold it are opened to find it exactly. A
read opens the files that overlap the offsets found, and no other.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.monitor import moment
from millrace.sources.files import decoded, literal
from millrace.sources.store import VersionedTable
from millrace.streaming.streams import MESSAGE

UNIT = ["topic", "partition"]
INDEX = "path string, topic string, partition int, first_offset bigint, last_offset bigint, first_time timestamp, last_time timestamp"


class MessageLog:
    """Parquet files of messages (``MESSAGE``) in ``folder``; the index is a table below ``path``. Files do not change."""

    def __init__(self, spark: SparkSession, folder: str, path: str) -> None:
        self.spark, self.folder = spark, folder
        self.index_table = VersionedTable(spark, f"{path.rstrip('/')}/index")

    def index(self) -> DataFrame:
        return self.index_table.read() if self.index_table.exists() else self.spark.createDataFrame([], INDEX)

    def refresh(self) -> None:
        """Add the files that the index does not have; only those are read."""
        listed = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True)
        fresh = listed.load(self.folder).select("path").join(self.index().select("path"), "path", "left_anti")
        paths = [r["path"] for r in fresh.collect()]  # what the reader of this refresh lists anyway
        if paths:
            path = decoded(F.col("_metadata.file_path")).alias("path")
            times = [F.min("timestamp").alias("first_time"), F.max("timestamp").alias("last_time")]
            found = self._open(paths).select(path, *UNIT, "offset", "timestamp").groupBy("path", *UNIT)
            self.index_table.append(found.agg(F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"), *times))

    def _open(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], MESSAGE)
        return self.spark.read.schema(MESSAGE).parquet(*[literal(p) for p in paths])

    def _paths(self, rows: DataFrame) -> list[str]:
        return [r["path"] for r in rows.select("path").distinct().collect()]

    def offsets_at(self, time: datetime) -> DataFrame:
        """``topic, partition, offset``: the first message of each partition that is not earlier than ``time``.

        A partition whose messages are all earlier has no row. Of the files with such a message only those that begin
        at or before the first end of one are opened: one for each partition if files follow each other.
        """
        may = self.index().where(F.col("last_time") >= moment(time).cast("timestamp"))
        bound = may.groupBy(*UNIT).agg(F.min("last_offset").alias("_bound"))
        paths = self._paths(may.join(bound, UNIT).where(F.col("first_offset") <= F.col("_bound")))
        late = self._open(paths).where(F.col("timestamp") >= moment(time).cast("timestamp"))
        return late.groupBy(*UNIT).agg(F.min("offset").alias("offset"))

    def read(self, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
        """All messages from the first one at or after ``start`` up to that before the first one at or after ``end``."""
        spans = self.index().groupBy(*UNIT).agg(F.min("first_offset").alias("_from"), (F.max("last_offset") + 1).alias("_to"))
        if start is not None:
            spans = spans.drop("_from").join(self.offsets_at(start).withColumnRenamed("offset", "_from"), UNIT)
        if end is not None:
            ends = self.offsets_at(end).withColumnRenamed("offset", "_end")
            spans = spans.join(ends, UNIT, "left").withColumn("_to", F.coalesce("_end", "_to")).drop("_end")
        overlap = (F.col("last_offset") >= F.col("_from")) & (F.col("first_offset") < F.col("_to"))
        paths = self._paths(self.index().join(spans, UNIT).where(overlap))
        rows = self._open(paths).join(spans, UNIT)
        inside = (F.col("offset") >= F.col("_from")) & (F.col("offset") < F.col("_to"))
        return rows.where(inside).select(*[f.name for f in self._open([]).schema.fields])
