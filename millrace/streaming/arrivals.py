"""Files that are still being written: a file is loaded only when it has not changed for a while.

A poll compares the listing with what the last one saw. The state has the size and time of every unit and since when
they have been the same; a unit is settled when that is at least the quiet period ago. A unit that grows starts anew.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.monitor import moment
from millrace.sources import files
from millrace.sources.file_load import FileLoader
from millrace.sources.store import VersionedTable

STATE = "file_path string, file_size bigint, file_mtime timestamp_ntz, since timestamp_ntz"


class Arrivals:
    """The units of a folder and since when each has been as it is, stored below ``path``.

    ``quiet`` is an interval such as ``10 minutes``. A run that is repeated sees the same state again.
    """

    def __init__(self, spark: SparkSession, folder: str, path: str, quiet: str, pattern: str = "*", unit: str = "file") -> None:
        self.spark, self.folder, self.quiet = spark, folder, quiet
        self.pattern, self.unit = pattern, unit
        self.state_table = VersionedTable(spark, f"{path.rstrip('/')}/arrivals")

    def state(self) -> DataFrame:
        return self.state_table.read() if self.state_table.exists() else self.spark.createDataFrame([], STATE)

    def poll(self, now: datetime | Column, listing: DataFrame | None = None) -> DataFrame:
        """Look at the folder, store what is seen, and return it: the listing, ``since`` and ``settled``."""
        seen = files.list_files(self.spark, self.folder, self.pattern, self.unit) if listing is None else listing
        known = self.state().select("file_path", F.struct("file_size", "file_mtime").alias("_was"), F.col("since").alias("_since"))
        same = F.col("_was").eqNullSafe(F.struct("file_size", "file_mtime"))
        since = F.when(same, F.col("_since")).otherwise(moment(now))
        current = seen.join(known, "file_path", "left").select("file_path", "file_size", "file_mtime", since.alias("since"))
        self.state_table.replace(current, allow_empty=True)
        return self.state().withColumn("settled", F.col("since") <= moment(now) - F.expr(f"INTERVAL {self.quiet}"))


def load_settled(loader: FileLoader, arrivals: Arrivals, now: datetime | Column, evolve: bool = False) -> DataFrame:
    """Load the settled units, each whole and once; returns the outcome per unit as ``FileLoader.sync`` does.

    A unit that was loaded before and is changing again keeps its loaded rows until it has settled; one that is gone is
    deleted at once.
    """
    polled = arrivals.poll(now)
    loaded = loader.ledger().where("status = 'loaded'").select("file_path", "file_size", "file_mtime")
    waiting = loaded.join(polled.where("NOT settled").select("file_path"), "file_path", "left_semi")
    listing = polled.where("settled").select("file_path", "file_size", "file_mtime").unionByName(waiting)
    return loader.sync(now, listing, evolve)


def watch(loader: FileLoader, arrivals: Arrivals, checkpoint: str, interval: str, seconds: float | None = None) -> None:
    """Poll and load at an interval, for ever or for some seconds, as a stream whose batches are the polls."""
    ticks = loader.spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def tick(batch: DataFrame, number: int) -> None:
        now = batch.sparkSession.range(1).select(F.current_timestamp().cast("timestamp_ntz")).first()[0]
        load_settled(loader, arrivals, now)

    query = ticks.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()
    try:
        query.awaitTermination(seconds)
    finally:
        query.stop()
