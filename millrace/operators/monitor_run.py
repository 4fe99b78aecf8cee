"""The whole run of monitors over stored state: values, comparisons and drill-downs are kept."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import drill, monitor
from millrace.operators.monitor import Monitor
from millrace.session import materialize
from millrace.sources.store import VersionedTable

RESULTS = (
    "metric_name string, result_type string, baseline_value double, change_pct double, exceeds_threshold boolean, "
    "trend_direction string, forecast_days int, computed_at timestamp_ntz"
)
SNAPSHOTS = f"{drill.BREAKDOWN}, computed_at timestamp_ntz"
CONTRIBUTORS = (
    "metric_name string, dimension string, group_value string, current_value double, previous_value double, "
    "change_abs double, change_pct double, rank int"
)


@dataclass(frozen=True)
class Run:
    """What one run found: the categorised results, the contributors of flagged metrics, and failed dimensions."""

    results: DataFrame
    contributors: DataFrame
    errors: DataFrame


class MonitorStore:
    """History of values, results of comparisons and snapshots of drill-downs as tables below ``path``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.history_table = VersionedTable(spark, f"{path}/history")
        self.results_table = VersionedTable(spark, f"{path}/results")
        self.snapshots_table = VersionedTable(spark, f"{path}/snapshots")

    def _read(self, table: VersionedTable, schema) -> DataFrame:
        return table.read() if table.exists() else self.spark.createDataFrame([], schema)

    def history(self) -> DataFrame:
        return self._read(self.history_table, monitor.HISTORY_SCHEMA)

    def results(self) -> DataFrame:
        return self._read(self.results_table, RESULTS)

    def snapshots(self) -> DataFrame:
        return self._read(self.snapshots_table, SNAPSHOTS)

    def run(
        self,
        tables: Mapping[str, DataFrame],
        monitors: Sequence[Monitor],
        now: datetime | Column,
        sources: Iterable[str] | None = None,
    ) -> Run:
        """Evaluate and store, compare with the stored history and store, drill into what is flagged and store.

        A drill-down is compared with the snapshot before it. Every step is a commit of its own, in this order.
        """
        values, compared, results = monitor.run_monitors(self.spark, tables, monitors, self.history(), now, sources)
        fields = monitor.HISTORY_SCHEMA.fieldNames()
        results, compared = materialize(results, "results"), materialize(compared, "compared")
        self.history_table.append(values.where(F.col("error").isNull()).select(*fields))
        self.results_table.append(
            compared.select(
                "metric_name",
                F.col("comparison_type").alias("result_type"),
                "baseline_value",
                "change_pct",
                "exceeds_threshold",
                "trend_direction",
                F.col("forecast_threshold_days").alias("forecast_days"),
                monitor.moment(now).alias("computed_at"),
            )
        )
        drilled = drill.drill_flagged(tables, monitors, results, self.snapshots())
        if drilled is None:
            none = self.spark.createDataFrame([], "metric_name string, dimension string, error string")
            return Run(results, self.spark.createDataFrame([], CONTRIBUTORS), none)
        current, contributors, errors = drilled
        contributors = materialize(contributors, "contributors")
        self.snapshots_table.append(drill.stamp_snapshot(current, now))
        return Run(results, contributors, errors)
