"""Incremental loading of files: what is new, changed or gone, and the ledger of what was loaded.

Loaded rows are parquet partitioned by unit (``_src_key``), so a changed file replaces its own
partition and nothing else. Readers go through the ledger: a unit counts as loaded when its
ledger row says so, and the semi join prunes the partitions of those that do not.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.functions.names import quoted
from millrace.operators.monitor import days, moment
from millrace.sources import files
from millrace.sources.store import VersionedTable

LEDGER = T.StructType(
    [
        T.StructField("source_name", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("file_size", T.LongType()),
        T.StructField("file_mtime", T.TimestampNTZType()),
        T.StructField("rows_loaded", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("loaded_at", T.TimestampNTZType()),
    ]
)

# Fixed value: days a deleted file is still shown.
SHOW_DELETED_DAYS = 7


class SchemaMismatchError(RuntimeError):
    """Files whose columns differ from the table's; nothing was loaded."""


def classify_files(listing: DataFrame, ledger: DataFrame) -> DataFrame:
    """Every listed or loaded unit as new, updated, unchanged or deleted.

    Ledger rows of deleted units do not count: one that comes back is new.
    """
    live = ledger.where(F.col("status") != "deleted").select("file_path", F.col("file_mtime").alias("_old"), F.lit(True).alias("_known"))
    listed = listing.withColumn("_listed", F.lit(True))
    state = (
        F.when(F.col("_known").isNull(), "new")
        .when(F.col("_listed").isNull(), "deleted")
        .when(F.col("file_mtime") > F.col("_old"), "updated")
        .otherwise("unchanged")
    )
    return listed.join(live, "file_path", "full").select("file_path", "file_size", "file_mtime", state.alias("state"))


def file_ledger(ledger: DataFrame, changes: DataFrame) -> DataFrame:
    """Upsert by (source, path): the row written last wins."""
    order = Window.partitionBy("source_name", "file_path").orderBy(F.desc("loaded_at"), F.desc("_new"))
    both = ledger.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_new")


def file_status(listing: DataFrame, ledger: DataFrame, now: datetime | Column) -> DataFrame:
    """Disk against ledger per unit; units deleted more than a week ago are not shown."""
    recent = F.col("loaded_at") > moment(now) - days(SHOW_DELETED_DAYS)
    shown = ledger.where((F.col("status") != "deleted") | recent).select(
        "file_path", "rows_loaded", "loaded_at", F.col("status").alias("_status"), F.lit(True).alias("_loaded")
    )
    on_disk = F.col("_on_disk").isNotNull()
    return (
        listing.withColumn("_on_disk", F.lit(True))
        .join(shown, "file_path", "full")
        .select(
            "file_path",
            F.substring_index("file_path", "/", -1).alias("file_name"),
            "file_size",
            "file_mtime",
            on_disk.alias("on_disk"),
            F.col("_loaded").isNotNull().alias("loaded"),
            "rows_loaded",
            "loaded_at",
            F.when(on_disk, F.col("_status")).otherwise("file_deleted").alias("status"),
        )
    )


def load_summary(outcomes: DataFrame, total_rows: DataFrame) -> DataFrame:
    """Counts by outcome and the table's rows; an error if files were tried and none loaded or deleted.

    ``outcomes``: (file_path, state, rows_loaded); ``total_rows``: one row, one number.
    """
    state, rows = F.col("state"), F.coalesce("rows_loaded", F.lit(0))
    tried = state.isin("new", "updated")
    counts = outcomes.agg(
        F.count_if((state == "new") & (rows > 0)).alias("new"),
        F.count_if((state == "updated") & (rows > 0)).alias("updated"),
        F.count_if(state == "deleted").alias("deleted"),
        F.count_if((state == "unchanged") | (tried & (rows == 0))).alias("skipped"),
        F.count_if(tried).alias("_tried"),
    )
    nothing = (F.col("_tried") > 0) & (F.col("new") + F.col("updated") + F.col("deleted") == 0)
    return (
        counts.withColumn("total_rows", total_rows.scalar())
        .withColumn("status", F.when(nothing, "error").otherwise("success"))
        .drop("_tried")
    )


def delete_file_rows(table: DataFrame, gone: DataFrame, key: str = "_src_file") -> DataFrame:
    """The table without the rows of vanished units (``file_path``)."""
    names = gone.select(F.col("file_path").alias(key)).distinct()
    return table.join(names, key, "left_anti").select(*table.columns)


class FileLoader:
    """Loads the files of one source into a table below ``path``."""

    def __init__(
        self,
        spark: SparkSession,
        source: str,
        folder: str,
        path: str,
        schema: T.StructType,
        pattern: str = "*",
        unit: str = "file",
        multiline: bool = False,
    ) -> None:
        self.spark, self.source = spark, source
        self.folder, self.path = folder.rstrip("/"), path.rstrip("/")
        self.pattern, self.unit, self.multiline = pattern, unit, multiline
        self.ledger_table = VersionedTable(spark, f"{self.path}/ledger")
        # An empty versioned table whose schema is the table's: it grows with the files.
        self.schema_table = VersionedTable(spark, f"{self.path}/schema")
        self.schema = self.schema_table.read().schema if self.schema_table.exists() else schema

    @property
    def rows_path(self) -> str:
        """Where the rows are: a folder of their own for every widening of types, named by the commit of the schema."""
        return f"{self.path}/{self.schema_table.note().get('rows', 'rows')}"

    def ledger(self) -> DataFrame:
        return self.ledger_table.read() if self.ledger_table.exists() else self.spark.createDataFrame([], LEDGER)

    def listing(self) -> DataFrame:
        return files.list_files(self.spark, self.folder, self.pattern, self.unit)

    def table(self) -> DataFrame:
        """Rows of the units the ledger has as loaded."""
        loaded = self.ledger().where("status = 'loaded'").select(F.md5("file_path").alias("_src_key"))
        stored = T.StructType([*self.schema.fields, *_PROVENANCE, T.StructField("_src_key", T.StringType())])
        rows = self.spark.read.schema(stored).parquet(self.rows_path)
        return rows.join(loaded, "_src_key", "left_semi").drop("_src_key")

    def rows_of(self, outcome: DataFrame) -> DataFrame:
        """The rows of the units that a load brought (its outcome); no other unit is read."""
        loaded = outcome.where(F.col("state").isin("new", "updated") & (F.col("rows_loaded") > 0))
        stored = T.StructType([*self.schema.fields, *_PROVENANCE])
        parts = [r["k"] for r in loaded.select(F.md5("file_path").alias("k")).collect()]  # as many as the load has read
        if not parts:
            return self.spark.createDataFrame([], stored)
        return self.spark.read.schema(stored).parquet(*[f"{self.rows_path}/_src_key={k}" for k in parts])

    def sync(self, now: datetime | Column, listing: DataFrame | None = None, evolve: bool = False) -> DataFrame:
        """Bring the table to the state of the files; returns the outcome per unit.

        With ``evolve`` new columns of the files are added, with the types found in them; rows
        loaded before read as NULL there; a column of numbers takes a wider type if a file needs it. Without it, other columns than the table's are an
        error before anything is loaded. Order matters for a crash in between: rows first, ledger
        last. A run that is repeated replaces the same partitions again.
        """
        # The outcome is used three times and its files may change meanwhile: fix it.
        found = classify_files(self.listing() if listing is None else listing, self.ledger())
        found = _kept(found, f"{self.path}/found")
        # Paths of this load only; the reader's own file index holds the same list.
        wanted = [r["file_path"] for r in found.where(F.col("state").isin("new", "updated")).select("file_path").collect()]
        if wanted:
            # One look at the CSV headers serves the check and the read.
            inputs = files.unit_paths(self.folder, self.unit, "csv", wanted)
            headers = files.csv_headers(self.spark, inputs, self.pattern) if inputs else []
            if evolve:
                self._grow_schema(wanted, headers)
            else:
                self._check_columns(wanted, headers)
            self._write_rows(wanted, now, headers)
        outcome = self._outcome(found, wanted, now)
        changes = outcome.where(
            (F.col("state") == "deleted") | (F.col("state").isin("new", "updated") & (F.col("rows_loaded") > 0))
        ).select(
            F.lit(self.source).alias("source_name"),
            "file_path",
            F.col("file_size").cast("bigint").alias("file_size"),
            "file_mtime",
            "rows_loaded",
            F.when(F.col("state") == "deleted", "deleted").otherwise("loaded").alias("status"),
            moment(now).alias("loaded_at"),
        )
        self.ledger_table.replace(file_ledger(self.ledger(), changes), allow_empty=True)
        return outcome

    def _check_columns(self, wanted: Sequence[str], headers: Sequence[dict]) -> None:
        columns = files.file_columns(
            self.spark, self.folder, self.pattern, self.unit, wanted, self.multiline, formats=("json", "parquet")
        )
        bad = [(r["file_path"], r["extra"], r["missing"]) for r in files.validate_file_schemas(columns, self.schema.names).collect()]
        expected = set(self.schema.names)
        for header in headers:
            extra, missing = sorted(set(header["columns"]) - expected), sorted(expected - set(header["columns"]))
            if extra or missing:
                bad += [(path.split(f"{self.folder}/")[-1], extra, missing) for path in header["paths"] + header["large"]]
        if bad:
            raise SchemaMismatchError("; ".join(f"{path}: extra {extra}, missing {missing}" for path, extra, missing in sorted(bad)))

    def _grow_schema(self, wanted: Sequence[str], headers: Sequence[dict]) -> None:
        """Take new columns, and wider types of known columns of numbers; the table's other types stand."""
        found = files.infer_schema(self.spark, self.folder, self.pattern, self.unit, wanted, self.multiline, headers)
        known = {f.name: f.dataType for f in self.schema.fields}
        fits = [f for f in found.fields if f.name not in known or files.wider(known[f.name], f.dataType) is not None]
        grown = files.merge_schemas(self.schema, T.StructType(fits), widen=True)
        if grown == self.schema:
            return
        note = self.schema_table.note()
        widened = [f for f in grown.fields if f.name in known and f.dataType != known[f.name]]
        if widened and self.ledger_table.exists():
            # files of the old type cannot be read as the new one: the rows move once, before the new schema is visible
            note = {"rows": f"rows-{uuid.uuid4().hex}"}
            stored = T.StructType([*self.schema.fields, *_PROVENANCE, T.StructField("_src_key", T.StringType())])
            old = self.spark.read.schema(stored).parquet(self.rows_path)
            old = old.withColumns({f.name: F.col(quoted(f.name)).cast(f.dataType) for f in widened})
            old.write.partitionBy("_src_key").parquet(f"{self.path}/{note['rows']}")
        self.schema = grown
        self.schema_table.replace(self.spark.createDataFrame([], grown), note=note)

    def _write_rows(self, wanted: Sequence[str], now: datetime | Column, headers: Sequence[dict]) -> None:
        rows = files.scan_files(
            self.spark,
            self.folder,
            self.schema,
            self.pattern,
            provenance=True,
            multiline=self.multiline,
            unit=self.unit,
            wanted=wanted,
            headers=headers,
        )
        tagged = (
            rows.withColumn("_src_loaded_at", moment(now)).withColumn("_src_deleted", F.lit(False)).withColumn("_src_key", F.md5("_src_file"))
        )
        # No shuffle: a task's input lies in few units, so it writes few partitions. A unit without
        # rows has no partition to overwrite, which keeps its old version.
        tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_src_key").parquet(self.rows_path)

    def _outcome(self, found: DataFrame, wanted: Sequence[str], now: datetime | Column) -> DataFrame:
        if not wanted:
            return found.withColumn("rows_loaded", F.lit(None).cast("bigint"))
        stored = T.StructType([*_PROVENANCE, T.StructField("_src_key", T.StringType())])
        rows = self.spark.read.schema(stored).parquet(self.rows_path)
        # The partitions of this run only, and in them its rows: the old rows of a file that is empty now carry an earlier time.
        keys = [hashlib.md5(path.encode()).hexdigest() for path in wanted]
        counts = rows.where(F.col("_src_key").isin(keys) & (F.col("_src_loaded_at") == moment(now))).groupBy("_src_key").agg(F.count(F.lit(1)).alias("_rows"))
        tried = F.col("state").isin("new", "updated")
        return (
            found.withColumn("_src_key", F.md5("file_path"))
            .join(counts, "_src_key", "left")
            .select("file_path", "file_size", "file_mtime", "state", F.when(tried, F.coalesce("_rows", F.lit(0))).alias("rows_loaded"))
        )


_PROVENANCE = [
    T.StructField("_src_file", T.StringType()),
    T.StructField("_src_mtime", T.TimestampNTZType()),
    T.StructField("_src_loaded_at", T.TimestampNTZType()),
    T.StructField("_src_deleted", T.BooleanType()),
]


def _kept(df: DataFrame, folder: str) -> DataFrame:
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
