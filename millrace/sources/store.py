"""Tables kept as plain parquet with versions: a write makes a new version, readers see whole ones.

A table is a folder with ``data/`` (one folder per write) and ``versions/`` (one small file per commit, which names all
folders of that version). A version becomes visible by its file alone; a lost executor or a failed job leaves the old
version in place, and a reader keeps the version it began with.

The file of a version has a fixed name that only one writer can make: it is written aside and then moved there, and the
move fails where the name exists. So of two writers that start from the same version one is told that it lost: an
append then goes on top, since it does not depend on what it follows; any other write is refused. The move is by
Hadoop's ``FileContext``, which is atomic on HDFS and what has its semantics, and by a hard link on a mounted folder.
Object stores need a committer with conditional writes there.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.names import quoted
from millrace.operators import load
from millrace.sources.files import merge_schemas

PART = "_part"


class EmptyReplaceError(RuntimeError):
    """A replace without rows over a table that has some."""


class ConflictError(RuntimeError):
    """The table changed while a write was made from an older version of it; nothing was written."""


@dataclass(frozen=True)
class Version:
    """What a version consists of: whole folders, or one folder for each part of a keyed table."""

    number: int
    kind: str
    schema: T.StructType
    folders: list[str] = field(default_factory=list)
    parts: dict[str, str] = field(default_factory=dict)
    note: dict = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps(self.__dict__ | {"schema": self.schema.jsonValue()})

    @staticmethod
    def of(text: str) -> Version:
        found = json.loads(text)
        return Version(**found | {"schema": T.StructType.fromJson(found["schema"])})


class CommitLog:
    """The files ``versions/000000000001.json`` and so on of a table."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._jvm = spark._jvm
        self._folder = self._jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._folder.getFileSystem(self._conf)

    def _file(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self._folder, name)

    def newest(self) -> Version | None:
        """Only the last file is read, since it names all that belongs to its version."""
        if not self._fs.exists(self._folder):
            return None
        names = [s.getPath().getName() for s in self._fs.listStatus(self._folder)]
        last = max((n for n in names if n.endswith(".json") and not n.startswith(".")), default=None)
        if last is None:
            return None
        stream = self._fs.open(self._file(last))
        try:
            return Version.of(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def publish(self, version: Version) -> bool:
        """Make the file of this version; false if there is one."""
        aside, target = self._file(f".{uuid.uuid4().hex}.json"), self._file(f"{version.number:012}.json")
        out = self._fs.create(aside)
        out.write(bytearray(version.text().encode()))
        out.close()
        if self._fs.getUri().getScheme() == "file":
            # a local rename would replace the file
            try:
                os.link(aside.toUri().getPath(), target.toUri().getPath())
            except FileExistsError:
                return False
            return True
        none = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._folder.toUri(), self._conf).rename(aside, target, none)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in str(error.java_exception.getClass().getName()):
                return False
            raise
        return True


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path.rstrip("/")
        self.log = CommitLog(spark, self.path)

    def _newest(self) -> Version | None:
        return self.log.newest()

    def exists(self) -> bool:
        return self._newest() is not None

    def _rows(self, version: Version) -> DataFrame:
        return self.spark.read.schema(version.schema).parquet(*version.folders)

    def read(self) -> DataFrame:
        newest = self._newest()
        if newest is None:
            raise FileNotFoundError(f"no table at {self.path}")
        return self._rows(newest)

    def _write(self, df: DataFrame) -> str:
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        return folder

    def _commit(self, kind: str, folder: str, schema: T.StructType, base: Version | None, note: Mapping | None = None) -> bool:
        """Publish the version after ``base``; false if another writer has published it."""
        before = base.folders if base is not None and kind == "append" else []
        return self.log.publish(Version((base.number if base else 0) + 1, kind, schema, [*before, folder], note=dict(note or {})))

    def note(self) -> dict:
        """What the last write left beside its rows."""
        newest = self._newest()
        return {} if newest is None else newest.note

    def _commit_whole(self, kind: str, folder: str, schema: T.StructType, base: Version | None, note: Mapping | None = None) -> None:
        if not self._commit(kind, folder, schema, base, note):
            raise ConflictError(f"{self.path} has changed since version {base.number if base else 0}; {kind} again")

    def append(self, df: DataFrame) -> None:
        """Add rows; nothing is rewritten. Columns of the table that ``df`` lacks read as NULL, and new ones are added.

        The version to follow is looked up when the rows are written; appends of other writers meanwhile stay.
        """
        folder = self._write(df)
        while True:
            base = self._newest()
            schema = df.schema if base is None else merge_schemas(base.schema, df.schema)
            if self._commit("append", folder, schema, base):
                return

    def replace(self, df: DataFrame, allow_empty: bool = False, note: Mapping | None = None) -> None:
        """Swap in a whole new version. The rows are written once, then counted from the
        footers before the swap, so a refused replace leaves the old version live."""
        base = self._newest()
        folder = self._write(df)
        if base is not None and not allow_empty:
            staged = self.spark.read.schema(df.schema).parquet(folder)
            if staged.isEmpty() and not self._rows(base).isEmpty():
                raise EmptyReplaceError(f"replacing {self.path} by 0 rows; the old version stays")
        self._commit_whole("replace", folder, df.schema, base, note)

    def compact(self) -> None:
        """Rewrite the folders of many appends as one."""
        base = self._newest()
        if base is None:
            raise FileNotFoundError(f"no table at {self.path}")
        self._commit_whole("compact", self._write(self._rows(base)), base.schema, base)

    def merge(self, batch: DataFrame, keys: Sequence[str], latest_by: Sequence[str] = ()) -> None:
        """Upsert by key. Rewrites the table; ``merge_partitions`` rewrites only what a batch touches."""
        self._rewrite("merge", batch, lambda old: load.write_merge(old, batch, keys, latest_by))

    def delete_insert(self, batch: DataFrame, keys: Sequence[str]) -> None:
        self._rewrite("delete_insert", batch, lambda old: load.write_delete_insert(old, batch, keys))

    def _rewrite(self, kind: str, batch: DataFrame, change: Callable[[DataFrame], DataFrame]) -> None:
        base = self._newest()
        new = change(self.spark.createDataFrame([], batch.schema) if base is None else self._rows(base))
        self._commit_whole(kind, self._write(new), new.schema, base)


class KeyedTable:
    """A versioned table cut into parts, so that a merge reads and writes only the parts that its batch touches.

    A part is a hash bucket of the keys, or one value of ``partition``, a column that never changes for a key. A version
    names the folder of every part; those a batch does not touch keep theirs, file for file. Stored rows are not
    shuffled: they are filtered against the keys of the batch, which Spark broadcasts where it measures them as small,
    and written by the tasks that read them. Readers never see a part half replaced.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 64, partition: str | None = None) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.keys, self.buckets, self.partition = list(keys), buckets, partition
        self.log = CommitLog(spark, self.path)

    def _part(self) -> Column:
        if self.partition is not None:
            return F.md5(F.coalesce(F.concat(F.lit("="), F.col(quoted(self.partition)).cast("string")), F.lit("")))
        return F.pmod(F.xxhash64(*[quoted(k) for k in self.keys]), F.lit(self.buckets)).cast("string")

    def exists(self) -> bool:
        return self.log.newest() is not None

    def note(self) -> dict:
        """What the last write left beside its rows."""
        newest = self.log.newest()
        return {} if newest is None else newest.note

    def _rows(self, version: Version, parts: Sequence[str]) -> DataFrame:
        """The rows of some parts. The driver lists a path for each, as it does to plan any scan of folders."""
        if not parts:
            return self.spark.createDataFrame([], version.schema)
        return self.spark.read.schema(version.schema).parquet(*[f"{version.parts[p]}/{PART}={p}" for p in parts])

    def read(self) -> DataFrame:
        newest = self.log.newest()
        if newest is None:
            raise FileNotFoundError(f"no table at {self.path}")
        return self._rows(newest, sorted(newest.parts))

    def merge(self, batch: DataFrame, latest_by: Sequence[str] = (), note: Mapping | None = None) -> None:
        """Upsert by key: the latest row of the batch replaces that of the table."""
        order = [F.col(quoted(c)).desc_nulls_last() for c in latest_by]
        self._change("merge", load.first_row(batch, self.keys, order), note)

    def delete_insert(self, batch: DataFrame, note: Mapping | None = None) -> None:
        """All rows of the batch's keys go, the batch comes."""
        self._change("delete_insert", batch, note)

    def _change(self, kind: str, fresh: DataFrame, note: Mapping | None) -> None:
        base = self.log.newest()
        schema = fresh.schema if base is None else merge_schemas(base.schema, fresh.schema)
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        # written once, since the batch names the parts it touches before it is merged into them
        staged = f"{self.path}/staged/{uuid.uuid4().hex}"
        load.clustered(fresh.withColumn(PART, self._part()), PART).write.partitionBy(PART).parquet(staged)
        held = T.StructType([*fresh.schema.fields, T.StructField(PART, T.StringType())])
        fresh = self.spark.read.schema(held).parquet(staged)
        touched = [r[0] for r in fresh.select(PART).distinct().collect()]
        old = self.kept(base, fresh, touched)
        new = fresh if old is None else old.unionByName(fresh, allowMissingColumns=True)
        new.select(*[quoted(c) for c in schema.names], PART).write.partitionBy(PART).parquet(folder)
        parts = {} if base is None else base.parts
        version = Version((base.number if base else 0) + 1, kind, schema, [], parts | dict.fromkeys(touched, folder), dict(note or {}))
        if not self.log.publish(version):
            raise ConflictError(f"{self.path} has changed since version {version.number - 1}; {kind} again")

    def kept(self, base: Version | None, fresh: DataFrame, touched: Sequence[str]) -> DataFrame | None:
        """The stored rows of the touched parts whose keys the batch does not have."""
        parts = [p for p in touched if base is not None and p in base.parts]
        if not parts:
            return None
        gone = fresh.select(*[quoted(k) for k in self.keys]).distinct()
        return load.without_keys(self._rows(base, parts), gone, self.keys).withColumn(PART, self._part())


def merge_partitions(
    spark: SparkSession, path: str, batch: DataFrame, keys: Sequence[str], partition: str, latest_by: Sequence[str] = ()
) -> None:
    """Upsert into a parquet table partitioned by a column that never changes for a key.

    Only the partitions the batch touches are read and replaced: they are listed in the filter, which prunes the scan.
    The list is no longer than that of the table's partitions, which the driver holds to plan any scan.
    """
    target = spark.read.schema(batch.schema).parquet(path)
    touched = [r[0] for r in batch.select(partition).distinct().collect()]
    named = F.col(partition).isin([v for v in touched if v is not None])
    old = target.where(named | F.col(partition).isNull() if None in touched else named)
    merged = load.write_merge(old, batch, keys, latest_by).select(*batch.columns)
    load.clustered(merged, partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
