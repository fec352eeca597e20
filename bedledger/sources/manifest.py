"""The publish log: which files of each table are live.

Each publish adds one small file to `publish_log`, named by its number. It lists the data files that the publish adds
and takes out, with their rows and key ranges. Giving the file its name is the commit: a name is given once, so of two
publishes that start from the same state one gets the number and the other has to look at the state again. Readers fold
the entries; every `FOLD` entries their sum is stored as a file of its own, which readers start from.

A commit needs a file system that refuses to rename a file to a name in use, in one step: HDFS and local disks do. On
object stores without that, let one writer at a time publish.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "publish_log"
FOLD = 16
_SCHEMA = (
    "publish string, action string, table_name string, part string, path string, rows bigint, first_key string, last_key string"
)
_ENDING, _SUM = ".parquet", ".sum.parquet"


class MissingTables(Exception):
    """Nothing was ever published under this root folder."""


@dataclass(frozen=True)
class DataFile:
    """A stored file: its table and partition value, its place under the root, and what it holds."""

    table: str
    part: str
    path: str
    rows: int
    first_key: str | None
    last_key: str | None


@dataclass(frozen=True)
class State:
    """The live files after a publish. `publishes` are those that the log still knows."""

    seq: int = 0
    files: dict[str, DataFile] = field(default_factory=dict)
    publishes: frozenset[str] = frozenset()

    def of(self, table: str, parts: Iterable[str] | None = None) -> list[DataFile]:
        wanted = None if parts is None else set(parts)
        return [f for f in self.files.values() if f.table == table and (wanted is None or f.part in wanted)]

    def parts(self, table: str) -> set[str]:
        return {f.part for f in self.of(table)}


@dataclass(frozen=True)
class Change:
    """What a publish does to one table. It was worked out from the files of `parts` as one state had them."""

    table: str
    parts: frozenset[str]
    added: list[DataFile]
    removed: frozenset[str]

    def clashes(self, base: State, now: State) -> bool:
        """Another publish has changed one of these parts since."""
        return {f.path for f in base.of(self.table, self.parts)} != {f.path for f in now.of(self.table, self.parts)}


def filesystem(spark: SparkSession, path: str):
    """The Hadoop path and its file system."""
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return made, made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove_folder(spark: SparkSession, path: str) -> None:
    target, files = filesystem(spark, path)
    files.delete(target, True)


def _names(spark: SparkSession, root: str) -> list[str]:
    pattern, files = filesystem(spark, f"{root}/{LOG}/*{_ENDING}")
    return sorted(f.getPath().getName() for f in files.globStatus(pattern) or [])


def _number(name: str) -> int:
    return int(name.partition(".")[0])


def read_state(spark: SparkSession, root: str, or_empty: bool = False) -> State:
    """Fold the log: the last stored sum and the entries after it. One row per live or lately changed file reaches the driver."""
    while True:
        names = _names(spark, root)
        if not names:
            if or_empty:
                return State()
            raise MissingTables(f"no tables under {root}")
        start = max((_number(n) for n in names if n.endswith(_SUM)), default=0)
        wanted = [n for n in names if (_number(n) == start) == n.endswith(_SUM) and _number(n) >= start]
        try:
            rows = _entries(spark, root, wanted).collect()
            break
        except Py4JJavaError:  # an entry was folded and removed meanwhile: look again
            if _names(spark, root) == names:
                raise
    files: dict[str, DataFile] = {}
    # a file is added once and never comes back, so removals of later entries win
    for r in rows:
        if r.action == "add":
            files[r.path] = DataFile(r.table_name, r.part, r.path, r.rows, r.first_key, r.last_key)
    for r in rows:
        if r.action == "remove":
            files.pop(r.path, None)
    return State(max(map(_number, names)), files, frozenset(r.publish for r in rows))


def _entries(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    return spark.read.schema(_SCHEMA).parquet(*(f"{root}/{LOG}/{n}" for n in names))


def _written(spark: SparkSession, root: str, rows: list[tuple]) -> str:
    """Rows as one finished file with a name that readers do not look at."""
    folder = f"{root}/{LOG}/_new-{uuid.uuid4().hex}"
    spark.createDataFrame(rows, _SCHEMA).coalesce(1).write.parquet(folder)
    pattern, files = filesystem(spark, f"{folder}/*{_ENDING}")
    return files.globStatus(pattern)[0].getPath().toString()


def name_once(spark: SparkSession, written: str, target: str) -> bool:
    """Give a finished file its name, unless a file has that name; says whether it did."""
    source, files = filesystem(spark, written)
    to, _ = filesystem(spark, target)
    if files.getScheme() == "file":
        try:
            # refused in one step where the name is in use, unlike a local rename
            os.link(source.toUri().getPath(), to.toUri().getPath())
        except FileExistsError:
            return False
        return True
    return rename_once(spark, written, target)


def rename_once(spark: SparkSession, written: str, target: str) -> bool:
    context, jvm = spark.sparkContext, spark.sparkContext._jvm
    source, to = (jvm.org.apache.hadoop.fs.Path(p) for p in (written, target))
    no_options = context._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), context._jsc.hadoopConfiguration()).rename(source, to, no_options)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in str(e.java_exception.getClass()):
            raise
        return False
    return True


def commit(spark: SparkSession, root: str, publish: str, changes: list[Change], base: State) -> bool:
    """Make the changes live as the publish after `base`; False if another one has taken that number."""
    rows = [(publish, "add", f.table, f.part, f.path, f.rows, f.first_key, f.last_key) for c in changes for f in c.added]
    rows += [(publish, "remove", c.table, None, path, None, None, None) for c in changes for path in sorted(c.removed)]
    written = _written(spark, root, rows or [(publish, None, None, None, None, None, None, None)])
    seq = base.seq + 1
    done = name_once(spark, written, f"{root}/{LOG}/{seq:012}{_ENDING}")
    remove_folder(spark, written.rpartition("/")[0])
    if done and any(n.endswith(_SUM) and _number(n) >= seq for n in _names(spark, root)):
        # the number was free only because its entry has been folded and forgotten
        path, files = filesystem(spark, f"{root}/{LOG}/{seq:012}{_ENDING}")
        files.delete(path, False)
        return False
    if done and seq % FOLD == 0:
        fold(spark, root, read_state(spark, root))
    return done


def fold(spark: SparkSession, root: str, state: State) -> None:
    """Store the sum of the log up to a state. The entries stay; a sum that is there already is the same."""
    rows = [("", "add", f.table, f.part, f.path, f.rows, f.first_key, f.last_key) for f in state.files.values()]
    rows += [(p, None, None, None, None, None, None, None) for p in sorted(state.publishes - {""})]
    written = _written(spark, root, rows or [("", None, None, None, None, None, None, None)])
    name_once(spark, written, f"{root}/{LOG}/{state.seq:012}{_SUM}")
    remove_folder(spark, written.rpartition("/")[0])


def forget(spark: SparkSession, root: str, state: State) -> None:
    """Remove the log entries that the stored sum of `state` stands for."""
    for name in _names(spark, root):
        if name != f"{state.seq:012}{_SUM}" and _number(name) <= state.seq:
            path, files = filesystem(spark, f"{root}/{LOG}/{name}")
            files.delete(path, False)


def describe_files(stored: DataFrame, table: str, key: str, partition: str | None) -> list[DataFile]:
    """The files a frame was read from, with their rows and key ranges; reads the key column."""
    part = F.col(partition).cast("string") if partition else F.lit("")
    found = (
        stored.select(F.col("_metadata.file_path").alias("path"), part.alias("part"), F.col(key).alias("key"))
        .groupBy("path", "part")
        .agg(F.count("*").alias("rows"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))
    )
    # one row per file
    return [DataFile(table, r.part, stored_path(r.path, table), r.rows, r.first_key, r.last_key) for r in found.collect()]


def stored_path(path: str, table: str) -> str:
    """The place of a data file under the root: everything from its version folder on, below the table's folder."""
    return f"{table}/{path[path.rindex(f'/{table}/version=') + len(table) + 2:]}"
