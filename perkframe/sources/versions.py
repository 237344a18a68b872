"""Replacing stored data in one step.

Data go to a folder or table of their own; nothing that readers see changes
until one small write, the commit, names it.  A write that fails before it
leaves the old version as it was, and one that fails after it only leaves the
old version behind, which the next write removes.

Folders: ``<path>/v-<id>/`` hold the versions and ``<path>/_commits/<number>``
names one each.  Numbers go up by one and a commit file is made by renaming, so
of two writers at once only one gets a number and the other is told.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_LOG = "_commits"


class ConcurrentWrite(RuntimeError):
    """Another writer committed in between; nothing of this write is seen."""


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _commits(spark: SparkSession, path: str) -> dict[int, str]:
    """Number of each commit -> its file."""
    jvm, fs = _fs(spark, path)
    log = jvm.org.apache.hadoop.fs.Path(f"{path}/{_LOG}")
    if not fs.exists(log):
        return {}
    names = [x.getPath().getName() for x in fs.listStatus(log)]
    return {int(n): f"{path}/{_LOG}/{n}" for n in names if n.isdigit()}


def current(spark: SparkSession, path: str) -> str | None:
    """Folder of the committed version of ``path``; None without a commit."""
    found = _commits(spark, path)
    return f"{path}/{_named(spark, found[max(found)])}" if found else None


def _named(spark: SparkSession, commit: str) -> str:
    jvm, fs = _fs(spark, commit)
    stream = fs.open(jvm.org.apache.hadoop.fs.Path(commit))
    try:
        return stream.readUTF()
    finally:
        stream.close()


def replace(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """Call ``write(folder)`` with a new folder, then make it the version that
    readers see; older versions are removed after that.  Returns the folder."""
    held = _commits(spark, path)
    before, replaced = max(held, default=0), {_named(spark, file) for file in held.values()}
    name = f"v-{uuid.uuid4().hex}"
    jvm, fs = _fs(spark, path)
    at = jvm.org.apache.hadoop.fs.Path
    try:
        write(f"{path}/{name}")
        draft, final = at(f"{path}/{_LOG}/.{name}"), at(f"{path}/{_LOG}/{before + 1:010d}")
        stream = fs.create(draft, True)
        stream.writeUTF(name)
        stream.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise ConcurrentWrite(f"{path} was replaced by another writer")
    except BaseException:
        fs.delete(at(f"{path}/{name}"), True)
        raise
    for file in held.values():
        fs.delete(at(file), False)
    day_old = jvm.System.currentTimeMillis() - 86_400_000
    for x in fs.listStatus(at(path)):
        folder = x.getPath().getName()
        # versions without a commit may be of writers still at work, unless old
        if folder != name and (folder in replaced or folder.startswith("v-") and x.getModificationTime() < day_old):
            fs.delete(x.getPath(), True)
    return f"{path}/{name}"


def replace_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """A8 in one step: the Parquet table at ``path`` becomes ``df``, which may
    be read from it."""
    def write(folder: str) -> None:
        w = df.write.mode("errorifexists")
        (w.partitionBy(*partition_by) if partition_by else w).parquet(folder)

    replace(df.sparkSession, path, write)


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The committed version of a table written by :func:`replace_parquet`; a
    folder without commits is read as it is."""
    return spark.read.parquet(current(spark, path) or path)


def replace_table(spark: SparkSession, name: str, write: Callable[[str], None], path: str | None = None) -> None:
    """A6 in one step: ``write(version)`` saves a new table of that name (under
    ``path``, if given), then the view ``name`` is pointed at it, which is the
    commit, and older versions are dropped.  A plain table ``name`` of before
    becomes a version first."""
    from ..session import remove_path
    version = f"{name}__v_{uuid.uuid4().hex}"
    database, _, short = name.rpartition(".")

    def drop(table: str) -> None:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        if path:  # an external table's files stay when it is dropped
            remove_path(spark, f"{path}/{table.rpartition('.')[2]}")

    try:
        write(version)
    except BaseException:
        drop(version)
        raise
    if spark.catalog.tableExists(name) and spark.catalog.getTable(name).tableType != "VIEW":
        spark.sql(f"ALTER TABLE {name} RENAME TO {name}__v_{uuid.uuid4().hex}")
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {version}")
    for t in spark.catalog.listTables(database or None, f"{short}__v_*"):
        full = f"{database}.{t.name}" if database else t.name
        if full.lower() != version.lower():
            drop(full)
