"""Folders that the driver and all executors share, and tables in them."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: The folder in which saved() writes now, where workspace() holds one.
_FOLDER: ContextVar[str | None] = ContextVar("folder", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of this machine only where the session is local and names none."""
    sc = spark.sparkContext
    kept = sc._jsc.sc().getCheckpointDir()
    if kept.isDefined():
        return kept.get()
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a shared folder")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidelog-"))
    return sc._jsc.sc().getCheckpointDir().get()


def hadoop(spark: SparkSession, path: str):
    """(file system, path) as the JVM has them."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def names(spark: SparkSession, path: str) -> list[str]:
    """What a folder holds; nothing, if it isn't there."""
    fs, p = hadoop(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop(spark, path)
    return bool(fs.delete(p, True))


def rename(spark: SparkSession, old: str, new: str) -> bool:
    """Puts a folder in its place at once; False if something is there. One writer."""
    fs, p = hadoop(spark, new)
    fs.mkdirs(p.getParent())
    return not fs.exists(p) and bool(fs.rename(hadoop(spark, old)[1], p))


def give_back(spark: SparkSession) -> None:
    """Has the driver's JVM return the native memory that it has freed: where many plans are made, some hundred MB of it stay with malloc.

    HotSpot on glibc can do that; elsewhere nothing happens.
    """
    jvm, made = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    try:
        server = jvm.java.lang.Class.forName("javax.management.MBeanServer")  # its own class can't be reached
        (invoke,) = (m for m in server.getMethods() if m.getName() == "invoke")
        given = made(jvm.java.lang.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except (Py4JError, ValueError):
        pass


@contextmanager
def workspace(spark: SparkSession) -> Iterator[str]:
    """A folder in the shared one for the tables that saved() writes inside; it goes when the block ends, or fails."""
    path = f"{shared_dir(spark)}/work-{uuid.uuid4().hex}"
    before = _FOLDER.set(path)
    try:
        yield path
    finally:
        _FOLDER.reset(before)
        remove(spark, path)


def saved(df: DataFrame) -> DataFrame:
    """The rows, computed once and written as Parquet in the shared folder: lineage is cut, sizes are known to the planner.

    The files go with the workspace() around the call. Outside of one they stay (table-* in the shared folder) until the
    caller deletes them, as rows are read from them whenever the result is used.
    """
    path = f"{_FOLDER.get() or shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    give_back(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, build: Callable[[str], DataFrame]) -> DataFrame:
    """What build(folder) returns, written; the folder, and the tables saved on the way, are gone."""
    outer = _FOLDER.get()
    with workspace(spark) as folder:
        rows = build(folder)
        inner = _FOLDER.set(outer)
        try:
            return saved(rows)
        finally:
            _FOLDER.reset(inner)
