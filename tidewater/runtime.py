"""Where intermediate tables go: the folder that spark.checkpoint.dir names, shared by the driver and all executors."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


#: Bytes of a row group in staged tables: what each writing task holds in memory.
ROW_GROUP = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared folder. Where the session names none, a local one is made and set if all runs on one machine; on a cluster that
    is an error, as executors don't see each other's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidewater-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def scratch_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one. It is deleted when the application ends: results that are still to be
    read have to be written elsewhere by then."""
    path = f"{shared_dir(spark)}/tidewater-{spark.sparkContext.applicationId}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        fs.mkdirs(at)
        fs.deleteOnExit(at)
    return path


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is run within leaves no shuffle files: for writes, whose plans nothing reads again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def staged(df: DataFrame) -> DataFrame:
    """A written Parquet table in the shared folder, read again: the rows survive the loss of any executor, lineage is cut and
    the planner knows the table's size, so a join broadcasts it only below spark.sql.autoBroadcastJoinThreshold and
    shuffles it otherwise. The shuffle files that its plan made go when it is written."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/staged-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.option("parquet.block.size", ROW_GROUP).option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    if _OPEN:
        _OPEN[-1].append(out)
    return out


def counted(df: DataFrame) -> DataFrame:
    """A staged table whose number of rows was taken while it was written: ``staged_rows``. (A stage that runs again after a loss may
    count rows twice, so only none and some are sure.)"""
    seen = Observation()
    out = staged(df.observe(seen, F.count(F.lit(1)).alias("n")))
    out.staged_rows = seen.get["n"]
    return out


def bucketed(df: DataFrame, column: str) -> DataFrame:
    """A staged and counted table in as many buckets as the session has shuffle partitions, by ``column``: joins on it don't shuffle it
    again."""
    spark, name = df.sparkSession, f"staged_{uuid.uuid4().hex}"
    n, path = int(spark.conf.get("spark.sql.shuffle.partitions")), f"{scratch_dir(spark)}/{name}"
    seen = Observation()
    with shuffles_removed(spark):
        df.observe(seen, F.count(F.lit(1)).alias("n")).repartition(n, column).write.bucketBy(n, column).sortBy(column).option("path", path).option("compression", "zstd").saveAsTable(name)
    out = spark.table(name)
    out.staged_at, out.staged_name, out.staged_rows = path, name, seen.get["n"]
    if _OPEN:
        _OPEN[-1].append(out)
    return out


#: For each tidy() call that is running, the tables staged in it.
_OPEN: list[list[DataFrame]] = []


def tidy(f: Callable) -> Callable:
    """The function's results (one DataFrame or a tuple) are staged, and all other tables that it staged are deleted."""
    @functools.wraps(f)
    def run(*args, **kwargs):
        _OPEN.append([])
        try:
            out = f(*args, **kwargs)
            own = _OPEN[-1]
            kept = [x if any(x is t for t in own) else staged(x) for x in (out if isinstance(out, tuple) else (out,))]
            unstage(*(t for t in own if not any(t is x for x in kept)))
        finally:
            _OPEN.pop()
        if _OPEN:  # the results belong to the caller's tables
            _OPEN[-1].extend(kept)
        return tuple(kept) if isinstance(out, tuple) else kept[0]

    return run


def unstage(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing will read any more: neither they nor what was derived from them and not staged itself."""
    for df in tables:
        at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.staged_at)
        if getattr(df, "staged_name", None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {df.staged_name}")
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Cutting lineage between the rounds of a loop is the same: a written table.
cut = staged
