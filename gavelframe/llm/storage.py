"""Tables and files that every executor can reach.

Everything that outlives one Spark job goes below ``spark.checkpoint.dir``; that setting is
read from the session and replaced by a temporary folder only where nobody has set it and
everything runs on one machine (tests); on a cluster without it, operators refuse to run.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import threading
import uuid
from collections.abc import Iterable

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by the driver and the executors."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.startswith("local-cluster") or not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = tempfile.mkdtemp(prefix="gavelframe-")
        spark.sparkContext.setCheckpointDir(_FALLBACK[app])
    return _FALLBACK[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/gavelframe/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete tables or files of the shared folder; missing ones are fine."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        with contextlib.suppress(Exception):
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def remove_all(spark: SparkSession) -> None:
    """Delete everything this application left in the shared folder, results that are still read included."""
    remove(spark, f"{shared_dir(spark)}/gavelframe/{spark.sparkContext.applicationId}")


_SETTINGS_LOCK = threading.RLock()


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Run jobs under other session settings; one operator of the process at a time, so that two never see each other's."""
    with _SETTINGS_LOCK:
        before = {name: spark.conf.get(name, None) for name in values}
        try:
            for name, value in values.items():
                spark.conf.set(name, value)
            yield
        finally:
            for name, value in before.items():
                spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def bounded_batches(spark: SparkSession, rows: int = 256, size: str = "4m"):
    """Bound the Arrow batches of the jobs run inside, for rows with long texts or sets."""
    return settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size})


def fresh(columns: Iterable[str], name: str) -> str:
    """name, or name with a number behind it, that none of columns has (case aside)."""
    taken, out, i = {c.lower() for c in columns}, name, 0
    while out.lower() in taken:
        i += 1
        out = f"{name}_{i}"
    return out


def trim_memory() -> None:
    """Give what a Python worker has freed back to the system; workers live longer than tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


class Scratch:
    """Written intermediate tables of one operator run."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def save(self, df: DataFrame, name: str, compact: bool = False) -> DataFrame:
        """Write df, cut its lineage, and return the table read back.

        compact: deal the rows anew before writing, so that a small result of many tasks makes few files.
        The shuffle files of the job go as soon as it has ended.
        """
        path = new_path(self.spark, name)
        with settings(self.spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
            (df.hint("rebalance") if compact else df).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[name] = path
        return out

    def save_bounded(self, df: DataFrame, name: str, rows: int = 256, size: str = "4m") -> DataFrame:
        """save() with small Arrow batches: Python stages hold a few texts at a time, not thousands."""
        with bounded_batches(self.spark, rows, size):
            return self.save(df, name)

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """save(), and drop every other table of this run: what is left is what the caller reads."""
        out = self.save(df, name)
        self.drop(*(n for n in list(self.paths) if n != name))
        return out

    def drop(self, *names: str) -> None:
        remove(self.spark, *(self.paths.pop(n) for n in names if n in self.paths))


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow file system and path, for Python code on an executor."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


@contextlib.contextmanager
def atomic_output(path: str):
    """Write to a temporary name beside path, then rename: a killed attempt leaves no half file."""
    fs, at = file_system(path)
    fs.create_dir(os.path.dirname(at), recursive=True)
    temporary = f"{at}.{uuid.uuid4().hex}.tmp"
    try:
        with fs.open_output_stream(temporary) as sink:
            yield sink
        fs.move(temporary, at)
    except BaseException:
        with contextlib.suppress(Exception):
            fs.delete_file(temporary)
        raise
