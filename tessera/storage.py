"""Tables in the shared folder: what a round leaves, and its end."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; without that setting, on one machine, one of our own that goes with the process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
        atexit.register(shutil.rmtree, folder.removeprefix("file://"), True)
    return folder.rstrip("/")


def path_of(spark: SparkSession, path: str):
    """(file system, path) of a path as Spark sees it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = path_of(spark, path)
    return fs.exists(target)


#: Paths of the tables written inside each open scratch().
_open: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables that round_table wrote inside, but for those with keep."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            fs, target = path_of(spark, path)
            fs.delete(target, True)


def round_table(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """df written to the shared folder and read back. Inside a scratch() it goes with it; with keep, with the one around that."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if len(_open) > keep:
        _open[-1 - keep].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes in memory that a side of a join may have to be broadcast.
BROADCAST = 64 << 20


def sized(df: DataFrame, growth: int = 4) -> DataFrame:
    """A written table as a side of a join: with a broadcast hint if the size of its files allows it, else with one for a merge join,
    so that neither side is broadcast by an estimate. growth: memory over file size."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size * growth <= BROADCAST else df.hint("merge")
