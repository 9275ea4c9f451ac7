"""What the operators share: tables, the shared folder, written intermediate tables, text expressions."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Space and the five ASCII controls that separate words.
SPACE = " \t\n\v\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where the session names none (tests, one machine), one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
        atexit.register(__import__("shutil").rmtree, folder.removeprefix("file://"), True)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Paths of tables written inside each open scratch().
_scratches: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables written inside, but for those with keep."""
    _scratches.append([])
    try:
        yield
    finally:
        for path in _scratches.pop():
            delete_path(spark, path)


def written(df: DataFrame, label: str, keep: bool = False, partition: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, with a folder for each value of partition: cuts the lineage and
    survives lost executors.

    Inside a scratch() the table goes with it; with keep it goes with the one around that, if any.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    if len(_scratches) > keep:
        _scratches[-1 - keep].append(path)
    df.write.option("compression", "zstd").parquet(path, partitionBy=partition)
    return spark.read.schema(df.schema).parquet(path)


def plan_bytes(df: DataFrame) -> int:
    """Spark's estimate of df's size; for a table that was written, the size of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


#: Bytes in memory that a side of a join may have to be broadcast.
BROADCAST = 128 << 20


def small(df: DataFrame, growth: int = 4, most: int | None = None) -> DataFrame:
    """df with a broadcast hint if the size of its files allows it; else the join shuffles. growth: memory over file size."""
    return F.broadcast(df) if plan_bytes(df) * growth <= (BROADCAST if most is None else most) else df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, also where body refers to it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else; the quick path is for texts of ASCII alone."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def space_words(text: Column) -> Column:
    """The words between the characters of SPACE; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def by_value(module: str) -> None:
    """Functions of the module travel to Python workers whole, so that these need not have this package."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[module])


def kept_by_worker(name: str, make: Callable):
    """What make() gives, made once in each Python worker process."""
    import sys

    held = sys.__dict__.setdefault("_tessera_held", {})
    if name not in held:
        held[name] = make()
    return held[name]


by_value(__name__)
