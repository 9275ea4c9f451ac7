"""Sets of tables that appear together: all of a version or none of it.

A version's tables are written below versions/, which nobody reads by itself. Its manifest, a small JSON file with the tables' paths,
schemas and row counts and the run's settings, is written beside and then renamed to manifests/<number>.json: that rename is
the commit. Readers take the manifest with the highest number, so they see a whole version or the one before, whatever
fails in between; of two writers with one number the second fails. A rename that replaces nothing is atomic on HDFS and
local folders; an object store needs a committer that gives the same.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..storage import path_of


@dataclass
class Version:
    number: int
    tables: dict[str, dict]
    meta: dict

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        entry = self.tables[name]
        return spark.read.schema(StructType.fromJson(entry["schema"])).parquet(entry["path"])


def _numbers(spark: SparkSession, path: str) -> list[int]:
    fs, target = path_of(spark, f"{path}/manifests")
    if not fs.exists(target):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(target)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())


def current(spark: SparkSession, path: str, number: int | None = None) -> Version | None:
    """The last version at path, or that with a number; None without any."""
    numbers = _numbers(spark, path)
    if not numbers or (number is not None and number not in numbers):
        return None
    number = numbers[-1] if number is None else number
    text = "\n".join(r[0] for r in spark.read.text(f"{path}/manifests/{number}.json", wholetext=True).collect())
    found = json.loads(text)
    return Version(number, found["tables"], found["meta"])


def publish(spark: SparkSession, path: str, tables: dict[str, DataFrame], meta: dict | None = None) -> Version:
    """Writes the tables and makes them the current version."""
    number = max(_numbers(spark, path), default=0) + 1
    # A name of its own: what a writer that failed has left is in nobody's way.
    home = f"{path}/versions/{number}-{uuid.uuid4().hex}"
    entries = {}
    for name, df in tables.items():
        df.write.parquet(f"{home}/{name}")
        entries[name] = {"path": f"{home}/{name}", "schema": df.schema.jsonValue(), "rows": spark.read.schema(df.schema).parquet(f"{home}/{name}").count()}
    fs, target = path_of(spark, f"{path}/manifests/{number}.json")
    draft = path_of(spark, f"{home}/manifest.json")[1]
    out = fs.create(draft, False)
    try:
        out.write(bytearray(json.dumps({"tables": entries, "meta": meta or {}}).encode()))
    finally:
        out.close()
    fs.mkdirs(target.getParent())
    if fs.exists(target) or not fs.rename(draft, target):
        raise FileExistsError(f"version {number} at {path} was published by another writer")
    return Version(number, entries, meta or {})


def retire(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Deletes all versions but the last ones, and what failed writers left of their numbers; the numbers deleted."""
    numbers = _numbers(spark, path)
    gone = numbers[: max(len(numbers) - keep, 0)]
    for number in gone:
        fs, target = path_of(spark, f"{path}/manifests/{number}.json")
        fs.delete(target, False)
    fs, home = path_of(spark, f"{path}/versions")
    for status in fs.listStatus(home) if fs.exists(home) else []:
        if int(status.getPath().getName().partition("-")[0]) in gone:
            fs.delete(status.getPath(), True)
    return gone
