"""Running sums over ordered rows, in segments, without a task that holds a whole segment.

Rows are dealt to parts by split points of (group, order), which come from a sample of the distinct keys. The split
points are a scalar subquery over the rows, so they are the same wherever the plan uses them, and a row's part is a
function of its key alone. Each part sums its own rows; the parts' totals, a row for each part and group, are summed
over the parts, and what lies before a part enters it as one more row in front. So a group is as many tasks as it
has parts, and small groups share one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType
from pyspark.sql.window import Window

#: Sampled keys for each part.
SAMPLES = 20


def split_points(keys: DataFrame, key: str, n: int) -> Column:
    """An array of at most n - 1 keys that cut the distinct keys into about equal parts: a scalar subquery over a sample of them, about
    SAMPLES * n, that have the least hashes."""
    share = F.pmod(F.xxhash64(key), F.lit(1 << 31)).cast("double") / float(1 << 31)
    count = keys.agg(F.count("*").cast("double").alias("n")).scalar()
    # A key that many rows have is sampled once; it is reduced before the shuffle.
    sample = keys.where(share * count < SAMPLES * n).select(key).distinct()
    ordered = sample.agg(F.sort_array(F.collect_list(key)).alias("s"))
    at = lambda i: F.get("s", F.floor(i * F.size("s") / n).cast("int"))
    return ordered.select(F.transform(F.sequence(F.lit(1), F.lit(n - 1)), at)).scalar()


def part_of(key: Column, points: Column, n: int) -> Column:
    """How many of the split points are at most key, by bisection."""
    steps = [1 << k for k in reversed(range(max(n - 1, 1).bit_length()))]
    further = lambda at, step, k: at + F.when((at + step <= F.size(points)) & (F.get(points, at + step - 1) <= k), step).otherwise(0)
    search = lambda k: F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, step: further(at, step, k))
    return F.transform(F.array(key), search)[0]


def with_parts(rows: DataFrame, order: str, *by: str, n: int | None = None, apart: bool = True) -> DataFrame:
    """rows with __part, that rises with (by, order), and __tie, a hash of the whole row that orders rows of one place. With apart
    such rows may be in several parts; rows that are equal in all columns share one."""
    n = n or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = [f.name for f in rows.schema.fields if not isinstance(f.dataType, (MapType, VariantType))]
    keyed = rows.withColumn("__tie", F.xxhash64(*[F.col(f"`{c}`") for c in hashed]))
    if n == 1:
        return keyed.withColumn("__part", F.lit(0))
    tie = [F.col("__tie").alias("t")] if apart else []
    keyed = keyed.withColumn("__key", F.struct(*[F.col(b).alias(f"b{i}") for i, b in enumerate(by)], F.col(order).alias("o"), *tie))
    placed = keyed.withColumn("__points", split_points(keyed, "__key", n))
    return placed.withColumn("__part", part_of(F.col("__key"), F.col("__points"), n)).drop("__key", "__points")


def scanned(rows: DataFrame, order: str, sums: dict[str, Column], *by: str, totals: dict[str, str] | None = None, n: int | None = None) -> DataFrame:
    """rows with a column for each of sums: its sum over the rows of the group (by) up to this one, in ascending order (nulls first,
    equal rows in any order; a null adds nothing). totals: further columns with the whole group's sum of one of sums.
    """
    values = {f"__v{i}": F.coalesce(v, F.lit(0)) for i, v in enumerate(sums.values())}
    place = {name: f"__v{i}" for i, name in enumerate(sums)}
    parts = with_parts(rows, order, *by, n=n).withColumns(values)
    each = parts.groupBy("__part", *by).agg(*[F.sum(v).alias(v) for v in values])
    whole = Window.partitionBy(*by)
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ends = [F.sum(place[of]).over(whole).alias(f"__all_{name}") for name, of in (totals or {}).items()]
    carried = each.select("__part", *by, *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(v) for v in values], *ends, F.lit(0).alias("__row"))
    both = parts.withColumn("__row", F.lit(1)).unionByName(carried, allowMissingColumns=True)
    run = Window.partitionBy("__part", *by).orderBy("__row", order, "__tie").rowsBetween(Window.unboundedPreceding, 0)
    out = {name: F.sum(v).over(run) for name, v in place.items()} | {name: F.first(f"__all_{name}").over(run) for name in totals or {}}
    new = both.withColumns(out).where("__row = 1")
    return new.select(*[f"`{c}`" for c in rows.columns if c not in out], *out)


def numbered(rows: DataFrame, order: str, name: str, *by: str, n: int | None = None) -> DataFrame:
    """rows with name: 1, 2, ... in order, inside each group of by."""
    return scanned(rows, order, {name: F.lit(1).cast("long")}, *by, n=n)
