"""Curves over ranked or ordered topics, as running sums in segments: a group is no one task's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .dedup import cumulated, dense_ids
from .scan import numbered, scanned


def _rate(x: str, n: str):
    return F.col(x) / F.nullif(F.col(n), F.lit(0))


def roc(rows: DataFrame, order: str, hit: str, *by: str) -> DataFrame:
    """rows with tp, fp, tpr, fpr along the order; a rate without a denominator is null. A null hit counts as neither."""
    one = lambda c: F.when(c, 1).otherwise(0).cast("long")
    up = scanned(rows, order, {"tp": one(F.col(hit)), "fp": one(~F.col(hit))}, *by, totals={"__tps": "tp", "__fps": "fp"})
    return up.withColumns({"tpr": _rate("tp", "__tps"), "fpr": _rate("fp", "__fps")}).drop("__tps", "__fps")


def precision_recall(rows: DataFrame, order: str, hit: str, *by: str) -> DataFrame:
    """k (from 1), precision and recall of the first k rows."""
    up = scanned(rows, order, {"k": F.lit(1).cast("long"), "__tp": F.when(F.col(hit), 1).otherwise(0).cast("long")}, *by, totals={"__tps": "__tp"})
    return up.withColumns({"k": F.col("k").cast("int"), "precision": F.col("__tp") / F.col("k"), "recall": _rate("__tp", "__tps")}).drop("__tp", "__tps")


def precision_recall_as_coded(first_ids: DataFrame, n: int) -> DataFrame:
    """k from 0, precision, recall where k counts as found if it is one of first_ids, and precision at 0 is 1."""
    spark = first_ids.sparkSession
    ids = first_ids.select(F.col("first_id").alias("k"), F.lit(1).alias("hit")).distinct()
    rows = spark.range(n).withColumnRenamed("id", "k").join(ids, "k", "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    total = ids.where((F.col("k") >= 0) & (F.col("k") < n)).agg(F.count("*").alias("total"))
    rows = cumulated(rows, "k", "hit", "tp").join(F.broadcast(total), F.lit(True))
    tp = F.col("tp")
    return rows.select("k", F.when(F.col("k") == 0, 1.0).otherwise(tp / F.nullif(F.col("k"), F.lit(0))).alias("precision"), (tp / F.nullif(F.col("total"), F.lit(0))).alias("recall"))


def recall_curve(first_ids: DataFrame, steps: int, total: int) -> DataFrame:
    """step 1..steps, recall: the share of labels whose first_id is at most step (null: never found)."""
    found = first_ids.where("first_id is not null").groupBy(F.greatest(F.col("first_id"), F.lit(1)).alias("step")).agg(F.count("*").alias("n"))
    grid = first_ids.sparkSession.range(1, steps + 1).withColumnRenamed("id", "step")
    rows = cumulated(grid.join(found, "step", "left"), "step", "n", "n_found")
    return rows.select("step", (F.col("n_found") / F.lit(total)).alias("recall"))


#: Buckets that the rows of a group are dealt to before the first of each are taken.
BUCKETS = 32


def precision_at(rows: DataFrame, order: str, hit: str, ks: tuple[int, ...] = (10, 100, 1000), *, clip: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """A column precision_at_k for each k; the denominator is k, or with clip the number of rows if smaller."""
    # The first rows of each bucket of a group hold the first of the group; Spark limits them before it shuffles.
    bucket = F.pmod(F.xxhash64(order), F.lit(BUCKETS))
    first = F.row_number().over(Window.partitionBy(*by, bucket).orderBy(order))
    few = rows.withColumn("__rn", first).where(F.col("__rn") <= max(ks)).drop("__rn")
    ranked = numbered(few, order, "rn", *by).where(F.col("rn") <= max(ks))
    n = lambda k: F.least(F.lit(k), F.count("*")) if clip else F.lit(k)
    return ranked.groupBy(*by).agg(*[(F.count_if((F.col("rn") <= k) & F.col(hit)) / n(k)).alias(f"precision_at_{k}") for k in ks])


def discovery(first_ids: DataFrame, max_steps: int | None = None) -> DataFrame:
    """first_id, n_found before it; with max_steps a last point that carries the total on."""
    rows = dense_ids(first_ids.where("first_id is not null").select("first_id"), "first_id").select("first_id", F.col("id").cast("long").alias("n_found"))
    if max_steps is None:
        return rows
    return rows.unionByName(first_ids.agg(F.lit(max_steps).cast("long").alias("first_id"), F.count("first_id").alias("n_found")))


def cumulative_distinct(rows: DataFrame, order: str, value: str, *by: str) -> DataFrame:
    """rows with n_seen: distinct values up to each row; rows that share an order see each other."""
    firsts = rows.groupBy(*by, value).agg(F.min(order).alias(order)).drop(value)
    # A marker where a value comes first, in front of the rows there.
    place = lambda df, at: df.withColumn("__place", F.struct(F.col(order).alias("o"), F.lit(at).alias("at")))
    both = place(rows.withColumn("__new", F.lit(0).cast("long")), 1).unionByName(place(firsts.withColumn("__new", F.lit(1).cast("long")), 0), allowMissingColumns=True)
    return scanned(both, "__place", {"n_seen": F.col("__new")}, *by).where("__new = 0").select(*rows.columns, "n_seen")


def translation_pairs(items: DataFrame, order: str, text: str, *by: str) -> DataFrame:
    """items with next_text, and whether the next item is its translation (this one has Han letters, the next none)."""
    from ..functions.text import has_han

    nxt = F.lead(text).over(Window.partitionBy(*by).orderBy(order))
    return items.withColumn("next_text", nxt).withColumn("has_translation", has_han(F.col(text)) & F.col("next_text").isNotNull() & ~has_han(F.col("next_text")))
