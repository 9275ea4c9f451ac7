"""Deterministic sampling: hashed orders in place of random draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hashed(seed: int, *values: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(seed), *[v.cast("string") for v in values]))


def stratified(rows: DataFrame, cluster: str, stratum: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of each cluster: an even quota of each stratum, then the rest in hashed order."""
    o = hashed(seed, F.col(key))
    within = F.row_number().over(Window.partitionBy(cluster, stratum).orderBy(o, key))
    strata = rows.groupBy(cluster).agg(F.count_distinct(stratum).alias("strata"))
    marked = rows.withColumn("rank_in_stratum", within).join(strata, cluster)
    over = F.col("rank_in_stratum") > F.ceil(F.lit(n) / F.col("strata"))
    order = F.row_number().over(Window.partitionBy(cluster).orderBy(over, hashed(seed, F.col(key)), key))
    return marked.withColumn("place", order).where(F.col("place") <= n).drop("rank_in_stratum", "strata")


def repeated(rows: DataFrame, times: int) -> DataFrame:
    """rows with gen_idx 0..times-1."""
    return rows.withColumn("gen_idx", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def drawn(requests: DataFrame, items: DataFrame, seed: int, name: str) -> DataFrame:
    """requests (step, i) each with one item drawn with replacement; items: item, pos (from 0, dense)."""
    n = items.agg(F.count("*").alias("n_items"))
    pick = F.conv(F.substring(hashed(seed, F.lit(name), F.col("step"), F.col("i")), 1, 12), 16, 10).cast("long") % F.col("n_items")
    chosen = requests.join(F.broadcast(n), F.lit(True)).withColumn("pos", pick).drop("n_items")
    return chosen.join(items.select("pos", F.col("item").alias(name)), "pos", "left").drop("pos")


def cycled(templates: Column, index: Column) -> Column:
    return F.element_at(templates, (index % F.size(templates)).cast("int") + 1)
