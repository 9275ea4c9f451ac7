"""Exact deduplication: against known heads, inside a batch, and across runs with provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keys import strip, summary_key, trim_key
from .scan import numbered, scanned


def with_provenance(topics: DataFrame, topic: str = "topic", run: str = "run", pos: str = "pos") -> DataFrame:
    """topic_key, topic (first spelling, stripped), n_runs, runs (sorted), first_pos for each non-blank key."""
    rows = topics.select(trim_key(F.col(topic)).alias("topic_key"), strip(F.col(topic)).alias("t"), F.col(run).alias("r"), F.col(pos).alias("p")).where("topic_key <> ''")
    grouped = rows.groupBy("topic_key").agg(F.min_by("t", "p").alias("topic"), F.array_sort(F.collect_set("r")).alias("runs"), F.min("p").alias("first_pos"))
    return grouped.select("topic_key", "topic", F.size("runs").cast("long").alias("n_runs"), "runs", "first_pos")


def known_heads(topics: DataFrame) -> DataFrame:
    """key, cluster_idx of the known heads; of heads with one key the last wins; empty keys never match."""
    heads = topics.where("is_head").select(summary_key(F.col("summary")).alias("key"), "cluster_idx", "id").where("key <> ''")
    return heads.groupBy("key").agg(F.max_by("cluster_idx", "id").alias("cluster_idx"))


def deduplicate(batch: DataFrame, heads: DataFrame, summary: Column, pos: str = "pos") -> DataFrame:
    """batch with key, known_cluster, is_head: a row is a head if no known head and no earlier row has its key.

    Rows with an empty key are always heads. The heads side is joined by hash of the key; Spark's own size check
    decides whether it is broadcast.
    """
    keyed = batch.withColumn("key", summary_key(summary))
    joined = keyed.join(heads.withColumnRenamed("cluster_idx", "known_cluster"), "key", "left")
    # Rows without a key are a partition of their own each, so they never meet in one task.
    first = Window.partitionBy("key", F.when(F.col("key") == "", F.col(pos))).orderBy(pos)
    rank = F.row_number().over(first)
    return joined.withColumn("is_head", (F.col("key") == "") | (F.col("known_cluster").isNull() & (rank == 1)))


def assigned_clusters(deduped: DataFrame, n_clusters: int, pos: str = "pos", as_coded: bool = False) -> DataFrame:
    """deduped with cluster_idx: known cluster, that of the row's head in the batch, or a new one.

    as_coded gives all new heads of the batch the index after the last known cluster.
    """
    heads = deduped.where("is_head").select(F.col("key").alias("head_key"), F.col(pos).alias("head_pos"))
    numbered = heads.withColumn("new_cluster", F.lit(n_clusters)) if as_coded else dense_ids(heads, "head_pos", n_clusters).withColumn("new_cluster", F.col("id").cast("int")).drop("id")
    named = numbered.where("head_key <> ''").select("head_key", F.col("new_cluster").alias("by_key"))
    blank = numbered.where("head_key = ''").select("head_pos", F.col("new_cluster").alias("by_pos"))
    out = deduped.join(named, deduped["key"] == named["head_key"], "left").join(blank, deduped[pos] == blank["head_pos"], "left")
    return out.withColumn("cluster_idx", F.coalesce("known_cluster", "by_key", "by_pos")).drop("head_key", "by_key", "head_pos", "by_pos")


def dense_ids(rows: DataFrame, order: str, offset: int = 0) -> DataFrame:
    """rows with id: offset, offset + 1, ... in order; by parts of the order and their totals, so no task holds all rows."""
    return numbered(rows, order, "id").withColumn("id", F.col("id") + F.lit(offset) - 1)


def cumulated(rows: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """rows with name: the sum of value up to each row in order, 0 before any; by parts as in dense_ids."""
    return scanned(rows, order, {name: F.col(value)})


def first_occurrence(rows: DataFrame, key: str, pos: str) -> DataFrame:
    """The row with the least pos of each key; an aggregate, so partial results combine before the shuffle."""
    picked = rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), pos).alias("r"))
    return picked.select(key, "r.*")


def last_by_key(rows: DataFrame, key: str, value: str, seq: str) -> DataFrame:
    """key, value of the row with the largest seq: duplicate keys, the last wins."""
    return rows.groupBy(key).agg(F.max_by(value, seq).alias(value))


def attach_last(rows: DataFrame, key: str, responses: DataFrame, value: str, seq: str) -> DataFrame:
    return rows.join(last_by_key(responses, key, value, seq), key, "left")


def chunked(rows: DataFrame, order: str, size: int, *by: str) -> DataFrame:
    """rows with chunk: batches of size in order, inside each group of by."""
    if by:
        return numbered(rows, order, "chunk", *by).withColumn("chunk", F.floor((F.col("chunk") - 1) / size).cast("long"))
    return dense_ids(rows, order).withColumn("chunk", F.floor(F.col("id") / size).cast("long")).drop("id")


def split_rows(topics: DataFrame, label: str = "summary", pos: str = "pos") -> DataFrame:
    """Rows of a label list as one row a part: the first part stays in place, the others go to the end.

    part > 0 marks rows that a split made; they keep raw, parent_id and is_chinese, have the part as english, shortened and
    label, and lose chinese and prompt where these columns exist.
    """
    from ..functions.text import split_labels

    rows = topics.select("*", F.posexplode(split_labels(F.col(label))).alias("part", "part_text"))
    many = F.size(split_labels(F.col(label))) > 1
    for c in ("english", "shortened"):
        if c in topics.columns:
            rows = rows.withColumn(c, F.when(many, F.col("part_text")).otherwise(F.col(c)))
    for c in ("chinese", "prompt"):
        if c in topics.columns:
            rows = rows.withColumn(c, F.when(F.col("part") > 0, F.lit(None)).otherwise(F.col(c)))
    return rows.withColumn(label, F.when(many, F.col("part_text")).otherwise(F.col(label))).withColumn("order_key", F.struct((F.col("part") > 0).alias("split"), F.col(pos), F.col("part"))).drop("part_text")
