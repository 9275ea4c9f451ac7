"""Manual labels as an event log: (seq, action, topic_id, cluster, new_cluster)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def current(events: DataFrame) -> DataFrame:
    """topic_id, cluster after all events: assign, remove (of a topic), delete (of a cluster).

    An assignment stands unless a later event moves or removes the topic or deletes its cluster.
    """
    last = events.where("action in ('assign', 'remove')").groupBy("topic_id").agg(F.max_by(F.struct("seq", "action", "cluster"), "seq").alias("e"))
    live = last.where("e.action = 'assign'").select("topic_id", F.col("e.cluster").alias("cluster"), F.col("e.seq").alias("seq"))
    gone = events.where("action = 'delete'").groupBy("cluster").agg(F.max("seq").alias("deleted"))
    return live.join(gone, "cluster", "left").where("deleted is null or deleted < seq").select("topic_id", "cluster")


def renamed(labels: DataFrame, names: DataFrame) -> DataFrame:
    """labels with clusters renamed by names (cluster, new_cluster); a target that exists is an error."""
    clash = names.join(labels.select(F.col("cluster").alias("new_cluster")).distinct(), "new_cluster", "left_semi")
    if clash.limit(1).count():
        raise ValueError("a cluster of the new name exists")
    return labels.join(names, "cluster", "left").select("topic_id", F.coalesce("new_cluster", "cluster").alias("cluster"))


def progress(topics: DataFrame, labels: DataFrame) -> DataFrame:
    """n_labelled, n_unlabelled."""
    flags = topics.select("topic_id").distinct().join(labels.select("topic_id", F.lit(True).alias("l")).distinct(), "topic_id", "left")
    return flags.agg(F.count_if(F.col("l").isNotNull()).alias("n_labelled"), F.count_if(F.col("l").isNull()).alias("n_unlabelled"))


def unlabelled(topics: DataFrame, labels: DataFrame) -> DataFrame:
    return topics.join(labels.select("topic_id").distinct(), "topic_id", "left_anti")
