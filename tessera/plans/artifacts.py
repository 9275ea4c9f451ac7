"""What a run leaves, in one call: all tables of a reduction as one version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import trim_key
from ..operators.lineage import consistency, log_summary, merged_mappings, trajectories
from ..sources.versions import Version, publish


def aggregation_tables(edges: DataFrame, originals: DataFrame, sources: DataFrame, iterations: int, n_runs: int) -> dict[str, DataFrame]:
    """The tables of a reduction: edges (its log), final_topics with what the last iteration merged, trajectories, sources of each
    final topic, consistency over n_runs and the summary. edges: iteration, batch, pos, out_topic, in_topic; sources: topic_key, run."""
    last = edges.where(F.col("iteration") == iterations - 1)
    finals = merged_mappings(last)
    runs = sources.groupBy("topic_key").agg(F.array_sort(F.collect_set("run")).alias("runs"))
    of_final = finals.select("out_topic", trim_key(F.col("out_topic")).alias("topic_key")).join(runs, "topic_key", "left")
    of_final = of_final.select("out_topic", F.coalesce(F.size("runs"), F.lit(0)).cast("long").alias("n_runs"), "runs")
    return {
        "edges": edges,
        "final_topics": finals,
        "trajectories": trajectories(edges, originals, iterations),
        "sources": of_final,
        "consistency": consistency(of_final, n_runs),
        "summary": log_summary(edges),
    }


def publish_aggregation(spark: SparkSession, path: str, edges: DataFrame, originals: DataFrame, sources: DataFrame, iterations: int, n_runs: int, meta: dict | None = None) -> Version:
    return publish(spark, path, aggregation_tables(edges, originals, sources, iterations, n_runs), meta)
