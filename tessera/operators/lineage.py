"""Lineage of reduced labels: edges (iteration, out_topic, in_topic), provenance, coverage gaps, trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import trim_key


def propagated(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """topic_key, run of each output: the runs of its inputs; sources: topic_key, run. Unknown inputs add none."""
    keyed = edges.select(trim_key(F.col("out_topic")).alias("out_key"), trim_key(F.col("in_topic")).alias("topic_key"))
    return keyed.join(sources, "topic_key", "left").where("run is not null").select(F.col("out_key").alias("topic_key"), "run").distinct()


def uncovered(inputs: DataFrame, edges: DataFrame, *by: str) -> DataFrame:
    """Rows of inputs (by, topic) that no edge of the same batch takes up."""
    taken = edges.select(*by, trim_key(F.col("in_topic")).alias("k")).distinct()
    return inputs.withColumn("k", trim_key(F.col("topic"))).join(taken, [*by, "k"], "left_anti").drop("k")


def merged_mappings(edges: DataFrame) -> DataFrame:
    """out_topic (first spelling by pos), inputs (distinct, sorted) for outputs equal but for case; edges: pos, out_topic, in_topic."""
    rows = edges.withColumn("k", trim_key(F.col("out_topic")))
    return rows.groupBy("k").agg(F.min_by("out_topic", "pos").alias("out_topic"), F.array_sort(F.collect_set("in_topic")).alias("inputs")).select("out_topic", "inputs")


def composed(steps: DataFrame) -> DataFrame:
    """out_key, in_key over all steps (iteration, out_key, in_key): what each key comes from, where a key that a step does not have
    passes through it.

    Each round composes neighbouring blocks of steps, all pairs of blocks in one join, and is written; so there are as many
    rounds as the logarithm of the iterations, and no plan grows with them.
    """
    from ..storage import round_table, scratch

    with scratch(steps.sparkSession):
        blocks = round_table(steps.select(F.col("iteration").cast("int").alias("block"), "out_key", "in_key").distinct(), "blocks")
        last = blocks.agg(F.max("block")).head()[0] or 0
        while last > 0:
            later = blocks.where("block % 2 = 1").select(F.expr("block div 2").cast("int").alias("block"), "out_key", F.col("in_key").alias("mid"))
            earlier = blocks.where("block % 2 = 0").select(F.expr("block div 2").cast("int").alias("block"), F.col("out_key").alias("mid"), "in_key")
            both = later.join(earlier, ["block", "mid"], "left").select("block", "out_key", F.coalesce("in_key", "mid").alias("in_key"))
            # Outputs of the earlier block that the later one does not take up stay as they are.
            past = earlier.withColumnRenamed("mid", "out_key").join(later.select("block", "out_key").distinct(), ["block", "out_key"], "left_anti").select("block", "out_key", "in_key")
            blocks = round_table(both.unionByName(past).distinct(), "blocks")
            last //= 2
        return round_table(blocks.select("out_key", "in_key"), "composed", keep=True)


def trajectories(edges: DataFrame, originals: DataFrame, iterations: int) -> DataFrame:
    """final_topic, origin pairs: each output of the last iteration with the original topics that it comes from.

    Blocks of iterations are composed by doubling. A key that an iteration does not have passes through. originals: topic, pos; of
    spellings with one key the last counts.
    """
    keyed = edges.where(F.col("iteration") < iterations).select("iteration", trim_key(F.col("out_topic")).alias("out_key"), trim_key(F.col("in_topic")).alias("in_key"), "out_topic", "pos")
    last = keyed.where(F.col("iteration") == iterations - 1)
    finals = last.groupBy("out_key").agg(F.min_by("out_topic", "pos").alias("final_topic"))
    front = finals.join(composed(keyed), "out_key", "left").select("final_topic", F.coalesce("in_key", "out_key").alias("at"))
    spelled = originals.groupBy(trim_key(F.col("topic")).alias("at")).agg(F.max_by("topic", "pos").alias("spelling"))
    return front.join(spelled, "at", "left").select("final_topic", F.coalesce("spelling", "at").alias("origin")).distinct()


def untraced(originals: DataFrame, traced: DataFrame) -> DataFrame:
    """Originals whose key no trajectory reaches."""
    return originals.join(traced.select(trim_key(F.col("origin")).alias("k")).distinct(), trim_key(originals["topic"]) == F.col("k"), "left_anti")


def log_summary(edges: DataFrame) -> DataFrame:
    """n_iterations, n_calls, n_inputs (of the first iteration), n_finals (outputs of the last)."""
    ends = edges.agg(F.min("iteration").alias("first"), F.max("iteration").alias("last"))
    rows = edges.join(F.broadcast(ends), F.lit(True))
    return rows.agg(
        F.count_distinct("iteration").alias("n_iterations"),
        F.count_distinct("iteration", "batch").alias("n_calls"),
        F.count_distinct(F.when(F.col("iteration") == F.col("first"), trim_key(F.col("in_topic")))).alias("n_inputs"),
        F.count_distinct(F.when(F.col("iteration") == F.col("last"), trim_key(F.col("out_topic")))).alias("n_finals"),
    )


def consistency(topics: DataFrame, n_runs: int) -> DataFrame:
    """score, n_consistent, n_total: the share of topics that every run has; 0 without topics. topics: n_runs."""
    full = F.count_if(F.col("n_runs") >= n_runs)
    return topics.agg(F.coalesce(full / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("score"), full.alias("n_consistent"), F.count("*").alias("n_total"))


def depth(topics: DataFrame) -> DataFrame:
    """id, depth of each topic below its seed (parent_id null or negative: 0), of chains of any length.

    Each round follows every open topic's ancestor to that one's own, so chains take rounds by the logarithm of their
    length. Topics whose chain ends at an id that is not there have no row; a cycle of parents raises ValueError.
    """
    from ..storage import round_table

    seed = F.expr("parent_id is null or parent_id < 0")
    state = round_table(topics.select("id", F.when(~seed, F.col("parent_id")).alias("at"), F.when(seed, 0).otherwise(1).alias("depth")), "depth")
    most, reach = state.count(), 1
    while state.where("at is not null").limit(1).count():
        if reach > most:
            raise ValueError("the parents of topics form a cycle")
        up = state.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("depth").alias("more"))
        moved = state.join(up, "at").select("id", F.col("next").alias("at"), (F.col("depth") + F.col("more")).alias("depth"))
        state = round_table(state.where("at is null").unionByName(moved), "depth")
        reach *= 2
    return state.select("id", "depth")


def tree_edges(final: DataFrame, heads: DataFrame, paths: DataFrame) -> DataFrame:
    """parent, child, level: final label over within-file head over topic. final: head, label; heads: topic, head; paths: topic, file."""
    upper = final.select(F.col("label").alias("parent"), F.col("head").alias("child"), F.lit(1).alias("level"))
    lower = heads.join(paths, "topic").select(F.col("head").alias("parent"), F.col("topic").alias("child"), F.lit(2).alias("level"))
    return upper.unionByName(lower).where("parent is not null and child is not null").distinct()
