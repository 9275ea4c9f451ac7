"""Matching of clusters to a ground truth, and what is derived from the matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import join_name


def matched_clusters(clusters: DataFrame, answers: DataFrame, use_flag: bool = False) -> DataFrame:
    """cluster, first_id, is_match, ground_truth_matches for each cluster.

    clusters: cluster, first_id. answers: gt, flag, matched (array of cluster texts, compared exactly). The judge's
    flag counts only with use_flag.
    """
    rows = answers.where("flag") if use_flag else answers
    pairs = rows.select("gt", F.explode("matched").alias("cluster")).distinct()
    found = pairs.groupBy("cluster").agg(F.array_sort(F.collect_set("gt")).alias("ground_truth_matches"))
    first = clusters.groupBy("cluster").agg(F.min("first_id").alias("first_id"))
    return first.join(found, "cluster", "left").select("cluster", "first_id", F.col("ground_truth_matches").isNotNull().alias("is_match"), F.coalesce("ground_truth_matches", F.array().cast("array<string>")).alias("ground_truth_matches"))


def first_match(clusters: DataFrame, answers: DataFrame) -> DataFrame:
    """gt, first_id: the earliest cluster that matches each ground-truth label, null without one."""
    pairs = answers.select("gt", F.explode_outer("matched").alias("cluster"))
    return pairs.join(clusters, "cluster", "left").groupBy("gt").agg(F.min("first_id").alias("first_id"))


def ranked_matches(ranked: DataFrame, answers: DataFrame) -> DataFrame:
    """ranked (topic, ...) with the judge's flag as is_match, and matched_topics."""
    return ranked.join(answers.select("topic", F.col("flag").alias("is_match"), F.col("matched").alias("matched_topics")), "topic", "left")


def residual_update(clusters: DataFrame, found: DataFrame) -> DataFrame:
    """clusters with gt replaced by residual:residual:name for the ids ``acronym:cluster`` of found (id, name)."""
    split = found.select(F.substring_index("id", ":", -1).alias("cluster"), F.concat(F.lit("residual:residual:"), "name").alias("residual"))
    return clusters.join(split, "cluster", "left").withColumn("gt", F.coalesce("residual", "gt")).drop("residual")


def presence(matches: DataFrame, labels: list[str]) -> DataFrame:
    """gt with a count for each label; matches: gt, label."""
    return matches.groupBy("gt").pivot("label", labels).count().na.fill(0)


def coverage_matrix(pairs: DataFrame, logs: list[str]) -> DataFrame:
    """cluster with a flag for each log; pairs: cluster, log."""
    return pairs.distinct().groupBy("cluster").pivot("log", logs).agg(F.bool_or(F.lit(True))).na.fill(False)


def name_join(left: DataFrame, right: DataFrame, name: str = "name") -> tuple[DataFrame, DataFrame]:
    """Rows of both sides with one name in join form, and the rows of left without a partner."""
    a, b = left.withColumn("k", join_name(F.col(name))), right.withColumn("k", join_name(F.col(name))).drop(name)
    return a.join(b, "k").drop("k"), a.join(b.select("k").distinct(), "k", "left_anti").drop("k")


def match_summary(clusters: DataFrame, truth: DataFrame) -> DataFrame:
    """Counts of matched and unmatched clusters and labels, and the two rates (0 for none). clusters: is_match; truth: first_id."""
    a = clusters.agg(F.count_if("is_match").alias("matched_clusters"), F.count_if(~F.coalesce("is_match", F.lit(False))).alias("unmatched_clusters"))
    b = truth.agg(F.count_if(F.col("first_id").isNotNull()).alias("matched_labels"), F.count_if(F.col("first_id").isNull()).alias("unmatched_labels"))
    rate = lambda x, y: F.coalesce(F.col(x) / F.nullif(F.col(x) + F.col(y), F.lit(0)), F.lit(0.0))
    return a.join(b, F.lit(True)).withColumns({"cluster_rate": rate("matched_clusters", "unmatched_clusters"), "label_rate": rate("matched_labels", "unmatched_labels")})


def missed(rates: DataFrame, identified: DataFrame, least: float = 0.05) -> DataFrame:
    """Topics (topic, rate) refused more often than least that were not identified."""
    return rates.where(F.col("rate") > least).join(identified.select("topic").distinct(), "topic", "left_anti")


def identified_rates(rates: DataFrame, identified: DataFrame) -> DataFrame:
    """model, identified, mean rate; rates: model, topic, rate; identified: model, topic."""
    flags = identified.select("model", "topic").distinct().withColumn("identified", F.lit(True))
    return rates.join(flags, ["model", "topic"], "left").groupBy("model", F.coalesce("identified", F.lit(False)).alias("identified")).agg(F.avg("rate").alias("mean_rate"))


def with_fallback(rows: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """rows with key replaced by mapping (key, final) where it has one."""
    return rows.join(mapping, key, "left").withColumn(key, F.coalesce("final", key)).drop("final")


def same_labels(a: DataFrame, b: DataFrame) -> bool:
    """Whether two label sets are equal; one row each way at most is fetched."""
    return not a.select("gt").exceptAll(b.select("gt")).limit(1).count() and not b.select("gt").exceptAll(a.select("gt")).limit(1).count()
