"""Row predicates of the topic table, with the three-valued flags that it has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import or_else
from ..functions.text import has_han, word_count

SEED = -5


def heads(topics: DataFrame) -> DataFrame:
    return topics.where("is_head")


def refused_heads(topics: DataFrame) -> DataFrame:
    return topics.where("is_head and is_refusal")


def without_seeds(topics: DataFrame) -> DataFrame:
    """Rows that are not seeds; a row without a parent is none."""
    return topics.where(~F.col("parent_id").eqNullSafe(SEED))


def summarised(topics: DataFrame) -> DataFrame:
    return topics.where("summary is not null")


def needs_summary() -> Column:
    """Rows to summarise: no summary yet, and not known to be a duplicate or an answered head."""
    return F.col("summary").isNull() & (F.col("is_head").isNull() | (F.col("is_head") & F.coalesce("is_refusal", F.lit(False))))


def short_summaries(topics: DataFrame, most: int = 4) -> DataFrame:
    """topics with summary filled from shortened (or raw) where one is needed and the text has few words."""
    short = needs_summary() & (word_count(F.col("shortened")) <= most)
    return topics.withColumn("summary", F.when(short, or_else(F.col("shortened"), F.col("raw"))).otherwise(F.col("summary")))


def unmatched(clusters: DataFrame) -> DataFrame:
    return clusters.where(~F.coalesce("is_match", F.lit(False)))


def large_groups(rows: DataFrame, group: str, more_than: int = 5, unwanted: tuple[str, ...] = (), text: str = "query") -> DataFrame:
    """rows of groups with more rows than more_than, after the unwanted texts are dropped."""
    kept = rows.where(~F.col(text).isin(*unwanted)) if unwanted else rows
    big = kept.groupBy(group).count().where(F.col("count") > more_than).select(group)
    return kept.join(big, group, "left_semi")


def by_language(rows: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows with Han letters, and the others."""
    return rows.where(has_han(F.col(text))), rows.where(~has_han(F.col(text)))


def uses_seeds(has_template: Column, n_seeds: Column, wanted: Column, has_broad: Column) -> Column:
    """Whether a seeded template applies: there is one and a seed for it, and it is wanted or there is no broad one to use instead."""
    return F.coalesce(has_template, F.lit(False)) & (F.coalesce(n_seeds, F.lit(0)) > 0) & (F.coalesce(wanted, F.lit(False)) | ~F.coalesce(has_broad, F.lit(False)))


def samples(items: Column, n: int = 3) -> Column:
    """The first n of a list."""
    return F.slice(items, 1, n)


def stage(step: Column, warmup: int) -> Column:
    return F.when(step < warmup, "warmup").otherwise("seeded")
