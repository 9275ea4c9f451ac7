"""Training-corpus pipeline: STAGES applied one after the other to the documents.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes each stage's rows to the
shared folder as Parquet and reads them again, so a lost executor repeats one stage at most. A stage's rows and its
intermediate tables are deleted once the next stage's are written.

An empty table goes through all stages as an empty table. What a stage does with null texts and repeated rows is said
below; null doc_ids are allowed in all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontam, jaccard, mixing, quality, tokens
from tessera.llm.common import delete_path, new_path, scratch, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their group's limits. A null text has no words and goes; repeated rows are judged alike."""
    return quality.kept(docs).select(*COLUMNS)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least doc_id (null first), of each group of near duplicates; of repeated rows one. Texts without words all stay."""
    return jaccard.deduplicated(docs).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item. A null text has none; repeated rows are judged alike."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as drawn for its source, in shuffled order. A null source is one more source; repeated rows draw the same count each."""
    return mixing.mixed(docs).select(*COLUMNS)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in shards, in the order of docs, and a row for each document read back from them. A null text is the end id alone."""
    return tokens.tokenized(docs, by_id=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("token_shards", token_shards),
]

#: The tokenizer of the last stage is not expressible in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_path(spark, name)
        with scratch(spark):
            rows = stage(spark, docs, sf_dir)
            rows.write.option("compression", "zstd").parquet(path)
        if before:
            delete_path(spark, before)
        docs, before = spark.read.schema(rows.schema).parquet(path), path
    return docs
