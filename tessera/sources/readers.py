"""Readers. JSON is read with explicit schemas; what does not parse keeps its text in _corrupt_record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import strip
from ..functions.names import parsed_name
from ..operators.scan import numbered
from ..storage import round_table
from . import schemas

PATH = "_metadata.file_path"


def crawl_logs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row a document: its fields, path, run_id (file name). A document is one row in one task, so long logs are written in parts of
    the same form, see writers.log_parts; readers of topics and summaries take them as they are."""
    docs = spark.read.schema(schemas.CRAWL_LOG).option("multiLine", True).option("mode", "PERMISSIVE").json(paths)
    path = F.col(PATH)
    return docs.withColumns({"path": path, "run_id": F.regexp_replace(F.substring_index(path, "/", -1), r"\.json$", "")})


def run_order(spark: SparkSession, paths: list[str]) -> DataFrame:
    """run_id, run_idx in the order of the arguments."""
    names = [p.rstrip("/").rpartition("/")[2].removesuffix(".json") for p in paths]
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "run_id string, run_idx int")


def refused_summaries(spark: SparkSession, paths: list[str]) -> DataFrame:
    """run_idx, pos, topic of the flat summary lists, in order of arguments and lists."""
    rows = crawl_logs(spark, paths).select("run_id", F.posexplode("head_refusal_topics_summaries").alias("i", "topic"))
    return rows.join(F.broadcast(run_order(spark, paths)), "run_id").select("run_idx", F.struct("run_idx", "i").alias("pos"), "topic")


def topics(logs: DataFrame, which: str = "clusters") -> DataFrame:
    """run_id and the topic's fields: of all clusters, of heads, or of refused heads. Older field names are filled in."""
    inside = {"clusters": F.flatten("queue.topics.cluster_topics"), "heads": F.col("queue.topics.head_topics"), "refused": F.col("queue.topics.head_refusal_topics")}[which]
    rows = logs.select("run_id", F.explode(inside).alias("t")).select("run_id", "t.*")
    return rows.withColumns({"english": F.coalesce("english", "translation", "text"), "chinese": F.coalesce("chinese", F.when(F.col("is_chinese"), F.col("raw")))}).drop("translation", "text")


def raw_topics(logs: DataFrame) -> DataFrame:
    """log_file_name, topic_summary of the refused heads that have a raw text."""
    return topics(logs, "refused").where("raw is not null").select(F.col("run_id").alias("log_file_name"), F.col("raw").alias("topic_summary"))


def steps(logs: DataFrame, parts: bool = False) -> DataFrame:
    """run_id, step, n_all, n_deduped, n_refused. With parts, documents of one run_id are parts of one log, and their numbers are added."""
    h = F.arrays_zip("stats.history.all_per_step", "stats.history.deduped_per_step", "stats.history.refusal_per_step")
    rows = logs.select("run_id", F.posexplode(h).alias("step", "h"))
    rows = rows.select("run_id", "step", F.col("h.all_per_step").alias("n_all"), F.col("h.deduped_per_step").alias("n_deduped"), F.col("h.refusal_per_step").alias("n_refused"))
    return rows.groupBy("run_id", "step").agg(*[F.sum(c).alias(c) for c in ("n_all", "n_deduped", "n_refused")]) if parts else rows


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """category, subtopic, pos."""
    rows = _whole(spark, path).select(F.explode(F.from_json("value", schemas.GROUND_TRUTH)).alias("category", "s"))
    return rows.select("category", F.posexplode("s").alias("pos", "subtopic")).select("category", "subtopic", "pos")


def ground_truth_keywords(spark: SparkSession, path: str) -> DataFrame:
    return _whole(spark, path).select(F.explode(F.from_json("value", "struct<keywords:array<string>>")["keywords"]).alias("topic"))


def benchmark(spark: SparkSession, path: str) -> DataFrame:
    """category, subcategory, prompt of a three-level benchmark below one root key."""
    rows = _whole(spark, path).select(F.explode(F.from_json("value", schemas.BENCHMARK)).alias("root", "c"))
    return rows.select(F.explode("c").alias("category", "s")).select("category", F.explode("s").alias("subcategory", "p")).select("category", "subcategory", F.explode("p").alias("prompt"))


def benchmark_topics(spark: SparkSession, path: str) -> DataFrame:
    """meta_cluster, pos, query."""
    rows = spark.read.schema(schemas.BENCHMARK_TOPICS).option("multiLine", True).json(path).select(F.explode("topics").alias("t"))
    return rows.select("t.meta_cluster", F.posexplode("t.queries").alias("pos", "query"))


def meta_clusters(spark: SparkSession, path: str) -> DataFrame:
    """meta, sub (null in the flat form), topic (JSON), log_file (with .json), by the variant reader for both known depths."""
    rows = _whole(spark, path).select(F.parse_json("value").alias("v"))
    rows.createOrReplaceTempView("__meta_document")
    found = spark.sql("""
        WITH meta AS (SELECT m.key AS meta, m.value AS v FROM __meta_document, LATERAL variant_explode(v) m),
        below AS (SELECT meta, x.key AS sub, x.value AS v FROM meta, LATERAL variant_explode(v) x),
        nested AS (SELECT meta, sub, y.value AS pair FROM below, LATERAL variant_explode(v) y WHERE sub IS NOT NULL),
        flat AS (SELECT meta, CAST(NULL AS STRING) AS sub, v AS pair FROM below WHERE sub IS NULL)
        SELECT meta, sub, to_json(variant_get(pair, '$[0]', 'variant')) AS topic, variant_get(pair, '$[1]', 'string') AS log_file
        FROM (SELECT * FROM nested UNION ALL SELECT * FROM flat)
    """)
    return found.withColumn("log_file", F.when(F.endswith("log_file", F.lit(".json")), F.col("log_file")).otherwise(F.concat("log_file", F.lit(".json"))))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line (from 0), value of text files, read by splits and written once.

    A line's place is its split's offset in the file and its row in the task that reads the split; lines are numbered by running
    counts over these places.
    """
    rows = spark.read.text(path).select(F.col(PATH).alias("path"), F.struct(F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("row")).alias("o"), "value")
    return numbered(round_table(rows, "lines"), "o", "line", "path").withColumn("line", F.col("line") - 1).drop("o")


def topic_lines(spark: SparkSession, path: str) -> DataFrame:
    """topic, first_id (line of its first occurrence) of a file with a JSON list of topics a line."""
    rows = numbered_lines(spark, path).select("line", F.explode(F.from_json("value", "array<string>")).alias("topic"))
    return rows.groupBy("topic").agg(F.min("line").cast("long").alias("first_id"))


def csv_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def listing(spark: SparkSession, folder: str, *formats: str) -> DataFrame:
    """path, modified and the parsed name of the logs in a folder, newest first; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select("path", F.col("modificationTime").alias("modified"))
    named = files.withColumn("n", parsed_name(F.col("path"), *(formats or ("prompt", "current"))))
    return named.where("n is not null").select("path", "modified", "n.*").where(~F.contains("path", F.lit("manual_clusters"))).orderBy(F.desc("ts"))


def latest_log(spark: SparkSession, folder: str, name: dict[str, object] | None = None, config: dict[str, object] | None = None) -> DataFrame:
    """The newest log whose name and config fields agree; names are tested before any file is opened, values as text and as numbers."""
    files = listing(spark, folder)
    for k, v in (name or {}).items():
        files = files.where(F.col(k).cast("string") == str(v))
    found = files.select("path", "ts")
    for k, v in (config or {}).items():
        logs = crawl_logs(spark, folder).select("path", F.try_variant_get("config", f"$.{k}", "string").alias("c"))
        same = (F.lower("c") == str(v).lower()) | (F.try_to_number("c", F.lit("999999999.999999")) == F.try_to_number(F.lit(str(v)), F.lit("999999999.999999")))
        found = found.join(logs.where(F.coalesce(same, F.lit(False))).select("path"), "path", "left_semi")
    return found.orderBy(F.desc("ts")).limit(1)


def reduction_edges(spark: SparkSession, path: str) -> DataFrame:
    """iteration, batch, pos, out_topic, in_topic of a reduction log."""
    log = spark.read.schema(schemas.REDUCTION_LOG).option("multiLine", True).json(path)
    step = log.select(F.explode("iterations").alias("i")).select(F.col("i.iteration_idx").alias("iteration"), F.explode("i.steps").alias("s"))
    out = step.select("iteration", F.col("s.batch_idx").alias("batch"), F.posexplode(F.map_entries("s.output_mapping")).alias("k", "m"))
    return out.select("iteration", "batch", F.struct("batch", "k").alias("pos"), F.col("m.key").alias("out_topic"), F.explode("m.value").alias("in_topic"))


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TRANSCRIPT).json(path).withColumn("timestamp", F.try_to_timestamp("timestamp"))


def discovered(logs: DataFrame, which: str = "refused") -> DataFrame:
    """run_id, topic: distinct non-blank summaries of refused heads, or of all heads."""
    return topics(logs, which).select("run_id", strip(F.col("summary")).alias("topic")).where("topic <> ''").distinct()
