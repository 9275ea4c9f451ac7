"""Iterative pipelines: one plan a round, its result written to the shared folder, so lineage stays short and a lost
executor repeats a round at most."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keys import or_else, strip, trim_key
from ..functions.parsers import parse_label_mapping
from ..functions.text import filled, has_han, json_strings, numbered, plain_words, summary_of, without_thinking, word_count
from ..operators.dedup import assigned_clusters, chunked, deduplicate, dense_ids, known_heads, split_rows
from ..operators.lineage import merged_mappings, propagated, uncovered
from ..operators.refusal import vote
from ..operators.sampling import drawn
from ..storage import exists, round_table, scratch
from .providers import Provider, chat, requests


#: Neutral texts; a project supplies its own.
REDUCE_PROMPT = "Group the following topics into at most {n} groups. Answer with a JSON object from group to topics.\n{items}"


@dataclass
class Reduction:
    final: DataFrame  # topic_key, topic, pos
    edges: DataFrame  # iteration, batch, pos, out_topic, in_topic
    sources: DataFrame  # topic_key, run
    iterations: int


def reduce_labels(topics: DataFrame, sources: DataFrame, provider: Provider, *, most: int, size: int, target: int, retries: int = 3, model: str = "reducer") -> Reduction:
    """Reduces topics (topic, pos) until there are at most `most`, `size` at a time, to min(target, half of a batch) each.

    Topics that an answer leaves out are asked for again up to `retries` times and then stand for themselves. A round that
    does not lower the count ends the loop.
    """
    current = round_table(topics.select("topic", "pos"), "topics")
    edges = None
    sources = round_table(sources.select("topic_key", "run"), "sources")
    count, i = current.count(), 0
    while count > most:
        batches = round_table(chunked(current, "pos", size).withColumnRenamed("chunk", "batch"), "batches")
        open_, found = batches, None
        for attempt in range(1 + retries):
            groups = open_.groupBy("batch").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "topic"))), lambda x: x["topic"]).alias("items"))
            limit = F.least(F.lit(target), F.greatest(F.lit(1), F.floor(F.size("items") / 2)))
            text = F.replace(F.replace(F.lit(REDUCE_PROMPT), F.lit("{n}"), limit.cast("string")), F.lit("{items}"), numbered(F.col("items")))
            asked = provider.answer(requests(groups.withColumn("attempt", F.lit(attempt)), "reduce", model, chat(None, text)))
            mapping = asked.select("batch", F.posexplode(F.map_entries(parse_label_mapping("text"))).alias("k", "m"))
            rows = mapping.select("batch", F.struct(F.lit(attempt).alias("attempt"), "batch", "k").alias("pos"), F.col("m.key").alias("out_topic"), F.explode("m.value").alias("in_topic"))
            rows = round_table(rows, "answers")
            found = rows if found is None else found.unionByName(rows)
            open_ = round_table(uncovered(batches, found, "batch"), "open")
            if not open_.limit(1).count():
                break
        alone = open_.select("batch", F.struct(F.lit(1 + retries).alias("attempt"), "batch", F.row_number().over(Window.partitionBy("batch").orderBy("pos")).alias("k")).alias("pos"), F.col("topic").alias("out_topic"), F.col("topic").alias("in_topic"))
        step = round_table(found.unionByName(alone).withColumn("iteration", F.lit(i)), "edges")
        edges = step if edges is None else edges.unionByName(step)
        sources = round_table(propagated(step, sources), "sources")
        merged = step.groupBy(trim_key(F.col("out_topic")).alias("k")).agg(F.min_by("out_topic", "pos").alias("topic"), F.min("pos").alias("p"))
        current = round_table(dense_ids(merged, "p").select("topic", F.col("id").alias("pos")), "topics")
        before, count = count, current.count()
        i += 1
        if count >= before:
            break
    if edges is None:
        edges = current.select(F.lit(0).alias("batch"), F.col("pos"), F.col("topic").alias("out_topic"), F.col("topic").alias("in_topic"), F.lit(0).alias("iteration")).limit(0)
    return Reduction(current.withColumn("topic_key", trim_key(F.col("topic"))), edges, sources, i)


def merged_outputs(edges: DataFrame) -> DataFrame:
    return merged_mappings(edges)


def translated(rows: DataFrame, provider: Provider, source: str, target: str, to: str, model: str = "translator") -> DataFrame:
    """rows with target: source translated, or source itself where the answer is blank."""
    asked = provider.answer(requests(rows, f"translate_{to}", model, chat(None, filled(F.lit("Translate into " + to + ": {}"), F.col(source)))))
    return asked.withColumn(target, or_else(strip(F.col("text")), F.col(source))).drop("role", "model", "messages", "temperature", "sample_idx", "request_id", "text")


def formatted(generations: DataFrame, provider: Provider, model: str = "formatter", most: int = 10) -> DataFrame:
    """Topics (gen_id, pos, raw, is_chinese, english, shortened, summary, parent_id) from generations (gen_id, parent_id, text).

    Extraction to a JSON list, translation of Han texts, shortening, a summary for topics of over four words, splitting of lists,
    and removal of topics without a summary.
    """
    extra = ["role", "model", "messages", "temperature", "sample_idx", "request_id", "text"]
    seen = generations.withColumn("generation", without_thinking(F.col("text"))).drop("text")
    asked = provider.answer(requests(seen, "extract", model, chat(None, filled(F.lit("List the topics as a JSON list of texts:\n{}"), F.col("generation")))))
    items = asked.select("gen_id", "parent_id", F.posexplode(F.slice(F.array_distinct(json_strings(F.col("text"))), 1, most)).alias("i", "raw"))
    # An answer has several readers below: it is written before.
    items = round_table(items.withColumns({"pos": F.struct("gen_id", "i"), "is_chinese": has_han(F.col("raw"))}), "items")
    chinese = translated(items.where("is_chinese"), provider, "raw", "english", "English")
    rows = items.where(~F.col("is_chinese")).withColumn("english", F.col("raw")).unionByName(chinese)
    rows = round_table(rows.withColumn("shortened", plain_words(F.col("english"))), "english")
    short = rows.where(word_count(F.col("shortened")) <= 4).withColumn("summary", or_else(F.col("shortened"), F.col("raw")))
    long = provider.answer(requests(rows.where(word_count(F.col("shortened")) > 4), "summarize", model, chat(None, filled(F.lit("Summarize in four words: {}"), F.col("shortened")))))
    long = long.withColumn("summary", summary_of(F.col("text"), F.col("shortened"))).drop(*extra)
    return split_rows(short.unionByName(long)).where("summary is not null")


def resumed(spark: SparkSession, path: str | None) -> DataFrame | None:
    """The topics that a crawl has kept at path, or None. A step that was not written whole has no success mark and is left out."""
    if not path:
        return None
    steps = []
    while exists(spark, f"{path}/after={len(steps)}/_SUCCESS"):
        steps.append(f"{path}/after={len(steps)}")
    return spark.read.parquet(*steps) if steps else None


def crawl(spark: SparkSession, seeds: DataFrame, templates: DataFrame, provider: Provider, *, steps: int, batch: int, warmup: int, max_topics: int, n_probes: int = 3, threshold: float = 0.25, seed: int = 0, model: str = "target", state_path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(topics, steps) of a crawl. seeds: topic; templates: item (with {}), pos, and where it has one, lang (a template without lang serves all).

    With state_path each step's topics are kept there as a folder of their own, and a crawl that finds some goes on after the
    last of them. Where templates have languages, steps take turns among these in order of their names.

    Seeds with Han letters are translated first. A step draws prompts (no topic in the first `warmup` steps, else a refused head), generates, formats, deduplicates against all
    heads, probes new heads, and appends. It stops when there are more than max_topics heads.
    """
    with scratch(spark):
        state = round_table(_crawled(spark, seeds, templates, provider, steps, batch, warmup, max_topics, n_probes, threshold, seed, model, state_path), "topics", keep=True)
    from ..operators.stats import step_counts

    return state, step_counts(state.where("step >= 0"), "step")


def translated_seeds(seeds: DataFrame, provider: Provider) -> DataFrame:
    """id, raw, english, is_chinese of seeds (topic), in order of their texts; those with Han letters are translated first."""
    first = round_table(dense_ids(seeds.select(F.col("topic").alias("raw")), "raw").withColumn("is_chinese", has_han(F.col("raw"))), "seeds")
    chinese = translated(first.where("is_chinese"), provider, "raw", "english", "English")
    return round_table(first.where(~F.col("is_chinese")).withColumn("english", F.col("raw")).unionByName(chinese), "seeds")


def _crawled(spark: SparkSession, seeds: DataFrame, templates: DataFrame, provider: Provider, steps: int, batch: int, warmup: int, max_topics: int, n_probes: int, threshold: float, seed: int, model: str, state_path: str | None) -> DataFrame:
    columns = ["id", "parent_id", "raw", "english", "shortened", "summary", "is_chinese", "is_head", "is_refusal", "cluster_idx", "step"]
    first = translated_seeds(seeds, provider)
    state = first.select("id", F.lit(-5).cast("long").alias("parent_id"), "raw", "english", plain_words(F.col("english")).alias("shortened"), F.col("english").alias("summary"), "is_chinese", F.lit(True).alias("is_head"), F.lit(True).alias("is_refusal"), F.col("id").cast("int").alias("cluster_idx"), F.lit(-1).alias("step"))
    state = round_table(state.select(*columns), "topics")
    begun = resumed(spark, state_path)
    if begun is not None:
        state = round_table(begun.select(*columns), "topics")
    elif state_path:
        state.write.parquet(f"{state_path}/after=0")
    langs = sorted(r[0] for r in templates.select("lang").where("lang is not null").distinct().collect()) if "lang" in templates.columns else []
    done = state.agg(F.max("step")).head()[0]
    for step in range((-1 if done is None else done) + 1, steps):
        if step and state.where("is_head").count() > max_topics:
            break
        slots = spark.range(batch).select(F.lit(step).alias("step"), F.col("id").alias("i"))
        usable = templates.select("item", "pos")
        if langs:
            own = templates.where(F.col("lang").isNull() | (F.col("lang") == langs[step % len(langs)]))
            usable = dense_ids(own.select("item", F.col("pos").alias("o")), "o").select("item", F.col("id").alias("pos"))
        slots = drawn(slots, usable, seed, "template")
        if step >= warmup:
            heads = dense_ids(state.where("is_head and is_refusal").select("id", "raw").withColumnsRenamed({"id": "parent_id"}), "parent_id").select(F.struct("parent_id", "raw").alias("item"), F.col("id").alias("pos"))
            slots = drawn(slots, heads, seed, "parent")
        else:
            slots = slots.withColumn("parent", F.lit(None).cast("struct<parent_id:bigint,raw:string>"))
        prompt = filled(F.col("template"), F.coalesce("parent.raw", F.lit("")))
        asked = provider.answer(requests(slots, "generate", model, chat(None, prompt)))
        generations = round_table(asked.select(F.col("i").alias("gen_id"), F.coalesce("parent.parent_id", F.lit(-1).cast("long")).alias("parent_id"), "text"), "generations")
        fresh = formatted(generations, provider)
        fresh = round_table(dense_ids(fresh.drop("pos", "i", "part", "gen_id"), "order_key", state.count()), "fresh")
        clusters = state.agg(F.max("cluster_idx")).head()[0]
        marked = assigned_clusters(deduplicate(fresh, known_heads(state), F.col("summary"), "id"), (clusters if clusters is not None else -1) + 1, "id")
        marked = round_table(marked, "marked")
        probes = marked.where("is_head").withColumn("probe", F.explode(F.sequence(F.lit(0), F.lit(n_probes - 1))))
        answered = provider.answer(requests(probes, "probe", model, chat(None, F.concat(F.lit("Question "), F.col("probe").cast("string"), F.lit(" about "), F.col("summary")))))
        from ..functions.text import refusal_fast

        votes = vote(answered.select("id", F.coalesce(refusal_fast(F.col("text")), F.lit(False)).alias("refused")), "id", threshold=threshold).select("id", "is_refusal")
        new = marked.join(votes, "id", "left").withColumns({"step": F.lit(step), "cluster_idx": F.col("cluster_idx").cast("int")})
        state = round_table(state.unionByName(new.select(*columns)), "topics")
        if state_path:
            state.where(F.col("step") == step).write.mode("overwrite").parquet(f"{state_path}/after={step + 1}")
    return state


def cluster_recursively(topics: DataFrame, provider: Provider, *, size: int, model: str = "clusterer") -> DataFrame:
    """topic, head, path: topics merged in full batches until a round merges nothing; the rest of a round is carried over."""
    paths = round_table(topics.select("topic", F.col("topic").alias("head"), F.array("topic").alias("path")), "paths")
    front = round_table(topics.select("topic", "pos"), "front")
    while (n := front.count()) >= size:
        batches = chunked(front, "pos", size)
        full = batches.where(F.col("chunk") < n // size)
        groups = full.groupBy("chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "topic"))), lambda x: x["topic"]).alias("items"))
        asked = provider.answer(requests(groups, "cluster", model, chat(None, F.concat(F.lit("Cluster these topics as a JSON object from name to numbers:\n"), numbered(F.col("items"), "bracket")))))
        from ..functions.parsers import parse_clustering

        rows = asked.select("chunk", F.explode(parse_clustering("text", "items")["clusters"]).alias("name", "members"))
        members = rows.select("chunk", "name", F.explode("members").alias("topic")).join(full, ["chunk", "topic"])
        merged = round_table(members.groupBy("chunk", "name").agg(F.min_by("topic", "pos").alias("new_head"), F.min("pos").alias("p"), F.collect_list("topic").alias("members")), "merged")
        mapping = merged.select("new_head", F.explode("members").alias("head"))
        paths = round_table(paths.join(mapping, "head", "left").select("topic", F.coalesce("new_head", "head").alias("head"), F.when(F.col("new_head").isNotNull() & (F.col("new_head") != F.col("head")), F.array_append("path", F.col("new_head"))).otherwise(F.col("path")).alias("path")), "paths")
        carried = batches.where(F.col("chunk") >= n // size).select("topic", F.struct(F.lit(0).alias("o"), "pos").alias("o"))
        heads = merged.select(F.col("new_head").alias("topic"), F.struct(F.lit(1).alias("o"), F.col("p").alias("pos")).alias("o"))
        front = round_table(dense_ids(carried.unionByName(heads), "o").select("topic", F.col("id").alias("pos")), "front")
        if front.count() >= n:
            break
    return paths
