"""Counters, rates and cross-run statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EPS = 1e-10


def ratio(x: Column, n: Column) -> Column:
    return F.coalesce(x / F.nullif(n, F.lit(0)), F.lit(0.0))


def step_counts(topics: DataFrame, *by: str) -> DataFrame:
    """by, n_all, n_deduped (heads), n_refused (refused heads). Steps without topics have no row."""
    head = F.coalesce("is_head", F.lit(False))
    return topics.groupBy(*by).agg(F.count("*").alias("n_all"), F.count_if(head).alias("n_deduped"), F.count_if(head & F.coalesce("is_refusal", F.lit(False))).alias("n_refused"))


def crawl_metrics(steps: DataFrame) -> DataFrame:
    total = F.coalesce(F.sum("n_all"), F.lit(0))
    refused = F.coalesce(F.sum("n_refused"), F.lit(0))
    return steps.agg(total.alias("total_all"), F.coalesce(F.sum("n_deduped"), F.lit(0)).alias("total_deduped"), refused.alias("total_refusals"), (refused / (total + EPS)).alias("avg_refusal_rate"), F.count("*").alias("n_steps"))


def step_averages(steps: DataFrame, *by: str) -> DataFrame:
    """by, n_steps, topics_per_step and refusal_rate of a log's steps (n_all, n_refused)."""
    out = steps.groupBy(*by).agg(F.count("*").alias("n_steps"), F.sum("n_all").alias("n"), F.sum("n_refused").alias("r"))
    return out.select(*by, "n_steps", (F.col("n") / F.col("n_steps")).alias("topics_per_step"), (F.col("r") / (F.col("n") + EPS)).alias("refusal_rate"))


def column_sums(wide: DataFrame, columns: list[str]) -> DataFrame:
    """column, total, n: sums and numbers of the values of a pivoted table's columns."""
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    return wide.select(F.explode(each).alias("e")).groupBy("e.column").agg(F.sum("e.value").alias("total"), F.count("e.value").alias("n"))


def refusal_rollup(rows: DataFrame, *levels: str) -> DataFrame:
    """Prompts (distinct), generations, refusals and rate at each level, null standing for all. rows: levels, prompt, refused."""
    out = rows.rollup(*levels).agg(F.count_distinct("prompt").alias("total_prompts"), F.count("*").alias("total_generations"), F.count_if("refused").alias("total_refusals"))
    return out.withColumn("refusal_rate", ratio(F.col("total_refusals"), F.col("total_generations")))


def refusal_by(rows: DataFrame, group: str) -> DataFrame:
    """The same by one column, with a row for all (null)."""
    return refusal_rollup(rows, group)


def contingency(rows: DataFrame, a: str, b: str) -> DataFrame:
    """n11, n10, n01, n00 and phi of two flags; phi is null if one of them is constant."""
    x, y = F.col(a), F.col(b)
    t = rows.agg(F.count_if(x & y).alias("n11"), F.count_if(x & ~y).alias("n10"), F.count_if(~x & y).alias("n01"), F.count_if(~x & ~y).alias("n00"))
    n = {k: F.col(k).cast("double") for k in t.columns}
    under = F.sqrt((n["n11"] + n["n10"]) * (n["n01"] + n["n00"]) * (n["n11"] + n["n01"]) * (n["n10"] + n["n00"]))
    return t.withColumn("phi", (n["n11"] * n["n00"] - n["n10"] * n["n01"]) / F.nullif(under, F.lit(0.0)))


def funnel(topics: DataFrame) -> DataFrame:
    """total, novel, refused, what each step drops, and shares of the total in percent."""
    head = F.coalesce("is_head", F.lit(False))
    t = topics.agg(F.count("*").alias("total"), F.count_if(head).alias("novel"), F.count_if(head & F.coalesce("is_refusal", F.lit(False))).alias("refused"))
    share = lambda c: 100 * ratio(F.col(c), F.col("total"))
    return t.select("total", "novel", "refused", (F.col("total") - F.col("novel")).alias("dropped_duplicates"), (F.col("novel") - F.col("refused")).alias("dropped_answered"), share("novel").alias("novel_percent"), share("refused").alias("refused_percent"))


def language_ratio(topics: DataFrame, order: str, first: int | None = None) -> DataFrame:
    """Share of rows marked Chinese; of the first rows in order with first."""
    rows = topics if first is None else topics.orderBy(order).limit(first)
    return rows.agg(F.avg(F.coalesce("is_chinese", F.lit(False)).cast("int")).alias("chinese_ratio"), F.count("*").alias("n"))


def recall_per_run(found: DataFrame, run: str = "run", label: str = "label") -> DataFrame:
    """run, k, n, recall of each run's labels against the union of all."""
    pairs = found.select(run, label).distinct()
    whole = pairs.agg(F.count_distinct(label).alias("n"))
    return pairs.groupBy(run).agg(F.count("*").alias("k")).join(F.broadcast(whole), F.lit(True)).select(run, "k", "n", ratio(F.col("k"), F.col("n")).alias("recall"))


def recall_summary(recalls: DataFrame, by: str) -> DataFrame:
    return recalls.groupBy(by).agg(F.avg("recall").alias("mean"), F.stddev_samp("recall").alias("std"), F.min("recall").alias("min"), F.max("recall").alias("max"), F.count("*").alias("n"))


def pool_recall(pool: DataFrame, discovered: DataFrame, refused: DataFrame, as_coded: bool = False) -> DataFrame:
    """(discovered + refused) / pool. Discovered counts inside the pool only, and refused among the rest; as_coded counts all discovered."""
    p, d, r = (x.select("topic").distinct() for x in (pool, discovered, refused))
    n = p.agg(F.count("*").alias("n_pool"))
    inside = (d if as_coded else d.join(p, "topic", "left_semi")).agg(F.count("*").alias("n_discovered"))
    rest = r.join(p, "topic", "left_semi").join(d, "topic", "left_anti").agg(F.count("*").alias("n_refused"))
    both = n.join(inside, F.lit(True)).join(rest, F.lit(True))
    return both.withColumn("recall", ratio(F.col("n_discovered") + F.col("n_refused"), F.col("n_pool")))


def discovery_recall(discovered: DataFrame, truth: DataFrame) -> DataFrame:
    d, t = discovered.select("topic").distinct(), truth.select("topic").distinct()
    k = d.join(t, "topic", "left_semi").agg(F.count("*").alias("k"))
    return k.join(t.agg(F.count("*").alias("n")), F.lit(True)).select("k", "n", ratio(F.col("k"), F.col("n")).alias("recall"))


def untested(pool: DataFrame, tested: DataFrame) -> DataFrame:
    return pool.join(tested.select("topic").distinct(), "topic", "left_anti")


def any_by_model(flags: DataFrame) -> DataFrame:
    """model, topic, flag: true if any of the model's runs has it. flags: model, run, topic, flag."""
    return flags.groupBy("model", "topic").agg(F.bool_or("flag").alias("flag"))


def pivot_rates(rates: DataFrame, models: list[str]) -> DataFrame:
    """topic with the first rate of each model, n_models (not null) and mean over these. rates: model, topic, rate."""
    wide = rates.groupBy("topic").pivot("model", models).agg(F.min("rate"))
    long = rates.groupBy("topic", "model").agg(F.min("rate").alias("rate")).groupBy("topic").agg(F.count("rate").alias("n_models"), F.avg("rate").alias("mean_rate"))
    return wide.join(long, "topic")


def cluster_sizes(rows: DataFrame, cluster: str, top: int | None = None) -> DataFrame:
    sizes = rows.groupBy(cluster).agg(F.count("*").alias("n")).orderBy(F.desc("n"), cluster)
    return sizes if top is None else sizes.limit(top)


def cluster_heads(rows: DataFrame, cluster: str, topic: str, pos: str) -> DataFrame:
    """cluster, head (first by pos), first_id, members in order of pos."""
    members = F.transform(F.array_sort(F.collect_list(F.struct(pos, topic))), lambda x: x[topic])
    return rows.groupBy(cluster).agg(F.min_by(topic, pos).alias("head"), F.min(pos).alias("first_id"), members.alias("members"))


def benchmark_totals(bench: DataFrame) -> DataFrame:
    per = bench.groupBy("topic").agg(F.count("*").alias("q"))
    return per.agg(F.count("*").alias("n_topics"), F.sum("q").alias("n_queries"), F.avg("q").alias("mean_queries"))


def min_max_scaled(rows: DataFrame, score: str) -> DataFrame:
    """rows with scaled in 0..1; unchanged scores if all are equal."""
    ends = rows.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    return rows.join(F.broadcast(ends), F.lit(True)).withColumn("scaled", F.coalesce((F.col(score) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), F.col(score))).drop("lo", "hi")


def is_unique(rows: DataFrame, column: str) -> bool:
    return not rows.groupBy(column).count().where("count > 1").limit(1).count()


def first_seen_recall(matches: DataFrame) -> DataFrame:
    """run, n_found, first_id, and the text first seen, of matches (run, gt, first_id, text)."""
    first = matches.groupBy("run", "gt").agg(F.min_by(F.struct("first_id", "text"), "first_id").alias("f"))
    return first.groupBy("run").agg(F.count("*").alias("n_found"), F.min("f.first_id").alias("first_id"), F.min_by("f.text", "f.first_id").alias("text"))


def running_total(rows: DataFrame, order: str, columns: list[str], *by: str) -> DataFrame:
    over = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({f"cum_{c}": F.sum(c).over(over) for c in columns})
