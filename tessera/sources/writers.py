"""Writers: tables per run, append-only logs, text and JSON exports, cached results."""

from __future__ import annotations

import html
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scan import scanned
from ..storage import exists


def run_state(rows: DataFrame, path: str) -> None:
    """Overwrites the partitions of the runs in rows, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


#: Bytes of the texts in a document of a crawl log.
PART = 4 << 20


def log_parts(topics: DataFrame, order: str, size: Column, *by: str) -> DataFrame:
    """topics with part: a log's (by) topics in order, cut where their sizes add up to PART, so a part has less than PART and one topic more."""
    sized = topics.withColumn("__size", size.cast("long"))
    placed = scanned(sized, order, {"__upto": F.col("__size")}, *by)
    return placed.withColumn("part", F.floor((F.col("__upto") - F.col("__size")) / PART)).drop("__size", "__upto")


def append_log(rows: DataFrame, path: str | None) -> None:
    """Appends JSON lines; without a path does nothing."""
    if path:
        rows.write.mode("append").json(path)


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table at path; made and written first if it is not there, or with force."""
    if force or not exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def text_list(rows: DataFrame, column: str, path: str) -> None:
    """One file of sorted lines; for final label lists, which are short."""
    rows.select(F.col(column).cast("string").alias("value")).orderBy("value").coalesce(1).write.mode("overwrite").text(path)


def json_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def csv_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def topic_json(topics: DataFrame) -> DataFrame:
    """run_id, topic: each topic as a JSON object with all its fields, nulls included."""
    fields = [c for c in topics.columns if c != "run_id"]
    return topics.select("run_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("topic"))


def nested_results(rows: DataFrame) -> DataFrame:
    """One row: {category: {subcategory: {prompt: [generations]}}} as nested maps, from the fact table of generations."""
    answers = rows.groupBy("category", "subcategory", "prompt").agg(F.transform(F.array_sort(F.collect_list(F.struct("gen_idx", "generation", "is_refusal"))), lambda g: F.struct(g["generation"].alias("generation"), g["is_refusal"].alias("is_refusal"))).alias("g"))
    per_sub = answers.groupBy("category", "subcategory").agg(F.map_from_entries(F.collect_list(F.struct("prompt", "g"))).alias("p"))
    per_category = per_sub.groupBy("category").agg(F.map_from_entries(F.collect_list(F.struct("subcategory", "p"))).alias("s"))
    return per_category.agg(F.map_from_entries(F.collect_list(F.struct("category", "s"))).alias("results"))


#: Rows of a report that is one text; longer ones are written in parts, see reports.
SHORT = 10_000


def _short(rows: DataFrame) -> list:
    found = rows.limit(SHORT + 1).collect()
    if len(found) > SHORT:
        raise ValueError(f"a report of over {SHORT} rows is written in parts, see tessera.sources.reports")
    return found


def latex_table(rows: DataFrame, columns: list[str]) -> str:
    """A longtable of up to SHORT rows."""
    clean = lambda x: "".join(f"\\{c}" if c in "&%$#_{}" else c for c in str("" if x is None else x))
    body = "".join(" & ".join(clean(r[c]) for c in columns) + " \\\\\n" for r in _short(rows.select(*columns)))
    return f"\\begin{{longtable}}{{{'l' * len(columns)}}}\n" + " & ".join(map(clean, columns)) + " \\\\\n\\hline\n" + body + "\\end{longtable}\n"


def markdown_tree(edges: DataFrame) -> str:
    """Nested lists of up to SHORT parent, child edges, roots (never a child) first."""
    children: dict[str, list[str]] = {}
    inner = set()
    for r in _short(edges.select("parent", "child").orderBy("parent", "child")):
        children.setdefault(r["parent"], []).append(r["child"])
        inner.add(r["child"])
    out: list[str] = []
    stack = [(p, 0) for p in sorted(set(children) - inner, reverse=True)]
    while stack:
        name, level = stack.pop()
        out.append("  " * level + f"- {name}")
        stack += [(c, level + 1) for c in reversed(children.get(name, []))]
    return "\n".join(out)


def explorer(trajectories: DataFrame, sources: DataFrame, n_runs: int) -> str:
    """An HTML page of up to SHORT final topics by falling number of origins, with a search field. sources: topic, n_runs."""
    grouped = trajectories.groupBy("final_topic").agg(F.array_sort(F.collect_set("origin")).alias("origins"))
    rows = grouped.join(sources.select(F.col("topic").alias("final_topic"), "n_runs"), "final_topic", "left").orderBy(F.desc(F.size("origins")), "final_topic")
    parts = []
    for r in _short(rows):
        items = "".join(f"<li>{html.escape(o)}</li>" for o in r["origins"])
        badge = f" [{r['n_runs'] or 0}/{n_runs}]"
        parts.append(f"<details><summary>{html.escape(r['final_topic'])} ({len(r['origins'])}){badge}</summary><ul>{items}</ul></details>")
    script = "const q=document.querySelector('input');q.oninput=()=>document.querySelectorAll('details').forEach(d=>d.hidden=!d.textContent.toLowerCase().includes(q.value.toLowerCase()))"
    return f"<!doctype html><meta charset='utf-8'><title>Topics</title><input placeholder='Search'>{''.join(parts)}<script>{script}</script>"
