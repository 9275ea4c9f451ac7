"""Reports as lines in order, written in parts: a report of any length passes through no single task and not through the driver.

Each function gives place (what the lines are sorted by) and line; write_lines writes them to a folder of text files whose
names are in the lines' order, so that they can be put together as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import round_table, scratch

#: Characters that a LaTeX text and an HTML text must escape, in this order.
LATEX, HTML = "&%$#_{}", (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.orderBy("place").select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def _framed(lines: DataFrame, head: list[str], tail: list[str]) -> DataFrame:
    """lines (place, line) between those of a head and a tail."""
    kind = lines.schema["place"].dataType.simpleString()
    none = F.lit(None).cast(kind)
    ends = lines.sparkSession.createDataFrame([(0, i, x) for i, x in enumerate(head)] + [(2, i, x) for i, x in enumerate(tail)], "part int, i int, line string")
    place = lambda part, at, i: F.struct(part.alias("part"), at.alias("at"), i.alias("i")).alias("place")
    return lines.select(place(F.lit(1), F.col("place"), F.lit(0)), "line").unionByName(ends.select(place(F.col("part"), none, F.col("i")), "line"))


def latex_lines(rows: DataFrame, columns: list[str], order: Column) -> DataFrame:
    """A longtable of the rows in order; a null is an empty cell."""
    cell = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), f"([{LATEX}])", r"\\$1")
    name = lambda c: "".join(f"\\{x}" if x in LATEX else x for x in c)
    lines = rows.select(order.alias("place"), F.concat(F.concat_ws(" & ", *map(cell, columns)), F.lit(" \\\\")).alias("line"))
    return _framed(lines, [f"\\begin{{longtable}}{{{'l' * len(columns)}}}", " & ".join(map(name, columns)) + " \\\\", "\\hline"], ["\\end{longtable}"])


def markdown_lines(edges: DataFrame) -> DataFrame:
    """Nested lists of edges (parent, child): roots (never a child), and below each its children in order of their names.

    A round for each level, written; a node with several parents comes below each of them. ValueError for a cycle below a root.
    """
    edges = edges.select("parent", "child").where("parent is not null and child is not null").distinct()
    with scratch(edges.sparkSession):
        edges = round_table(edges, "edges")
        roots = edges.select("parent").distinct().join(edges.select(F.col("child").alias("parent")).distinct(), "parent", "left_anti")
        front = round_table(roots.select(F.array("parent").alias("place")), "level")
        found = front
        while True:
            below = front.join(edges, F.element_at("place", -1) == edges["parent"])
            front = round_table(below.select(F.concat("place", F.array("child")).alias("place"), F.array_contains("place", F.col("child")).alias("again")), "level")
            if front.where("again").limit(1).count():
                raise ValueError("the edges form a cycle")
            front = front.select("place")
            if not front.limit(1).count():
                break
            found = found.unionByName(front)
        lines = found.select("place", F.concat(F.repeat(F.lit("  "), F.size("place") - 1), F.lit("- "), F.element_at("place", -1)).alias("line"))
        return round_table(lines, "lines", keep=True)


def explorer_lines(trajectories: DataFrame, sources: DataFrame, n_runs: int) -> DataFrame:
    """An HTML page with a search field: a section for each final topic, by falling number of origins, and a line for each of these.

    trajectories: final_topic, origin; sources: topic, n_runs.
    """

    def safe(c: Column) -> Column:
        for x, y in HTML:
            c = F.replace(c, F.lit(x), F.lit(y))
        return c

    pairs = trajectories.select("final_topic", "origin").distinct()
    sizes = pairs.groupBy("final_topic").agg(F.count("*").alias("n")).join(sources.select(F.col("topic").alias("final_topic"), "n_runs"), "final_topic", "left")
    at = lambda n, i, origin: F.struct((-n).alias("n"), F.col("final_topic").alias("topic"), F.lit(i).alias("i"), origin.alias("origin")).alias("place")
    none = F.lit(None).cast("string")
    badge = F.concat(F.lit(" ("), F.col("n").cast("string"), F.lit(") ["), F.coalesce("n_runs", F.lit(0)).cast("string"), F.lit(f"/{n_runs}]"))
    heads = sizes.select(at(F.col("n"), 0, none), F.concat(F.lit("<details><summary>"), safe(F.col("final_topic")), badge, F.lit("</summary><ul>")).alias("line"))
    ends = sizes.select(at(F.col("n"), 2, none), F.lit("</ul></details>").alias("line"))
    items = pairs.join(sizes.select("final_topic", "n"), "final_topic").select(at(F.col("n"), 1, F.col("origin")), F.concat(F.lit("<li>"), safe(F.col("origin")), F.lit("</li>")).alias("line"))
    script = "<script>const q=document.querySelector('input');q.oninput=()=>document.querySelectorAll('details').forEach(d=>d.hidden=!d.textContent.toLowerCase().includes(q.value.toLowerCase()))</script>"
    return _framed(heads.unionByName(items).unionByName(ends), ["<!doctype html><meta charset='utf-8'><title>Topics</title><input placeholder='Search'>"], [script])
