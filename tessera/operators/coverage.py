"""Coverage of a ground truth (category, subtopic) by crawled topics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import trim_key
from .dedup import chunked


def contained(truth: DataFrame, crawl: DataFrame, predicate: Callable[[Column, Column], Column], size: int = 50) -> DataFrame:
    """category, subtopic, matched_topic (null without one): the first topic, by pos, for which predicate(subtopic, topic) holds.

    For predicates that no index serves, such as a judge's; contained_text is for texts. Topics are tried in chunks, and a subtopic leaves the probe side once it has a match. A chunk has `size` topics, so each
    join pairs the unmatched subtopics with a bounded side, which is broadcast. Each round is written to the shared folder, and
    the last is that in which no subtopic is left.
    """
    from ..storage import round_table

    topics = round_table(chunked(crawl.select("topic", "pos"), "pos", size), "chunks")
    n = topics.agg(F.max("chunk")).head()[0]
    open_, found = round_table(truth.select("category", "subtopic"), "open"), None
    for i in range(0 if n is None else n + 1):
        if not open_.limit(1).count():
            break
        chunk = topics.where(F.col("chunk") == i)
        pairs = open_.join(F.broadcast(chunk), predicate(F.col("subtopic"), F.col("topic")))
        hit = round_table(pairs.groupBy("category", "subtopic").agg(F.min_by("topic", "pos").alias("matched_topic")), "hits")
        if hit.limit(1).count():
            found = hit if found is None else found.unionByName(hit)
            open_ = round_table(open_.join(hit, ["category", "subtopic"], "left_anti"), "open")
    rest = open_.withColumn("matched_topic", F.lit(None).cast("string"))
    return rest if found is None else found.unionByName(rest)


#: Letters of the grams by which texts are looked up.
GRAM = 3


def _grams(text: Column, size: int) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(text) - size + 1), lambda i: F.substring(text, i, F.lit(size))))


def contained_text(truth: DataFrame, crawl: DataFrame, needle: Column, topic: Column) -> DataFrame:
    """category, subtopic, matched_topic (null without one): the first topic, by pos, whose text (an expression over crawl) contains
    the needle (one over truth). An index instead of pairs of all: texts are listed by their grams of GRAM letters, each
    needle is looked up under that of its grams that fewest texts have, and what is found there is compared.

    Equal texts are one, with the first of their topics. A plan's estimate knows nothing of the number of grams, so what is broadcast is
    the needles' side, by the size of its files, and never the list of texts. A needle under GRAM letters is a gram of its own; an empty
    one is in every topic; a null on either side matches nothing.
    """
    from ..storage import round_table, sized

    wanted = truth.select("category", "subtopic", needle.alias("needle"))
    needles = wanted.where("needle <> ''").select("needle").distinct()
    rows = crawl.select("pos", "topic", topic.alias("text")).where("text is not null")
    texts = round_table(rows.groupBy("text").agg(F.min_by("topic", "pos").alias("topic"), F.min("pos").alias("pos")), "texts")
    size = F.least(F.char_length("needle"), F.lit(GRAM))
    sizes = sorted(r[0] for r in needles.select(size.alias("s")).distinct().collect())
    found = None
    if sizes:
        by_size = lambda c, s: F.when(F.char_length(c) >= s, _grams(c, s)).otherwise(F.array().cast("array<string>"))
        own = round_table(needles.select("needle", F.explode(F.coalesce(*[F.when(size == s, by_size(F.col("needle"), s)) for s in sizes])).alias("gram")), "grams")
        listed = lambda *c: texts.select(*c, F.explode(F.flatten(F.array(*[by_size(F.col("text"), s) for s in sizes]))).alias("gram"))
        known = round_table(listed().join(sized(own.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n")), "known")
        rarest = own.join(sized(known), "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g")).where("g.n > 0").select("needle", "g.gram")
        hits = listed("pos", "topic", "text").join(sized(round_table(rarest, "rarest")), "gram").where(F.contains(F.col("text"), F.col("needle")))
        found = hits.groupBy("needle").agg(F.min_by("topic", "pos").alias("matched_topic"))
    first = texts.groupBy().agg(F.min_by("topic", "pos").alias("matched_topic")).where("matched_topic is not null").select(F.lit("").alias("needle"), "matched_topic")
    found = first if found is None else found.unionByName(first)
    return wanted.join(sized(round_table(found, "found")), "needle", "left").select("category", "subtopic", "matched_topic")


def keyed_coverage(truth: DataFrame, crawl: DataFrame) -> DataFrame:
    """The same with equality of keys as predicate: one equi-join."""
    keys = crawl.groupBy(trim_key(F.col("topic")).alias("k")).agg(F.min_by("topic", "pos").alias("matched_topic"))
    return truth.join(keys, trim_key(truth["subtopic"]) == keys["k"], "left").select("category", "subtopic", "matched_topic")


def report(coverage: DataFrame) -> DataFrame:
    """category (null: all), covered, total, rate, missing (sorted), matches (subtopic to topic; of equal subtopics one)."""
    missing = F.array_sort(F.collect_list(F.when(F.col("matched_topic").isNull(), F.col("subtopic"))))
    pairs = F.array_sort(F.collect_list(F.when(F.col("matched_topic").isNotNull(), F.struct("subtopic", "matched_topic"))))
    rolled = coverage.rollup("category").agg(F.count("matched_topic").alias("covered"), F.count("*").alias("total"), missing.alias("missing"), pairs.alias("pairs"))
    firsts = F.filter("pairs", lambda p, i: (i == 0) | (p["subtopic"] != F.get(F.col("pairs"), i - 1)["subtopic"]))
    return rolled.select("category", "covered", "total", F.coalesce(F.col("covered") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0)).alias("rate"), "missing", F.map_from_entries(firsts).alias("matches"))


def resolved(terms: DataFrame, reference: DataFrame) -> DataFrame:
    """terms (id, term) with the first reference spelling (term, pos) of the same key, or null."""
    keys = reference.groupBy(trim_key(F.col("term")).alias("k")).agg(F.min_by("term", "pos").alias("resolved"))
    return terms.join(keys, trim_key(terms["term"]) == keys["k"], "left").select("id", "term", "resolved")


def completion(counts: DataFrame) -> DataFrame:
    """category, dataset, k, n: labels with a count over 0, of all."""
    return counts.groupBy("category", "dataset").agg(F.count_if(F.col("n") > 0).alias("k"), F.count("*").alias("n"))
