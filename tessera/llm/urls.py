"""URL filters: rules first, else host word segmentation and naive Bayes.

A rule is (action, host, path): it fits a url whose host is the rule's or a subdomain of it, and whose path starts with the
rule's; the longest (host and path together; of equal ones the last) that fits decides. Rules are a table of any size: each
distinct url is joined by the suffixes of its host and those beginnings of its path that are as long as some rule's path.

Other urls are judged by words: hosts and paths are cut at characters other than letters and digits, and each piece is
segmented by a unigram Viterbi search into the words that most probably make it up; letters in a row where no word fits
are one word. A multinomial naive Bayes model with equal priors and add-one smoothing scores the words of host and path;
block wins if its probability is the larger.

What is learned: the segmenter's word counts from the visible text of all pages, without the labels of the page's own host
(counted from urls, or from the pages of its own site, an unsplit name would soon be a word by itself and hide its parts);
the model from the urls that a rule decides, each page's url being an example of its rule's action. All of them are used.
Counts and model stay tables of any size: the substrings of each distinct stretch of letters are joined with the word
counts, its words with the model, and urls with their stretches. A word has at most LONGEST letters, in names as in text.

Defined results: a null url, or one without ``://``, has empty host and path, and is judged by its rule or as a url without
words (allow); null html adds no words; repeated rows are judged alike and each stays a row; without examples of both
actions all other urls are allowed; an empty table gives an empty table. Only page_id, url and html are read.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, by_value, scratch, written

#: Letters of a word; rules that are broadcast (some ten MB), more are joined by a shuffle.
LONGEST, FEW_RULES = 24, 100_000


def host(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3)).otherwise("")
    return F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3)).otherwise("")
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(urls: DataFrame, rules) -> DataFrame:
    """host, path, action, rule of the distinct urls (host, path) that a rule fits; rules: (action, host, path)."""
    rows = [(k, action, h.translate(str.maketrans(UPPER, LOWER)), p) for k, (action, h, p) in enumerate(rules)]
    table = urls.sparkSession.createDataFrame(rows, "k int, action string, r_host string, r_path string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = F.array(*map(F.lit, sorted({len(r[3]) for r in rows}) or [0]))
    begins = F.transform(F.filter(lengths, lambda n: n <= F.char_length("path")), lambda n: F.substr("path", F.lit(1), n))
    each = urls.select("host", "path", F.explode(suffixes).alias("r_host"), begins.alias("begins")).select("host", "path", "r_host", F.explode("begins").alias("r_path"))
    fits = each.join(F.broadcast(table) if len(rows) <= FEW_RULES else table, ["r_host", "r_path"])
    order = F.struct((F.char_length("r_host") + F.char_length("r_path")).alias("n"), "k", "action", F.concat("r_host", "r_path").alias("rule"))
    return fits.groupBy("host", "path").agg(F.max(order).alias("r")).select("host", "path", "r.action", "r.rule")


class Segmenter:
    """words(piece): the most probable segmentation under unigram probabilities.

    counts may be those of the substrings of a piece alone, if total is given.
    """

    def __init__(self, counts: dict[str, int], total: int | None = None):
        total = total or sum(counts.values()) + 1
        self.log = {w: math.log(n / total) for w, n in counts.items()}
        self.unknown = math.log(1 / total)
        self.longest = min(LONGEST, max(map(len, counts), default=1))
        self.words = lru_cache(maxsize=100_000)(self._words)

    def _words(self, piece: str) -> tuple[str, ...]:
        if piece.isdigit():
            return ("<digits>",)
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(piece) + 1):
            # An unknown character is dearer than any known word, so it is used only where no word fits.
            choice = (best[end - 1][0] + 2 * self.unknown, end - 1)
            for start in range(max(0, end - self.longest), end):
                p = self.log.get(piece[start:end])
                if p is not None and best[start][0] + p > choice[0]:
                    choice = (best[start][0] + p, start)
            best.append(choice)
        out, end, stray = [], len(piece), False
        while end:
            start = best[end][1]
            word, end = piece[start:end], start
            # Letters that fit no word, side by side, are taken together.
            now = word not in self.log and word.isalpha()
            out[-1:] = [word + out[-1]] if now and stray else [*out[-1:], word]
            stray = now
        return tuple(reversed(out))


def parts(text: Column) -> Column:
    """The parts that are segmented alone, in order: stretches of letters, single digits; # for a piece of digits only."""
    digits = F.regexp_replace(F.lower(text), r"(?<![\p{L}\p{N}])\p{Nd}+(?![\p{L}\p{N}])", "#")
    return F.regexp_extract_all(digits, F.lit(r"#|\p{L}+|\p{N}"), F.lit(0))


def word_counts(pages: DataFrame) -> DataFrame:
    """word, n over the visible text of all pages; the labels of a page's own host do not count on it."""
    visible = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>|&#?\w{1,10};", " ")
    cut = lambda c: F.split(F.lower(c), r"[^\p{L}]+")
    rows = pages.select(cut(visible).alias("words"), cut(host(pages["url"])).alias("own"))
    words = F.filter("words", lambda w: F.length(w).between(2, LONGEST) & ~F.array_contains("own", w))
    return rows.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def _segment(total):
    def segment(batches):
        import pyarrow as pa

        for batch in batches:
            names, known = batch.column(0), batch.column(1).to_pylist()
            found = [Segmenter({k["word"]: k["n"] for k in ks or ()}, total).words(p) for p, ks in zip(names.to_pylist(), known)]
            yield pa.RecordBatch.from_arrays([names, pa.array(found, pa.list_(pa.string()))], names=["part", "words"])

    return segment


def segmented(stretches: DataFrame, counts: DataFrame) -> DataFrame:
    """part, words for each distinct stretch of letters (part), from all counts (word, n)."""
    total = (counts.agg(F.sum("n")).head()[0] or 0) + 1
    size = F.length("part")
    each = F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST), size - i + 1)), lambda k: F.substr("part", i, k)))
    known = stretches.select("part", F.explode(F.array_distinct(F.flatten(each))).alias("word")).join(counts, "word")
    known = known.groupBy("part").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    return stretches.join(known, "part", "left").select("part", "known").mapInArrow(_segment(total), "part string, words array<string>")


def in_order(pos: str, value: str) -> Column:
    """The sum of value in the order of pos, so that it does not depend on how rows are dealt."""
    return F.aggregate(F.array_sort(F.collect_list(F.struct(pos, value))), F.lit(0.0), lambda a, x: a + x[value])


def decided(pages: DataFrame, rules) -> DataFrame:
    """host, path, action and rule (null without one), log_odds (of block against allow, by words) of each distinct url."""
    with scratch(pages.sparkSession):
        words = written(word_counts(pages), "words")
        rows = pages.select(host(pages["url"]).alias("host"), path(pages["url"]).alias("path")).groupBy("host", "path").agg(F.count("*").alias("n"))
        own = parts(F.regexp_extract("host", r"(?s)^(.*)\.", 1))
        urls = written(rows.select("host", "path", "n", own.alias("own"), parts(F.col("path")).alias("rest")), "urls")
        found = written(ruled(urls.select("host", "path"), rules), "ruled")
        stretches = urls.select(F.explode(F.concat("own", "rest")).alias("part")).where(r"part rlike '^\\p{L}'").distinct()
        split = written(segmented(written(stretches, "stretches"), words), "segmented")

        labelled = urls.join(found, ["host", "path"]).select(F.explode(F.concat("own", "rest")).alias("part"), "action", "n")
        sums = [F.sum(F.when(F.col("action") == name, F.col("n")).otherwise(0)).alias(name) for name in ("allow", "block")]
        counted = labelled.groupBy("part").agg(*sums).join(split, "part", "left")
        counted = counted.select(F.explode(F.coalesce("words", F.array("part"))).alias("word"), "allow", "block")
        model = written(counted.groupBy("word").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")), "model")

        allow, block, size = (x or 0 for x in model.agg(F.sum("allow"), F.sum("block"), F.count("*")).head())
        base = math.log(allow + size + 1) - math.log(block + size + 1)
        ratios = model.select("word", (F.log((F.col("block") + 1) / (F.col("allow") + 1)) + base).alias("ratio"))
        letters = split.select("part", F.posexplode("words").alias("pos", "word")).join(ratios, "word").groupBy("part").agg(in_order("pos", "ratio").alias("score"))
        others = ratios.where(r"not word rlike '^\\p{L}'").select(F.col("word").alias("part"), F.col("ratio").alias("score"))
        scores = written(letters.unionByName(others), "scores")
        # Without examples of both there is nothing to tell them apart by.
        each = urls.where(F.lit(bool(allow and block))).select("host", "path", F.posexplode(F.concat("own", "rest")).alias("pos", "part")).join(scores, "part")
        odds = each.groupBy("host", "path").agg(in_order("pos", "score").alias("log_odds"))
        return written(urls.select("host", "path").join(found, ["host", "path"], "left").join(odds, ["host", "path"], "left"), "decided", keep=True)


def judged(pages: DataFrame, rules) -> DataFrame:
    """page_id, host, path, rule, verdict and log_odds (of block against allow, by words)."""
    rows = pages.select("page_id", host(pages["url"]).alias("host"), path(pages["url"]).alias("path"))
    both = rows.join(decided(pages, rules), ["host", "path"], "left").withColumn("log_odds", F.coalesce("log_odds", F.lit(0.0)))
    by_words = F.when(F.col("log_odds") > 0, "block").otherwise("allow")
    return both.select("page_id", "host", "path", "rule", F.coalesce("action", by_words).alias("verdict"), "log_odds")


by_value(__name__)
