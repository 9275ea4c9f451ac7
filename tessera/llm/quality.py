"""Quality rules: limits from mergeable quantile sketches for each language and source, joined back to filter.

A sketch of a measure is a histogram whose buckets keep the five highest bits below a number's first (relative error 1/32),
so partial sketches merge by adding counts, in any order, to the same result. The limits of each (lang, source) come from
the quantiles of its sketch alone: above, the upper quantile of the measure's TAILS plus SPREAD times its distance from the
median; below (measures in LOWER), the lower quantile less SPREAD times its distance. Symbols and word length take the 90 %
quantile, which junk in under a tenth of a group does not move; duplicate lines and repeats, which ordinary documents
have too, the 99 % quantile. There is no fixed part: where a quantile is 0, so is the limit. A group of fewer than LEAST
documents uses its language's sketch (the merged sketches of that language's groups), and a language of fewer than LEAST
the merged sketch of all.

Base rules are fixed: at least 50 words, and at most half of the words in repeated 3-word windows. Documents that
fail them are not part of the sketches.

Defined results: null text is an empty text (no words: base_failed); null lang or source is a group like any other;
repeated rows are judged alike and each stays a row; an empty table gives an empty table; further columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import let, space_words, written

LEAST, BITS = 50, 5
#: Measures, in thousandths: the percentage of the quantile that sets a limit, and SPREAD.
TAILS = {"symbols": (90, 4), "duplicate_lines": (99, 1), "repeats": (99, 1), "word_length": (90, 4)}
LOWER = ("word_length",)
BOUNDS = (*TAILS, *(f"least_{k}" for k in LOWER))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
LIMITS = "__limits"


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, by 64-bit hashes of the windows."""

    def covered(grams: Column) -> Column:
        rows = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def positions(s: Column) -> Column:
            same = lambda x, j: (x["g"] == F.get(s, j - 1)["g"]) | (x["g"] == F.get(s, j + 1)["g"])
            return F.sort_array(F.transform(F.filter(s, lambda x, j: F.coalesce(same(x, j), F.lit(False))), lambda x: x["i"]))

        zero = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        step = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"))
        return F.aggregate(let(rows, positions), zero, step, lambda acc: acc["n"])

    grams = F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))
    return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(covered(g)))


def measured(text: Column) -> Column:
    """A struct of COUNTS and n_lines (lines with a word) of a whole text."""
    whole = F.coalesce(text, F.lit(""))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeat_words(w).cast("long").alias("n_repeat_words"))

    lines = let(F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), of_lines)
    parts = F.struct(let(space_words(text), of_words).alias("w"), lines.alias("l"), F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"))
    return let(
        parts,
        lambda p: F.struct(
            p["w"]["n_words"].alias("n_words"),
            p["w"]["word_chars"].alias("word_chars"),
            p["n_symbols"].alias("n_symbols"),
            p["l"]["n_dup_lines"].alias("n_dup_lines"),
            p["w"]["n_repeat_words"].alias("n_repeat_words"),
            p["l"]["n_lines"].alias("n_lines"),
        ),
    )


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def _measures(m: Column) -> dict[str, Column]:
    per = lambda x, n: F.coalesce(F.floor(1000 * x / F.nullif(n, F.lit(0))), F.lit(0)).cast("long")
    return {"symbols": per(m["n_symbols"], m["n_words"]), "duplicate_lines": per(m["n_dup_lines"], m["n_lines"]), "repeats": per(m["n_repeat_words"], m["n_words"]), "word_length": per(m["word_chars"], m["n_words"])}


def _width(x: Column) -> Column:
    return F.greatest(F.length(F.bin(x)) - (BITS + 1), F.lit(0))


def bucket(x: Column) -> Column:
    """The least number of x's bucket."""
    return F.call_function("shiftleft", F.call_function("shiftright", x, _width(x)), _width(x))


def bucket_end(b: Column) -> Column:
    """The largest number of the bucket whose least is b."""
    return b + F.call_function("shiftleft", F.lit(1).cast("long"), _width(b)) - 1


def sketches(rows: DataFrame) -> DataFrame:
    """lang, source, measure, bucket, n of documents that pass the base rules; rows: lang, source and the struct m."""
    m = _measures(F.col("m"))
    each = rows.where(~base_failed(F.col("m"))).select("lang", "source", F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), bucket(v).alias("bucket")) for k, v in m.items()])).alias("b"))
    return each.groupBy("lang", "source", "b.measure", "b.bucket").agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, *keys: str) -> DataFrame:
    return sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def _limits(sketch: DataFrame, *keys: str) -> DataFrame:
    """keys, the BOUNDS, and the documents that they come from."""
    over = Window.partitionBy(*keys, "measure")
    rows = sketch.select(*keys, "measure", "bucket", F.sum("n").over(over.orderBy("bucket")).alias("upto"), F.sum("n").over(over).alias("total"))
    of = lambda i: F.coalesce(*[F.when(F.col("measure") == k, v[i]) for k, v in TAILS.items()])
    q = lambda percent: F.min(F.when(100 * F.col("upto") >= percent * F.col("total"), F.col("bucket")))
    found = rows.groupBy(*keys, "measure").agg(q(F.lit(50)).alias("mid"), q(of(0)).alias("top"), q(100 - of(0)).alias("low"), F.max("total").alias("total"))
    upper = bucket_end(F.col("top")) + of(1) * (bucket_end(F.col("top")) - bucket_end(F.col("mid")))
    lower = F.col("low") - of(1) * (F.col("mid") - F.col("low"))
    pick = lambda k, x: F.max(F.when(F.col("measure") == k, x))
    return found.groupBy(*keys).agg(*[pick(k, upper).alias(k) for k in TAILS], *[pick(k, lower).alias(f"least_{k}") for k in LOWER], F.max("total").alias("total"))


def limits(sketch: DataFrame) -> DataFrame:
    """lang, source and the BOUNDS, from the group's own sketch or the next larger one."""
    named = lambda df, tag, *keys: df.select(*keys, *[F.col(c).alias(f"{tag}_{c}") for c in (*BOUNDS, "total")])
    groups = named(_limits(sketch, "lang", "source"), "g", "lang", "source")
    langs = named(_limits(merged(sketch, "lang"), "lang"), "l", F.col("lang").alias("l_lang"))
    whole = named(_limits(merged(sketch)), "w")
    rows = groups.join(langs, F.col("lang").eqNullSafe(F.col("l_lang"))).join(whole, F.lit(True))
    pick = lambda k: F.when(F.col("g_total") >= LEAST, F.col(f"g_{k}")).when(F.col("l_total") >= LEAST, F.col(f"l_{k}")).otherwise(F.col(f"w_{k}"))
    return rows.select("lang", "source", *[pick(k).alias(k) for k in BOUNDS])


def judged(rows: DataFrame, limit: DataFrame) -> DataFrame:
    """rows with the struct m, plus base_failed and kept."""
    keys = limit.select(F.col("lang").alias(f"{LIMITS}_lang"), F.col("source").alias(f"{LIMITS}_source"), F.struct(*BOUNDS).alias(LIMITS))
    both = rows.join(keys, rows["lang"].eqNullSafe(keys[f"{LIMITS}_lang"]) & rows["source"].eqNullSafe(keys[f"{LIMITS}_source"]), "left")
    within = F.lit(True)
    for k, v in _measures(rows["m"]).items():
        within = within & F.coalesce(v <= keys[LIMITS][k], F.lit(False))
        if k in LOWER:
            within = within & F.coalesce(v >= keys[LIMITS][f"least_{k}"], F.lit(False))
    failed = base_failed(rows["m"])
    return both.withColumn("base_failed", failed).withColumn("kept", ~failed & within).drop(LIMITS, f"{LIMITS}_lang", f"{LIMITS}_source")


def quality(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, the counts, base_failed, kept. Texts are read once."""
    rows = written(docs.select("doc_id", "lang", "source", measured(docs["text"]).alias("m")), "quality")
    limit = written(limits(sketches(rows)), "limits")
    return judged(rows, limit).select("doc_id", *[F.col("m")[c].alias(c) for c in COUNTS], "base_failed", "kept")


def kept(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their columns. They are written with their measures, so that texts are measured once."""
    rows = written(docs.select(F.struct(*docs.columns).alias("d"), "lang", "source", measured(docs["text"]).alias("m")), "measured")
    limit = written(limits(sketches(rows)), "limits")
    return judged(rows, limit).where("kept").select("d.*")
