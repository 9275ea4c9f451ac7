"""Benchmark decontamination by winnowing.

Words are hashed to 64 bits. A window is WINDOW consecutive words; its fingerprint is the least hash of its K-grams, so
documents and items that share a window share its fingerprint whatever stands around it (winnowing with WINDOW - K + 1
K-grams in a sliding window). A document gives one fingerprint for each run of windows with the same minimum, with
the word hashes of the run. Runs whose fingerprint an item has are extended: each of their windows is compared with the
items' windows by all of its word hashes. Items of fewer words than a window are one window of their own length; such
windows, which no fingerprint of a full window can find, are looked up directly at every position.

A fingerprint or window joins at most one row (equal windows of several items are one row with the list of items), so
no text, however common, multiplies rows. Words and windows of documents are never sent to the driver.

Defined results: null or empty text has no words, no hits and no items; an item without words has no window; repeated
documents are judged alike and each stays a row; repeated item ids count once; a null item_id is left out of the list
of items but its windows are hit; an empty table gives an empty table; without items nothing is hit; further columns
of the documents stay in clean().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let, written

WINDOW, K = 10, 5
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
HASHES = "array<bigint>"


def item_words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def word_hashes(text: Column) -> Column:
    return F.transform(item_words(text), lambda w: F.xxhash64(w))


def _at(values: Column, i: Column, n: int) -> list[Column]:
    return [F.get(values, i + k if k else i) for k in range(n)]


def _minima(h: Column) -> Column:
    """The fingerprint of each window of the word hashes h, of which there are at least WINDOW."""
    grams = F.transform(F.sequence(F.lit(0), F.size(h) - K), lambda i: F.xxhash64(*_at(h, i, K)))
    return let(grams, lambda g: F.transform(F.sequence(F.lit(0), F.size(g) - (WINDOW - K + 1)), lambda i: F.least(*_at(g, i, WINDOW - K + 1))))


def _runs(h: Column) -> Column:
    """fingerprint, start, and the word hashes of each run of windows with one fingerprint."""

    def of_minima(m: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: (i == 0) | (F.get(m, i) != F.get(m, i - 1)))
        run = lambda s, end: F.struct(F.get(m, s).alias("fingerprint"), s.alias("start"), F.slice(h, s + 1, end - s + WINDOW - 1).alias("hashes"))
        return let(starts, lambda all_: F.transform(all_, lambda s, j: run(s, F.coalesce(F.get(all_, j + 1), F.size(m)))))

    return let(_minima(h), of_minima)


def _windows(h: Column, start: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.struct((start + i).alias("pos"), F.slice(h, i + 1, n).alias("window")))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """n (words of a window), window (their hashes), items (sorted ids) of all windows of the items."""
    rows = benchmark.select(benchmark["item_id"].cast("string").alias("item_id"), word_hashes(benchmark["text"]).alias("h")).where(F.size("h") > 0)
    long = rows.where(F.size("h") >= WINDOW).select("item_id", F.explode(_windows(F.col("h"), F.lit(0), WINDOW)["window"]).alias("window"))
    short = rows.where(F.size("h") < WINDOW).select("item_id", F.col("h").alias("window"))
    return long.unionByName(short).groupBy("window").agg(F.sort_array(F.collect_set("item_id")).alias("items")).select(F.size("window").alias("n"), "window", "items")


def _short_hits(base: DataFrame, known: DataFrame, lengths: list[int]) -> DataFrame:
    """Places of the windows under WINDOW words, all lengths in one pass: by the first two words (or the only one), then whole."""
    pair = F.when(F.col("n") == 1, F.get("window", 0)).otherwise(F.xxhash64(F.get("window", 0), F.get("window", 1)))
    heads = written(known.groupBy(pair.alias("key")).agg(F.sort_array(F.collect_set("n")).alias("lengths")), "heads")
    place = lambda i: F.struct(i.alias("pos"), F.slice(F.col("h"), i + 1, max(lengths)).alias("next"))
    each = base.where(F.size("h") >= lengths[0]).select("doc_id", "digest", F.explode(F.transform(F.sequence(F.lit(0), F.size("h") - 1), place)).alias("w")).select("doc_id", "digest", "w.*")
    keys = [F.get("next", 0)] * (1 in lengths) + [F.when(F.size("next") > 1, F.xxhash64(F.get("next", 0), F.get("next", 1)))] * (lengths[-1] > 1)
    met = each.select("*", F.explode(F.array(*keys)).alias("key")).join(heads, "key").select("doc_id", "digest", "pos", "next", F.explode("lengths").alias("n"))
    whole = met.where(F.size("next") >= F.col("n")).select("doc_id", "digest", "pos", "n", F.slice("next", F.lit(1), F.col("n")).alias("window"))
    return whole.join(known.drop("n"), "window")


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, digest (of the text), spans (pos, n of the item windows found) and items, for documents with any."""
    known = written(item_windows(benchmark), "windows")
    lengths = [r[0] for r in known.select("n").distinct().collect()]  # at most WINDOW numbers
    base = docs.select(docs["doc_id"], F.xxhash64(docs["text"]).alias("digest"), word_hashes(docs["text"]).alias("h"))
    found = []
    if WINDOW in lengths:
        full = known.where(F.col("n") == WINDOW)
        marks = written(full.select(_minima(F.col("window"))[0].alias("fingerprint")).distinct(), "fingerprints")
        runs = base.where(F.size("h") >= WINDOW).select("doc_id", "digest", F.explode(_runs(F.col("h"))).alias("r")).select("doc_id", "digest", "r.*")
        extended = runs.join(marks, "fingerprint").select("doc_id", "digest", F.explode(_windows(F.col("hashes"), F.col("start"), WINDOW)).alias("w"))
        found.append(extended.select("doc_id", "digest", "w.*").join(full, "window"))
    if few := sorted(set(lengths) - {WINDOW}):
        found.append(_short_hits(base, known.where(F.col("n") < WINDOW), few))
    if not found:
        found.append(base.where(F.lit(False)).select("doc_id", "digest", F.lit(0).alias("pos"), F.lit(0).alias("n"), F.lit(None).cast("array<string>").alias("items")))
    rows = found[0].select("doc_id", "digest", "pos", "n", "items")
    for more in found[1:]:
        rows = rows.unionByName(more.select("doc_id", "digest", "pos", "n", "items"))
    return rows.groupBy("doc_id", "digest").agg(F.sort_array(F.collect_set(F.struct("pos", "n"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))


def _covered(spans: Column) -> Column:
    """Words inside any of the sorted spans."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def step(acc: Column, s: Column) -> Column:
        end = F.greatest(acc["end"], s["pos"] + s["n"])
        return F.struct(end.alias("end"), (acc["n"] + end - F.greatest(acc["end"], F.least(s["pos"], end))).alias("n"))

    return F.aggregate(spans, zero, step, lambda acc: acc["n"])


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    base = docs.select("doc_id", F.xxhash64("text").alias("digest"), F.size(item_words(docs["text"])).cast("long").alias("n_words"))
    found = hits(docs, benchmark).select(F.col("doc_id").alias("hit_id"), F.col("digest").alias("hit_digest"), _covered(F.col("spans")).alias("n"), "items")
    rows = base.join(found, base["doc_id"].eqNullSafe(found["hit_id"]) & (base["digest"] == found["hit_digest"]), "left")
    return rows.select(
        "doc_id",
        "n_words",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n", F.lit(0)) > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a hit, with their columns."""
    found = written(hits(docs, benchmark).select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")), "contaminated")
    return docs.join(found, docs["doc_id"].eqNullSafe(found["__id"]) & (F.xxhash64(docs["text"]) == found["__digest"]), "left_anti")
