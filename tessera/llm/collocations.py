"""Phrases of up to SIZES words that occur more often than their parts let expect, for each language.

1. Texts are split into pieces and words, and their n-grams exploded into rows (lang, size, phrase, f), those of a group of texts
   added up where it is read; Spark adds the rest by a hash aggregate. This goes in rounds: words, pairs, then all longer
   ones. A phrase counts LEAST times only if its words and pairs do, so a round explodes n-grams whose parts did in
   the round before. It knows them by a sieve: a bitmap of their hashes of SIEVE bits at most, whatever the corpus has. A
   sieve may let through what it should not, which costs a row and changes no count; if it is too small for a corpus, more rows
   are shuffled.
2. Counts of each candidate's first k words and of the rest are joined, and each cut scored in decimals.
3. Candidates inside a longer one of nearly their own count go by an anti-join with the one-word extensions: each
   occurrence of a longer phrase is one of any phrase between the two, so some extension has at least as many.
4. Windows rank those that are left: in buckets of a language first, then the first rows of these.

Defined results: null text has no words, null lang is `und`; A-Z count as a-z and no other letter; repeated rows count
as often as they occur; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import splitting
from .common import ascii_lower, by_value, scratch, small, written
from .splitting import byte_kinds, factored, hashes, split
from .suffixes import mixed

#: Words of a phrase at most, its least count, the share (percent) of its count from which a longer one replaces it, and phrases of a language.
SIZES, LEAST, SHARE, TOP = 5, 100, 100, 2000
#: What is between words, and what ends a piece.
GAPS, SEPARATORS = b" \t", b".,;:!?\n\x0b\x0c\r"
#: Buckets that a language's phrases are ranked in before.
BUCKETS = 64
#: Bits of a sieve: for each entry, and at most (64 MB).
EACH, SIEVE = 16, 1 << 29
#: Bits of one part of a sieve, as Spark's bitmaps have them.
PART = 1 << 15
GRAM = "lang string, size int, phrase string, f bigint"


def keys(lang, *words):
    """A hash of each row's language and words, from their hashes."""
    import numpy as np

    total = mixed(lang)
    for k, w in enumerate(words):
        total = total + w * np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1)
    return mixed(total)


def _places(bits: int):
    """Rows (lang, phrase) to places (from 1) in a sieve."""

    def places(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            if len(batch):
                words = pc.split_pattern(batch.column(1), " ")
                own = hashes(words.flatten()).reshape(len(batch), -1)
                at = keys(hashes(batch.column(0)), *own.T) >> np.uint64(64 - bits)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype("i8") + 1)], names=["place"])

    return places


def sieve(phrases: DataFrame):
    """A broadcast (bits, bitmap) of the hashes of phrases (lang, phrase) of one size; at most SIEVE bits."""
    bits = min(max((EACH * phrases.count()).bit_length(), PART.bit_length() - 1), SIEVE.bit_length() - 1)
    places = phrases.select("lang", "phrase").mapInArrow(_places(bits), "place bigint")
    parts = places.groupBy(F.bitmap_bucket_number("place").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("data"))
    held = bytearray(1 << (bits - 3))
    for part, data in parts.toLocalIterator():
        held[(part - 1) * (PART >> 3) : part * (PART >> 3)] = data
    return phrases.sparkSession.sparkContext.broadcast((bits, bytes(held)))


def _grams(lo: int, hi: int, held=None):
    """(text, lang) to the phrases of lo to hi words with their counts; size 0 is the number of words. held: a sieve of lo - 1 words."""

    def grams(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        kinds = byte_kinds(GAPS, SEPARATORS)

        def passed(hashed):
            bits, data = held.value
            place = hashed >> np.uint64(64 - bits)
            return np.frombuffer(data, "u1")[(place >> np.uint64(3)).astype("i8")] >> (place & np.uint64(7)).astype("u1") & 1 == 1

        def rows(lang, size, phrase, f):
            return pa.RecordBatch.from_arrays([lang.cast(pa.string()), pa.array(np.full(len(f), size, "i4")), phrase.cast(pa.string()), pa.array(f.astype("i8"))], names=["lang", "size", "phrase", "f"])

        def counted(texts, langs, lang_of):
            words, word, lang, piece = texts.words, texts.word, lang_of[texts.text], texts.piece
            if not len(word):
                return
            if lo == 1:
                total = np.bincount(lang, minlength=len(langs))
                some = np.flatnonzero(total)
                yield rows(langs.take(pa.array(some)), 0, pa.array([""] * len(some)), total[some])
                _, f, first = factored(lang * len(words) + word)
                yield rows(langs.take(pa.array(lang[first])), 1, words.take(pa.array(word[first])), f)
            if hi == 1:
                return
            own, spoken = hashes(words), hashes(langs)
            # Whether a word and the next may be in a phrase together.
            may = piece[1:] == piece[:-1]
            if held is not None and lo == 2:
                known = passed(keys(spoken[lang], own[word]))
                may &= known[1:] & known[:-1]
            elif held is not None:
                at = np.flatnonzero(may)
                may[at] = passed(keys(spoken[lang[at]], own[word[at]], own[word[at + 1]]))
            ids, ok = lang * len(words) + word, np.append(may, False)
            for size in range(2, hi + 1):
                at = np.flatnonzero(ok)
                if not len(at):
                    return
                codes, f, first = factored(ids[at] * len(words) + word[at + size - 1])
                if size >= lo:
                    place = at[first]
                    parts = [words.take(pa.array(word[place + k])) for k in range(size)]
                    yield rows(langs.take(pa.array(lang[place])), size, pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())), f)
                ids[at] = codes
                ok[: len(ok) - size] &= may[size - 1 :]
                ok[len(ok) - size :] = False

        for batch in batches:
            if len(batch):
                coded = batch.column(1).dictionary_encode()
                lang_of = coded.indices.to_numpy().astype("i8")
                for texts in split(batch.column(0), kinds):
                    yield from counted(texts, coded.dictionary, lang_of)

    return grams


def counts(docs: DataFrame, sizes: int = SIZES, least: int = LEAST) -> DataFrame:
    """lang, size, phrase, f of all phrases of up to sizes words that occur least times; size 0 has the words of a language."""
    rows = docs.select("text", F.coalesce(F.col("lang"), F.lit("und")).alias("lang"))
    rows = rows.select(ascii_lower(F.col("text")).alias("text"), "lang")

    def round_(lo: int, hi: int, held=None) -> DataFrame:
        grams = rows.mapInArrow(_grams(lo, hi, held), GRAM)
        return written(grams.groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f")).where((F.col("size") == 0) | (F.col("f") >= least)), "phrases")

    found = [round_(1, 1)]
    for lo, hi in ((2, 2), (3, sizes)):
        known = found[-1].where("size > 0")
        if hi >= lo and hi <= sizes and known.limit(1).count():
            found.append(round_(lo, hi, sieve(known)))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (left * right)) of counts of up to 19 digits; at most 10 n, so it fits 64 bits."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide(a) * wide(n), wide(left) * wide(right))


def collocations(docs: DataFrame, sizes: int = SIZES, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score of each language's first phrases. docs: text, lang."""
    with scratch(docs.sparkSession):
        all_ = counts(docs, sizes, least)
        totals = all_.where("size = 0").select("lang", F.col("f").alias("n"))
        f = all_.where("size > 0")
        words = F.split("phrase", " ")
        part = lambda a, n: F.array_join(F.slice(words, a, n), " ")
        candidates = f.where("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"))
        cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
        cuts = cuts.select("*", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
        side = lambda name, count: small(f.select("lang", F.col("phrase").alias(name), F.col("f").alias(count)))
        scored = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"]).join(small(totals), "lang")
        scored = scored.withColumn("score", _score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
        lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("s"))
        longer = candidates.where("size > 2").select("lang", "a", F.explode(F.array(part(F.lit(1), F.col("size") - 1), part(F.lit(2), F.col("size") - 1))).alias("phrase"))
        longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
        alone = lowest.join(longer, (lowest["lang"] == longer["lang"]) & (lowest["phrase"] == longer["phrase"]) & (100 * longer["most"] >= share * lowest["a"]), "left_anti")
        order = (F.desc("s.score"), F.desc("a"), F.asc("phrase"))
        # The first of a language are among the first of each bucket, so the last window sees BUCKETS * top rows of it at most.
        bucket = F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS))
        few = alone.withColumn("place", F.row_number().over(Window.partitionBy("lang", bucket).orderBy(*order))).where(F.col("place") <= top)
        best = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
        return written(best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "s.l", "s.r", "n", "s.score"), "collocations", keep=True)


by_value(__name__)
