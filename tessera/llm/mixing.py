"""Mixing sources to target weights by Poisson replication.

A source's rate is its target share of the output divided by its share of the input (in characters). Each
document is repeated a number of times that is Poisson distributed with that mean: a hash of (seed, doc_id, text) gives a
number u in [0, 1), and the count is the smallest k with u below the distribution function at k. Rates above STEP are
a sum of independent draws of at most STEP each, which keeps exp(-rate) exact enough at any rate. The expected output
has as many characters as the input; counts do not depend on the partitioning, so a lost task gives the same rows
again. The output is shuffled globally: dealt out and sorted by a hash of (seed, doc_id, text, copy).

Defined results: a null source is a source of its own; a source without a target weight gets the square root of its
size (sampling with temperature 2) among those without one; weight 0 drops a source; null or empty text counts one
character, so that such a source has a size; repeated rows draw the same count each; an empty table gives an empty
table; further columns stay, but for columns named copy or shuffle_key, in whose place come the new ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

STEP = 16.0
#: Terms of the distribution function for a mean of STEP: beyond these the rest is under 2 ** -52.
TERMS = 80


def uniform(*values: Column) -> Column:
    """A number in [0, 1) from 52 bits of a hash of the values."""
    text = F.concat_ws("|", *[F.coalesce(v.cast("string"), F.lit("~")) for v in values])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def rates(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """source, chars, rate: mean copies of a document of the source."""
    sizes = docs.groupBy("source").agg(F.sum(F.greatest(F.coalesce(F.char_length("text"), F.lit(1)), F.lit(1)).cast("long")).alias("chars"))
    own = F.lit(None).cast("double")
    for name, weight in (weights or {}).items():
        own = F.when(F.col("source").eqNullSafe(name), float(weight)).otherwise(own)
    sizes = sizes.withColumn("own", own).withColumn("root", F.round(F.sqrt("chars") * 1000).cast("long"))
    total = sizes.agg(F.sum("chars").alias("all_chars"), F.coalesce(F.sum("own"), F.lit(0.0)).alias("all_own"), F.coalesce(F.sum(F.when(F.col("own").isNull(), F.col("root"))), F.lit(0)).alias("all_root"))
    # Given weights are shares of the output; the rest is shared by the sources without one.
    share = F.when(F.col("own").isNotNull(), F.col("own") / F.greatest(F.col("all_own"), F.lit(1.0))).otherwise(F.greatest(1 - F.col("all_own"), F.lit(0.0)) * F.col("root") / F.col("all_root"))
    return sizes.join(total, F.lit(True)).select("source", "chars", (share * F.col("all_chars") / F.col("chars")).alias("rate"))


def _distribution(mean: Column) -> Column:
    """P(count <= k) for k from 0."""
    zero = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("upto"))
    step = lambda acc, k: F.struct((acc["p"] * mean / k).alias("p"), F.array_append(acc["upto"], F.element_at(acc["upto"], -1) + acc["p"] * mean / k).alias("upto"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), zero, step, lambda acc: acc["upto"])


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, seed: int = 0) -> DataFrame:
    """The documents' columns, copy (from 0) and shuffle_key, in shuffled order."""
    rate = rates(docs, weights)
    draws = F.greatest(F.ceil(F.col("rate") / STEP), F.lit(1)).cast("int")
    table = written(rate.select(F.col("source").alias("__source"), draws.alias("__draws"), _distribution(F.col("rate") / draws).alias("__upto")), "rates")
    names = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    rows = docs.select(F.struct(*names).alias("d")).join(table, F.col("d.source").eqNullSafe(F.col("__source")))
    digest = F.md5(F.coalesce(F.col("d.text"), F.lit("")))
    drawn = rows.select("d", "__draws", "__upto", digest.alias("__digest"))
    count = lambda j: F.size(F.filter("__upto", lambda c: c <= uniform(F.lit(seed), F.col("d.doc_id"), F.col("__digest"), j)))
    one = F.size(F.filter("__upto", lambda c: c <= F.col("__u")))
    several = F.aggregate(F.sequence(F.lit(2), F.col("__draws")), F.lit(0), lambda acc, j: acc + count(j))
    u = drawn.withColumn("__u", uniform(F.lit(seed), F.col("d.doc_id"), F.col("__digest"), F.lit(1)))
    n = one + F.when(F.col("__draws") > 1, several).otherwise(0)
    copies = u.select("d", "__digest", n.alias("__n")).where("__n > 0").select("d", "__digest", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("copy"))
    keyed = copies.select("d.*", "copy", F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("d.doc_id").cast("string"), F.lit("~")), "__digest", "copy")).alias("shuffle_key"))
    return keyed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
