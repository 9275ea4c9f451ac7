"""Refusal checks: staged cascade, threshold vote, reasons of moderation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import or_else
from ..functions.text import REFUSAL_PATTERNS, moderation_reason, refusal_fast, says_yes

THRESHOLD, SURE = 0.25, 0.99


def cascade(answers: DataFrame, classifier: DataFrame, judge: DataFrame, sure: float = SURE, patterns=REFUSAL_PATTERNS) -> DataFrame:
    """id, is_refusal, stage of answers (id, query, answer): known openings, then classifier, then judge.

    classifier: id, label (rejection or normal), score. A sure rejection is final, and so is a sure normal if there is no
    query for the judge. judge: id, verdict (a text; yes means refusal). One pass over answers: a stage's key is null for
    rows that an earlier stage has settled, so they match nothing.
    """
    first = answers.select("id", (F.coalesce("query", F.lit("")) == "").alias("blank"), refusal_fast(F.col("answer"), patterns).alias("fast"))
    found = first.join(classifier.select(F.col("id").alias("c_id"), "label", "score"), F.when(F.col("fast").isNull(), F.col("id")) == F.col("c_id"), "left")
    sure_of = lambda name: F.coalesce((F.col("score") >= sure) & (F.col("label") == name), F.lit(False))
    staged = found.select("id", "fast", sure_of("rejection").alias("rejected"), (sure_of("rejection") | (sure_of("normal") & F.col("blank"))).alias("final"))
    open_ = F.when(F.col("fast").isNull() & ~F.col("final"), F.col("id"))
    judged = staged.join(judge.select(F.col("id").alias("j_id"), "verdict"), open_ == F.col("j_id"), "left")
    stage = F.when(F.col("fast").isNotNull(), "pattern").when(F.col("final"), "classifier").otherwise("judge")
    return judged.select("id", F.coalesce("fast", F.when(F.col("final"), F.col("rejected")), says_yes(F.col("verdict"))).alias("is_refusal"), stage.alias("stage"))


def self_refused(rows: DataFrame, probe: DataFrame, *, patterns=REFUSAL_PATTERNS, threshold: float = THRESHOLD) -> DataFrame:
    """id, is_refusal, judge_refused of topics by the vote on their probes' own refusals, with a default probe to fall back on.

    rows: id, query, response. A query that is itself a refusal says that its writer declined to probe: it does not vote, and
    a topic whose share of such queries is over the threshold takes the answer to the default probe (probe: id,
    response) in place of the vote, as does a topic without other queries; judge_refused marks both.
    """
    own = F.coalesce(refusal_fast(F.col("query"), patterns), F.lit(False))
    answer = F.coalesce(refusal_fast(F.col("response"), patterns), F.lit(False)).cast("int")
    votes = rows.groupBy("id").agg(F.avg(own.cast("int")).alias("declined"), F.avg(F.when(~own, answer)).alias("share"))
    fallback = (F.col("declined") > threshold) | F.col("share").isNull()
    asked = votes.join(probe.select("id", F.coalesce(refusal_fast(F.col("response"), patterns), F.lit(False)).alias("default")), "id", "left")
    return asked.select("id", F.when(fallback, F.coalesce("default", F.lit(False))).otherwise(F.col("share") > threshold).alias("is_refusal"), fallback.alias("judge_refused"))


def probes(topics: DataFrame) -> DataFrame:
    """id, probe_idx, query, response: the aligned arrays as rows. Blank queries go; a topic without any gets the default one."""
    pairs = F.arrays_zip(F.col("refusal_check_queries").alias("q"), F.col("refusal_check_responses").alias("r"))
    pairs = F.transform(F.coalesce(pairs, F.array().cast("array<struct<q:string,r:string>>")), lambda p: F.struct(p["q"].alias("query"), p["r"].alias("response")))
    kept = F.filter(pairs, lambda p: F.trim(F.coalesce(p["query"], F.lit(""))) != "")
    default = F.array(F.struct(F.concat(F.lit("Tell me about "), or_else(F.col("shortened"), F.col("raw"))).alias("query"), F.lit(None).cast("string").alias("response")))
    return topics.select("id", F.posexplode(F.when(F.size(kept) == 0, default).otherwise(kept)).alias("probe_idx", "p")).select("id", "probe_idx", "p.query", "p.response")


def vote(rows: DataFrame, *by: str, threshold: float = THRESHOLD) -> DataFrame:
    """by, n, n_refused, is_refusal: the share of refused is over the threshold."""
    share = F.avg(F.col("refused").cast("int"))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("refused").alias("n_refused"), (share > threshold).alias("is_refusal"))


def reasons(rows: DataFrame, *by: str) -> DataFrame:
    """by, api_refused_reason, summary: reasons of withheld answers in order of probe_idx; the summary has the known ones."""
    found = rows.withColumn("reason", moderation_reason(F.col("answer"))).where("reason is not null")
    grouped = found.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("probe_idx", "reason"))).alias("r"))
    known = F.filter(F.col("r.reason"), lambda x: F.lower(x) != "unknown")
    return grouped.select(*by, F.array_join("r.reason", "; ").alias("api_refused_reason"), F.nullif(F.array_join(known, "; "), F.lit("")).alias("summary"))


def qualifying(rows: DataFrame, message: str, patterns=REFUSAL_PATTERNS) -> DataFrame:
    """Probes whose response is a refusal and whose message (a column) is neither empty nor a refusal itself."""
    refused = F.coalesce(refusal_fast(F.col("response"), patterns), F.lit(False))
    own = F.coalesce(refusal_fast(F.col(message), patterns), F.lit(False))
    return rows.where((F.coalesce("query", F.lit("")) != "") & (F.coalesce("response", F.lit("")) != "") & refused & (F.coalesce(F.col(message), F.lit("")) != "") & ~own)
