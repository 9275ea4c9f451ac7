"""The refusal cascade with its models: patterns, translation, classifier, judge; each model sees only what is open before it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import REFUSAL_PATTERNS, cleaned, has_han, refusal_fast
from ..operators.refusal import SURE, cascade
from ..storage import round_table
from .loops import translated
from .providers import Provider, chat, requests

#: Neutral text; a project supplies its own.
JUDGE_PROMPT = "Does this answer decline the request? Answer yes or no.\nRequest: {q}\nAnswer: {a}"


def checked(answers: DataFrame, translator: Provider | None, classify: Callable[[DataFrame], DataFrame] | None, judge: Provider, sure: float = SURE, patterns=REFUSAL_PATTERNS, model: str = "judge") -> DataFrame:
    """id, is_refusal, stage of answers (id, query, answer).

    Rows that a known opening settles go no further. Of the others those with Han letters are translated, since the classifier
    reads English (a blank translation leaves them as they are); classify gives id, label, score of rows (id, text); and what is not
    sure after it, or is sure to be normal but has a request to hold it against, goes to the judge, each row once. Every
    model's answers are written before they are read.
    """
    first = answers.select("id", "query", "answer", refusal_fast(F.col("answer"), patterns).alias("fast"))
    open_ = round_table(first.where("fast is null").select("id", "query", cleaned(F.col("answer")).alias("text_in"), "answer"), "open")
    english = open_.withColumn("text_of", F.col("text_in")).drop("text_in")
    if translator:
        han = has_han(F.col("text_in"))
        chinese = translated(open_.where(han), translator, "text_in", "text_of", "English").drop("text_in")
        english = open_.where(~F.coalesce(han, F.lit(False))).withColumn("text_of", F.col("text_in")).drop("text_in").unionByName(chinese)
        english = round_table(english, "english")
    none = english.select("id", F.lit(None).cast("string").alias("label"), F.lit(None).cast("double").alias("score")).limit(0)
    found = round_table(classify(english.select("id", F.col("text_of").alias("text"))), "classes") if classify else none
    known = english.join(found, "id", "left")
    rejected = F.coalesce((F.col("score") >= sure) & (F.col("label") == "rejection"), F.lit(False))
    normal = F.coalesce((F.col("score") >= sure) & (F.col("label") == "normal"), F.lit(False)) & (F.coalesce("query", F.lit("")) == "")
    unsure = known.where(~(rejected | normal)).select("id", "query", "text_of")
    prompt = F.replace(F.replace(F.lit(JUDGE_PROMPT), F.lit("{q}"), F.coalesce("query", F.lit(""))), F.lit("{a}"), F.coalesce("text_of", F.lit("")))
    verdicts = round_table(judge.answer(requests(unsure, "judge", model, chat(None, prompt))).select("id", F.col("text").alias("verdict")), "verdicts")
    return cascade(answers, found, verdicts, sure, patterns)
