"""Model calls: retries, outcomes, a cache; each request answered once; translation in the cascade and of seeds."""

import re
import time

import pytest
from pyspark.sql import functions as F

from tessera import storage
from tessera.operators import coverage
from tessera.plans import loops, providers, refusals
from tessera.plans.providers import CallError, CallProvider, FunctionProvider, Policy
from tessera.sources import versions
from tessera.streaming import streams


def asked(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    return providers.requests(rows, "r", "m", providers.chat(None, F.col("t")))


def counting(path, answer):
    """A function that notes each chat it gets in a file of its own."""

    def fn(chats):
        import os
        import uuid

        for c in chats:
            with open(os.path.join(path, uuid.uuid4().hex), "w") as f:
                f.write(c[-1]["content"])
        return [answer(c[-1]["content"]) for c in chats]

    return fn


def test_outcomes_of_calls(spark):
    def make():
        tries = {}

        def call(messages, model, temperature):
            text = messages[-1]["content"]
            tries[text] = tries.get(text, 0) + 1
            if text == "flaky" and tries[text] < 3:
                raise CallError(429)
            if text == "broken":
                raise ConnectionError("reset")
            if text == "blocked":
                raise CallError(403, "policy")
            if text in ("400", "404"):
                raise CallError(int(text))
            return "" if text == "mute" else text.upper()

        return call

    fast = Policy(partitions=1, retries=2, pause=0.0)
    rows = asked(spark, ["ok", "ok", "flaky", "broken", "blocked", "404", "mute", " "])
    found = {r["t"]: (r["outcome"], r["status"], r["attempts"], r["text"]) for r in rows.join(CallProvider(make(), fast).outcomes(rows), "request_id").collect()}
    assert found == {
        "ok": ("answered", 200, 1, "OK"),
        "flaky": ("answered", 200, 3, "FLAKY"),
        "broken": ("exhausted", None, 3, ""),
        "blocked": ("moderated", 403, 1, ""),
        "404": ("refused", 404, 1, ""),
        "mute": ("empty", 200, 1, ""),
    }
    with pytest.raises(ValueError, match="404 to 1"):
        CallProvider(make(), fast).answer(rows)
    answers = {r["t"]: r["text"] for r in CallProvider(make(), fast).answer(asked(spark, ["ok", "blocked", " "])).collect()}
    assert answers == {"ok": "OK", "blocked": "[MODERATION_BLOCKED]: policy", " ": ""}


def test_rate_and_cache(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    note = counting(str(calls), str.upper)
    provider = CallProvider(lambda messages, model, temperature: note([messages])[0], Policy(partitions=2, rate=20.0), cache=f"file://{tmp_path}/cache")
    began = time.time()
    assert provider.answer(asked(spark, [f"t{i}" for i in range(12)])).where("text = upper(t)").count() == 12
    assert time.time() - began >= 5 / 10  # six calls in each partition, ten a second
    assert provider.answer(asked(spark, [f"t{i}" for i in range(14)])).where("text = upper(t)").count() == 14
    assert len(list(calls.iterdir())) == 14


def test_each_generation_is_extracted_once(spark, tmp_path):
    def answer(text):
        return '["a topic", "one more topic of several words", "中文 topic"]' if text.startswith("List the topics") else "short answer"

    generations = spark.createDataFrame([(i, -1, f"generation {i}") for i in range(4)], "gen_id long, parent_id long, text string")
    rows = loops.formatted(generations, FunctionProvider(counting(str(tmp_path), answer)))
    storage.round_table(rows, "formatted")
    sent = [p.read_text() for p in tmp_path.iterdir()]
    assert len([t for t in sent if t.startswith("List the topics")]) == 4
    assert len(sent) == len(set(sent))


def test_the_judge_sees_each_open_row_once_and_in_english(spark, tmp_path):
    rows = [(1, "q", "I'm sorry, but I cannot do that"), (2, "q", "拒绝了"), (3, "q", "plain text"), (4, None, "fine text"), (5, "q", None), (6, "q", "fine text too")]
    answers = spark.createDataFrame(rows, "id long, query string, answer string")
    (tmp_path / "j").mkdir()
    (tmp_path / "t").mkdir()
    translator = FunctionProvider(counting(str(tmp_path / "t"), lambda t: "declined outright"))
    judge = FunctionProvider(counting(str(tmp_path / "j"), lambda t: "yes" if "plain" in t else "no"))

    def classify(df):
        score = F.when(F.rlike("text", F.lit("declined|fine")), 0.999).otherwise(0.4)
        return df.select("id", F.when(F.contains("text", F.lit("declined")), "rejection").otherwise("normal").alias("label"), score.alias("score"))

    got = {r["id"]: (r["is_refusal"], r["stage"]) for r in refusals.checked(answers, translator, classify, judge).collect()}
    assert got == {1: (True, "pattern"), 2: (True, "classifier"), 3: (True, "judge"), 4: (False, "classifier"), 5: (False, "pattern"), 6: (False, "judge")}
    assert len(list((tmp_path / "t").iterdir())) == 1
    sent = sorted(p.read_text() for p in (tmp_path / "j").iterdir())
    assert len(sent) == 2 and "plain text" in sent[1] + sent[0]
    # Without classifier and translator the judge gets all that the patterns leave.
    assert {r["id"] for r in refusals.checked(answers, None, None, judge).where("stage = 'judge'").collect()} == {2, 3, 4, 6}


def test_seeds_are_translated(spark):
    class Rule(providers.Provider):
        def answer(self, requests):
            return requests.withColumn("text", F.lit(" translated seed "))

    got = [(r["raw"], r["english"], r["is_chinese"]) for r in loops.translated_seeds(spark.createDataFrame([("plain",), ("中文",)], "topic string"), Rule()).orderBy("id").collect()]
    assert got == [("plain", "plain", False), ("中文", "translated seed", True)]


def test_rounds_leave_nothing_but_what_they_return(spark):
    import os

    folder = storage.shared_dir(spark).removeprefix("file://")
    there = lambda: {p.partition("-")[0] for p in os.listdir(folder)} & {"gone", "kept"}
    with storage.scratch(spark):
        storage.round_table(spark.range(3), "gone")
        kept = storage.round_table(spark.range(4), "kept", keep=True)
        assert there() == {"gone", "kept"}
    assert kept.count() == 4 and there() == {"kept"}


def test_a_version_appears_whole_or_not_at_all(spark, tmp_path):
    path = f"file://{tmp_path}/runs"
    assert versions.current(spark, path) is None
    versions.publish(spark, path, {"a": spark.range(3), "b": spark.range(4)}, {"run": 1})
    bad = spark.range(2).select(F.raise_error(F.lit("lost")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        versions.publish(spark, path, {"a": spark.range(30), "b": bad})
    found = versions.current(spark, path)
    assert (found.number, found.read(spark, "a").count(), found.read(spark, "b").count(), found.meta) == (1, 3, 4, {"run": 1})
    for n in (5, 6):
        versions.publish(spark, path, {"a": spark.range(n).where("id < 0")})
    assert versions.current(spark, path).read(spark, "a").count() == 0  # an empty table has its schema
    assert versions.current(spark, path, 1).tables["b"]["rows"] == 4
    assert versions.retire(spark, path, keep=1) == [1, 2] and versions.current(spark, path, 1) is None and versions.current(spark, path).number == 3


def test_heads_over_micro_batches_have_the_batch_operators_numbers(spark, tmp_path):
    src, out, marks = (f"{tmp_path}/{x}" for x in ("src", "out", "marks"))
    rows = [(i, t) for i, t in enumerate(["One!", "two", "one", "", "three", "TWO", "four", "one?", "", "five"])]
    for part in (rows[:4], rows[4:7], rows[7:]):
        spark.createDataFrame(part, "pos long, topic string").coalesce(1).write.mode("append").parquet(src)
        streams.numbered_heads(spark.readStream.schema("pos long, topic string").parquet(src), "topic", "pos", out, marks).awaitTermination()
    got = {r["key"]: (r["pos"], r["cluster_idx"]) for r in spark.read.parquet(out).collect()}
    assert got == {"one": (0, 0), "two": (1, 1), "three": (4, 2), "four": (6, 3), "five": (9, 4)}


def test_texts_found_by_their_grams(spark):
    topics = ["alpha beta", "gamma", "be", "x alpha", None, "äöü beta"]
    needles = ["alpha", "beta", "be", "b", "", "zeta", "äöü b", "amma", None, "alpha beta gamma"]
    truth = spark.createDataFrame([("c", n) for n in needles], "category string, subtopic string")
    crawl = spark.createDataFrame([(t, 10 - i) for i, t in enumerate(topics)], "topic string, pos long")
    got = {r["subtopic"]: r["matched_topic"] for r in coverage.contained_text(truth, crawl, F.col("subtopic"), F.col("topic")).collect()}
    order = [t for t in reversed(topics) if t is not None]
    assert got == {n: next((t for t in order if n is not None and n in t), None) for n in needles}
    plan = coverage.contained_text(truth, crawl, F.col("subtopic"), F.col("topic"))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    empty = coverage.contained_text(truth, crawl.limit(0), F.col("subtopic"), F.col("topic"))
    assert empty.where("matched_topic is not null").count() == 0 and empty.count() == len(needles)


def test_a_list_of_texts_is_never_broadcast(spark, monkeypatch):
    from tessera import storage

    plans, write = [], storage.round_table
    planned = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    monkeypatch.setattr(storage, "round_table", lambda df, *more, **named: write(planned(df), *more, **named))
    truth = spark.createDataFrame([("c", "alpha"), ("c", "nothing")], "category string, subtopic string")
    crawl = spark.range(3000).select(F.concat(F.lit("some alpha text "), F.col("id").cast("string")).alias("topic"), F.col("id").alias("pos"))
    for most in (storage.BROADCAST if hasattr(storage, "BROADCAST") else 0, 0):
        monkeypatch.setattr(storage, "BROADCAST", most, raising=False)
        found = planned(coverage.contained_text(truth, crawl, F.col("subtopic"), F.col("topic")))
        assert {(r["subtopic"], r["matched_topic"]) for r in found.collect()} == {("alpha", "some alpha text 0"), ("nothing", None)}
    for plan in plans:
        lines = plan.splitlines()
        depth = [re.search("[A-Za-z]", x).start() if re.search("[A-Za-z]", x) else 0 for x in lines]
        for i in (i for i, x in enumerate(lines) if "BroadcastExchange" in x):
            below = next((k for k in range(i + 1, len(lines)) if depth[k] <= depth[i]), len(lines))
            assert not any("Generate" in x for x in lines[i:below])
