"""Model calls as relations: requests (role, model, messages, temperature, sample_idx) in, request_id and text out."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sentinel
from ..shipping import by_value
from ..storage import exists, round_table

SEPARATOR = "\x01"


def with_request_id(requests: DataFrame) -> DataFrame:
    """requests with request_id, a hash of all that determines the answer."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "model")]
    return requests.withColumn("request_id", F.md5(F.concat_ws(SEPARATOR, *parts, F.to_json("messages"), F.col("temperature").cast("string"), F.col("sample_idx").cast("string"))))


def blank(messages: Column) -> Column:
    """No message, or one without text: such a request is answered with an empty text and not sent."""
    return (F.size(messages) <= 0) | F.exists(messages, lambda m: F.trim(F.coalesce(m["content"], F.lit(""))) == "")


class Provider:
    def answer(self, requests: DataFrame) -> DataFrame:
        """requests with text."""
        raise NotImplementedError


class ResponseTable(Provider):
    """Answers from a table (request_id, text, status); no row gives an empty text.

    Status 403 with a moderation reason gives the sentinel text; 400, 401, 403 and 404 without one are errors; others are empty.
    """

    def __init__(self, responses: DataFrame):
        self.responses = responses

    def answer(self, requests: DataFrame) -> DataFrame:
        columns = [c for c in ("text", "status", "reason") if c in self.responses.columns]
        rows = requests.join(self.responses.select("request_id", *columns), "request_id", "left")
        if "status" not in columns:
            return rows.withColumn("text", F.coalesce("text", F.lit("")))
        reason = F.col("reason") if "reason" in columns else F.lit(None).cast("string")
        failed = F.raise_error(F.concat(F.lit("the provider answered "), F.col("status").cast("string")))
        text = (
            F.when(F.col("status").isNull() | (F.col("status") == 200), F.coalesce("text", F.lit("")))
            .when((F.col("status") == 403) & reason.isNotNull(), sentinel(reason))
            .when(F.col("status").isin(400, 401, 403, 404), failed.cast("string"))
            .otherwise("")
        )
        return rows.withColumn("text", text).drop("status", "reason")


class HashStub(Provider):
    """A fixed choice among texts by the request's hash: deterministic, the same in SQL."""

    def __init__(self, *texts: str):
        self.texts = texts

    def answer(self, requests: DataFrame) -> DataFrame:
        pick = F.conv(F.substring("request_id", 1, 8), 16, 10).cast("long") % len(self.texts)
        return requests.withColumn("text", F.element_at(F.array(*[F.lit(t) for t in self.texts]), pick.cast("int") + 1))


class FunctionProvider(Provider):
    """A function from a list of chats to a list of texts, called once for each Arrow batch.

    Answers are written before they are joined to their requests, so each request is answered once, however often the plan
    above reads it.
    """

    def __init__(self, fn: Callable[[list[list[dict]]], list[str]], partitions: int | None = None):
        self.fn, self.partitions = fn, partitions

    def answer(self, requests: DataFrame) -> DataFrame:
        fn = self.fn

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                chats = [[{k: m[k] for k in ("role", "content")} for m in chat] for chat in pdf["messages"]]
                yield pdf[["request_id"]].assign(text=fn(chats))

        sent = requests.where(~blank(F.col("messages"))).select("request_id", "messages").dropDuplicates(["request_id"])
        sent = sent.repartition(self.partitions) if self.partitions else sent
        answers = round_table(sent.mapInPandas(run, "request_id string, text string"), "answers")
        return requests.join(answers, "request_id", "left").withColumn("text", F.coalesce("text", F.lit("")))


class CallError(Exception):
    """A call that was answered with a status other than 200; reason: why a moderator withheld the answer."""

    def __init__(self, status: int, reason: str | None = None):
        super().__init__(f"status {status}")
        self.status, self.reason = status, reason


# Statuses that are no use to try again, and those that are.
FATAL, AGAIN = (400, 401, 403, 404), (408, 409, 429)
OUTCOMES = "request_id string, text string, outcome string, status int, reason string, attempts int"


@dataclass
class Policy:
    """How calls are made: requests in flight in a partition, calls a second of all partitions together (None: no limit), further
    attempts after a failure that may pass, and the pause before the first of them in seconds, which doubles up to the longest."""

    partitions: int = 8
    concurrency: int = 4
    rate: float | None = None
    retries: int = 4
    pause: float = 0.5
    longest: float = 8.0


class CallProvider(Provider):
    """call(messages, model, temperature) gives a text, or raises CallError, for each request; called in the workers.

    Each distinct request is called by one task, in threads, and called again after what may pass: statuses 408, 409, 429 and from
    500 on, and any other exception. Its outcome is a column: `answered`; `empty` (no text); `moderated` (403 with a reason; the text
    is the sentinel that names it); `refused` (400, 401, 403 and 404, which answer() raises); `exhausted` (the attempts came to
    an end; the text is empty). Outcomes are written before anyone reads them. With cache, a path, they are kept there, and a request that
    it holds with an outcome that is final is not sent again, in this run or a later one. A task that is lost is run
    again with its requests: calls are made at least once then, and answered once.
    """

    def __init__(self, call: Callable[[list[dict], str, float], str], policy: Policy | None = None, cache: str | None = None):
        self.call, self.policy, self.cache = call, policy or Policy(), cache

    def outcomes(self, requests: DataFrame) -> DataFrame:
        """request_id, text, outcome, status, reason, attempts of each distinct request that is not blank."""
        spark = requests.sparkSession
        wanted = requests.where(~blank(F.col("messages"))).dropDuplicates(["request_id"]).select("request_id", "messages", "model", "temperature")
        known = spark.read.schema(OUTCOMES).parquet(self.cache) if self.cache and exists(spark, self.cache) else None
        if known is not None:
            # Of the outcomes of several runs the last final one.
            known = known.where("outcome <> 'exhausted'").groupBy("request_id").agg(F.max_by(F.struct("text", "outcome", "status", "reason", "attempts"), "attempts").alias("o")).select("request_id", "o.*")
            wanted = round_table(wanted, "requests")
            known = round_table(known.join(wanted.select("request_id"), "request_id", "left_semi"), "known")
            wanted = wanted.join(known.select("request_id"), "request_id", "left_anti")
        fresh = round_table(wanted.repartition(self.policy.partitions).mapInPandas(_called(self.call, self.policy), OUTCOMES), "answers")
        if self.cache:
            fresh.write.mode("append").parquet(self.cache)
        return fresh if known is None else fresh.unionByName(known)

    def answer(self, requests: DataFrame) -> DataFrame:
        found = self.outcomes(requests)
        bad = found.where("outcome = 'refused'").groupBy("status").agg(F.count("*").alias("n")).orderBy("status").collect()
        if bad:
            raise ValueError("the provider answered " + ", ".join(f"{r['status']} to {r['n']} requests" for r in bad))
        text = F.when(F.col("outcome") == "moderated", sentinel(F.col("reason"))).otherwise(F.col("text"))
        return requests.join(found.select("request_id", text.alias("text")), "request_id", "left").withColumn("text", F.coalesce("text", F.lit("")))


def _called(call, policy: Policy):
    def outcome(messages, model, temperature, turn) -> tuple:
        import random
        import time

        status = None
        for attempt in range(1, policy.retries + 2):
            turn()
            try:
                text = call([{k: m[k] for k in ("role", "content")} for m in messages], model, temperature)
                return text or "", "answered" if text else "empty", 200, None, attempt
            except Exception as e:  # any failure of a remote call, of any client's classes
                status, reason = getattr(e, "status", None), getattr(e, "reason", None)
                if status == 403 and reason is not None:
                    return "", "moderated", 403, str(reason), attempt
                if status in FATAL:
                    return "", "refused", status, None, attempt
                if status is not None and status not in AGAIN and status < 500:
                    return "", "exhausted", status, None, attempt
            if attempt <= policy.retries:
                time.sleep(min(policy.pause * 2 ** (attempt - 1), policy.longest) * (0.5 + random.random() / 2))
        return "", "exhausted", status, None, policy.retries + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import threading
        import time
        from concurrent.futures import ThreadPoolExecutor

        # A partition has its share of the rate: calls begin no closer than its gap.
        gap, lock, free = (policy.partitions / policy.rate if policy.rate else 0.0), threading.Lock(), [0.0]

        def turn() -> None:
            with lock:
                at = max(time.monotonic(), free[0])
                free[0] = at + gap
            time.sleep(max(at - time.monotonic(), 0.0))

        with ThreadPoolExecutor(policy.concurrency) as pool:
            for pdf in batches:
                rows = list(pool.map(lambda r: outcome(*r, turn), zip(pdf["messages"], pdf["model"], pdf["temperature"])))
                found = pd.DataFrame(rows, columns=["text", "outcome", "status", "reason", "attempts"]).astype({"status": "Int32", "attempts": "int32"})
                yield pd.concat([pdf[["request_id"]].reset_index(drop=True), found], axis=1)

    return run


def classified(rows: DataFrame, text: str, load: Callable[[], Callable[[list[str]], list[tuple[str, float]]]]) -> DataFrame:
    """id, label, score of rows (id, text) by a classifier on the workers: load() gives it, once for each Python worker's task,
    and it takes a batch of texts. A null text is not classified (null label and score)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classify = load()
        for pdf in batches:
            known = pdf["text"].notna()
            found = iter(classify(pdf.loc[known, "text"].tolist()))
            both = [next(found) if k else (None, None) for k in known]
            yield pd.DataFrame({"id": pdf["id"], "label": [b[0] for b in both], "score": [b[1] for b in both]})

    return rows.select("id", F.col(text).alias("text")).mapInPandas(run, f"id {rows.schema['id'].dataType.simpleString()}, label string, score double")


def chat(system: Column | None, user: Column) -> Column:
    """messages of an optional system text and a user text."""
    # Names given as literals: an alias is lost where the text holds a lambda.
    message = lambda role, text: F.named_struct(F.lit("role"), F.lit(role), F.lit("content"), text)
    return F.array(*([message("system", system)] if system is not None else []), message("user", user))


def requests(rows: DataFrame, role: str, model: str, messages: Column, temperature: float = 0.0, samples: int = 1) -> DataFrame:
    """rows with the request columns, one row for each sample."""
    out = rows.withColumns({"role": F.lit(role), "model": F.lit(model), "messages": messages, "temperature": F.lit(temperature), "sample_idx": F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))})
    return with_request_id(out)


by_value(__name__)
