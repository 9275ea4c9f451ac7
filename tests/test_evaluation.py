import pytest
from pyspark.sql import functions as F

from tessera.operators import ranking
from tessera.plans import config, evaluation, loops, providers


class Rule(providers.Provider):
    def __init__(self, text):
        self.text = text

    def answer(self, requests):
        return requests.withColumn("text", self.text)


def test_settings_and_sweep(spark):
    runs = config.sweep(config.Settings(), {"crawl.steps": ["3", 4], "model.temperature": [0, 1]})
    assert [(r.crawl.steps, r.model.temperature) for r in runs] == [(3, 0.0), (3, 1.0), (4, 0.0), (4, 1.0)]
    assert config.run_table(spark, {"a": runs[0]}).count() == 1
    with pytest.raises(AttributeError):
        config.Settings().with_values(crawl__none=1)


def test_matches_over_chunks(spark):
    truth = spark.createDataFrame([("g1",), ("g2",)], "gt string")
    topics = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "topic string, pos long")
    answer = F.when(F.col("gt") == "g1", F.concat(F.lit("\\topic{"), F.col("items")[0], F.lit("}\\boxed{y}"))).otherwise("\\boxed{n}")
    got = {r["gt"]: (r["flag"], sorted(r["matched"])) for r in evaluation.judged_matches(truth, topics, Rule(answer), size=2).collect()}
    assert got == {"g1": (True, ["a", "c"]), "g2": (False, [])}


def test_terms_resolve_to_the_reference(spark):
    terms = spark.createDataFrame([(1, "x"), (2, "y")], "id long, term string")
    reference = spark.createDataFrame([("Apple", 0), ("apple", 1)], "term string, pos long")
    answer = F.when(F.col("id") == 1, '{"match": true, "matched_term": " APPLE "}').otherwise('{"match": false}')
    got = {r["id"]: (r["match"], r["resolved"]) for r in evaluation.judged_terms(terms, reference, Rule(answer)).collect()}
    assert got == {1: (True, "Apple"), 2: (False, None)}


def test_ranking_experiment_orders_by_strength(spark):
    topics = spark.createDataFrame([(f"t{i}", i) for i in range(4)], "topic string, pos long")
    answer = F.when(F.col("a") > F.col("b"), "\\boxed{A}").otherwise("\\boxed{b}")
    got = evaluation.ranking_experiment(topics, Rule(answer), "elo", ranking.Elo, comparisons=120, batch=60).where("snapshot = 1").orderBy("rank").collect()
    assert [r["topic"] for r in got] == ["t3", "t2", "t1", "t0"]
    assert evaluation.ranking_experiment(topics.limit(1), Rule(answer), "elo", ranking.Elo, comparisons=5, batch=1).count() == 1


def test_queries_and_recall(spark):
    clusters = spark.createDataFrame([("c",)], "cluster string")
    got = evaluation.generated_queries(clusters, Rule(F.lit("1. first long query\n2. second long query")), n=1)
    assert [(r["cluster"], r["query"]) for r in got.collect()] == [("c", "first long query")]
    pool = spark.createDataFrame([("a",), ("b",), ("c",)], "topic string")
    bench = spark.createDataFrame([("b", "pb"), ("c", "pc"), ("a", "pa")], "topic string, prompt string")
    answer = F.when(F.col("topic") == "b", "I'm sorry, but I cannot").otherwise("yes")
    r = evaluation.pool_recall_of(pool, pool.limit(1), bench, Rule(answer), model="m", times=2).head()
    assert (r["n_pool"], r["n_discovered"], r["n_refused"]) == (3, 1, 1)


def test_clusters_over_batches_and_files(spark):
    topics = spark.createDataFrame([(f"t{i}", i) for i in range(4)], "topic string, pos long")
    one = Rule(F.when(F.size("items") > 1, '{"all": [1, 2]}').otherwise('{"all": [1]}'))
    assert {r["cluster"] for r in evaluation.clustered_in_batches(topics, one, size=2).collect()} == {"all"}
    heads = {r["topic"]: r["head"] for r in evaluation.merged_heads(topics, Rule(F.lit('{"x": [1, 2, 3]}')), size=2).collect()}
    assert heads == {f"t{i}": "t0" for i in range(4)}


class Echo(providers.Provider):
    """Topics and probes that depend on the request alone."""

    def answer(self, requests):
        text = F.when(F.col("role") == "extract", F.to_json(F.array(F.concat(F.lit("topic "), F.substring("request_id", 1, 6)), F.lit("common theme"))))
        return requests.withColumn("text", text.when(F.col("role") == "probe", F.when(F.substring("request_id", 1, 1) < "8", "I cannot help you with that").otherwise("Sure")).otherwise(F.concat(F.lit("about "), "request_id")))


def test_a_crawl_goes_on_where_it_stopped(spark, tmp_path):
    seeds = spark.createDataFrame([("first seed",), ("other seed",)], "topic string")
    templates = spark.createDataFrame([("Say {}", 0, "en"), ("Tell {}", 1, "en"), ("Sag {}", 2, "de")], "item string, pos long, lang string")
    run = lambda steps, path: loops.crawl(spark, seeds, templates, Echo(), steps=steps, batch=2, warmup=1, max_topics=100, state_path=path)[0]
    key = lambda df: sorted(map(str, df.collect()))
    whole = key(run(2, None))
    run(1, f"file://{tmp_path}/state")
    assert loops.resumed(spark, f"file://{tmp_path}/none") is None
    assert key(run(2, f"file://{tmp_path}/state")) == whole
    assert key(run(2, f"file://{tmp_path}/state")) == whole  # nothing is left to do


def test_clusters_of_any_number_of_rounds(spark):
    """A clusterer that merges the first pair of a round alone: 22 rounds."""
    n = 23
    topics = spark.createDataFrame([(f"t{i:02d}", i) for i in range(n)], "topic string, pos long")
    got = loops.cluster_recursively(topics, Rule(F.when(F.col("chunk") == 0, '{"a": [1, 2]}').otherwise('{"a": [1], "b": [2]}')), size=2)
    assert got.count() == n and got.select("head").distinct().count() == 1


def test_a_judge_that_sees_the_reference_in_chunks(spark):
    terms = spark.createDataFrame([(1, "x"), (2, "y")], "id long, term string")
    reference = spark.createDataFrame([(f"r{i}", i) for i in range(5)], "term string, pos long")
    answer = F.when((F.col("id") == 1) & F.array_contains("items", "r3"), '{"match": true, "matched_term": "R3"}').otherwise('{"match": false}')
    got = {r["id"]: (r["match"], r["resolved"]) for r in evaluation.judged_terms(terms, reference, Rule(answer), size=2).collect()}
    assert got == {1: (True, "r3"), 2: (False, None)}


def test_endpoints_and_keys():
    assert config.endpoint("openai:m:x", {"OPENAI_API_KEY": "k"}) == {"model": "m:x", "url": "https://api.openai.com/v1", "key": "k"}
    for model, default in (("m", "openrouter"), ("m", "unknown")):
        with pytest.raises(ValueError):
            config.endpoint(model, {}, default=default)
    assert config.missing_keys(["local", "ollama:m", "gemini:m"], {}) == {"gemini": "GEMINI_API_KEY"}
