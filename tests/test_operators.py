import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import coverage, curves, dedup, labels, lineage, ranking, refusal, sampling, stats
from tessera.plans import loops, providers


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_elo_and_trueskill_folds(spark):
    games = spark.createDataFrame([("r", 2, "b", "a"), ("r", 1, "a", "b")], "run string, seq long, winner string, loser string")
    names = spark.createDataFrame([("r", "a", 0), ("r", "b", 1), ("q", "c", 0)], "run string, topic string, pos int")
    got = {(r["run"], r["topic"]): r for r in ranking.folded(games, names, "elo", ranking.Elo).collect()}
    first = 16.0
    back = 32 * (1 - 1 / (1 + 10 ** ((1000 + first - (1000 - first)) / 400)))
    assert math.isclose(got["r", "a"]["rating"], 1000 + first - back) and math.isclose(got["r", "b"]["rating"], 1000 - first + back)
    assert got["q", "c"]["rating"] == 1000 and got["r", "b"]["rank"] == 1
    skill = ranking.folded(games, names, "trueskill", ranking.TrueSkill, every=1)
    assert {(r["snapshot"], r["topic"]): r["rank"] for r in skill.where("run = 'r'").collect()}[0, "a"] == 1
    assert all(r["sigma"] < 333.333 for r in skill.where("run = 'r' and snapshot = 1").collect())


def test_kendall_against_pairs(spark):
    a = {"x": 1, "y": 2, "z": 3, "w": 3}
    b = {"x": 2, "y": 1, "z": 3, "w": 4}
    table = lambda m: spark.createDataFrame(list(m.items()), "topic string, rank int")
    sign = lambda v: (v > 0) - (v < 0)
    pairs = [(sign(a[p] - a[q]), sign(b[p] - b[q])) for p in a for q in a if p < q]
    want = sum(x * y for x, y in pairs) / math.sqrt(sum(map(abs, (x for x, _ in pairs))) * sum(map(abs, (y for _, y in pairs))))
    assert math.isclose(ranking.kendall(table(a), table(b)).head()["tau"], want)


def test_dedup_first_in_batch_and_known(spark):
    heads = spark.createDataFrame([("A!", True, 4, 1), ("a", True, 7, 2)], "summary string, is_head boolean, cluster_idx int, id long")
    batch = spark.createDataFrame([(10, "A"), (11, "b"), (12, "B."), (13, None), (14, "")], "pos long, summary string")
    got = dedup.assigned_clusters(dedup.deduplicate(batch, dedup.known_heads(heads), F.col("summary")), 8)
    assert rows(got, "pos", "is_head", "cluster_idx") == [(10, False, 7), (11, True, 8), (12, False, 8), (13, True, 9), (14, True, 10)]
    coded = dedup.assigned_clusters(dedup.deduplicate(batch, dedup.known_heads(heads), F.col("summary")), 8, as_coded=True)
    assert {r["cluster_idx"] for r in coded.where("is_head").collect()} == {8}


def test_provenance_keeps_first_spelling(spark):
    t = spark.createDataFrame([(" Ab ", "r1", 2), ("aB", "r2", 1), ("  ", "r1", 0)], "topic string, run string, pos int")
    assert [tuple(r) for r in dedup.with_provenance(t).collect()] == [("ab", "aB", 2, ["r1", "r2"], 1)]


def test_trajectory_passes_through_missing_iterations(spark):
    e = spark.createDataFrame([(0, 0, "g", "t1"), (1, 0, "H", "G"), (1, 1, "H", "t2")], "iteration int, pos int, out_topic string, in_topic string")
    originals = spark.createDataFrame([("T1", 0), ("t2", 1), ("t3", 2)], "topic string, pos int")
    got = lineage.trajectories(e, originals, 2)
    assert rows(got, "final_topic", "origin") == [("H", "T1"), ("H", "t2")]
    assert rows(lineage.untraced(originals, got), "topic") == [("t3",)]


def test_depth_of_long_chains_and_cycles(spark):
    chain = [(i, i - 1 if i else None) for i in range(300)]
    t = spark.createDataFrame(chain + [(900, -5), (901, 900), (950, 999), (951, 950)], "id long, parent_id long")
    assert rows(lineage.depth(t), "id", "depth") == [*((i, i) for i in range(300)), (900, 0), (901, 1)]
    with pytest.raises(ValueError):
        lineage.depth(spark.createDataFrame([(1, None), (2, 4), (3, 2), (4, 3)], "id long, parent_id long"))
    assert lineage.depth(t.limit(0)).count() == 0


def test_coverage_first_match_and_none(spark):
    truth = spark.createDataFrame([("c", "ab"), ("c", "zz")], "category string, subtopic string")
    crawl = spark.createDataFrame([("xab", 1), ("ab", 0), ("yab", 2)], "topic string, pos int")
    got = coverage.contained(truth, crawl, lambda s, t: F.contains(t, s), size=2)
    assert rows(got.na.fill("-"), "subtopic", "matched_topic") == [("ab", "ab"), ("zz", "-")]
    empty = coverage.contained(truth, crawl.limit(0), lambda s, t: F.contains(t, s))
    assert empty.where("matched_topic is null").count() == 2


def test_coverage_rounds_do_not_grow_the_plan(spark):
    truth = spark.createDataFrame([("c", f"t{i}.") for i in range(9)], "category string, subtopic string")
    crawl = spark.createDataFrame([(f"a t{i}.", i) for i in range(8)], "topic string, pos int")
    got = coverage.contained(truth, crawl, lambda s, t: F.contains(t, s), size=1)
    assert got._jdf.queryExecution().analyzed().toString().count("\n") < 60
    assert rows(got.na.fill("-"), "subtopic", "matched_topic") == [*((f"t{i}.", f"a t{i}.") for i in range(8)), ("t8.", "-")]


def test_probes_and_vote(spark):
    t = spark.createDataFrame([(1, ["q", " ", None], ["a", "b", "c"], "s", "r"), (2, None, None, "", "raw")], "id long, refusal_check_queries array<string>, refusal_check_responses array<string>, shortened string, raw string")
    assert [tuple(r) for r in refusal.probes(t).orderBy("id").collect()] == [(1, 0, "q", "a"), (2, 0, "Tell me about raw", None)]
    v = spark.createDataFrame([(1, True)] + [(1, False)] * 3 + [(2, True), (2, False), (2, False)], "id int, refused boolean")
    assert rows(refusal.vote(v, "id"), "id", "is_refusal") == [(1, False), (2, True)]


def test_curves_on_small_inputs(spark):
    ids = spark.createDataFrame([(3,), (0,), (None,)], "first_id long")
    assert [round(r["recall"], 4) for r in curves.recall_curve(ids, 4, 4).orderBy("step").collect()] == [0.25, 0.25, 0.5, 0.5]
    none = spark.createDataFrame([(1, False)], "o int, hit boolean")
    assert curves.roc(none, "o", "hit").head()["tpr"] is None


def test_labels(spark):
    e = spark.createDataFrame([(1, "assign", 1, "a"), (2, "assign", 2, "a"), (3, "assign", 1, "b"), (4, "delete", None, "a"), (5, "assign", 3, "a"), (6, "remove", 1, None)], "seq long, action string, topic_id long, cluster string")
    now = labels.current(e)
    assert rows(now, "topic_id", "cluster") == [(3, "a")]
    names = spark.createDataFrame([("a", "z")], "cluster string, new_cluster string")
    assert rows(labels.renamed(now, names), "topic_id", "cluster") == [(3, "z")]
    with pytest.raises(ValueError):
        labels.renamed(now, spark.createDataFrame([("b", "a")], "cluster string, new_cluster string"))


def test_empty_metrics_are_zero(spark):
    empty = spark.createDataFrame([], "n_all long, n_deduped long, n_refused long")
    assert stats.crawl_metrics(empty).head()["avg_refusal_rate"] == 0
    assert lineage.consistency(spark.createDataFrame([], "n_runs long"), 2).head()["score"] == 0


def test_stratified_sample_fills_up(spark):
    t = spark.createDataFrame([("c", "s1", i) for i in range(1)] + [("c", "s2", i) for i in range(10, 30)], "cluster string, stratum string, id long")
    got = sampling.stratified(t, "cluster", "stratum", "id", 6)
    assert got.count() == 6 and got.where("stratum = 's1'").count() == 1


class Echo(providers.Provider):
    def answer(self, requests):
        item = F.concat(F.lit('["topic '), F.col("sample_idx").cast("string"), F.lit(' x", "'), F.substring("request_id", 1, 2), F.lit(' zone"]'))
        text = F.when(F.col("role") == "extract", item).when(F.col("role") == "probe", "Sorry, I can't help with that.").otherwise(F.col("messages")[0]["content"])
        return requests.withColumn("text", text)


def test_crawl_loop_stops_and_links_parents(spark):
    seeds = spark.createDataFrame([("seed topic",)], "topic string")
    templates = spark.createDataFrame([("Name topics like {}", 0), ("More on {}", 1)], "item string, pos long")
    topics, steps = loops.crawl(spark, seeds, templates, Echo(), steps=3, batch=2, warmup=1, max_topics=50)
    t = topics.toPandas()
    assert sorted(t["id"]) == list(range(len(t))) and steps.count() == 3
    assert set(t[t.step == 0].parent_id) == {-1} and set(t[t.step >= 1].parent_id) <= set(t["id"])
    assert t[t.is_head].summary.str.lower().nunique() == t.is_head.sum()
    assert (t[t.is_head & (t.step >= 0)].is_refusal == True).all()  # noqa: E712


class Nothing(providers.Provider):
    def answer(self, requests):
        return requests.withColumn("text", F.lit("no object"))


def test_reduction_without_progress_ends(spark):
    topics = spark.createDataFrame([(f"t{i}", i) for i in range(6)], "topic string, pos long")
    out = loops.reduce_labels(topics, topics.select(F.col("topic").alias("topic_key"), F.lit("r").alias("run")), Nothing(), most=2, size=3, target=2, retries=1)
    assert out.final.count() == 6 and out.iterations == 1
    assert out.sources.count() == 6


def test_function_provider_skips_blank_requests(spark):
    t = spark.createDataFrame([(1, "a"), (2, " ")], "i int, q string")
    asked = providers.FunctionProvider(lambda chats: [c[-1]["content"] * 2 for c in chats]).answer(providers.requests(t, "r", "m", providers.chat(None, F.col("q"))))
    assert rows(asked, "i", "text") == [(1, "aa"), (2, "")]


def test_recursive_clustering_carries_the_rest(spark):
    class Pair(providers.Provider):
        def answer(self, requests):
            return requests.withColumn("text", F.lit('{"a": [1, 2]}'))

    topics = spark.createDataFrame([(f"t{i}", i) for i in range(5)], "topic string, pos long")
    got = {r["topic"]: (r["head"], r["path"]) for r in loops.cluster_recursively(topics, Pair(), size=2).collect()}
    assert set(got) == {f"t{i}" for i in range(5)} and len({h for h, _ in got.values()}) == 1


def test_cascade_stages(spark):
    from tessera.operators import refusal

    no = "I cannot help you with that"
    answers = spark.createDataFrame([(1, "q", no), (2, "q", "a"), (3, "", "a"), (4, "q", "a"), (5, "q", "a"), (6, None, None)], "id long, query string, answer string")
    classifier = spark.createDataFrame([(1, "normal", 1.0), (2, "rejection", 0.999), (3, "normal", 0.999), (4, "normal", 0.999), (5, "rejection", 0.5)], "id long, label string, score double")
    judge = spark.createDataFrame([(2, "no"), (4, " YES "), (5, "no")], "id long, verdict string")
    got = {r["id"]: (r["is_refusal"], r["stage"]) for r in refusal.cascade(answers, classifier, judge).collect()}
    assert got == {1: (True, "pattern"), 2: (True, "classifier"), 3: (False, "classifier"), 4: (True, "judge"), 5: (False, "judge"), 6: (False, "pattern")}


def test_running_sums_over_partitions(spark):
    from tessera.operators.dedup import cumulated

    rows = spark.range(1000).selectExpr("id", "if(id % 7 = 0, null, id % 5) as v").repartition(7)
    got = {r["id"]: r["s"] for r in cumulated(rows, "id", "v", "s").collect()}
    total = 0
    for i in range(1000):
        total += i % 5 if i % 7 else 0
        assert got[i] == total
    assert cumulated(rows.limit(0), "id", "v", "s").count() == 0


def test_trajectories_over_many_iterations(spark):
    """64 iterations: a chain that renames one topic each time, one that skips iterations, and a late merge."""
    rows = [(i, 0, f" A{i + 1}", f"a{i}") for i in range(64)]
    rows += [(i, 1, f"b{i + 1}", "b0" if i < 4 else f"b{i - 3}") for i in range(3, 64, 4)]
    rows += [(63, 2, "A64", "late")]
    edges = spark.createDataFrame(rows, "iteration int, pos int, out_topic string, in_topic string")
    originals = spark.createDataFrame([("a0", 0), ("B0", 1), ("Late", 2)], "topic string, pos int")
    got = {tuple(r) for r in lineage.trajectories(edges, originals, 64).collect()}
    assert got == {(" A64", "a0"), (" A64", "Late"), ("b64", "B0")}
    # The plan has the joins of the last step alone, however many iterations there are.
    plan = lineage.trajectories(edges, originals, 64)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 3


def test_fold_reads_games_as_a_stream(spark):
    games = spark.range(25_000).select(F.concat(F.lit("r"), (F.col("id") % 2).cast("string")).alias("run"), F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("winner"), F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("loser"))
    names = spark.createDataFrame([(r, t, i) for r in ("r0", "r1") for i, t in enumerate("ab")], "run string, topic string, pos int")
    got = ranking.folded(games, names, "elo", ranking.Elo, every=1000)
    assert "FlatMapCoGroups" not in got._jdf.queryExecution().executedPlan().toString()
    for r in (0, 1):
        system, want = ranking.Elo(), {}
        system.start(["a", "b"])
        for i, k in enumerate(range(r, 25_000, 2), 1):
            system.update(*("ab" if k % 3 == 0 else "ba"))
            if i % 1000 == 0 or i == 12_500:
                want |= {((i - 1) // 1000, t): x for t, (x, _) in system.scores().items()}
        assert {(x["snapshot"], x["topic"]): x["rating"] for x in got.where(f"run = 'r{r}'").collect()} == want


def test_a_fold_holds_no_games(spark):
    import tracemalloc

    import pyarrow as pa

    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows]) for k in range(4)], names=["run", "game", "a", "b"])
    played = batch([("r", True, "a", "b")] * 10_000)
    stream = lambda: (b for b in [batch([("r", False, t, None) for t in "ab"]), *[played] * 30])
    tracemalloc.start()
    assert sum(b.num_rows for b in ranking._fold("trueskill", ranking.TrueSkill, 100)(stream())) == 2 * 3000
    assert tracemalloc.get_traced_memory()[1] < 16 << 20
    tracemalloc.stop()
