import json

import pytest
from pyspark.sql import functions as F

from tessera.sources import readers, writers
from tessera.streaming import streams


@pytest.fixture()
def logs(tmp_path):
    def topic(i, **more):
        return {"id": i, "raw": f"raw {i}", "english": f"t {i}", "summary": f"s {i}", "is_chinese": False, "is_head": True, "is_refusal": True, "parent_id": -1} | more

    for n, k in (("crawler_log_20240101_000000_m_1samples_1crawls_Truefilter_userprompt_api", 2), ("crawler_log_20240201_000000_m_1samples_1crawls_Truefilter_userprompt_api", 3)):
        topics = [topic(i) for i in range(k)] + [{"id": k, "raw": None, "translation": "older", "is_head": True}]
        doc = {"stats": {"history": {"all_per_step": [k, 1], "deduped_per_step": [k, 0], "refusal_per_step": [1, 0]}}, "config": {"a": k, "b": "x"}, "queue": {"topics": {"head_refusal_topics": topics, "head_topics": topics, "cluster_topics": [[t] for t in topics]}}, "head_refusal_topics_summaries": [f"s {i}" for i in range(k)]}
        (tmp_path / f"{n}.json").write_text(json.dumps(doc, indent=1))
    return tmp_path


def test_crawl_log_reader(spark, logs):
    found = readers.crawl_logs(spark, str(logs))
    assert readers.topics(found).count() == 7
    assert readers.raw_topics(found).count() == 5
    assert sorted(r["n_all"] for r in readers.steps(found).collect()) == [1, 1, 2, 3]
    assert readers.topics(found).where("english = 'older'").count() == 2
    assert readers.discovered(found).select("topic").distinct().count() == 3


def test_runs_keep_the_order_of_arguments(spark, logs):
    paths = sorted(map(str, logs.glob("*.json")), reverse=True)
    rows = readers.refused_summaries(spark, paths)
    assert {(r["run_idx"], r["topic"]) for r in rows.collect()} == {(0, "s 0"), (0, "s 1"), (0, "s 2"), (1, "s 0"), (1, "s 1")}


def test_latest_log_by_name_and_config(spark, logs):
    assert "20240201" in readers.latest_log(spark, str(logs), {"model": "m"}).head()["path"]
    assert "20240101" in readers.latest_log(spark, str(logs), {"samples": 1}, {"a": "2"}).head()["path"]


def test_taxonomies(spark, tmp_path):
    (tmp_path / "gt.json").write_text(json.dumps({"c": ["a", "b"], "d": ["e"]}))
    assert readers.ground_truth(spark, str(tmp_path / "gt.json")).count() == 3
    (tmp_path / "b.json").write_text(json.dumps({"root": {"c": {"s": ["p1", "p2"]}}}))
    assert readers.benchmark(spark, str(tmp_path / "b.json")).count() == 2
    (tmp_path / "m.json").write_text(json.dumps({"m": {"s": [[{"raw": "a"}, "f"]]}, "flat": [[{"raw": "b"}, "g.json"]]}))
    got = {(r["meta"], r["sub"], json.loads(r["topic"])["raw"], r["log_file"]) for r in readers.meta_clusters(spark, str(tmp_path / "m.json")).collect()}
    assert got == {("m", "s", "a", "f.json"), ("flat", None, "b", "g.json")}
    (tmp_path / "l.jsonl").write_text('["a", "b"]\n["b", "c"]\n')
    assert {tuple(r) for r in readers.topic_lines(spark, str(tmp_path / "l.jsonl")).collect()} == {("a", 0), ("b", 0), ("c", 1)}


def test_round_trip_and_cache(spark, logs, tmp_path):
    topics = readers.topics(readers.crawl_logs(spark, str(logs)))
    writers.run_state(topics, str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "state")).count() == topics.count()
    calls = []
    make = lambda: calls.append(1) or topics
    for _ in range(2):
        writers.cached(spark, str(tmp_path / "cache"), make)
    assert len(calls) == 1
    t = writers.topic_json(topics).where("topic like '%older%'").head()["topic"]
    assert json.loads(t)["raw"] is None


def test_reports(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d")], "parent string, child string")
    assert writers.markdown_tree(edges) == "- a\n  - b\n    - c\n  - d"
    assert "x\\_1" in writers.latex_table(spark.createDataFrame([("x_1", None)], "a string, b string"), ["a", "b"])
    t = spark.createDataFrame([("f", "<o>"), ("f", "p")], "final_topic string, origin string")
    assert "&lt;o&gt;" in writers.explorer(t, spark.createDataFrame([("f", 2)], "topic string, n_runs int"), 3)
    g = spark.createDataFrame([("c", "s", "p", 0, "x", True)], "category string, subcategory string, prompt string, gen_idx int, generation string, is_refusal boolean")
    assert writers.nested_results(g).head()["results"]["c"]["s"]["p"][0]["generation"] == "x"
    writers.text_list(spark.createDataFrame([("b",), ("a",)], "t string"), "t", str(tmp_path / "t"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "t")).collect()] == ["a", "b"]


def run_stream(spark, tmp_path, schema, batches, make, mode):
    folder = tmp_path / "in"
    folder.mkdir()
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(str(folder / f"b{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
    got = []
    make(stream).writeStream.foreachBatch(lambda df, e: got.extend(df.collect())).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    return got


def test_label_state_stream(spark, tmp_path):
    got = run_stream(spark, tmp_path, "topic_id long, seq long, cluster string", [[(1, 5, "b"), (2, 1, "a")], [(1, 3, "a")]], streams.current_labels, "update")
    last = {r["topic_id"]: r["cluster"] for r in got}
    assert last == {1: "b", 2: "a"}


def test_elo_stream(spark, tmp_path):
    got = run_stream(spark, tmp_path, "system string, seq long, winner string, loser string", [[("s", 1, "a", "b")], [("s", 2, "b", "a")]], streams.elo_ratings, "update")
    assert abs(sum(r["rating"] for r in got[-2:]) - 2000) < 1e-9


def test_stream_append_is_idempotent(spark, tmp_path):
    (tmp_path / "src").mkdir()
    spark.range(5).withColumn("x", F.lit(1)).write.parquet(str(tmp_path / "src" / "a"))
    s = spark.readStream.schema("id long, x int").option("recursiveFileLookup", "true").parquet(str(tmp_path / "src"))
    for _ in range(2):
        streams.append_table(s, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_reports_in_parts(spark, tmp_path):
    from tessera.sources import reports

    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d"), ("e", "d")], "parent string, child string")
    reports.write_lines(reports.markdown_lines(edges), str(tmp_path / "md"))
    assert [r["value"] for r in readers.numbered_lines(spark, str(tmp_path / "md")).orderBy("path", "line").collect()] == ["- a", "  - b", "    - c", "  - d", "- e", "  - d"]
    with pytest.raises(ValueError, match="cycle"):
        reports.markdown_lines(spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "a")], "parent string, child string"))
    rows = spark.createDataFrame([(2, None), (1, "x_1 & 5%")], "i int, t string")
    lines = [r["line"] for r in reports.latex_lines(rows, ["t", "i"], F.col("i")).orderBy("place").collect()]
    assert lines == ["\\begin{longtable}{ll}", "t & i \\\\", "\\hline", "x\\_1 \\& 5\\% & 1 \\\\", " & 2 \\\\", "\\end{longtable}"]
    t = spark.createDataFrame([("f", "<o>"), ("f", "p"), ("g", "q"), ("f", "p")], "final_topic string, origin string")
    page = [r["line"] for r in reports.explorer_lines(t, spark.createDataFrame([("f", 2)], "topic string, n_runs int"), 3).orderBy("place").collect()]
    assert page[1:-1] == ["<details><summary>f (2) [2/3]</summary><ul>", "<li>&lt;o&gt;</li>", "<li>p</li>", "</ul></details>", "<details><summary>g (1) [0/3]</summary><ul>", "<li>q</li>", "</ul></details>"]


def test_short_reports_refuse_long_tables(spark, monkeypatch):
    monkeypatch.setattr(writers, "SHORT", 3)
    with pytest.raises(ValueError, match="in parts"):
        writers.latex_table(spark.range(4), ["id"])


def test_lines_are_numbered_over_splits_and_files(spark, tmp_path):
    (tmp_path / "l").mkdir()
    want = set()
    for name, n in (("a.txt", 3000), ("b.txt", 17)):
        lines = [f"{name} line {i} " + "x" * (i % 50) for i in range(n)]
        (tmp_path / "l" / name).write_text("\n".join(lines) + "\n")
        want |= {(name, i, t) for i, t in enumerate(lines)}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = readers.numbered_lines(spark, str(tmp_path / "l"))
        got = {(r["path"].rpartition("/")[2], r["line"], r["value"]) for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == want


def test_long_logs_are_written_in_parts(spark, tmp_path, monkeypatch):
    from tessera import catalog_rows

    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 100).alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") < 290, "s").otherwise("t").alias("source"), F.lit(100).alias("n_chars"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(0, 300, 3).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(1).alias("toxic")).write.parquet(str(tmp_path / "labels.parquet"))
    monkeypatch.setattr(writers, "PART", 3000)
    logs = catalog_rows.crawl_log_files(spark, str(tmp_path))
    sizes = [r["n"] for r in logs.select(F.size("queue.topics.head_topics").alias("n")).collect()]
    assert sum(sizes) == 300 and max(sizes) <= 3000 // 200 + 1
    assert {(r["run_id"], r["step"], r["n_all"], r["n_deduped"], r["n_refused"]) for r in catalog_rows.crawl_log_steps(spark, str(tmp_path)).collect()} == {("s", 0, 290, 290, 97), ("s", 1, 145, 145, 0), ("t", 0, 10, 10, 3), ("t", 1, 5, 5, 0)}
    assert {(r["run_id"], r["n_steps"]): r["topics_per_step"] for r in catalog_rows.step_averages(spark, str(tmp_path)).collect()} == {("s", 2): 217.5, ("t", 2): 7.5}
    assert sorted(r["id"] for r in catalog_rows.crawl_log_topics(spark, str(tmp_path)).collect()) == list(range(300))
