"""Running sums in segments, ranks and Kendall's tau against plain versions, on rows that many parts share."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import curves, dedup, ranking, scan


@pytest.mark.parametrize("n", [32, 200])
def test_a_million_wide_rows_are_numbered_without_gaps(spark, n):
    text = F.sha2(F.col("id").cast("string"), 256)
    rows = spark.range(1_000_000).select(F.xxhash64("id").alias("o"), text.alias("a"), F.reverse(text).alias("b"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    try:
        got = dedup.dense_ids(rows, "o", 7)
        # The ids are right if the orders, sorted, are those of the ids: each id once, and no smaller order with a larger id.
        found = got.agg(F.count("*"), F.count_distinct("id"), F.min("id"), F.max("id")).head()
        assert tuple(found) == (1_000_000, 1_000_000, 7, 1_000_006)
        ordered = got.select("o", "id").toPandas().sort_values("o")["id"].to_numpy()
        assert (ordered[1:] - ordered[:-1] == 1).all()
        sums = dedup.cumulated(spark.range(200_000).withColumn("v", F.col("id") % 3), "id", "v", "upto")
        assert sums.where(F.col("upto") != F.floor(F.col("id") / 3) * 3 + F.element_at(F.array(F.lit(0), F.lit(1), F.lit(3)), (F.col("id") % 3 + 1).cast("int"))).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_segments_of_a_hot_group_ties_nulls_and_empty_tables(spark):
    draw = random.Random(1)
    rows = [("hot" if draw.random() < 0.5 else draw.choice(["a", "b", None]), draw.choice([None, *range(50)]), draw.choice([None, 1, 2]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, o int, v long, i long").withColumn("k", F.struct(F.col("o"), F.col("i")))
    got = scan.scanned(df, "k", {"upto": F.col("v")}, "g", totals={"all": "upto"}, n=16).collect()
    assert len(got) == 3000
    for g in {r[0] for r in rows}:
        total, own = 0, sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[3]))
        want = {}
        for r in own:
            total += r[2] or 0
            want[r[3]] = total
        assert {r["i"]: r["upto"] for r in got if r["g"] == g} == want
        assert {r["all"] for r in got if r["g"] == g} == {total}
    # Equal rows are numbered in any order, but each number comes once.
    same = spark.range(500).select(F.lit("x").alias("g"), F.lit(1).alias("o"))
    assert sorted(r["n"] for r in scan.numbered(same, "o", "n", "g", n=8).collect()) == list(range(1, 501))
    assert scan.numbered(same.limit(0), "o", "n", "g", n=8).count() == 0 and dedup.dense_ids(same.limit(0), "o").count() == 0


def test_parts_of_a_group_are_several_and_no_window_holds_a_group(spark):
    rows = spark.range(20_000).select(F.lit("x").alias("g"), F.col("id"), (F.col("id") % 7 == 0).alias("hit"))
    parts = scan.with_parts(rows, "id", "g", n=16).groupBy("__part").count().collect()
    assert len(parts) == 16 and max(r["count"] for r in parts) < 4 * 20_000 / 16
    for df in (curves.roc(rows, "id", "hit", "g"), curves.precision_recall(rows, "id", "hit", "g"), curves.cumulative_distinct(rows, "id", "hit", "g"), ranking.ranked(rows, "id", "id", "g")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        large = [line for line in plan.splitlines() if "Window" in line and "__part" not in line and "__all" not in line]  # those over the parts' totals have a row a part
        assert not large, large


def test_curves_against_plain_loops(spark):
    draw = random.Random(2)
    rows = [(draw.choice("ab"), i, draw.random() < 0.3, draw.randrange(40)) for i in range(600)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, o long, hit boolean, v int")
    roc = {r["o"]: r for r in curves.roc(df, "o", "hit", "g").collect()}
    pr = {r["o"]: r for r in curves.precision_recall(df, "o", "hit", "g").collect()}
    seen = {r["o"]: r["n_seen"] for r in curves.cumulative_distinct(df, "o", "v", "g").collect()}
    at = {r["g"]: r["precision_at_10"] for r in curves.precision_at(df, "o", "hit", (10,), by=("g",)).collect()}
    for g in "ab":
        own = sorted((r for r in rows if r[0] == g), key=lambda r: r[1])
        hits, values = sum(r[2] for r in own), set()
        tp = 0
        for k, (_, o, hit, v) in enumerate(own, 1):
            tp += hit
            values.add(v)
            assert (roc[o]["tp"], roc[o]["fp"], roc[o]["tpr"], roc[o]["fpr"]) == (tp, k - tp, tp / hits, (k - tp) / (len(own) - hits))
            assert (pr[o]["k"], pr[o]["precision"], pr[o]["recall"]) == (k, tp / k, tp / hits) and seen[o] == len(values)
        assert at[g] == sum(r[2] for r in own[:10]) / 10


def plain_tau(pairs):
    sign = lambda x: (x > 0) - (x < 0)
    num = left = right = 0
    for i, (a, b) in enumerate(pairs):
        for c, d in pairs[:i]:
            num += sign(a - c) * sign(b - d)
            left += a != c
            right += b != d
    return num / (left * right) ** 0.5 if left and right else None


def test_kendall_with_ties_over_parts(spark):
    draw = random.Random(3)
    rows = []
    for g, n, most in (("large", 700, 900), ("ties", 300, 6), ("one", 1, 5), ("flat", 20, 1), (None, 30, 10)):
        rows += [(g, f"t{i}", draw.randrange(most), draw.randrange(most)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, topic string, a int, b int").where("g is not null")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        got = {r["g"]: r["tau"] for r in ranking.kendall(df.withColumnRenamed("a", "rank"), df.withColumnRenamed("b", "rank"), "g").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for g in ("large", "ties", "one", "flat"):
        want = plain_tau([(r[2], r[3]) for r in rows if r[0] == g])
        assert got.get(g) == (None if want is None else pytest.approx(want, abs=1e-12)), g


def test_kendall_of_many_topics(spark):
    n = 200_000
    topics = spark.range(n).select(F.lit("e").alias("system"), F.explode(F.array(F.lit("x"), F.lit("y"))).alias("run"), F.col("id").alias("topic"))
    # The second run reverses the first.
    final = topics.withColumn("rank", F.when(F.col("run") == "x", F.col("topic")).otherwise(n - F.col("topic")))
    assert ranking.run_agreement(final).head()["mean"] == -1.0


def test_average_ranks_of_ties(spark):
    df = spark.createDataFrame([(g, v) for g in "ab" for v in (5, 5, 1, 7, None, 5)], "g string, v int")
    got = sorted((r["g"], r["v"] or 0, r["avg_rank"]) for r in ranking.average_ranks(df, "v", "g").collect())
    assert got == sorted((g, v, rank) for g in "ab" for v, rank in ((0, 1.0), (1, 2.0), (5, 4.0), (5, 4.0), (5, 4.0), (7, 6.0)))
