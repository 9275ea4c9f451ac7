"""Registered queries of the analytics operators over the synthetic tables, with the SQL that checks them.

The tables hold no model output, so texts are decorated: both sides build the same text from the same columns. Each query
reads whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage
from .functions import keys, names, parsers, text
from .operators import coverage, curves, dedup, filters, labels, lineage, matching, ranking, refusal, sampling, stats
from .plans import loops, providers
from .streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_topics(spark, d) -> DataFrame:
    """topic (first sentence), run (source), pos."""
    docs = table(spark, d, "documents")
    return docs.select(F.regexp_extract("text", "^[^.]*", 0).alias("topic"), F.col("source").alias("run"), F.col("doc_id").alias("pos"), "lang")


def flagged(spark, d) -> DataFrame:
    """Documents as topics of a crawl: step, is_head, is_refusal, is_chinese; without a label the flags are null."""
    docs, lab = table(spark, d, "documents"), table(spark, d, "labels")
    return docs.join(lab, "doc_id", "left").select("doc_id", "lang", "source", "n_chars", F.floor(F.col("doc_id") / 50).alias("step"), (F.col("quality") == 1).alias("is_head"), (F.col("toxic") == 1).alias("is_refusal"), (F.col("lang") == "fr").alias("is_chinese"))


FLAGGED = """flagged AS (SELECT d.doc_id, lang, source, n_chars, d.doc_id // 50 AS step, quality = 1 AS is_head, toxic = 1 AS is_refusal, lang = 'fr' AS is_chinese
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
TOPICS = r"""t AS (SELECT regexp_extract(text, '^[^.]*') AS topic, source AS run, doc_id AS pos, lang FROM documents),
k AS (SELECT lower(regexp_replace(topic, '^\s+|\s+$', '', 'g')) AS topic_key, regexp_replace(topic, '^\s+|\s+$', '', 'g') AS topic, run, pos, lang FROM t)"""


# Deduplication and provenance


@query(f"WITH {TOPICS} SELECT topic_key, arg_min(topic, pos) AS topic, count(DISTINCT run) AS n_runs, min(pos) AS first_pos FROM k WHERE topic_key <> '' GROUP BY topic_key")
def dedup_sources(spark, d):
    return dedup.with_provenance(doc_topics(spark, d)).drop("runs")


@query(f"""WITH {TOPICS}, g AS (SELECT topic_key, count(DISTINCT lang) AS n FROM k WHERE topic_key <> '' GROUP BY topic_key)
SELECT coalesce(count(*) FILTER (n >= 2)::DOUBLE / nullif(count(*), 0), 0.0) AS score, count(*) FILTER (n >= 2) AS n_consistent, count(*) AS n_total FROM g""")
def consistency(spark, d):
    return lineage.consistency(dedup.with_provenance(doc_topics(spark, d), run="lang"), 2)


PUNCT = r"""translate(lower(topic), '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', '')"""


@query(f"""WITH {TOPICS}, e AS (SELECT {PUNCT} AS key, topic, pos, lang FROM t),
h AS (SELECT key, arg_max(pos, pos) AS known_cluster FROM e WHERE lang = 'en' AND key <> '' GROUP BY key)
SELECT pos, key, known_cluster, key = '' OR (known_cluster IS NULL AND row_number() OVER (PARTITION BY key, CASE WHEN key = '' THEN pos END ORDER BY pos) = 1) AS is_head
FROM e LEFT JOIN h USING (key) WHERE lang <> 'en'""")
def exact_dedup_heads(spark, d):
    rows = doc_topics(spark, d)
    heads = dedup.known_heads(rows.where("lang = 'en'").select(F.col("topic").alias("summary"), F.lit(True).alias("is_head"), F.col("pos").alias("cluster_idx"), F.col("pos").alias("id")))
    return dedup.deduplicate(rows.where("lang <> 'en'"), heads, F.col("topic")).select("pos", "key", "known_cluster", "is_head")


@query(f"""WITH {TOPICS}, e AS (SELECT {PUNCT} AS key, pos FROM t), h AS (SELECT key, pos, row_number() OVER (ORDER BY pos) - 1 AS c FROM (SELECT key, min(pos) AS pos FROM e WHERE key <> '' GROUP BY key UNION ALL SELECT key, pos FROM e WHERE key = ''))
SELECT e.pos, e.pos = h.pos AS is_head, h.c::INT AS cluster_idx FROM e JOIN h ON e.key = h.key AND (e.key <> '' OR e.pos = h.pos)""")
def new_clusters(spark, d):
    rows = doc_topics(spark, d)
    none = spark.createDataFrame([], "key string, cluster_idx int")
    return dedup.assigned_clusters(dedup.deduplicate(rows, none, F.col("topic")), 0).select("pos", "is_head", "cluster_idx")


@query("SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) + 99 AS id FROM documents")
def dense_ids(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.struct("n_chars", "doc_id").alias("o"))
    return dedup.dense_ids(rows, "o", 100).select("doc_id", "id")


@query("SELECT source, lang_batch AS chunk, count(*) AS n, least(25, greatest(1, count(*) // 2)) AS n_out FROM (SELECT source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 50 AS lang_batch FROM documents) GROUP BY ALL")
def chunk_sizes(spark, d):
    rows = dedup.chunked(table(spark, d, "documents").select("doc_id", "source"), "doc_id", 50, "source")
    return rows.groupBy("source", "chunk").agg(F.count("*").alias("n"), F.least(F.lit(25).cast("long"), F.greatest(F.lit(1).cast("long"), F.expr("count(*) div 2"))).alias("n_out"))


@query(r"SELECT split_part(text, ' ', 1) AS head, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, head LIMIT 10")
def cluster_sizes(spark, d):
    return stats.cluster_sizes(table(spark, d, "documents").select(F.substring_index("text", " ", 1).alias("head")), "head", 10)


@query("SELECT lang, arg_min(source, doc_id) AS head, min(doc_id) AS first_id, sha256(string_agg(source, ',' ORDER BY doc_id)) AS members FROM documents GROUP BY lang")
def cluster_heads(spark, d):
    rows = stats.cluster_heads(table(spark, d, "documents").select("lang", "source", "doc_id"), "lang", "source", "doc_id")
    return rows.withColumn("members", F.sha2(F.array_join("members", ","), 256))


@query("SELECT c_custkey, c_name, o_orderpriority FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def attach_last(spark, d):
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return dedup.attach_last(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", orders, "o_orderpriority", "o_orderkey")


# Text of answers

CONV = r"""c AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '<think>' || left(text, 9) || '</think>  ' || text WHEN 1 THEN '<|assistant|>' || text || ' **b** _c_ `d`' WHEN 2 THEN '<think>' || text
  ELSE 'x' || chr(10) || 'assistant' || chr(10) || '“' || text || '”' END AS x FROM conversations)"""


def decorated(spark, d):
    c, t = table(spark, d, "conversations"), F.col("text")
    kinds = [F.concat(F.lit("<think>"), F.left(t, F.lit(9)), F.lit("</think>  "), t), F.concat(F.lit("<|assistant|>"), t, F.lit(" **b** _c_ `d`")), F.concat(F.lit("<think>"), t)]
    x = F.concat(F.lit("x\nassistant\n“"), t, F.lit("”"))
    for i, k in enumerate(kinds):
        x = F.when(F.col("turn") % 4 == i, k).otherwise(x)
    return c.select("conv_id", "turn", x.alias("x"))


@query(rf"""WITH {CONV}, s AS (SELECT conv_id, turn, regexp_split_to_array(x, '(?i)<\|assistant\|>|Assistant:|\nassistant\n')[-1] AS y FROM c)
SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(translate(replace(regexp_replace(y, '<think>.*?</think>', '', 'gs'), '</think>', ''), '“”‘’', '""'''''), '*', ''), '_', ''), '`', ''), '\s+', ' ', 'g'), '^ ', ''), ' $', '') AS cleaned FROM s""")
def clean_response(spark, d):
    return decorated(spark, d).select("conv_id", "turn", text.cleaned(F.col("x")).alias("cleaned"))


@query(rf"""WITH {CONV} SELECT conv_id, turn, CASE WHEN contains(x, '</think>') THEN regexp_replace(substr(x, instr(x, '</think>') + 8), '^\s+', '') WHEN contains(x, '<think>') THEN '' ELSE x END AS answer FROM c""")
def strip_thinking(spark, d):
    return decorated(spark, d).select("conv_id", "turn", text.without_thinking(F.col("x")).alias("answer"))


@query(rf"""WITH {CONV} SELECT conv_id, turn, trim(regexp_split_to_array(x, '(?i)<\|assistant\|>|Assistant:|\nassistant\n')[-1], ' <>|:') AS probe FROM c""")
def probe_text(spark, d):
    return decorated(spark, d).select("conv_id", "turn", text.probe_text(F.col("x")).alias("probe"))


REFUSALS = """a AS (SELECT conv_id, turn, text AS query, CASE (conv_id * 7 + turn) % 5 WHEN 0 THEN 'I''m sorry, but I cannot ' || text WHEN 1 THEN '[MODERATION_BLOCKED]: policy' WHEN 2 THEN NULL WHEN 3 THEN 'i CANNOT help you with that ' || text ELSE text END AS answer FROM conversations),
f AS (SELECT *, CASE WHEN answer IS NULL THEN false WHEN (conv_id * 7 + turn) % 5 IN (0, 1, 3) THEN true END AS fast FROM a)"""


def answers(spark, d):
    c, t = table(spark, d, "conversations"), F.col("text")
    k = (F.col("conv_id") * 7 + F.col("turn")) % 5
    answer = F.when(k == 0, F.concat(F.lit("I'm sorry, but I cannot "), t)).when(k == 1, "[MODERATION_BLOCKED]: policy").when(k == 3, F.concat(F.lit("i CANNOT help you with that "), t)).when(k == 4, t)
    return c.select("conv_id", "turn", F.concat_ws("-", "conv_id", "turn").alias("id"), t.alias("query"), answer.alias("answer"))


@query(f"WITH {REFUSALS} SELECT conv_id, turn, fast FROM f")
def refusal_fast(spark, d):
    return answers(spark, d).select("conv_id", "turn", text.refusal_fast(F.col("answer")).alias("fast"))


@query(f"""WITH {REFUSALS}, v AS (SELECT conv_id || '-' || turn AS id, fast, ('0x' || substr(md5(conv_id || '-' || turn), 1, 4))::INT % 100 AS s FROM f)
SELECT id, CASE WHEN fast IS NOT NULL THEN fast WHEN s >= 70 THEN true ELSE s % 2 = 0 END AS is_refusal, CASE WHEN fast IS NOT NULL THEN 'pattern' WHEN s >= 70 THEN 'classifier' ELSE 'judge' END AS stage FROM v""")
def cascade(spark, d):
    rows = answers(spark, d)
    s = F.conv(F.substring(F.md5("id"), 1, 4), 16, 10).cast("int") % 100
    classifier = rows.select("id", F.when(s >= 70, "rejection").otherwise("normal").alias("label"), F.when(s >= 70, 0.995).otherwise(0.5).alias("score"))
    judge = rows.select("id", F.when(s % 2 == 0, "Yes, it is").otherwise("No").alias("verdict"))
    return refusal.cascade(rows, classifier, judge)


@query(f"WITH {REFUSALS} SELECT conv_id, count(*) AS n, count(*) FILTER (fast) AS n_refused, avg((coalesce(fast, false))::INT) > 0.25 AS is_refusal FROM f GROUP BY conv_id")
def refusal_vote(spark, d):
    rows = answers(spark, d).select("conv_id", F.coalesce(text.refusal_fast(F.col("answer")), F.lit(False)).alias("refused"))
    return refusal.vote(rows, "conv_id")


@query("""WITH a AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'policy ' || turn WHEN 1 THEN 'unknown' END AS reason FROM conversations)
SELECT conv_id, string_agg(reason, '; ' ORDER BY turn) AS api_refused_reason, string_agg(reason, '; ' ORDER BY turn) FILTER (reason <> 'unknown') AS summary FROM a WHERE reason IS NOT NULL GROUP BY conv_id""")
def api_reasons(spark, d):
    k = F.col("turn") % 3
    answer = F.when(k == 0, F.concat(F.lit("[MODERATION_BLOCKED]: policy "), "turn")).when(k == 1, "[MODERATION_BLOCKED]").otherwise(F.col("text"))
    return refusal.reasons(table(spark, d, "conversations").select("conv_id", F.col("turn").alias("probe_idx"), answer.alias("answer")), "conv_id")


@query(r"""WITH s AS (SELECT doc_id, string_split(replace(text, chr(10), ' '), '.') AS p FROM documents), n AS (SELECT doc_id, list_transform(list_filter(p, lambda x: trim(x) <> ''), lambda x: trim(x)) AS p FROM s)
SELECT doc_id, array_to_string(p[1:5], '|') AS items, len(p[1:5])::INT AS n FROM (SELECT doc_id, list_filter(p, lambda x, i: list_position(p, x) = i) AS p FROM n)""")
def numbered_list(spark, d):
    parts = F.filter(F.transform(F.split(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), r"\."), lambda s: F.trim(s)), lambda x: x != "")
    made = table(spark, d, "documents").select("doc_id", text.numbered(parts).alias("x"))
    return made.select("doc_id", text.numbered_items(F.col("x"), 5).alias("i")).select("doc_id", F.array_join("i", "|").alias("items"), F.size("i").alias("n"))


@query(rf"""WITH {TOPICS}, w AS (SELECT pos, string_split_regex(replace(trim(lower(topic), ' ./:",''()[]'), '.', ''), '\s+') AS w FROM t)
SELECT pos, array_to_string(list_filter(w, lambda x: length(x) > 1), ' ') AS plain FROM w""")
def plain_words(spark, d):
    return doc_topics(spark, d).select("pos", text.plain_words(F.col("topic")).alias("plain"))


@query(rf"""WITH {TOPICS}, w AS (SELECT pos, string_split_regex(topic || ', and more or or less', '\s*,\s*|\s+or\s+') AS p FROM t)
SELECT pos, array_to_string(list_transform(p, lambda x: regexp_replace(regexp_replace(x, '^(?:or|and)\s+', ''), '^\s+|\s+$', '', 'g')), '|') AS parts FROM w""")
def split_labels(spark, d):
    return doc_topics(spark, d).select("pos", F.array_join(text.split_labels(F.concat("topic", F.lit(", and more or or less"))), "|").alias("parts"))


@query(r"SELECT doc_id, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))::INT AS n_words FROM documents")
def word_count(spark, d):
    return table(spark, d, "documents").select("doc_id", text.word_count(F.col("text")).alias("n_words"))


@query(r"""WITH x AS (SELECT c_custkey, c_custkey % 3 AS k FROM customer)
SELECT c_custkey, CASE k WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS winner, k = 0 AS flag, CASE k WHEN 0 THEN 'x1|y' ELSE 'z' END AS topics FROM x""")
def parse_boxed(spark, d):
    k = F.col("c_custkey") % 3
    x = F.when(k == 0, r"first \boxed{A} then").when(k == 1, r"\boxed{ b }").otherwise(r"\boxed{?}")
    y = F.when(k == 0, r"<thinking>\topic{w}</thinking>\topic{x1}\topic{y} \topic{None}\boxed{Y}").otherwise(r"\topic{z} \boxed{no}")
    rows = table(spark, d, "customer").select("c_custkey", text.pairwise_winner(x).alias("winner"), text.similarity(y).alias("s"))
    return rows.select("c_custkey", "winner", F.col("s.flag").alias("flag"), F.array_join("s.topics", "|").alias("topics"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN '' ELSE c_name || '|' || c_mktsegment END AS items FROM customer""")
def parse_topic_list(spark, d):
    body = F.to_json(F.array("c_name", "c_mktsegment"))
    k = F.col("c_custkey") % 3
    x = F.when(k == 0, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```"))).when(k == 1, body).otherwise(F.concat(F.lit("```not a list "), body, F.lit("```")))
    return table(spark, d, "customer").select("c_custkey", F.array_join(text.json_strings(x), "|").alias("items"))


@query("SELECT n_nationkey, n_name AS name, 2 AS n_groups, 'a|' || n_name AS members FROM nation")
def parse_mapping(spark, d):
    x = F.concat(F.lit('ok ```json\n{" '), "n_name", F.lit('": ["a"], "b": [["c", 1], " "], "'), F.lower("n_name"), F.lit('": "'), "n_name", F.lit('", "": ["d"]}\n``` end'))
    m = table(spark, d, "nation").select("n_nationkey", "n_name", parsers.parse_label_mapping(x).alias("m"))
    return m.select("n_nationkey", F.map_keys("m")[0].alias("name"), F.size("m").alias("n_groups"), F.array_join(F.element_at("m", F.col("n_name")), "|").alias("members"))


@query("""SELECT s_suppkey, 'Model-' || s_suppkey AS model, (s_suppkey % 9)::INT AS samples, CASE s_suppkey % 2 WHEN 0 THEN 'thought_' ELSE 'assistant_' END AS mode, TIMESTAMP '2024-03-05 06:07:08' AS ts,
  CASE s_suppkey % 2 WHEN 0 THEN 'openai' ELSE 'openrouter' END AS provider FROM supplier""")
def parse_names(spark, d):
    k = F.col("s_suppkey")
    path = F.concat(F.lit("/logs/crawler_log_20240305_060708_Model-"), k.cast("string"), F.lit("_"), (k % 9).cast("string"), F.lit("samples_7crawls_Truefilter_"), F.when(k % 2 == 0, "thought").otherwise("assistant"), F.lit("_prompt_vllm.json"))
    rows = table(spark, d, "supplier").select(k, names.parsed_name(path, "prompt").alias("n"), names.provider_and_model(F.concat(F.when(k % 2 == 0, "OpenAI:").otherwise("other:"), F.lit("m"))).alias("p"))
    return rows.select("s_suppkey", "n.model", "n.samples", F.substr(F.col("n.mode"), F.lit(1)).alias("mode"), F.col("n.ts").cast("timestamp_ntz").alias("ts"), "p.provider")


# Lineage

EDGES = """edges AS (SELECT 0 AS iteration, doc_id // 64 AS batch, doc_id AS pos, 'A' || (doc_id // 8) AS out_topic, ' t' || doc_id AS in_topic FROM documents
  UNION ALL SELECT 1, k // 64, k, 'b' || (k // 8), 'a' || k FROM (SELECT DISTINCT doc_id // 8 AS k FROM documents)),
kept AS (SELECT * FROM edges WHERE NOT (iteration = 0 AND pos % 5 = 0))"""


def edges(spark, d):
    ids = table(spark, d, "documents").select("doc_id")
    text_of = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    i, k = F.col("doc_id"), F.col("k")
    first = ids.select(F.lit(0).alias("iteration"), F.floor(i / 64).alias("batch"), i.alias("pos"), text_of("A", F.floor(i / 8)).alias("out_topic"), text_of(" t", i).alias("in_topic"))
    second = ids.select(F.floor(i / 8).alias("k")).distinct().select(F.lit(1).alias("iteration"), F.floor(k / 64).alias("batch"), k.alias("pos"), text_of("b", F.floor(k / 8)).alias("out_topic"), text_of("a", k).alias("in_topic"))
    return first.unionByName(second)


@query("""WITH x AS (SELECT DISTINCT 'a' || (doc_id // 8) AS topic_key, source AS run FROM documents) SELECT topic_key, run FROM x""")
def propagate(spark, d):
    first = edges(spark, d).where("iteration = 0")
    sources = table(spark, d, "documents").select(F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("topic_key"), F.col("source").alias("run"))
    return lineage.propagated(first, sources)


@query(f"WITH {EDGES} SELECT iteration, batch, in_topic AS topic FROM edges WHERE iteration = 0 AND pos % 5 = 0")
def batch_gaps(spark, d):
    e = edges(spark, d)
    kept = e.where("not (iteration = 0 and pos % 5 = 0)")
    return lineage.uncovered(e.select("iteration", "batch", F.col("in_topic").alias("topic")), kept, "iteration", "batch")


@query(f"WITH {EDGES} SELECT arg_min(out_topic, pos) AS out_topic, string_agg(DISTINCT in_topic, '|' ORDER BY in_topic) AS inputs FROM edges WHERE iteration = 0 GROUP BY lower(out_topic)")
def merge_map(spark, d):
    return lineage.merged_mappings(edges(spark, d).where("iteration = 0")).withColumn("inputs", F.array_join("inputs", "|"))


@query("SELECT 'b' || (doc_id // 64) AS final_topic, 't' || doc_id AS origin FROM documents")
def trajectories(spark, d):
    originals = table(spark, d, "documents").select(F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("topic"), F.col("doc_id").alias("pos"))
    return lineage.trajectories(edges(spark, d), originals, 2)


@query(f"""WITH {EDGES} SELECT count(DISTINCT iteration) AS n_iterations, count(DISTINCT (iteration, batch)) AS n_calls,
count(DISTINCT trim(in_topic)) FILTER (iteration = 0) AS n_inputs, count(DISTINCT out_topic) FILTER (iteration = 1) AS n_finals FROM edges""")
def log_summary(spark, d):
    return lineage.log_summary(edges(spark, d))


@query("""WITH RECURSIVE t AS (SELECT doc_id AS id, CASE WHEN doc_id < 5 THEN -5 ELSE doc_id // 5 END AS parent_id FROM documents),
r AS (SELECT id, 0 AS depth FROM t WHERE parent_id < 0 UNION ALL SELECT t.id, depth + 1 FROM t JOIN r ON t.parent_id = r.id) SELECT id, depth FROM r""")
def topic_depth(spark, d):
    i = F.col("doc_id")
    return lineage.depth(table(spark, d, "documents").select(i.alias("id"), F.when(i < 5, F.lit(-5)).otherwise(F.floor(i / 5)).alias("parent_id")))


# Coverage and matching


@query("""WITH truth AS (SELECT DISTINCT p_brand AS category, p_type AS subtopic FROM part), hit AS (SELECT category, subtopic, arg_min('about ' || p_name, p_partkey) AS matched_topic FROM truth JOIN part ON contains('about ' || p_name, lower(subtopic)) GROUP BY ALL)
SELECT category, subtopic, matched_topic FROM truth LEFT JOIN hit USING (category, subtopic)""")
def coverage_contains(spark, d):
    p = table(spark, d, "part")
    truth = p.select(F.col("p_brand").alias("category"), F.col("p_type").alias("subtopic")).distinct()
    crawl = p.select(F.concat(F.lit("about "), "p_name").alias("topic"), F.col("p_partkey").alias("pos"))
    return coverage.contained_text(truth, crawl, F.lower("subtopic"), F.col("topic"))


@query("""WITH c AS (SELECT p_brand AS category, lower(p_name) IN (SELECT lower(p_name) FROM part WHERE p_size < 25) AS hit, p_name FROM part)
SELECT category, count(*) FILTER (hit) AS covered, count(*) AS total, count(*) FILTER (hit)::DOUBLE / count(*) AS rate, sha256(coalesce(string_agg(p_name, '|' ORDER BY p_name) FILTER (NOT hit), '')) AS missing FROM c GROUP BY ROLLUP (category)""")
def coverage_report(spark, d):
    p = table(spark, d, "part")
    truth = p.select(F.col("p_brand").alias("category"), F.col("p_name").alias("subtopic"))
    crawl = p.where("p_size < 25").select(F.concat(F.lit(" "), F.upper("p_name")).alias("topic"), F.col("p_partkey").alias("pos"))
    return coverage.report(coverage.keyed_coverage(truth, crawl)).withColumn("missing", F.sha2(F.array_join("missing", "|"), 256)).drop("matches")


@query("""SELECT s_suppkey AS id, lower(s_name) AS term, CASE WHEN s_acctbal > 0 THEN s_name END AS resolved FROM supplier""")
def resolve_terms(spark, d):
    s = table(spark, d, "supplier")
    return coverage.resolved(s.select(F.col("s_suppkey").alias("id"), F.lower("s_name").alias("term")), s.where("s_acctbal > 0").select(F.col("s_name").alias("term"), F.col("s_suppkey").alias("pos")))


MATCH = """a AS (SELECT n_name AS gt, n_nationkey % 2 = 0 AS flag, s_name AS cluster FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > 0)"""


def match_answers(spark, d):
    s, n = table(spark, d, "supplier").where("s_acctbal > 0"), table(spark, d, "nation")
    m = s.groupBy("s_nationkey").agg(F.collect_list("s_name").alias("matched"))
    return n.join(m, n["n_nationkey"] == m["s_nationkey"], "left").select(F.col("n_name").alias("gt"), (F.col("n_nationkey") % 2 == 0).alias("flag"), "matched")


def clusters(spark, d):
    return table(spark, d, "supplier").select(F.col("s_name").alias("cluster"), F.col("s_suppkey").alias("first_id"))


@query(f"""WITH {MATCH} SELECT s_name AS cluster, min(s_suppkey) AS first_id, count(gt) > 0 AS is_match, coalesce(string_agg(DISTINCT gt, '|' ORDER BY gt), '') AS ground_truth_matches FROM supplier LEFT JOIN a ON s_name = cluster GROUP BY s_name""")
def gt_match(spark, d):
    return matching.matched_clusters(clusters(spark, d), match_answers(spark, d)).withColumn("ground_truth_matches", F.array_join("ground_truth_matches", "|"))


@query(f"""WITH {MATCH}, c AS (SELECT s_name IN (SELECT cluster FROM a) AS m FROM supplier), g AS (SELECT n_name IN (SELECT gt FROM a) AS m FROM nation),
x AS (SELECT count(*) FILTER (m) AS matched_clusters, count(*) FILTER (NOT m) AS unmatched_clusters FROM c), y AS (SELECT count(*) FILTER (m) AS matched_labels, count(*) FILTER (NOT m) AS unmatched_labels FROM g)
SELECT *, matched_clusters::DOUBLE / (matched_clusters + unmatched_clusters) AS cluster_rate, matched_labels::DOUBLE / (matched_labels + unmatched_labels) AS label_rate FROM x, y""")
def match_summary(spark, d):
    c, a = clusters(spark, d), match_answers(spark, d)
    return matching.match_summary(matching.matched_clusters(c, a), matching.first_match(c, a))


@query("""SELECT n_name AS name, n_nationkey AS a, r_regionkey AS b FROM nation JOIN region ON lower(trim(replace(n_name, '_', ' '))) = lower(trim(r_name))
UNION ALL SELECT n_name, n_nationkey, NULL FROM nation WHERE lower(n_name) NOT IN (SELECT lower(r_name) FROM region)""")
def name_join(spark, d):
    n = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("a"))
    r = table(spark, d, "region").select(F.concat(F.lit(" "), F.lower(F.replace("r_name", F.lit(" "), F.lit("_")))).alias("name"), F.col("r_regionkey").alias("b"))
    both, rest = matching.name_join(n, r)
    return both.select("name", "a", "b").unionByName(rest.select("name", "a", F.lit(None).cast("int").alias("b")))


@query("SELECT source AS gt, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'de') AS de FROM documents GROUP BY source")
def presence(spark, d):
    return matching.presence(table(spark, d, "documents").select(F.col("source").alias("gt"), F.col("lang").alias("label")), ["en", "de"])


@query("SELECT source AS cluster, bool_or(lang = 'en') AS en, bool_or(lang = 'es') AS es FROM documents GROUP BY source")
def coverage_matrix(spark, d):
    return matching.coverage_matrix(table(spark, d, "documents").select(F.col("source").alias("cluster"), F.col("lang").alias("log")), ["en", "es"])


RATES = f"""WITH {FLAGGED}, rates AS (SELECT lang AS model, source AS topic, count(*) FILTER (is_refusal)::DOUBLE / count(*) AS rate FROM flagged GROUP BY ALL),
found AS (SELECT DISTINCT lang AS model, source AS topic FROM flagged WHERE NOT is_head)"""


def rates(spark, d):
    f = flagged(spark, d)
    r = f.groupBy(F.col("lang").alias("model"), F.col("source").alias("topic")).agg((F.count_if("is_refusal") / F.count("*")).alias("rate"))
    return r, f.where("not is_head").select(F.col("lang").alias("model"), F.col("source").alias("topic")).distinct()


@query(RATES + " SELECT topic, model, rate FROM rates WHERE rate > 0.05 AND topic NOT IN (SELECT topic FROM found WHERE model = 'es')")
def missed(spark, d):
    r, found = rates(spark, d)
    return matching.missed(r, found.where("model = 'es'"))


@query(RATES + " SELECT r.model, f.topic IS NOT NULL AS identified, round(avg(rate), 9) AS mean_rate FROM rates r LEFT JOIN found f ON r.model = f.model AND r.topic = f.topic GROUP BY ALL")
def identified_rates(spark, d):
    return matching.identified_rates(*rates(spark, d)).withColumn("mean_rate", F.round("mean_rate", 9))


@query(RATES + " SELECT topic, min(rate) FILTER (model = 'en') AS en, min(rate) FILTER (model = 'es') AS es, count(rate) AS n_models, round(avg(rate), 9) AS mean_rate FROM rates GROUP BY topic")
def pivot_rates(spark, d):
    return stats.pivot_rates(rates(spark, d)[0], ["en", "es"]).withColumn("mean_rate", F.round("mean_rate", 9))


# Filters


@query("""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN -5 WHEN doc_id % 3 > 0 THEN doc_id - 1 END AS parent_id, CASE WHEN doc_id % 2 = 0 THEN lang END AS summary, CASE doc_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_head,
  doc_id % 5 = 0 AS is_refusal, array_to_string((string_split(replace(text, chr(10), ' '), ' '))[1:2 + doc_id % 4], ' ') AS shortened, source AS raw FROM documents)
SELECT doc_id, CASE WHEN summary IS NULL AND (is_head IS NULL OR (is_head AND is_refusal)) AND len(list_filter(string_split_regex(shortened, '\\s+'), lambda w: w <> '')) <= 4 THEN coalesce(nullif(shortened, ''), raw) ELSE summary END AS summary FROM t WHERE parent_id IS DISTINCT FROM -5""")
def short_summaries(spark, d):
    i = F.col("doc_id")
    short = F.array_join(F.slice(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " "), F.lit(1), (i % 4 + 2).cast("int")), " ")
    t = table(spark, d, "documents").select(i, F.when(i % 7 == 0, F.lit(filters.SEED)).when(i % 3 > 0, i - 1).alias("parent_id"), F.when(i % 2 == 0, F.col("lang")).alias("summary"), F.when(i % 3 == 0, True).when(i % 3 == 1, False).alias("is_head"), (i % 5 == 0).alias("is_refusal"), short.alias("shortened"), F.col("source").alias("raw"))
    return filters.short_summaries(filters.without_seeds(t)).select("doc_id", "summary")


@query("""WITH b AS (SELECT lang, source FROM documents GROUP BY ALL HAVING count(*) > 5) SELECT lang || ':' || source AS cell, count(*) AS n FROM documents JOIN b USING (lang, source) WHERE source <> 'src1' GROUP BY 1""")
def large_groups(spark, d):
    rows = table(spark, d, "documents").select(keys.composite(F.col("lang"), F.col("source")).alias("cell"), F.col("source").alias("query"))
    return filters.large_groups(rows, "cell", 5, ("src1",)).groupBy("cell").agg(F.count("*").alias("n"))


# Counters and rates


@query(f"WITH {FLAGGED} SELECT step, lang, count(*) AS n_all, count(*) FILTER (is_head) AS n_deduped, count(*) FILTER (is_head AND is_refusal) AS n_refused FROM flagged GROUP BY ALL")
def step_stats(spark, d):
    return stats.step_counts(flagged(spark, d), "step", "lang")


@query(f"""WITH {FLAGGED}, s AS (SELECT step, count(*) AS a, count(*) FILTER (is_head) AS h, count(*) FILTER (is_head AND is_refusal) AS r FROM flagged GROUP BY step)
SELECT sum(a)::BIGINT AS total_all, sum(h)::BIGINT AS total_deduped, sum(r)::BIGINT AS total_refusals, sum(r)::DOUBLE / (sum(a)::DOUBLE + 1e-10::DOUBLE) AS avg_refusal_rate, count(*) AS n_steps FROM s""")
def crawl_metrics(spark, d):
    return stats.crawl_metrics(stats.step_counts(flagged(spark, d), "step"))


@query(f"""WITH {FLAGGED}, s AS (SELECT lang, step, count(*) AS n_all, count(*) FILTER (is_head) AS n_deduped FROM flagged GROUP BY ALL)
SELECT lang, step, sum(n_all) OVER w::BIGINT AS cum_n_all, sum(n_deduped) OVER w::BIGINT AS cum_n_deduped FROM s WINDOW w AS (PARTITION BY lang ORDER BY step ROWS UNBOUNDED PRECEDING)""".replace("sum(n_all) OVER w::BIGINT", "(sum(n_all) OVER w)::BIGINT").replace("sum(n_deduped) OVER w::BIGINT", "(sum(n_deduped) OVER w)::BIGINT"))
def cumulative(spark, d):
    return stats.running_total(stats.step_counts(flagged(spark, d), "lang", "step"), "step", ["n_all", "n_deduped"], "lang").select("lang", "step", "cum_n_all", "cum_n_deduped")


def generations(spark, d):
    return flagged(spark, d).select(F.col("lang").alias("category"), F.col("source").alias("subcategory"), (F.col("doc_id") % 97).alias("prompt"), F.coalesce("is_refusal", F.lit(False)).alias("refused"))


@query(f"WITH {FLAGGED} SELECT lang AS category, source AS subcategory, count(DISTINCT doc_id % 97) AS total_prompts, count(*) AS total_generations, count(*) FILTER (is_refusal) AS total_refusals, count(*) FILTER (is_refusal)::DOUBLE / count(*) AS refusal_rate FROM flagged GROUP BY ROLLUP (lang, source)")
def refusal_rollup(spark, d):
    return stats.refusal_rollup(generations(spark, d), "category", "subcategory")


@query(f"WITH {FLAGGED}, r AS (SELECT source AS subcategory, count(DISTINCT doc_id % 97) AS total_prompts, count(*) AS total_generations, count(*) FILTER (is_refusal) AS total_refusals, count(*) FILTER (is_refusal)::DOUBLE / count(*) AS refusal_rate FROM flagged GROUP BY source) SELECT *, (row_number() OVER (ORDER BY refusal_rate DESC, subcategory) - 1)::INT AS rank_idx FROM r")
def ranked_rates(spark, d):
    return ranking.ranked(stats.refusal_by(generations(spark, d), "subcategory").where("subcategory is not null"), "refusal_rate", "subcategory")


@query(f"WITH {FLAGGED} SELECT count(*) FILTER (is_head AND is_refusal) AS n11, count(*) FILTER (is_head AND NOT is_refusal) AS n10, count(*) FILTER (NOT is_head AND is_refusal) AS n01, count(*) FILTER (NOT is_head AND NOT is_refusal) AS n00, round(corr(is_head::INT, is_refusal::INT) FILTER (is_head IS NOT NULL), 9) AS phi FROM flagged")
def contingency(spark, d):
    return stats.contingency(flagged(spark, d), "is_head", "is_refusal").withColumn("phi", F.round("phi", 9))


@query(f"""WITH {FLAGGED}, f AS (SELECT count(*) AS total, count(*) FILTER (is_head) AS novel, count(*) FILTER (is_head AND is_refusal) AS refused FROM flagged)
SELECT *, total - novel AS dropped_duplicates, novel - refused AS dropped_answered, 100 * (novel::DOUBLE / total) AS novel_percent, 100 * (refused::DOUBLE / total) AS refused_percent FROM f""")
def funnel(spark, d):
    return stats.funnel(flagged(spark, d))


@query(f"WITH {FLAGGED} SELECT avg(is_chinese::INT) AS chinese_ratio, count(*) AS n FROM flagged WHERE is_head")
def language_ratio(spark, d):
    return stats.language_ratio(flagged(spark, d).where("is_head"), "doc_id")


@query(f"WITH {TOPICS}, p AS (SELECT DISTINCT run, topic_key FROM k) SELECT run, count(*) AS k, (SELECT count(DISTINCT topic_key) FROM p) AS n, count(*)::DOUBLE / (SELECT count(DISTINCT topic_key) FROM p) AS recall FROM p GROUP BY run")
def recall_per_run(spark, d):
    return stats.recall_per_run(doc_topics(spark, d).withColumn("label", keys.trim_key(F.col("topic"))))


@query(f"""WITH {TOPICS}, p AS (SELECT DISTINCT run, topic_key FROM k), r AS (SELECT run, count(*)::DOUBLE / (SELECT count(DISTINCT topic_key) FROM p) AS recall FROM p GROUP BY run)
SELECT right(run, 1) AS parity, round(avg(recall), 9) AS mean, round(stddev_samp(recall), 9) AS std, min(recall) AS min, max(recall) AS max, count(*) AS n FROM r GROUP BY 1""")
def recall_summary(spark, d):
    r = recall_per_run(spark, d).withColumn("parity", F.right("run", F.lit(1)))
    return stats.recall_summary(r, "parity").withColumns({"mean": F.round("mean", 9), "std": F.round("std", 9)})


SETS = f"""WITH {TOPICS}, p AS (SELECT DISTINCT topic_key AS topic FROM k), a AS (SELECT DISTINCT topic_key AS topic FROM k WHERE lang = 'en'), b AS (SELECT DISTINCT topic_key AS topic FROM k WHERE run <> 'src0')"""


def topic_sets(spark, d):
    t = doc_topics(spark, d).withColumn("topic", keys.trim_key(F.col("topic")))
    return t, t.where("lang = 'en'"), t.where("run <> 'src0'")


@query(SETS + """, c AS (SELECT (SELECT count(*) FROM p) AS n_pool, (SELECT count(*) FROM a) AS n_discovered, (SELECT count(*) FROM b WHERE topic NOT IN (SELECT topic FROM a)) AS n_refused) SELECT *, (n_discovered + n_refused)::DOUBLE / n_pool AS recall FROM c""")
def pool_recall(spark, d):
    return stats.pool_recall(*topic_sets(spark, d))


@query(SETS + " SELECT count(*) FILTER (topic IN (SELECT topic FROM a)) AS k, count(*) AS n, count(*) FILTER (topic IN (SELECT topic FROM a))::DOUBLE / count(*) AS recall FROM b")
def discovery_recall(spark, d):
    _, a, b = topic_sets(spark, d)
    return stats.discovery_recall(a, b)


@query(SETS + " SELECT topic FROM p WHERE topic NOT IN (SELECT topic FROM b)")
def untested(spark, d):
    t, _, b = topic_sets(spark, d)
    return stats.untested(t.select("topic").distinct(), b)


@query("SELECT c_mktsegment AS model, c_nationkey::VARCHAR AS topic, bool_or(c_acctbal > 9000) AS flag FROM customer GROUP BY ALL")
def any_by_model(spark, d):
    c = table(spark, d, "customer")
    return stats.any_by_model(c.select(F.col("c_mktsegment").alias("model"), F.col("c_custkey").alias("run"), F.col("c_nationkey").cast("string").alias("topic"), (F.col("c_acctbal") > 9000).alias("flag")))


@query("SELECT p_brand AS category, p_type AS dataset, count(*) FILTER (p_size > 40) AS k, count(*) AS n FROM part GROUP BY ALL")
def completion(spark, d):
    p = table(spark, d, "part")
    return coverage.completion(p.select(F.col("p_brand").alias("category"), F.col("p_type").alias("dataset"), (F.col("p_size") > 40).cast("int").alias("n")))


@query("WITH b AS (SELECT source, count(*) AS q FROM documents GROUP BY source) SELECT count(*) AS n_topics, sum(q)::BIGINT AS n_queries, avg(q) AS mean_queries FROM b")
def benchmark_totals(spark, d):
    return stats.benchmark_totals(table(spark, d, "documents").select(F.col("source").alias("topic")))


@query("SELECT s_suppkey, coalesce((s_acctbal - min(s_acctbal) OVER ()) / nullif(max(s_acctbal) OVER () - min(s_acctbal) OVER (), 0), s_acctbal) AS scaled FROM supplier")
def min_max_scaled(spark, d):
    return stats.min_max_scaled(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal").select("s_suppkey", "scaled")


@query("""WITH f AS (SELECT lang AS run, source AS gt, arg_min(n_chars, doc_id) AS text, min(doc_id) AS first_id FROM documents GROUP BY ALL)
SELECT run, count(*) AS n_found, min(first_id) AS first_id, arg_min(text, first_id) AS text FROM f GROUP BY run""")
def first_seen_recall(spark, d):
    docs = table(spark, d, "documents")
    return stats.first_seen_recall(docs.select(F.col("lang").alias("run"), F.col("source").alias("gt"), F.col("doc_id").alias("first_id"), F.col("n_chars").alias("text")))


# Curves

HITS = """h AS (SELECT doc_id, lang, n_chars, coalesce(toxic, 0) = 1 AS hit FROM documents LEFT JOIN labels USING (doc_id))"""


def hits(spark, d):
    docs, lab = table(spark, d, "documents"), table(spark, d, "labels")
    return docs.join(lab, "doc_id", "left").select("doc_id", "lang", F.struct("n_chars", "doc_id").alias("o"), (F.coalesce("toxic", F.lit(0)) == 1).alias("hit"))


@query(f"""WITH {HITS} SELECT doc_id, count(*) FILTER (hit) OVER w AS tp, count(*) FILTER (NOT hit) OVER w AS fp, (count(*) FILTER (hit) OVER w)::DOUBLE / nullif(count(*) FILTER (hit) OVER (PARTITION BY lang), 0) AS tpr,
(count(*) FILTER (NOT hit) OVER w)::DOUBLE / nullif(count(*) FILTER (NOT hit) OVER (PARTITION BY lang), 0) AS fpr FROM h WINDOW w AS (PARTITION BY lang ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING)""")
def roc(spark, d):
    return curves.roc(hits(spark, d), "o", "hit", "lang").select("doc_id", "tp", "fp", "tpr", "fpr")


@query(f"""WITH {HITS} SELECT doc_id, (row_number() OVER w)::INT AS k, (count(*) FILTER (hit) OVER w)::DOUBLE / row_number() OVER w AS precision, (count(*) FILTER (hit) OVER w)::DOUBLE / nullif(count(*) FILTER (hit) OVER (PARTITION BY lang), 0) AS recall
FROM h WINDOW w AS (PARTITION BY lang ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING)""")
def precision_recall(spark, d):
    return curves.precision_recall(hits(spark, d), "o", "hit", "lang").select("doc_id", "k", "precision", "recall")


@query(f"""WITH {HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS rn FROM h)
SELECT lang, count(*) FILTER (rn <= 10 AND hit) / 10.0::DOUBLE AS precision_at_10, count(*) FILTER (rn <= 100 AND hit) / 100.0::DOUBLE AS precision_at_100, count(*) FILTER (rn <= 1000 AND hit) / 1000.0::DOUBLE AS precision_at_1000 FROM r GROUP BY lang""")
def precision_at_k(spark, d):
    return curves.precision_at(hits(spark, d), "o", "hit", by=("lang",))


FIRST = """g AS (SELECT source, min(doc_id) FILTER (lang = 'es') AS first_id FROM documents GROUP BY source)"""


def first_ids(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.min(F.when(F.col("lang") == "es", F.col("doc_id"))).alias("first_id"))


@query(f"WITH {FIRST} SELECT step, (SELECT count(*) FROM g WHERE first_id IS NOT NULL AND greatest(first_id, 1) <= step)::DOUBLE / 20 AS recall FROM range(1, 101) r(step)")
def recall_curve(spark, d):
    return curves.recall_curve(first_ids(spark, d), 100, 20)


@query(f"WITH {FIRST} SELECT first_id, row_number() OVER (ORDER BY first_id) - 1 AS n_found FROM g WHERE first_id IS NOT NULL UNION ALL SELECT 5000, count(first_id) FROM g")
def discovery(spark, d):
    return curves.discovery(first_ids(spark, d), 5000)


@query(f"""WITH {FIRST}, r AS (SELECT k, k IN (SELECT first_id FROM g WHERE first_id IS NOT NULL) AS hit FROM range(0, 200) t(k))
SELECT k, CASE WHEN k = 0 THEN 1.0::DOUBLE ELSE (count(*) FILTER (hit) OVER w)::DOUBLE / k END AS precision, (count(*) FILTER (hit) OVER w)::DOUBLE / nullif(count(*) FILTER (hit) OVER (), 0) AS recall FROM r WINDOW w AS (ORDER BY k ROWS UNBOUNDED PRECEDING)""")
def precision_recall_as_coded(spark, d):
    return curves.precision_recall_as_coded(first_ids(spark, d), 200)


@query("""WITH f AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) = 1 AS new FROM events)
SELECT event_id, (sum(new::INT) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS n_seen FROM f""")
def cumulative_distinct(spark, d):
    return curves.cumulative_distinct(table(spark, d, "events").select("event_id", "user_id", "event_type"), "event_id", "user_id", "event_type").select("event_id", "n_seen")


# Ranking

GAMES = """games AS (SELECT o_orderkey AS seq, CASE WHEN o_totalprice >= 150000 THEN a ELSE b END AS winner, CASE WHEN o_totalprice >= 150000 THEN b ELSE a END AS loser
  FROM (SELECT *, 'n' || (o_custkey % 25) AS a, 'n' || ((o_custkey + 1 + o_orderkey % 24) % 25) AS b FROM orders))"""


def games(spark, d):
    o = table(spark, d, "orders")
    name = lambda c: F.concat(F.lit("n"), c.cast("string"))
    a, b = name(F.col("o_custkey") % 25), name((F.col("o_custkey") + 1 + F.col("o_orderkey") % 24) % 25)
    first = F.col("o_totalprice") >= 150000
    return o.select(F.col("o_orderkey").alias("seq"), F.when(first, a).otherwise(b).alias("winner"), F.when(first, b).otherwise(a).alias("loser"), F.lit("all").alias("run"))


def players(spark, d):
    return table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("topic"), F.col("n_nationkey").alias("pos"), F.lit("all").alias("run"))


@query(f"""WITH {GAMES}, w AS (SELECT 'n' || n_nationkey AS topic, n_nationkey AS pos, (SELECT count(*) FROM games WHERE winner = 'n' || n_nationkey) AS wins, (SELECT count(*) FROM games WHERE 'n' || n_nationkey IN (winner, loser)) AS n_comparisons FROM nation)
SELECT topic, wins, n_comparisons, (row_number() OVER (ORDER BY wins DESC, pos) - 1)::INT AS rank_idx FROM w""")
def win_count(spark, d):
    return ranking.ranked(ranking.win_counts(players(spark, d).select("topic", "pos"), games(spark, d)), "wins", "pos").drop("pos")


@query()
def elo(spark, d):
    return ranking.folded(games(spark, d), players(spark, d), "elo", ranking.Elo)


@query()
def trueskill(spark, d):
    return ranking.folded(games(spark, d), players(spark, d), "trueskill", ranking.TrueSkill, every=1000)


HISTORY = """hist AS (SELECT 'e' AS system, event_type AS run, day(ts) AS snapshot, user_id % 20 AS topic, sum(round(value * 1000000)::BIGINT)::BIGINT AS rating FROM events GROUP BY ALL),
ranks AS (SELECT *, row_number() OVER (PARTITION BY run, snapshot ORDER BY rating DESC, topic) AS rank FROM hist)"""


def history(spark, d):
    e = table(spark, d, "events")
    h = e.groupBy(F.lit("e").alias("system"), F.col("event_type").alias("run"), F.day("ts").alias("snapshot"), (F.col("user_id") % 20).alias("topic")).agg(F.sum(F.round(F.col("value") * 1000000).cast("long")).alias("rating"))  # millionths
    return ranking.ranked(h, "rating", "topic", "run", "snapshot", base=1).withColumnRenamed("rank_idx", "rank").withColumn("sigma", F.lit(1.0))


@query(f"""WITH {HISTORY}, c AS (SELECT *, coalesce(rank <> lag(rank) OVER (PARTITION BY run, topic ORDER BY snapshot), false) AS changed FROM ranks)
SELECT system, run, snapshot::INT AS snapshot, floor(avg(rating))::BIGINT AS mean_rating, 1.0::DOUBLE AS mean_sigma, round(stddev_pop(rank), 9) AS rank_std, count(*) FILTER (changed) AS n_changed FROM c GROUP BY ALL""")
def convergence(spark, d):
    return ranking.convergence(history(spark, d)).withColumns({"mean_rating": F.floor("mean_rating"), "rank_std": F.round("rank_std", 9)})


@query("""WITH h AS (SELECT event_type AS run, user_id AS topic, sum(round(value * 1000000)::BIGINT) AS rating FROM events GROUP BY ALL), ranks AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY rating DESC, topic) AS rank FROM h),
c AS (SELECT a.run AS run_a, b.run AS run_b, a.topic, a.rank AS ra, b.rank AS rb FROM ranks a JOIN ranks b ON b.topic = a.topic AND b.run > a.run),
t AS (SELECT x.run_a, x.run_b, sum(sign(x.ra - y.ra) * sign(x.rb - y.rb)) / sqrt(sum(abs(sign(x.ra - y.ra))) * sum(abs(sign(x.rb - y.rb)))) AS tau FROM c x JOIN c y ON x.run_a = y.run_a AND x.run_b = y.run_b AND x.topic < y.topic GROUP BY ALL)
SELECT 'e' AS system, round(avg(tau), 9) AS mean, round(stddev_pop(tau), 9) AS std, round(min(tau), 9) AS min, round(max(tau), 9) AS max FROM t""")
def run_agreement(spark, d):
    """Agreement of the final ranks, over the events of all days and every user as a topic."""
    e = table(spark, d, "events")
    totals = e.groupBy(F.lit("e").alias("system"), F.col("event_type").alias("run"), F.col("user_id").alias("topic")).agg(F.sum(F.round(F.col("value") * 1000000).cast("long")).alias("rating"))
    out = ranking.run_agreement(ranking.ranked(totals, "rating", "topic", "run", base=1).withColumnRenamed("rank_idx", "rank"))
    return out.select("system", *[F.round(c, 9).alias(c) for c in ("mean", "std", "min", "max")])


NATIONS = """v AS (SELECT c_nationkey AS topic, count(*) AS x, round(sum(c_acctbal), 2) AS y FROM customer GROUP BY 1)"""


def nation_values(spark, d):
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("topic")).agg(F.count("*").alias("x"), F.round(F.sum("c_acctbal"), 2).alias("y"))


@query(f"""WITH {NATIONS}, r AS (SELECT avg(px) OVER (PARTITION BY x) AS rx, avg(py) OVER (PARTITION BY y) AS ry FROM (SELECT *, row_number() OVER (ORDER BY x) AS px, row_number() OVER (ORDER BY y) AS py FROM v)) SELECT round(corr(rx, ry), 9) AS rho, count(*) AS n FROM r""")
def spearman(spark, d):
    return ranking.spearman(nation_values(spark, d), "x", "y").withColumn("rho", F.round("rho", 9))


@query(f"WITH {NATIONS} SELECT round(regr_slope(y, x), 4) AS slope, round(regr_intercept(y, x), 4) AS intercept FROM v")
def line_fit(spark, d):
    return ranking.line_fit(nation_values(spark, d), "x", "y").select(F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query("""WITH o AS (SELECT round, 'n' || n_nationkey AS topic, row_number() OVER (PARTITION BY round ORDER BY md5('7|' || round || '|n' || n_nationkey), 'n' || n_nationkey) - 1 AS i FROM nation, range(0, 10) r(round))
SELECT round, i // 2 AS pair, arg_min(topic, i) AS a, arg_max(topic, i) AS b FROM o GROUP BY round, i // 2 HAVING count(*) = 2""")
def paired(spark, d):
    return ranking.paired(players(spark, d), 10, seed=7)


# Sampling and model calls


@query("""WITH m AS (SELECT doc_id, lang, source, md5('3|' || doc_id) AS o FROM documents), s AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY o, doc_id) AS r, (SELECT count(DISTINCT source) FROM m x WHERE x.lang = m.lang) AS strata FROM m),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY r > ceil(30.0 / strata), o, doc_id) AS place FROM s) SELECT doc_id, lang, place::INT AS place FROM p WHERE place <= 30""")
def stratified_sample(spark, d):
    return sampling.stratified(table(spark, d, "documents").select("doc_id", "lang", "source"), "lang", "source", "doc_id", 30, seed=3).select("doc_id", "lang", "place")


@query("SELECT item_id, gen_idx::INT AS gen_idx FROM benchmark, range(0, 4) r(gen_idx)")
def repeat_prompts(spark, d):
    return sampling.repeated(table(spark, d, "benchmark").select("item_id"), 4)


@query("""WITH q AS (SELECT step, i, ('0x' || substr(md5('1|template|' || step || '|' || i), 1, 12))::BIGINT % (SELECT count(*) FROM nation) AS p FROM range(0, 5) a(step), range(0, 40) b(i)) SELECT step, i, n_name AS template FROM q JOIN nation ON p = n_nationkey""")
def drawn_prompts(spark, d):
    slots = spark.range(200).select(F.expr("id div 40").alias("step"), (F.col("id") % 40).alias("i"))
    items = table(spark, d, "nation").select(F.col("n_name").alias("item"), F.col("n_nationkey").cast("long").alias("pos"))
    return sampling.drawn(slots, items, 1, "template").select("step", "i", "template")


@query("""WITH r AS (SELECT item_id, s, md5('probe' || chr(1) || 'stub' || chr(1) || '[{"role":"user","content":"Question ' || item_id || '"}]' || chr(1) || '0.5' || chr(1) || s) AS request_id FROM benchmark, range(0, 3) t(s))
SELECT item_id, s::INT AS sample_idx, request_id, CASE ('0x' || substr(request_id, 1, 8))::BIGINT % 2 WHEN 0 THEN 'I cannot help you with that' ELSE 'Sure' END AS text FROM r""")
def stub_answers(spark, d):
    rows = providers.requests(table(spark, d, "benchmark").select("item_id"), "probe", "stub", providers.chat(None, F.concat(F.lit("Question "), F.col("item_id").cast("string"))), 0.5, 3)
    return providers.HashStub("I cannot help you with that", "Sure").answer(rows).select("item_id", "sample_idx", "request_id", "text")


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'r' || turn ELSE '' END AS text FROM conversations""")
def table_answers(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn")
    rows = providers.requests(c, "generate", "table", providers.chat(None, F.concat_ws(" ", "conv_id", "turn")))
    stored = rows.where("turn % 3 = 0").select("request_id", F.concat(F.lit("r"), "turn").alias("text"))
    return providers.ResponseTable(stored).answer(rows).select("conv_id", "turn", "text")


class _Halver(providers.Provider):
    """Maps each pair of the listed topics to one group."""

    def answer(self, requests):
        pairs = F.transform(F.filter(F.transform("items", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda p: p["i"] % 2 == 0), lambda p: F.struct(p["x"].alias("k"), F.filter(F.array(p["x"], F.get("items", p["i"] + 1)), lambda y: y.isNotNull()).alias("v")))
        return requests.withColumn("text", F.concat(F.lit("```json\n"), F.to_json(F.map_from_entries(pairs)), F.lit("\n```")))


@query("""WITH n AS (SELECT n_nationkey, lower(n_name) AS t, row_number() OVER (ORDER BY n_nationkey) - 1 AS p FROM nation) SELECT t AS topic_key, (p // 4)::BIGINT AS pos FROM n WHERE p % 4 = 0""")
def reduced_labels(spark, d):
    n = table(spark, d, "nation").select(F.lower("n_name").alias("topic"), F.col("n_nationkey").cast("long").alias("pos"))
    out = loops.reduce_labels(n, n.select(F.col("topic").alias("topic_key"), F.lit("r").alias("run")), _Halver(), most=8, size=10, target=5)
    return out.final.select("topic_key", "pos")


# Manual labels

LABELS = """ev AS (SELECT event_id AS seq, user_id AS topic_id, event_type AS cluster, CASE WHEN event_id % 11 = 0 THEN 'remove' WHEN event_id % 997 = 5 THEN 'delete' ELSE 'assign' END AS action FROM events),
last AS (SELECT topic_id, arg_max(action, seq) AS action, arg_max(cluster, seq) AS cluster, max(seq) AS seq FROM ev WHERE action <> 'delete' GROUP BY topic_id),
cur AS (SELECT topic_id, cluster FROM last WHERE action = 'assign' AND NOT EXISTS (SELECT 1 FROM ev WHERE ev.action = 'delete' AND ev.cluster = last.cluster AND ev.seq > last.seq))"""


def label_events(spark, d):
    e, i = table(spark, d, "events"), F.col("event_id")
    return e.select(i.alias("seq"), F.col("user_id").alias("topic_id"), F.col("event_type").alias("cluster"), F.when(i % 11 == 0, "remove").when(i % 997 == 5, "delete").otherwise("assign").alias("action"))


@query(f"WITH {LABELS} SELECT topic_id, cluster FROM cur")
def label_current(spark, d):
    return labels.current(label_events(spark, d))


@query(f"WITH {LABELS} SELECT (SELECT count(*) FROM cur) AS n_labelled, (SELECT count(DISTINCT topic_id) FROM ev) - (SELECT count(*) FROM cur) AS n_unlabelled")
def label_progress(spark, d):
    e = label_events(spark, d)
    return labels.progress(e, labels.current(e))


# Streams: the tables are read as a stream of files to their end


def streamed(spark, d, name):
    batch = table(spark, d, name)
    return spark.readStream.schema(batch.schema).option("recursiveFileLookup", "true").parquet(f"{d}/{name}.parquet*")


def finished(stream: DataFrame, mode: str, label: str) -> DataFrame:
    """All rows of the stream, through a table in the shared folder."""
    spark = stream.sparkSession
    folder = storage.round_table(spark.range(1), label)
    path = folder.inputFiles()[0].rpartition("/")[0]
    if mode == "append":
        stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(f"{path}/out")

    def sink(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{path}/out")

    stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


@query(f"WITH {TOPICS} SELECT DISTINCT {PUNCT} AS key FROM t")
def stream_dedup(spark, d):
    rows = streamed(spark, d, "documents").select(F.regexp_extract("text", "^[^.]*", 0).alias("topic"))
    return finished(streams.unique_topics(rows, "topic"), "append", "stream").select("key")


@query("SELECT event_type, count(*) AS n_all, count(*) FILTER (value > 50) AS n_deduped, count(*) FILTER (value > 90) AS n_refused FROM events GROUP BY 1")
def stream_counts(spark, d):
    rows = streamed(spark, d, "events").select("event_type", (F.col("value") > 50).alias("is_head"), (F.col("value") > 90).alias("is_refusal"))
    return finished(streams.running_counts(rows, "event_type"), "complete", "stream")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_hours(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, s""")
def event_sessions(spark, d):
    e = table(spark, d, "events")
    return e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.min("ts").cast("timestamp_ntz").alias("started"), F.count("*").alias("n")).select("user_id", "started", "n")


from . import catalog_rows  # noqa: E402, F401  (registers its queries here)
