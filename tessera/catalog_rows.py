"""More registered queries: expressions over texts, row predicates, joins of the evaluation, files that are written and read back.

As in catalog, texts are decorated alike in the query and in its SQL. Queries on files write them to the shared folder
and give what the readers find there.
"""

from __future__ import annotations

import functools
import re
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import storage
from .catalog import EDGES, PUNCT, REFUSALS, TOPICS, answers, edges, query, table
from .functions import keys, names, parsers, text
from .operators import coverage, curves, filters, labels, lineage, matching, ranking, refusal, sampling, scan, stats
from .plans import artifacts, config, evaluation, loops, providers, refusals
from .plans.providers import CallError
from .shipping import by_value
from .sources import readers, reports, versions, writers
from .streaming import streams


def cases(by: Column, *kinds: Column) -> Column:
    """The kind at by (a number from 0)."""
    out = kinds[-1]
    for i, k in list(enumerate(kinds))[-2::-1]:
        out = F.when(by == i, k).otherwise(out)
    return out


def conversations(spark, d) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", "role", "text")


def parts(spark, d) -> DataFrame:
    return table(spark, d, "part")


def folder(spark, label: str) -> str:
    return f"{storage.shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


# Text of answers


@query("""WITH c AS (SELECT conv_id, turn, CASE turn % 2 WHEN 0 THEN text || '漢字' ELSE text END AS x FROM conversations)
SELECT conv_id, turn, CASE WHEN regexp_matches(x, '[\\x{4e00}-\\x{9fff}]') THEN 'han' ELSE 'other' END AS language FROM c""")
def language_partition(spark, d):
    c = conversations(spark, d).withColumn("x", cases(F.col("turn") % 2, F.concat("text", F.lit("漢字")), F.col("text")))
    han, other = filters.by_language(c, "x")
    mark = lambda df, name: df.select("conv_id", "turn", F.lit(name).alias("language"))
    return mark(han, "han").unionByName(mark(other, "other"))


PATTERNS = "|".join(p.replace("'", "''") for p in text.REFUSAL_PATTERNS)


@query(f"""WITH c AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'assistantI''M SORRY, but I cannot ' || text WHEN 1 THEN 'I''m sorry, but I cannot: Assistant ' || text ELSE '很抱歉，我不能' || text END AS x FROM conversations)
SELECT conv_id, turn, regexp_matches(string_split(x, 'ssistant')[-1], '(?i)(?:{PATTERNS})') AS refused FROM c""")
def refusal_legacy(spark, d):
    t = F.col("text")
    x = cases(F.col("turn") % 3, F.concat(F.lit("assistantI'M SORRY, but I cannot "), t), F.concat(F.lit("I'm sorry, but I cannot: Assistant "), t), F.concat(F.lit("很抱歉，我不能"), t))
    return conversations(spark, d).select("conv_id", "turn", text.refusal_legacy(x).alias("refused"))


@query("""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN role || '|' || conv_id WHEN 1 THEN role ELSE '' END AS items FROM conversations""")
def fenced_json(spark, d):
    listed = F.to_json(F.array("role", F.col("conv_id").cast("string")))
    x = cases(F.col("turn") % 3, F.concat(F.lit("see ```json\n"), listed, F.lit("\n``` end")), F.to_json(F.array("role")), F.concat(F.lit("no list "), F.col("text")))
    return conversations(spark, d).select("conv_id", "turn", F.array_join(text.json_strings(x), "|").alias("items"))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_type END AS name FROM part""")
def cluster_answers(spark, d):
    x = cases(F.col("p_size") % 3, F.concat(F.lit('the answer{"'), "p_brand", F.lit('"} "x"')), F.concat(F.lit('My ANSWER: it is "'), "p_type", F.lit('"')), F.concat(F.lit("none of them, "), "p_name"))
    return parts(spark, d).select("p_partkey", text.answer_name(x).alias("name"))


@query("""SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN trim(p_name) WHEN 1 THEN NULL WHEN 2 THEN p_type WHEN 3 THEN 'plain ' || p_brand ELSE p_brand END AS summary FROM part""")
def summary_lines(spark, d):
    kinds = [F.concat(F.lit("Summary:  "), "p_name", F.lit(" \n")), F.lit("a: [SKIP]"), F.lit("note:  \t"), F.concat(F.lit("plain "), "p_brand"), F.concat(F.lit("x: <think>y</think>\n "), "p_brand")]
    return parts(spark, d).select("p_partkey", text.summary_of(cases(F.col("p_size") % 5, *kinds), F.col("p_type")).alias("summary"))


@query("""WITH p AS (SELECT p_partkey, replace(p_type, ' ', '_') AS x FROM part) SELECT p_partkey, upper(left(replace(x, '_', ' '), 1)) || lower(substr(replace(x, '_', ' '), 2)) AS name FROM p""")
def display_names(spark, d):
    return parts(spark, d).select("p_partkey", text.display_name(F.replace("p_type", F.lit(" "), F.lit("_"))).alias("name"))


@query("""WITH p AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'a:b:  ' || p_name || ' ' WHEN 1 THEN 'gt: NONE' ELSE p_brand END AS x FROM part)
SELECT p_partkey, nullif(lower(trim(string_split(x, ':')[-1])), 'none') AS part FROM p""")
def last_parts(spark, d):
    x = cases(F.col("p_size") % 3, F.concat(F.lit("a:b:  "), "p_name", F.lit(" ")), F.lit("gt: NONE"), F.col("p_brand"))
    return parts(spark, d).select("p_partkey", keys.last_part(x).alias("part"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'first long ' || p_brand || '|second long ' || p_brand ELSE 'only long query ' || p_brand || '|1. only long query ' || p_brand END AS items FROM part""")
def listed_queries(spark, d):
    b = F.col("p_brand")
    two = F.concat(F.lit("Topic: of queries\n1. first long "), b, F.lit("\n2. short\n- second long "), b, F.lit("\n3. third long "), b)
    one = F.concat(F.lit("Topic: of queries\n1. only long query "), b, F.lit("\n  a further line "), b, F.lit("\nx"))
    return parts(spark, d).select("p_partkey", F.array_join(text.listed_queries(cases(F.col("p_size") % 2, two, one), 2), "|").alias("items"))


@query("""SELECT p_partkey, p_brand || '|' || p_type || CASE WHEN p_size % 2 = 0 THEN '|' || p_name ELSE '' END AS items, CASE WHEN p_size % 2 = 0 THEN p_name END AS second FROM part""")
def split_translations(spark, d):
    first = F.concat("p_brand", F.lit("  [English: "), "p_type", F.lit("]"))
    items = cases(F.col("p_size") % 2, F.array(first, F.col("p_name")), F.array(first))
    return parts(spark, d).select("p_partkey", F.array_join(text.with_translations(items), "|").alias("items"), text.translation(cases(F.col("p_size") % 2, F.concat(F.lit("x [English:  "), "p_name", F.lit("] y")), F.lit("[English x]"))).alias("second"))


@query(r"""SELECT doc_id, regexp_replace(text, '[^A-Za-z0-9_]', '', 'g') AS label, CASE WHEN length(text) > 50 THEN left(text, 50) || '...' ELSE text END AS short FROM documents""")
def document_labels(spark, d):
    return table(spark, d, "documents").select("doc_id", text.safe_label(F.col("text")).alias("label"), text.shortened(F.col("text")).alias("short"))


@query("""SELECT conv_id, sha256(string_agg(text, ' ' ORDER BY turn, role, text)) AS chat, bool_or(turn % 4 = 3) AS reasoning FROM conversations GROUP BY conv_id""")
def rendered_chats(spark, d):
    rows = conversations(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    chat = text.rendered_chat(F.col("m"))
    opened = F.exists("m", lambda x: x["turn"] % 4 == 3)
    template = F.when(opened & (F.col("conv_id") % 2 == 0), "{x}<think>").otherwise("{x}")
    prompt = F.when(opened & (F.col("conv_id") % 2 == 1), F.concat(chat, F.lit("<think>\n"))).otherwise(chat)
    return rows.select("conv_id", F.sha2(chat, 256).alias("chat"), text.reasoning_template(F.regexp_replace(prompt, r"\s+$", ""), template).alias("reasoning"))


KEYWORDS = ("The ", "tion", "ING", "zzz", "er")


@query(f"""SELECT doc_id, array_to_string(list_filter({list(KEYWORDS)}, lambda k: contains(lower(text), lower(k))), '|') AS hits FROM documents""")
def keyword_hits(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(text.keywords_in(F.col("text"), KEYWORDS), "|").alias("hits"))


@query("""WITH n AS (SELECT n_regionkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS i FROM nation)
SELECT n_regionkey, string_agg(i || '. ' || n_name, chr(10) ORDER BY i) AS dot, string_agg('[' || i || '] ' || n_name, chr(10) ORDER BY i) AS bracket, string_agg('- ' || n_name, chr(10) ORDER BY i) AS dash FROM n GROUP BY 1""")
def numbered_prompts(spark, d):
    rows = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("l"))
    return rows.select("n_regionkey", *[text.numbered(F.col("l"), s).alias(s) for s in ("dot", "bracket", "dash")])


@query("""SELECT conv_id, count(*) FILTER (turn % 3 = 0) * 2 > count(*) AS thinks FROM conversations GROUP BY conv_id""")
def thinking_models(spark, d):
    x = cases(F.col("turn") % 3, F.concat(F.lit("<think>a</think>"), "text"), F.concat(F.lit("<think>"), "text"), F.col("text"))
    return conversations(spark, d).groupBy("conv_id").agg(F.collect_list(x).alias("r")).select("conv_id", text.thinking_share(F.col("r")).alias("thinks"))


# Names and keys


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'openai' WHEN 1 THEN 'ollama' ELSE 'openrouter' END AS provider, CASE p_size % 4 WHEN 0 THEN p_brand || ':x' WHEN 1 THEN p_brand WHEN 2 THEN 'other:' || p_brand ELSE p_brand END AS model FROM part""")
def provider_names(spark, d):
    x = cases(F.col("p_size") % 4, F.concat(F.lit("openai:"), "p_brand", F.lit(":x")), F.concat(F.lit("Ollama:"), "p_brand"), F.concat(F.lit("other:"), "p_brand"), F.col("p_brand"))
    return parts(spark, d).select("p_partkey", names.provider_and_model(x).alias("n")).select("p_partkey", "n.*")


@query("""SELECT n_nationkey, CASE n_name WHEN 'NATION_3' THEN 'fr' WHEN 'NATION_5' THEN 'zh' ELSE n_name END AS name FROM nation""")
def mapped_names(spark, d):
    return table(spark, d, "nation").select("n_nationkey", names.mapped_name(F.col("n_name"), {"NATION_3": "fr", "NATION_5": "zh"}).alias("name"))


@query("""SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'purchase' WHEN bool_or(event_type = 'click') THEN 'click' WHEN bool_or(event_type = 'view') THEN 'view' END AS mode FROM events GROUP BY user_id""")
def preferred_modes(spark, d):
    rows = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("m"))
    return rows.select("user_id", names.preferred(F.col("m"), ("purchase", "click", "view")).alias("mode"))


@query("""SELECT p_partkey, coalesce(nullif(CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END, ''), nullif(CASE WHEN p_size % 3 = 0 THEN p_type END, ''), nullif(CASE WHEN p_size % 5 = 0 THEN p_brand ELSE '' END, ''), 'raw') AS display,
CASE WHEN coalesce(p_size % 2 = 0, false) AND p_size % 3 = 0 THEN p_type || ' (' || p_brand || ')' ELSE p_brand END AS annotated, concat_ws(':', p_brand, CASE WHEN p_size % 3 = 0 THEN p_type END, p_size) AS composite, CASE WHEN p_size < 10 THEN 'warmup' ELSE 'seeded' END AS stage FROM part""")
def display_columns(spark, d):
    size, some = F.col("p_size"), lambda k, c, e: F.when(F.col("p_size") % k == 0, F.col(c)).otherwise(F.lit(e))
    shown = keys.display_text(some(2, "p_name", ""), some(3, "p_type", None), some(5, "p_brand", ""), F.lit("raw"))
    annotated = keys.annotated(F.col("p_brand"), some(3, "p_type", None), size % 2 == 0)
    return parts(spark, d).select("p_partkey", shown.alias("display"), annotated.alias("annotated"), keys.composite(F.col("p_brand"), some(3, "p_type", None), size.cast("string")).alias("composite"), filters.stage(size, 10).alias("stage"))


@query("""SELECT event_id, ['a', 'b', 'c'][event_id % 3 + 1] AS template FROM events""")
def cycled_templates(spark, d):
    return table(spark, d, "events").select("event_id", sampling.cycled(F.array(*map(F.lit, "abc")), F.col("event_id")).alias("template"))


# Probes


@query("""WITH p AS (SELECT p_partkey AS id, p_size % 3 AS k, p_name, p_type, p_brand FROM part)
SELECT id, 0 AS probe_idx, p_name AS query, p_type AS response FROM p WHERE k = 0 UNION ALL SELECT id, 1, p_brand, 'y' FROM p WHERE k = 0
UNION ALL SELECT id, 0, 'Tell me about ' || CASE WHEN k = 1 THEN p_brand ELSE p_name END, NULL FROM p WHERE k <> 0""")
def probe_rows(spark, d):
    size = F.col("p_size") % 3
    none = F.lit(None).cast("array<string>")
    queries = cases(size, F.array(F.col("p_name"), F.lit("  "), F.col("p_brand")), F.array(F.lit(" ")), none)
    responses = cases(size, F.array(F.col("p_type"), F.lit("x"), F.lit("y")), F.array(F.lit("x")), none)
    short = cases(size, F.lit(""), F.col("p_brand"), F.lit(""))
    return refusal.probes(parts(spark, d).select(F.col("p_partkey").alias("id"), queries.alias("refusal_check_queries"), responses.alias("refusal_check_responses"), short.alias("shortened"), F.col("p_name").alias("raw")))


@query("""SELECT p_partkey FROM part WHERE p_size % 2 = 0 AND p_size % 3 <> 0 AND p_size % 5 <> 0 AND p_size % 7 <> 0""")
def qualifying_probes(spark, d):
    no = F.lit("I cannot help you with that")
    p, size = parts(spark, d), F.col("p_size")
    rows = p.select("p_partkey", F.when(size % 5 != 0, F.col("p_name")).alias("query"), F.when(size % 2 == 0, no).otherwise("Sure").alias("response"), F.when(size % 3 == 0, no).when(size % 7 == 0, "").otherwise(F.col("p_name")).alias("message"))
    return refusal.qualifying(rows, "message").select("p_partkey")


# Matches and labels


@query("SELECT p_partkey FROM part WHERE p_size % 3 <> 0")
def unmatched_clusters(spark, d):
    flag = F.when(F.col("p_size") % 3 == 0, True).when(F.col("p_size") % 3 == 1, False)
    return filters.unmatched(parts(spark, d).withColumn("is_match", flag)).select("p_partkey")


@query("""SELECT p.p_partkey AS topic, CASE WHEN p_size < 20 THEN p_size % 2 = 0 END AS is_match, CASE WHEN p_size < 20 THEN p_brand END AS matched FROM part p""")
def ranked_matches(spark, d):
    p = parts(spark, d).withColumnRenamed("p_partkey", "topic")
    answers = p.where("p_size < 20").select("topic", (F.col("p_size") % 2 == 0).alias("flag"), F.array("p_brand").alias("matched"))
    return matching.ranked_matches(p.select("topic"), answers).select("topic", "is_match", F.col("matched_topics")[0].alias("matched"))


@query("""SELECT p_partkey AS cluster, CASE WHEN p_size % 4 = 0 THEN 'residual:residual:' || p_type ELSE p_brand END AS gt FROM part""")
def residual_clusters(spark, d):
    p = parts(spark, d).withColumn("cluster", F.col("p_partkey").cast("string"))
    found = p.where("p_size % 4 = 0").select(F.concat(F.lit("ab:"), "cluster").alias("id"), F.col("p_type").alias("name"))
    return matching.residual_update(p.select("cluster", F.col("p_brand").alias("gt")), found).select(F.col("cluster").cast("long").alias("cluster"), "gt")


@query("""SELECT c_custkey, coalesce(CASE WHEN n_nationkey % 2 = 0 THEN n_name END, c_nationkey::VARCHAR) AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def mapped_with_fallback(spark, d):
    mapping = table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("string").alias("nation"), F.col("n_name").alias("final"))
    return matching.with_fallback(table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("nation")), mapping, "nation")


@query("""SELECT r_name AS parent, n_name AS child, 1 AS level FROM region JOIN nation ON r_regionkey = n_regionkey UNION SELECT n_name, s_name, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def hierarchy_edges(spark, d):
    n, r, s = (table(spark, d, t) for t in ("nation", "region", "supplier"))
    final = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_name").alias("head"), F.col("r_name").alias("label"))
    both = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.col("s_name").alias("topic"), F.col("n_name").alias("head"))
    return lineage.tree_edges(final, both, both.select("topic", F.lit("f").alias("file")))


@query("""WITH c AS (SELECT conv_id, turn, CASE turn % 2 WHEN 0 THEN '漢' || text ELSE text END AS x FROM conversations),
n AS (SELECT *, lead(x) OVER (PARTITION BY conv_id ORDER BY turn) AS y FROM c) SELECT conv_id, turn, turn % 2 = 0 AND y IS NOT NULL AND NOT contains(y, '漢') AS has_translation FROM n""")
def translation_pairs(spark, d):
    c = conversations(spark, d).withColumn("x", cases(F.col("turn") % 2, F.concat(F.lit("漢"), "text"), F.col("text")))
    return curves.translation_pairs(c, "turn", "x", "conv_id").select("conv_id", "turn", "has_translation")


@query("""SELECT p_partkey FROM part WHERE lower(p_name) NOT IN (SELECT lower(p_name) FROM part WHERE p_size < 25)""")
def untraced_topics(spark, d):
    p = parts(spark, d).withColumnRenamed("p_name", "topic")
    return lineage.untraced(p.select("p_partkey", "topic"), p.where("p_size < 25").select(F.concat(F.lit("  "), F.upper("topic")).alias("origin"))).select("p_partkey")


@query("""SELECT true AS same_as_itself, (SELECT count(*) FROM (SELECT p_brand FROM part EXCEPT SELECT p_brand FROM part WHERE p_size < 3)) = 0 AS same_as_some, (SELECT count(*) = count(DISTINCT p_partkey) FROM part) AS keys_unique, (SELECT count(*) = count(DISTINCT p_brand) FROM part) AS brands_unique""")
def label_checks(spark, d):
    p = parts(spark, d)
    gt = lambda df: df.select(F.col("p_brand").alias("gt")).distinct()
    flags = (matching.same_labels(gt(p), gt(p)), matching.same_labels(gt(p), gt(p.where("p_size < 3"))), stats.is_unique(p, "p_partkey"), stats.is_unique(p, "p_brand"))
    return spark.createDataFrame([flags], "same_as_itself boolean, same_as_some boolean, keys_unique boolean, brands_unique boolean")


@query("""SELECT p_partkey AS topic_id, CASE WHEN p_brand LIKE '%1' THEN 'new ' || p_brand ELSE p_brand END AS cluster FROM part""")
def renamed_labels(spark, d):
    p = parts(spark, d).select(F.col("p_partkey").alias("topic_id"), F.col("p_brand").alias("cluster"))
    new = p.where("cluster like '%1'").select("cluster", F.concat(F.lit("new "), "cluster").alias("new_cluster")).distinct()
    return labels.renamed(p, new)


# Files


def crawl_log_files(spark, d) -> DataFrame:
    """The logs of the sources: documents as topics, a JSON document for each part of a source's log, written and read back."""
    docs, lab = table(spark, d, "documents"), table(spark, d, "labels")
    rows = docs.join(lab, "doc_id", "left").select(
        "source", F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 7 != 0, F.col("text")).alias("raw"), F.col("lang").alias("english"), (F.col("lang") == "fr").alias("is_chinese"), F.lit(True).alias("is_head"), (F.col("toxic") == 1).alias("is_refusal"), F.concat(F.lit(" s "), (F.col("doc_id") % 50).cast("string")).alias("summary")
    )
    # Topics of a part are gathered once; its other lists are taken from them row by row.
    topic = F.struct("id", "raw", "english", "is_chinese", "is_head", "is_refusal", "summary")
    gathered = writers.log_parts(rows, "id", F.coalesce(F.octet_length("raw"), F.lit(0)) + 200, "source").groupBy("source", "part").agg(F.array_sort(F.collect_list(topic)).alias("heads"))
    taken = lambda test: F.filter("heads", test)
    logs = gathered.select("source", "heads", taken(lambda t: t["is_refusal"]).alias("refused"), taken(lambda t: t["id"] % 2 == 0).alias("even"), taken(lambda t: t["id"] % 2 == 1).alias("odd"))
    history = F.struct(F.array(F.size("heads"), F.size("even")).alias("all_per_step"), F.array(F.size("heads"), F.size("odd")).alias("deduped_per_step"), F.array(F.size("refused"), F.lit(0)).alias("refusal_per_step"))
    topics = F.struct(F.col("refused").alias("head_refusal_topics"), F.col("heads").alias("head_topics"), F.array("even", "odd").alias("cluster_topics"))
    document = logs.select("source", F.struct(history.alias("history")).alias("stats"), F.struct(topics.alias("topics")).alias("queue"), F.transform("refused", lambda t: t["summary"]).alias("head_refusal_topics_summaries"))
    path = folder(spark, "logs")
    document.write.option("maxRecordsPerFile", 1).partitionBy("source").json(path)
    return readers.crawl_logs(spark, path).withColumn("run_id", F.regexp_extract("path", "source=([^/]*)", 1))


@query("""SELECT source AS run_id, doc_id AS id, CASE WHEN doc_id % 7 <> 0 THEN text END AS raw, lang AS english, toxic = 1 AS is_refusal FROM documents LEFT JOIN labels USING (doc_id)""")
def crawl_log_topics(spark, d):
    return readers.topics(crawl_log_files(spark, d)).select("run_id", "id", "raw", "english", "is_refusal")


@query("""SELECT source AS log_file_name, text AS topic_summary FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND doc_id % 7 <> 0""")
def crawl_log_raw_topics(spark, d):
    return readers.raw_topics(crawl_log_files(spark, d))


@query("""SELECT DISTINCT source AS run_id, 's ' || doc_id % 50 AS topic FROM documents""")
def discovered_topics(spark, d):
    return readers.discovered(crawl_log_files(spark, d), "heads")


@query("""WITH s AS (SELECT source, count(*) AS n, count(*) FILTER (doc_id % 2 = 0) AS even, count(*) FILTER (doc_id % 2 = 1) AS odd, count(*) FILTER (toxic = 1) AS refused FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source)
SELECT source AS run_id, 0 AS step, n AS n_all, n AS n_deduped, refused AS n_refused FROM s UNION ALL SELECT source, 1, even, odd, 0 FROM s""")
def crawl_log_steps(spark, d):
    return readers.steps(crawl_log_files(spark, d), parts=True)


def nation_map(spark, d) -> DataFrame:
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("l"))


def text_file(spark, df: DataFrame, label: str) -> str:
    path = folder(spark, label)
    df.coalesce(1).write.text(path)
    return path


NATION_POS = "n AS (SELECT r_name, n_name, row_number() OVER (PARTITION BY r_name ORDER BY n_name) - 1 AS i FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query(f"WITH {NATION_POS} SELECT r_name AS category, n_name AS subtopic, i::INT AS pos FROM n")
def ground_truth_file(spark, d):
    document = nation_map(spark, d).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("r_name", "l")))).alias("value"))
    return readers.ground_truth(spark, text_file(spark, document, "truth"))


@query("SELECT n_name AS topic FROM nation")
def keyword_file(spark, d):
    document = table(spark, d, "nation").agg(F.to_json(F.struct(F.collect_list("n_name").alias("keywords"))).alias("value"))
    return readers.ground_truth_keywords(spark, text_file(spark, document, "keywords"))


@query("SELECT r_name AS category, n_name AS subcategory, s_name AS prompt FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def benchmark_file(spark, d):
    n, r, s = (table(spark, d, t) for t in ("nation", "region", "supplier"))
    rows = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).groupBy("r_name", "n_name").agg(F.collect_list("s_name").alias("l"))
    inner = rows.groupBy("r_name").agg(F.map_from_entries(F.collect_list(F.struct("n_name", "l"))).alias("m"))
    document = inner.agg(F.to_json(F.create_map(F.lit("prompts"), F.map_from_entries(F.collect_list(F.struct("r_name", "m"))))).alias("value"))
    return readers.benchmark(spark, text_file(spark, document, "benchmark"))


@query(f"WITH {NATION_POS} SELECT r_name AS meta_cluster, i::INT AS pos, n_name AS query FROM n")
def benchmark_topics_file(spark, d):
    document = nation_map(spark, d).agg(F.to_json(F.struct(F.count("*").alias("num_meta_clusters"), F.collect_list(F.struct(F.col("r_name").alias("meta_cluster"), F.col("l").alias("queries"))).alias("topics"))).alias("value"))
    return readers.benchmark_topics(spark, text_file(spark, document, "benchmark-topics"))


@query("""SELECT r_name AS meta, CASE WHEN r_regionkey % 2 = 0 THEN 'sub ' || n_regionkey END AS sub, n_name AS raw, 'log' || n_nationkey || '.json' AS log_file FROM nation JOIN region ON n_regionkey = r_regionkey""")
def meta_cluster_file(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    pair = F.concat(F.lit('[{"raw":'), F.to_json(F.array("n_name")).substr(F.lit(2), F.length(F.to_json(F.array("n_name"))) - 2), F.lit('},"log'), "n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, '.json"]').otherwise('"]'))
    rows = n.join(r, n["n_regionkey"] == r["r_regionkey"]).groupBy("r_name", "r_regionkey").agg(F.concat(F.lit("["), F.array_join(F.collect_list(pair), ","), F.lit("]")).alias("l"))
    entry = F.concat(F.lit('"'), "r_name", F.lit('":'), F.when(F.col("r_regionkey") % 2 == 0, F.concat(F.lit('{"sub '), "r_regionkey", F.lit('":'), "l", F.lit("}"))).otherwise(F.col("l")))
    document = rows.agg(F.concat(F.lit("{"), F.array_join(F.collect_list(entry), ","), F.lit("}")).alias("value"))
    found = readers.meta_clusters(spark, text_file(spark, document, "meta"))
    return found.select("meta", "sub", F.get_json_object("topic", "$.raw").alias("raw"), "log_file")


@query("""SELECT topic, min(line) AS first_id FROM (SELECT unnest([n_name, 'x' || n_nationkey % 3]) AS topic, n_nationkey AS line FROM nation) GROUP BY topic""", )
def topic_line_file(spark, d):
    lines_ = table(spark, d, "nation").orderBy("n_nationkey").select(F.to_json(F.array("n_name", F.concat(F.lit("x"), F.col("n_nationkey") % 3))).alias("value"))
    return readers.topic_lines(spark, text_file(spark, lines_, "lines")).withColumn("first_id", F.col("first_id").cast("int"))


@query("SELECT p_partkey, p_name, p_retailprice FROM part")
def csv_file(spark, d):
    path = folder(spark, "csv")
    writers.csv_rows(parts(spark, d).select("p_partkey", "p_name", "p_retailprice"), path)
    return readers.csv_table(spark, path, "p_partkey bigint, p_name string, p_retailprice double")


@query("SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def transcript_rows(spark, d):
    """Two appends and none without a path, read back."""
    rows, path = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), folder(spark, "log")
    for half in (rows.where("s_suppkey % 2 = 0"), rows.where("s_suppkey % 2 = 1")):
        writers.append_log(half, path)
        writers.append_log(half, None)
    return spark.read.schema(rows.schema).json(path)


@query("SELECT c_custkey, c_mktsegment AS run_id, CASE WHEN c_mktsegment = 'BUILDING' THEN 2 ELSE 1 END AS version FROM customer")
def run_state_table(spark, d):
    """All runs, then one run anew: the others' partitions stay."""
    rows, path = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("run_id")), folder(spark, "state")
    writers.run_state(rows.withColumn("version", F.lit(1)), path)
    writers.run_state(rows.where("run_id = 'BUILDING'").withColumn("version", F.lit(2)), path)
    return spark.read.parquet(path).select("c_custkey", "run_id", "version")


@query("SELECT s_suppkey, 1 AS made FROM supplier")
def cached_table(spark, d):
    path = folder(spark, "cache")
    for i in (1, 2):
        out = writers.cached(spark, path, lambda: table(spark, d, "supplier").select("s_suppkey", F.lit(i).alias("made")))
    return out


@query("SELECT DISTINCT p_type AS value FROM part")
def text_list_file(spark, d):
    path = folder(spark, "list")
    writers.text_list(parts(spark, d).select("p_type").distinct(), "p_type", path)
    return spark.read.text(path)


@query(r"""SELECT sha256('\begin{longtable}{ll}' || chr(10) || 'n\_name & n\_regionkey \\' || chr(10) || '\hline' || chr(10) || string_agg(replace(n_name, '_', '\_') || ' & ' || n_regionkey || ' \\' || chr(10), '' ORDER BY n_name) || '\end{longtable}' || chr(10)) AS latex FROM nation""")
def latex_report(spark, d):
    out = writers.latex_table(table(spark, d, "nation").orderBy("n_name"), ["n_name", "n_regionkey"])
    return spark.createDataFrame([(out,)], "x string").select(F.sha2("x", 256).alias("latex"))


@query("""WITH n AS (SELECT r_name, string_agg('  - ' || n_name, chr(10) ORDER BY n_name) AS l FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name) SELECT sha256(string_agg('- ' || r_name || chr(10) || l, chr(10) ORDER BY r_name)) AS markdown FROM n""")
def markdown_report(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    out = writers.markdown_tree(n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("r_name").alias("parent"), F.col("n_name").alias("child")))
    return spark.createDataFrame([(out,)], "x string").select(F.sha2("x", 256).alias("markdown"))


@query("""SELECT s_nationkey AS run_id, '{"id":' || s_suppkey || ',"raw":"' || s_name || '","summary":null}' AS topic FROM supplier""")
def topic_documents(spark, d):
    return writers.topic_json(table(spark, d, "supplier").select(F.col("s_nationkey").alias("run_id"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("raw"), F.lit(None).cast("string").alias("summary")))


# Model calls


@query("""WITH r AS (SELECT item_id, s AS gen_idx, md5('generate' || chr(1) || 'm' || chr(1) || '[{"role":"user","content":"Q ' || item_id || ' ' || s || '"}]' || chr(1) || '0.6' || chr(1) || 0) AS request_id FROM benchmark, range(0, 5) t(s)),
a AS (SELECT item_id, ('0x' || substr(request_id, 1, 8))::BIGINT % 3 = 0 AS refused FROM r) SELECT item_id, count(*) AS n, count(*) FILTER (refused) AS n_refused, avg(refused::INT) > 0.25 AS is_refusal FROM a GROUP BY item_id""")
def probed_items(spark, d):
    """Five answers of a stub to each benchmark item, judged by the openings, and the vote."""
    rows = sampling.repeated(table(spark, d, "benchmark").select("item_id"), 5)
    prompt = F.concat(F.lit("Q "), F.col("item_id").cast("string"), F.lit(" "), F.col("gen_idx").cast("string"))
    asked = providers.HashStub("I cannot help you with that", "Sure", "Yes: ").answer(providers.requests(rows, "generate", "m", providers.chat(None, prompt), 0.6))
    judged = asked.withColumn("refused", F.coalesce(text.refusal_fast(F.col("text")), F.lit(False)))
    return refusal.vote(judged, "item_id")


REFUSED = "I cannot help you with that"


@query("""WITH b AS (SELECT p_brand AS id, avg((p_size % 5 = 0)::INT) AS declined, avg((p_size % 4 = 0)::INT) FILTER (p_size % 5 <> 0) AS share FROM part GROUP BY p_brand), f AS (SELECT *, declined > 0.25 OR share IS NULL AS fallback FROM b)
SELECT id, CASE WHEN fallback THEN id LIKE '%1' ELSE share > 0.25 END AS is_refusal, fallback AS judge_refused FROM f""")
def self_refusals(spark, d):
    p, no = parts(spark, d), F.lit(REFUSED)
    rows = p.select(F.col("p_brand").alias("id"), F.when(F.col("p_size") % 5 == 0, no).otherwise(F.col("p_name")).alias("query"), F.when(F.col("p_size") % 4 == 0, no).otherwise("Sure").alias("response"))
    probe = p.select(F.col("p_brand").alias("id")).distinct().select("id", F.when(F.endswith("id", F.lit("1")), no).otherwise("Sure").alias("response"))
    return refusal.self_refused(rows, probe)


@query("""WITH s AS (SELECT i, n, ('0x' || substr(md5('3|a|' || i), 1, 12))::BIGINT % n AS pa, ('0x' || substr(md5('3|b|' || i), 1, 12))::BIGINT % (n - 1) AS step FROM range(0, 500) t(i), (SELECT count(*) AS n FROM nation))
SELECT i, a.n_name AS a, b.n_name AS b FROM s JOIN nation a ON a.n_nationkey = pa JOIN nation b ON b.n_nationkey = (pa + 1 + step) % n""")
def random_pairs(spark, d):
    return ranking.random_pairs(table(spark, d, "nation").select(F.col("n_name").alias("topic"), F.col("n_nationkey").cast("long").alias("pos")), 500, 3)


@query("""SELECT p_partkey, p_size % 2 = 0 AND p_size % 3 > 0 AND (p_size > 20 OR p_size % 5 <> 0) AS seeded FROM part""")
def seeded_prompts(spark, d):
    size = F.col("p_size")
    return parts(spark, d).select("p_partkey", filters.uses_seeds(size % 2 == 0, size % 3, F.when(size > 20, True), size % 5 == 0).alias("seeded"))


@query("""SELECT c_nationkey, array_to_string(list(c_name ORDER BY c_custkey)[:3], '|') AS shown FROM customer GROUP BY 1""")
def first_samples(spark, d):
    rows = table(spark, d, "customer").groupBy("c_nationkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))), lambda x: x["c_name"]).alias("l"))
    return rows.select("c_nationkey", F.array_join(filters.samples(F.col("l")), "|").alias("shown"))


@query("""WITH s AS (SELECT source, count(*) AS n, count(*) FILTER (doc_id % 2 = 0) AS even, count(*) FILTER (toxic = 1) AS refused FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source)
SELECT source AS run_id, 2 AS n_steps, (n + even) / 2 AS topics_per_step, refused / (n + even + 1e-10) AS refusal_rate FROM s""")
def step_averages(spark, d):
    return stats.step_averages(readers.steps(crawl_log_files(spark, d), parts=True), "run_id").withColumn("n_steps", F.col("n_steps").cast("int"))


@query("""SELECT 'p_size' AS column, sum(p_size)::DOUBLE AS total, count(p_size) AS n FROM part UNION ALL SELECT 'p_partkey', sum(p_partkey)::DOUBLE, count(*) FILTER (p_size % 2 = 0) * 0 + count(p_partkey) FROM part""")
def pivot_sums(spark, d):
    return stats.column_sums(parts(spark, d), ["p_size", "p_partkey"])


@query("""WITH t AS (SELECT DISTINCT p_brand, p_name FROM part), k AS (SELECT lower(p_name) AS key, arg_min(' ' || upper(p_name), p_partkey) AS topic FROM part WHERE p_size < 25 GROUP BY 1), m AS (SELECT p_brand, p_name, topic FROM t LEFT JOIN k ON lower(p_name) = key)
SELECT p_brand AS category, coalesce(string_agg(p_name || '=' || topic, '|' ORDER BY p_name), '') AS matches FROM m GROUP BY p_brand""")
def coverage_matches(spark, d):
    p = parts(spark, d)
    truth = p.select(F.col("p_brand").alias("category"), F.col("p_name").alias("subtopic"))
    crawl = p.where("p_size < 25").select(F.concat(F.lit(" "), F.upper("p_name")).alias("topic"), F.col("p_partkey").alias("pos"))
    out = coverage.report(coverage.keyed_coverage(truth, crawl)).where("category is not null")
    return out.select("category", F.array_join(F.transform(F.map_entries("matches"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|").alias("matches"))


@query("""WITH r AS (SELECT p_brand AS model, avg((p_size < 25)::INT) AS recall, min(CASE WHEN p_size < 3 THEN p_partkey END) AS first_id FROM part GROUP BY 1)
SELECT model, (row_number() OVER (ORDER BY recall DESC, model) - 1)::INT AS by_recall, row_number() OVER (ORDER BY first_id NULLS LAST, model) - 1 AS by_first, (row_number() OVER (ORDER BY model) - 1)::BIGINT AS by_name FROM r""")
def model_orders(spark, d):
    """Models by falling recall, by first id (missing last), and by name."""
    from .operators.dedup import dense_ids

    r = parts(spark, d).groupBy(F.col("p_brand").alias("model")).agg(F.avg((F.col("p_size") < 25).cast("int")).alias("recall"), F.min(F.when(F.col("p_size") < 3, F.col("p_partkey"))).alias("first_id"))
    a = ranking.ranked(r, "recall", "model").select("model", F.col("rank_idx").alias("by_recall"))
    b = dense_ids(r.select("model", F.struct(F.col("first_id").isNull().alias("none"), "first_id", "model").alias("o")), "o").select("model", F.col("id").alias("by_first"))
    c = dense_ids(r.select("model", F.col("model").alias("o")), "o").select("model", F.col("id").alias("by_name"))
    return a.join(b, "model").join(c, "model")


FILLER = "x" * 220


@query(f"""SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN p_name WHEN 1 THEN 'why ' || p_name WHEN 2 THEN p_brand || chr(10) || p_type WHEN 3 THEN 'ask ' || p_name WHEN 4 THEN '' ELSE 'last ' || p_type END AS message FROM part""")
def user_messages(spark, d):
    """Dialects, a topic and query block, instruction lines, a label in a long text, a system text, the last paragraph."""
    n, b, t = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    kinds = [
        F.concat(F.lit("<|user|>\n"), n, F.lit("<|assistant|> yes")),
        F.concat(F.lit(f"You are {FILLER}\nTopic: a\n Query: why "), n, F.lit("<")),
        F.concat(F.lit("Example of it\n"), b, F.lit("\nNow, go\n"), t),
        F.concat(F.lit(f"Rules {FILLER}\nQuery: ask "), n, F.lit("\n\nQuery: other")),
        F.concat(F.lit("You are a bot about "), n),
        F.concat(F.lit(f"a {FILLER}\n\nExample: b\n\nlast "), t),
    ]
    return parts(spark, d).select("p_partkey", parsers.parse_user_message(cases(F.col("p_size") % 6, *kinds)).alias("message"))


@query("""SELECT CASE n_nationkey % 3 WHEN 0 THEN 'm:' || n_name WHEN 1 THEN n_name ELSE 'other:' || n_name END AS model, CASE n_nationkey % 3 WHEN 1 THEN 'http://local' ELSE 'https://openrouter.ai/api/v1' END AS url, CASE n_nationkey % 3 WHEN 1 THEN 'not-needed' ELSE 'k' END AS key, 'openai' AS missing FROM nation""")
def provider_endpoints(spark, d):
    rows = []
    for r in table(spark, d, "nation").select("n_nationkey", "n_name").collect():
        model = ("openrouter:m:", "Ollama:", "other:")[r["n_nationkey"] % 3] + r["n_name"]
        e = config.endpoint(model, {"OPENROUTER_API_KEY": "k"}, {"OLLAMA": "http://local"})
        rows.append((*e.values(), ",".join(config.missing_keys([model, "openai:x", "local"], {"OPENROUTER_API_KEY": "k"}))))
    return spark.createDataFrame(rows, "model string, url string, key string, missing string")


@query("""WITH s AS (SELECT unnest([10, 20]) AS steps), t AS (SELECT unnest(['0.1', '0.9']) AS threshold) SELECT 'r' || (row_number() OVER (ORDER BY steps, threshold) - 1) AS run_id, steps, threshold FROM s, t""")
def swept_settings(spark, d):
    runs = config.sweep(config.Settings(), {"crawl__steps": [10, 20], "crawl__threshold": [0.1, 0.9]})
    out = config.run_table(spark, {f"r{i}": r for i, r in enumerate(runs)})
    return out.select("run_id", F.get_json_object("config", "$.crawl.steps").cast("int").alias("steps"), F.get_json_object("config", "$.crawl.threshold").alias("threshold"))


def parity_classifier():
    return lambda texts: [("rejection" if len(t) % 2 else "normal", 0.5 + len(t) % 5 / 10) for t in texts]


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 7 <> 0 THEN CASE WHEN length(p_name) % 2 = 1 THEN 'rejection' ELSE 'normal' END END AS label, CASE WHEN p_size % 7 <> 0 THEN 0.5::DOUBLE + length(p_name) % 5 / 10::DOUBLE END AS score FROM part""")
def classified_texts(spark, d):
    rows = parts(spark, d).select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 7 != 0, F.col("p_name")).alias("text"))
    return providers.classified(rows, "text", parity_classifier)


def marked_topics(chats):
    """A judge that names the listed topics which begin with the label's first word."""
    out = []
    for chat in chats:
        first, *rest = chat[-1]["content"].split("\n")
        label = re.search(r"same as (.*?)\?", first)[1].split()[0]
        hits = [x[2:] for x in rest if x[2:].startswith(label)]
        out.append("".join(f"\\topic{{{h}}}" for h in hits) + ("\\boxed{y}" if hits else "\\boxed{n}"))
    return out


@query("""SELECT gt, count(topic) > 0 AS flag, count(topic) AS n_matched FROM (SELECT DISTINCT split_part(p_name, ' ', 1) AS gt FROM part) g LEFT JOIN (SELECT DISTINCT p_name AS topic FROM part) t ON split_part(topic, ' ', 1) LIKE split_part(gt, ' ', 1) || '%' GROUP BY gt""")
def judged_matches(spark, d):
    p = parts(spark, d)
    topics = p.select(F.col("p_name").alias("topic")).distinct().withColumn("pos", F.col("topic"))
    out = evaluation.judged_matches(p.select(F.substring_index("p_name", " ", 1).alias("gt")).distinct(), topics, providers.FunctionProvider(marked_topics), size=20)
    return out.select("gt", "flag", F.size("matched").cast("long").alias("n_matched"))


@query("""WITH t AS (SELECT DISTINCT p_type AS model, (p_size % 3)::VARCHAR AS run, p_name AS topic FROM part), g AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS gt FROM part), h AS (SELECT model, run, topic, gt FROM t LEFT JOIN g ON split_part(topic, ' ', 1) LIKE split_part(gt, ' ', 1) || '%')
SELECT model, run, count(DISTINCT topic) AS n_topics, count(DISTINCT gt) AS n_found, (SELECT count(*) FROM g) AS n_labels, count(DISTINCT gt) / (SELECT count(*) FROM g) AS recall, min(topic) FILTER (gt IS NOT NULL) AS first_id FROM h GROUP BY GROUPING SETS ((model, run), (model))""")
def model_analysis(spark, d):
    p = parts(spark, d)
    topics = p.select(F.col("p_type").alias("model"), (F.col("p_size") % 3).cast("string").alias("run"), F.col("p_name").alias("topic"), F.col("p_name").alias("pos"))
    return evaluation.model_analysis(topics, p.select(F.substring_index("p_name", " ", 1).alias("gt")).distinct(), providers.FunctionProvider(marked_topics), size=20)


@query("""WITH r AS (SELECT p_name AS topic, row_number() OVER (ORDER BY p_partkey) AS rank, p_size < 25 AS hit FROM part), c AS (SELECT count(*) FILTER (rank <= 10 AND hit) / 10 AS p10, count(*) FILTER (rank <= 100 AND hit) / 100 AS p100 FROM r)
SELECT 'precision' AS mode, round(p10, 6) AS a, round(p100, 6) AS b FROM c UNION ALL SELECT 'summary', count(*) FILTER (hit), count(*) FILTER (NOT hit) FROM r""")
def evaluation_modes(spark, d):
    """Two modes of the evaluation driver, kept in a folder and read from it the second time."""
    ids = parts(spark, d).select(F.col("p_name").alias("topic"), F.col("p_partkey").alias("o"), (F.col("p_size") < 25).alias("is_match"))
    from .operators.dedup import dense_ids

    ranked = dense_ids(ids, "o", 1).withColumnRenamed("id", "rank")
    tables = {"ranked": ranked, "clusters": ids, "truth": ids.select(F.col("o").alias("first_id"))}
    modes = {"precision": {"ks": (10, 100)}, "summary": {}}
    path = folder(spark, "evaluation")
    evaluation.evaluate(tables, modes, path)
    out = evaluation.evaluate(dict.fromkeys(tables, ids.limit(0)), modes, path)
    a = out["precision"].select(F.lit("precision").alias("mode"), F.round("precision_at_10", 6).alias("a"), F.round("precision_at_100", 6).alias("b"))
    return a.unionByName(out["summary"].select(F.lit("summary").alias("mode"), F.col("matched_clusters").cast("double").alias("a"), F.col("unmatched_clusters").cast("double").alias("b")))


def halves(chats):
    """A clusterer that puts odd and even numbers together, and gives no valid answer for lists that begin with 'blue'."""
    out = []
    for chat in chats:
        items = chat[-1]["content"].split("\n")
        odd, even = (",".join(str(i + 1) for i in range(k, len(items), 2)) for k in (0, 1))
        out.append("no" if items[0].startswith("[1] blue") else f'```json\n{{"odd": [{odd}], "even": [{even}]}}\n```')
    return out


@query("""WITH n AS (SELECT p_partkey, p_name, (row_number() OVER (ORDER BY p_partkey) - 1) // 7 AS chunk, (row_number() OVER (ORDER BY p_partkey) - 1) % 7 AS i FROM part), b AS (SELECT *, first_value(p_name) OVER (PARTITION BY chunk ORDER BY i) LIKE 'blue%' AS bad, count(*) OVER (PARTITION BY chunk) AS n FROM n)
SELECT chunk, CASE WHEN any_value(bad) THEN count(DISTINCT p_name) ELSE least(any_value(n), 2) END AS n_clusters FROM b GROUP BY chunk""")
def clustered_batches(spark, d):
    """Batches of seven; those without a valid answer in three attempts become clusters of one (of equal topics more than one name)."""
    from .operators.dedup import chunked

    rows = chunked(parts(spark, d).select("p_partkey", "p_name"), "p_partkey", 7)
    groups = rows.groupBy("chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x["p_name"]).alias("items"))
    found = evaluation.clustering_answers(groups, providers.FunctionProvider(halves), retries=2)
    texts = F.size(F.array_distinct(F.flatten(F.map_values("clusters"))))
    alone = F.forall(F.map_values("clusters"), lambda v: F.size(v) == 1) & (F.size(F.map_keys("clusters")) > 2)
    return found.select("chunk", F.when(alone, texts).otherwise(F.size(F.map_keys("clusters"))).cast("long").alias("n_clusters"))


def writer(chats):
    """Two listed queries, or one."""
    return [f"1. a query of {x[-1]['content'][-12:]}\n2. a second query" if x[-1]["content"].startswith("Write queries") else f" one more: {x[-1]['content']} " for x in chats]


@query("""WITH c AS (SELECT DISTINCT p_type AS cluster FROM part) SELECT cluster, 0 AS pos, 'a query of ' || right('Write queries about ' || cluster, 12) AS query FROM c UNION ALL SELECT cluster, 1, 'a second query' FROM c UNION ALL SELECT cluster, 2, '1. a query of ' || right('Write queries about ' || cluster, 12) FROM c
UNION ALL SELECT cluster, 3, '2. a second query' FROM c UNION ALL SELECT cluster, i::INT, 'one more: Write query ' || i || ' about ' || cluster FROM c, range(4, 6) t(i)""")
def topped_up_queries(spark, d):
    return evaluation.generated_queries(parts(spark, d).select(F.col("p_type").alias("cluster")).distinct(), providers.FunctionProvider(writer), n=6)


@query("""SELECT doc_id, lower(source) AS key, doc_id = (SELECT min(doc_id) FROM documents e WHERE e.source = d.source) AS is_new FROM documents d""")
def feedback_stream(spark, d):
    """A stream whose batches meet the rows of earlier ones: a source is new in the first document that has it."""
    src, path, marks = folder(spark, "feedback-in"), folder(spark, "feedback"), folder(spark, "feedback-marks")
    docs = table(spark, d, "documents").select("doc_id", "source")
    mid = docs.agg(F.percentile_approx("doc_id", 0.5)).head()[0]
    docs.where(F.col("doc_id") <= mid).coalesce(1).write.parquet(src)

    def step(batch, known):
        rows = batch.withColumn("key", F.lower("source"))
        first = rows.groupBy("key").agg(F.min("doc_id").alias("first"))
        first = first if known is None else first.join(known.select("key").distinct(), "key", "left_anti")
        return rows.join(first, "key", "left").select("doc_id", "key", F.coalesce(F.col("doc_id") == F.col("first"), F.lit(False)).alias("is_new"))

    for more in (None, docs.where(F.col("doc_id") > mid)):
        if more is not None:
            more.coalesce(1).write.mode("append").parquet(src)
        running = streams.feedback(spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(src), path, step, marks)
        running.processAllAvailable()
        running.stop()
    return spark.read.parquet(path).drop("epoch")


# Model calls with failures, translation, versions, long lineage, numbered streams


class Rule(providers.Provider):
    """Answers by an expression over the requests' rows, with the chat's last text as content."""

    def __init__(self, text):
        self.text = text

    def answer(self, requests):
        return requests.withColumn("content", F.element_at("messages", -1)["content"]).withColumn("text", self.text).drop("content")


@query(f"""WITH {REFUSALS}, v AS (SELECT conv_id || '-' || turn AS id, query, fast, (conv_id * 7 + turn) % 5 = 4 AND turn % 3 = 0 AS declines, (conv_id * 7 + turn) % 5 = 4 AND turn % 3 = 1 AS agrees, ('0x' || substr(md5(conv_id || '-' || turn), 1, 4))::INT % 100 AS s FROM f)
SELECT id, CASE WHEN fast IS NOT NULL THEN fast WHEN declines THEN true WHEN agrees AND coalesce(query, '') = '' THEN false ELSE s % 2 = 0 END AS is_refusal,
CASE WHEN fast IS NOT NULL THEN 'pattern' WHEN declines OR (agrees AND coalesce(query, '') = '') THEN 'classifier' ELSE 'judge' END AS stage FROM v""")
def cascade_translated(spark, d):
    """Answers in Han letters are translated before the classifier, which knows only English words."""
    rows = answers(spark, d)
    own = (F.col("conv_id") * 7 + F.col("turn")) % 5 == 4
    han = F.when(own & (F.col("turn") % 3 == 0), F.concat(F.lit("\u6211\u62d2\u7edd "), "answer")).when(own & (F.col("turn") % 3 == 1), F.concat(F.lit("\u6211\u540c\u610f "), "answer")).otherwise(F.col("answer"))
    translator = Rule(F.regexp_replace(F.regexp_replace("content", "^[^:]*: \u6211\u62d2\u7edd", "Declined:"), "^[^:]*: \u6211\u540c\u610f", "Agreed:"))
    label = lambda df: F.when(F.startswith(df["text"], F.lit("Declined:")), "rejection").otherwise("normal")
    classify = lambda df: df.select("id", label(df).alias("label"), F.when(F.rlike("text", F.lit("^(Declined|Agreed):")), 0.995).otherwise(0.5).alias("score"))
    s = F.conv(F.substring(F.md5("id"), 1, 4), 16, 10).cast("int") % 100
    return refusals.checked(rows.select("id", "query", han.alias("answer")), translator, classify, Rule(F.when(s % 2 == 0, "Yes").otherwise("No")))


def remote():
    """A call that is answered, withheld, empty, down for good, or busy at first, by the length of the text."""
    seen = set()

    def call(messages, model, temperature):
        text = messages[-1]["content"]
        kind = len(text) % 5
        if kind == 0:
            raise CallError(403, "policy")
        if kind == 1:
            return ""
        if kind == 2:
            raise CallError(503)
        if kind == 3 and text not in seen:
            seen.add(text)
            raise CallError(429)
        return text.upper()

    return call


@query("""SELECT doc_id, o AS outcome, CASE o WHEN 'moderated' THEN 403 WHEN 'exhausted' THEN 503 WHEN 'answered' THEN 200 WHEN 'empty' THEN 200 END AS status, CASE WHEN length(text) % 5 IN (2, 3) AND o IS NOT NULL THEN 2 WHEN o IS NOT NULL THEN 1 END AS attempts
FROM (SELECT *, CASE WHEN trim(coalesce(text, '')) <> '' THEN ['moderated', 'empty', 'exhausted', 'answered', 'answered'][length(text) % 5 + 1] END AS o FROM documents)""")
def called_answers(spark, d):
    """Every document's text sent once to a function that fails in all the ways it can."""
    rows = table(spark, d, "documents").select("doc_id", "text")
    asked = providers.requests(rows, "echo", "m", providers.chat(None, F.col("text")))
    found = providers.CallProvider(remote(), providers.Policy(retries=1, pause=0.0)).outcomes(asked)
    return asked.select("doc_id", "request_id").join(found, "request_id", "left").select("doc_id", "outcome", "status", "attempts")


@query("SELECT 'k12-' || (doc_id // 4096) AS final_topic, 'k0-' || doc_id AS origin FROM documents")
def long_trajectories(spark, d):
    """Twelve rounds that halve the topics."""
    ids, i, k = table(spark, d, "documents").select("doc_id"), F.col("iteration"), F.col("k")
    name = lambda at, n: F.concat(F.lit("k"), at.cast("string"), F.lit("-"), n.cast("string"))
    keys = ids.select(F.explode(F.sequence(F.lit(0), F.lit(11))).alias("iteration"), "doc_id").select("iteration", F.expr("shiftright(doc_id, iteration)").alias("k")).distinct()
    edges_ = keys.select("iteration", k.alias("pos"), name(i + 1, F.shiftright("k", 1)).alias("out_topic"), name(i, k).alias("in_topic"))
    return lineage.trajectories(edges_, ids.select(F.concat(F.lit("k0-"), F.col("doc_id").cast("string")).alias("topic"), F.col("doc_id").alias("pos")), 12)


@query(f"""WITH {EDGES}, r AS (SELECT DISTINCT 'b' || (doc_id // 64) AS out_topic, source FROM documents), s AS (SELECT out_topic, count(source) AS n FROM r GROUP BY 1)
SELECT e.out_topic, string_agg(DISTINCT in_topic, '|' ORDER BY in_topic) AS inputs, any_value(n) AS n_runs FROM edges e JOIN s USING (out_topic) WHERE iteration = 1 GROUP BY 1""")
def published_artifacts(spark, d):
    """The tables of a reduction, published as one version and read back from it."""
    docs = table(spark, d, "documents")
    e, originals = edges(spark, d), docs.select(F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("topic"), F.col("doc_id").alias("pos"))
    sources = docs.select(F.concat(F.lit("b"), F.floor(F.col("doc_id") / 64).cast("string")).alias("topic_key"), F.col("source").alias("run")).distinct()
    path = folder(spark, "artifacts")
    artifacts.publish_aggregation(spark, path, e, originals, sources, 2, 20)
    version = versions.current(spark, path)
    finals, of_final = version.read(spark, "final_topics"), version.read(spark, "sources").select("out_topic", "n_runs")
    return finals.join(of_final, "out_topic").select("out_topic", F.array_join("inputs", "|").alias("inputs"), "n_runs")


@query(f"""WITH {TOPICS}, h AS (SELECT {PUNCT} AS key, min(pos) AS pos FROM t GROUP BY 1) SELECT key, pos, row_number() OVER (ORDER BY pos) - 1 AS cluster_idx FROM h WHERE key <> ''""")
def stream_heads(spark, d):
    """The stream's unique topics with the cluster numbers of the batch operator."""
    batch = table(spark, d, "documents")
    rows = spark.readStream.schema(batch.schema).option("recursiveFileLookup", "true").parquet(f"{d}/documents.parquet*")
    out = folder(spark, "stream-heads")
    streams.numbered_heads(rows.select(F.regexp_extract("text", "^[^.]*", 0).alias("topic"), "doc_id"), "topic", "doc_id", f"{out}/heads", f"{out}/marks").awaitTermination()
    return spark.read.parquet(f"{out}/heads").select("key", "pos", "cluster_idx")


# Reports in parts


@query(r"""SELECT 1 AS part, c_custkey AS at, replace(c_name, '#', '\#') || ' & ' || c_nationkey || ' \\' AS line FROM customer
UNION ALL SELECT * FROM (VALUES (0, NULL, '\begin{longtable}{ll}'), (0, NULL, 'c\_name & c\_nationkey \\'), (0, NULL, '\hline'), (2, NULL, '\end{longtable}'))""")
def latex_lines(spark, d):
    lines = reports.latex_lines(table(spark, d, "customer"), ["c_name", "c_nationkey"], F.col("c_custkey"))
    return lines.select("place.part", "place.at", "line")


@query(r"""WITH d AS (SELECT source, source || ' ' || lang AS part, source || ' ' || lang || ' ' || doc_id AS leaf FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL)
SELECT place, line FROM (SELECT DISTINCT source AS place, '- ' || source AS line FROM d UNION ALL SELECT DISTINCT source || '/' || part, '  - ' || part FROM d UNION ALL SELECT source || '/' || part || '/' || leaf, '    - ' || leaf FROM d)""")
def markdown_lines(spark, d):
    """The tree of sources, their languages and documents, written in parts and read back as lines."""
    docs = table(spark, d, "documents").where("source is not null and lang is not null")
    part = F.concat_ws(" ", "source", "lang")
    edges_ = docs.select(F.col("source").alias("parent"), part.alias("child")).unionByName(docs.select(part.alias("parent"), F.concat_ws(" ", "source", "lang", "doc_id").alias("child")))
    return reports.markdown_lines(edges_).select(F.array_join("place", "/").alias("place"), "line")


@query(r"""WITH e AS (SELECT 'b' || (doc_id // 64) AS topic, 't' || doc_id AS origin FROM documents), n AS (SELECT topic, count(*) AS n FROM e GROUP BY 1), r AS (SELECT 'b' || (doc_id // 64) AS topic, count(DISTINCT source) AS n_runs FROM documents GROUP BY 1)
SELECT topic, 0 AS i, '<details><summary>' || topic || ' (' || n || ') [' || n_runs || '/20]</summary><ul>' AS line FROM n JOIN r USING (topic) UNION ALL SELECT topic, 1, '<li>' || origin || '</li>' FROM e UNION ALL SELECT topic, 2, '</ul></details>' FROM n""")
def explorer_lines(spark, d):
    """The page of a reduction's final topics, written in parts and read back."""
    docs = table(spark, d, "documents")
    topic = F.concat(F.lit("b"), F.floor(F.col("doc_id") / 64).cast("string"))
    found = docs.select(topic.alias("final_topic"), F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("origin"))
    lines = reports.explorer_lines(found, docs.groupBy(topic.alias("topic")).agg(F.count_distinct("source").alias("n_runs")), 20)
    path = folder(spark, "report")
    reports.write_lines(lines, path)
    # The parts, in order of their names, are the lines in order; a section's number of lines shows it.
    read = readers.numbered_lines(spark, path).where(F.col("value").rlike("^<(details|li|/ul)"))
    kind = F.when(F.startswith("value", F.lit("<details")), 0).when(F.startswith("value", F.lit("<li")), 1).otherwise(2)
    rows = read.select(F.struct("path", "line").alias("o"), kind.alias("i"), "value", F.regexp_extract("value", "<summary>([^ ]*)", 1).alias("name"))
    run = scan.scanned(rows, "o", {"section": F.when(F.col("i") == 0, 1).otherwise(0).cast("long")})
    names = run.where("i = 0").select("section", F.col("name").alias("topic"))
    return run.join(names, "section").select("topic", "i", F.col("value").alias("line"))


@query("""SELECT topic, min(line) AS first_id FROM (SELECT unnest([source, lang || doc_id % 100]) AS topic, row_number() OVER (ORDER BY doc_id) - 1 AS line FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL) GROUP BY topic""")
def document_line_file(spark, d):
    """A JSON list a line for each document, in one file, read by splits."""
    docs = table(spark, d, "documents").where("source is not null and lang is not null").orderBy("doc_id")
    lines_ = docs.select(F.to_json(F.array("source", F.concat("lang", (F.col("doc_id") % 100).cast("string")))).alias("value"))
    return readers.topic_lines(spark, text_file(spark, lines_, "lines"))


# What each mode of the evaluation driver makes of the parts: its rows, and a figure of them.
@query(r"""WITH ids AS (SELECT p_name AS topic, p_partkey AS id, p_size < 25 AS hit, split_part(p_name, ' ', 1) AS gt FROM part), t AS (SELECT topic, min(id) AS first_id, row_number() OVER (ORDER BY topic) AS pos FROM ids GROUP BY topic), g AS (SELECT DISTINCT gt FROM ids),
m AS (SELECT gt, topic FROM g JOIN t ON split_part(topic, ' ', 1) LIKE gt || '%'), r AS (SELECT id, hit, row_number() OVER (ORDER BY id) AS k FROM ids), f AS (SELECT gt, min(first_id) AS first_id FROM m JOIN t USING (topic) GROUP BY gt),
c AS (SELECT k, hit, (count(*) FILTER (hit) OVER (ORDER BY k))::DOUBLE / count(*) FILTER (hit) OVER () AS tpr FROM r), n AS (SELECT count(*) AS n FROM t), b AS (SELECT item_id, item_id % 3 = 0 AS refused FROM benchmark),
runs AS (SELECT DISTINCT p_type AS model, (p_size % 3)::VARCHAR AS run, p_name AS topic FROM part), found AS (SELECT model, run, count(DISTINCT gt) AS k FROM runs LEFT JOIN m USING (topic) GROUP BY GROUPING SETS ((model, run), (model)))
SELECT 'match' AS mode, (SELECT count(*) FROM g)::BIGINT AS n, count(*)::DOUBLE AS figure FROM m
UNION ALL SELECT 'clusters', count(*), count(*) FILTER (topic IN (SELECT topic FROM m)) FROM t
UNION ALL SELECT 'first', count(*), sum(first_id) FROM f
UNION ALL SELECT 'recall', 100, round(sum((SELECT count(*) FROM f WHERE greatest(first_id, 1) <= s.s) / 10.0::DOUBLE), 6) FROM range(1, 101) s(s)
UNION ALL SELECT 'precision', 1, count(*) FILTER (k <= 10 AND hit) / 10 FROM r
UNION ALL SELECT 'roc', count(*), round(sum(tpr), 6) FROM c
UNION ALL SELECT 'summary', 1, count(*) FILTER (hit) / count(*) FROM ids
UNION ALL SELECT 'rank', n * ((60 // (n // 2) * (n // 2) + 19) // 20), n FROM n
UNION ALL SELECT 'benchmark', 2 * count(*), 2 * count(*) FILTER (refused) FROM b
UNION ALL SELECT 'pool', 1, count(*) FILTER (item_id % 2 = 0 OR refused) / count(*) FROM b
UNION ALL SELECT 'models', count(*), sum(k) FROM found""")
def evaluation_all(spark, d):
    """All modes of the evaluation driver in one call, kept below one folder."""
    p, bench = parts(spark, d), table(spark, d, "benchmark")
    ids = p.select(F.col("p_name").alias("topic"), F.col("p_partkey").alias("id"), (F.col("p_size") < 25).alias("is_match"))
    first = ids.groupBy("topic").agg(F.min("id").alias("first_id"))
    truth = p.select(F.substring_index("p_name", " ", 1).alias("gt")).distinct()
    answers_ = truth.join(first.select("topic"), F.startswith(F.substring_index("topic", " ", 1), F.col("gt"))).groupBy("gt").agg(F.collect_set("topic").alias("matched")).withColumn("flag", F.lit(True))
    items = bench.select(F.col("item_id").cast("string").alias("topic"), F.concat(F.lit("Q "), F.col("item_id").cast("string")).alias("prompt"))
    topics = first.select("topic", F.col("topic").alias("pos"))
    runs = p.select(F.col("p_type").alias("model"), (F.col("p_size") % 3).cast("string").alias("run"), F.col("p_name").alias("topic"), F.col("p_name").alias("pos"))
    judge, stronger = providers.FunctionProvider(marked_topics), Rule(F.lit("\\boxed{a}"))
    refusing = Rule(F.when(F.substring_index("prompt", " ", -1).cast("long") % 3 == 0, "I cannot help you with that").otherwise("Sure"))
    numbered_ = scan.numbered(topics, "pos", "n").select("topic", F.col("n").alias("pos"))
    tables = {"truth": truth, "topics": topics, "clusters": first.withColumnRenamed("topic", "cluster"), "answers": answers_, "ranked": scan.numbered(ids, "id", "rank"), "benchmark": items, "pool": items.select("topic"), "discovered": items.where(F.col("topic").cast("long") % 2 == 0).select("topic")}
    path = folder(spark, "evaluation")
    run = lambda modes, **more: evaluation.evaluate(tables | more, modes, path)
    out = run({"match": {"provider": judge, "size": 20}, "clusters": {}, "first": {}, "recall": {"steps": 100, "total": 10}, "precision": {"ks": (10,)}, "roc": {}, "benchmark": {"provider": refusing, "times": 2, "model": "m"}, "pool": {"provider": refusing, "model": "m"}})
    out |= run({"summary": {}}, clusters=ids, truth=truth.withColumn("first_id", F.lit(1)))
    out |= run({"rank": {"provider": stronger, "name": "elo", "make": ranking.Elo, "comparisons": 60, "batch": 20}}, topics=numbered_)
    out |= run({"models": {"provider": judge, "size": 20}}, topics=runs)
    figures = {
        "match": F.sum(F.size("matched")),
        "clusters": F.count_if("is_match"),
        "first": F.sum("first_id"),
        "recall": F.round(F.sum("recall"), 6),
        "precision": F.max("precision_at_10"),
        "roc": F.round(F.sum("tpr"), 6),
        "summary": F.max("cluster_rate"),
        "rank": F.count_distinct("topic"),
        "benchmark": F.count_if("is_refusal"),
        "pool": F.max("recall"),
        "models": F.sum("n_found"),
    }
    rows = [out[m].agg(F.lit(m).alias("mode"), F.count("*").alias("n"), f.cast("double").alias("figure")) for m, f in figures.items()]
    return functools.reduce(DataFrame.unionByName, rows)


by_value(__name__)
