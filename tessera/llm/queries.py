"""The registered queries of the operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, collocations, decontam, jaccard, langid, lines, mixing, quality, suffixes, tokens, toxicity, urls, vectors
from .common import table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "\\### Assistant: </turn> ok"
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.array(*[F.struct(F.lit(r).alias("role"), F.lit(probe).alias("content")) for r in ("user", "assistant")]).alias("messages"))
    turns = chat.canonical_turns(table(spark, sf_dir, "conversations")).unionByName(chat.canonical_turns(extra))
    return chat.digests(chat.format_parts(turns))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.span_digests(table(spark, sf_dir, "documents"))


def op10_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.tokenized(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: (action, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"), RULES)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_digests(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.code_digests(table(spark, sf_dir, "embeddings"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_quality_rules, op3_mix_sources, op4_language_id, op5_decontaminate, op6_url_filter, op7_jaccard_join, op8_line_dedup, op9_suffix_dedup, op10_token_shards, op11_collocations, op12_vector_codes, op13_toxicity)}

SQL = {
    "op1_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)
), escaped AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '### ', '#\## ') AS body FROM turns
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('### ' || role || ': ' || body || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
""",
    "op2_quality_rules": r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM docs
), g AS (
  SELECT rid, i, word, CASE WHEN lead(word, 2) OVER v IS NOT NULL THEN word || ' ' || lead(word) OVER v || ' ' || lead(word, 2) OVER v END AS gram
  FROM w WINDOW v AS (PARTITION BY rid ORDER BY i)
), r AS (
  SELECT rid, i, word, gram IS NOT NULL AND count(*) OVER (PARTITION BY rid, gram) > 1 AS again FROM g
), c AS (
  SELECT rid, word, again OR coalesce(lag(again) OVER v, false) OR coalesce(lag(again, 2) OVER v, false) AS covered FROM r WINDOW v AS (PARTITION BY rid ORDER BY i)
), by_word AS (
  SELECT rid, count(*) AS n_words, sum(length(word)) AS word_chars, count(*) FILTER (covered) AS n_repeat_words FROM c GROUP BY rid
), lines AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid
), m AS (
  SELECT docs.*, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines
  FROM docs LEFT JOIN by_word USING (rid) LEFT JOIN lines USING (rid)
), v AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    coalesce(1000 * n_symbols // nullif(n_words, 0), 0) AS symbols, coalesce(1000 * n_dup_lines // nullif(n_lines, 0), 0) AS duplicate_lines,
    coalesce(1000 * n_repeat_words // nullif(n_words, 0), 0) AS repeats, coalesce(1000 * word_chars // nullif(n_words, 0), 0) AS word_length
  FROM m
), each AS (
  UNPIVOT (SELECT rid, lang, source, symbols, duplicate_lines, repeats, word_length FROM v WHERE NOT base_failed) ON symbols, duplicate_lines, repeats, word_length INTO NAME measure VALUE x
), sketch AS (
  SELECT lang, source, measure, (x >> greatest(length(bin(x)) - 6, 0)) << greatest(length(bin(x)) - 6, 0) AS bucket, count(*) AS n FROM each GROUP BY ALL
), levels AS (
  SELECT 1 AS level, lang, source, measure, bucket, n FROM sketch
  UNION ALL SELECT 2, lang, NULL, measure, bucket, sum(n) FROM sketch GROUP BY lang, measure, bucket
  UNION ALL SELECT 3, NULL, NULL, measure, bucket, sum(n) FROM sketch GROUP BY measure, bucket
), ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, lang, source, measure) AS total FROM levels
), limits AS (
  SELECT level, lang, source, measure, max(total) AS total, min(bucket) FILTER (100 * upto >= 50 * total) AS mid,
    min(bucket) FILTER (100 * upto >= CASE WHEN measure IN ('symbols', 'word_length') THEN 90 ELSE 99 END * total) AS top,
    min(bucket) FILTER (100 * upto >= CASE WHEN measure IN ('symbols', 'word_length') THEN 10 ELSE 1 END * total) AS low
  FROM ranked GROUP BY level, lang, source, measure
), ends AS (
  SELECT *, top + (1::BIGINT << greatest(length(bin(top)) - 6, 0)) - 1 AS top_end, mid + (1::BIGINT << greatest(length(bin(mid)) - 6, 0)) - 1 AS mid_end,
    CASE WHEN measure IN ('symbols', 'word_length') THEN 4 ELSE 1 END AS spread
  FROM limits
), capped AS (
  SELECT level, lang, source, measure, total, top_end + spread * (top_end - mid_end) AS most, CASE measure WHEN 'word_length' THEN low - spread * (mid - low) ELSE 0 END AS least FROM ends
), chosen AS (
  SELECT e.rid, bool_and(CASE WHEN a.total >= 50 THEN e.x BETWEEN a.least AND a.most WHEN b.total >= 50 THEN e.x BETWEEN b.least AND b.most ELSE e.x BETWEEN c.least AND c.most END) AS within
  FROM each e
  JOIN capped a ON a.level = 1 AND a.measure = e.measure AND a.lang IS NOT DISTINCT FROM e.lang AND a.source IS NOT DISTINCT FROM e.source
  JOIN capped b ON b.level = 2 AND b.measure = e.measure AND b.lang IS NOT DISTINCT FROM e.lang
  JOIN capped c ON c.level = 3 AND c.measure = e.measure
  GROUP BY e.rid
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(within, false) AND NOT base_failed AS kept
FROM v LEFT JOIN chosen USING (rid)
""",
    "op3_mix_sources": r"""
WITH RECURSIVE sizes AS (
  SELECT source, sum(greatest(coalesce(length(text), 1), 1))::BIGINT AS chars FROM documents GROUP BY source
), roots AS (
  SELECT *, round(sqrt(chars) * 1000)::BIGINT AS root FROM sizes
), totals AS (
  SELECT sum(chars)::BIGINT AS all_chars, sum(root)::BIGINT AS all_root FROM roots
), rates AS (
  SELECT source, (1.0::DOUBLE * root / all_root * all_chars / chars) AS rate FROM roots, totals
), draws AS (
  SELECT source, greatest(ceil(rate / 16.0::DOUBLE), 1)::INT AS draws, rate / greatest(ceil(rate / 16.0::DOUBLE), 1)::INT AS mean FROM rates
), d(source, draws, mean, k, p, upto) AS (
  SELECT source, draws, mean, 0, exp(-mean), exp(-mean) FROM draws
  UNION ALL SELECT source, draws, mean, k + 1, p * mean / (k + 1), upto + p * mean / (k + 1) FROM d WHERE k < 80
), docs AS (
  SELECT row_number() OVER () AS rid, *, md5(coalesce(text, '')) AS digest FROM documents
), drawn AS (
  SELECT docs.*, j, ('0x' || substr(md5('0|' || coalesce(doc_id::VARCHAR, '~') || '|' || digest || '|' || j), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM docs JOIN draws ON docs.source IS NOT DISTINCT FROM draws.source, unnest(range(1, draws + 1)) t(j)
), counted AS (
  SELECT rid, count(*) AS n FROM drawn JOIN d ON drawn.source IS NOT DISTINCT FROM d.source AND d.upto <= drawn.u GROUP BY rid
)
SELECT doc_id, text, lang, source, n_chars, copy::INT AS copy, md5('0|' || coalesce(doc_id::VARCHAR, '~') || '|' || digest || '|' || copy) AS shuffle_key
FROM docs JOIN counted USING (rid), unnest(range(0, n)) t(copy)
""",
    "op5_decontaminate": r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM items, unnest(range(1, len(w) - least(len(w), 10) + 2)) t(i) WHERE len(w) > 0
), lengths AS (SELECT DISTINCT n FROM windows), places AS (
  SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM docs, lengths, unnest(range(1, len(w) - n + 2)) t(i) WHERE len(w) >= n
), found AS (SELECT rid, i, places.n, item_id FROM places JOIN windows USING (n, win)
), covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM found, unnest(range(i, i + n)) t(p) GROUP BY rid
), by_doc AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM found GROUP BY rid
)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (rid) LEFT JOIN by_doc USING (rid)
""",
    "op8_line_dedup": r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), lines AS (
  SELECT rid, i, l[i] AS line, translate(regexp_replace(regexp_replace(l[i], '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM docs, unnest(range(1, len(l) + 1)) t(i)
), common AS (
  SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10
), marked AS (
  SELECT rid, i, line, key IN (SELECT key FROM common) AS gone FROM lines
)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked JOIN docs USING (rid) GROUP BY rid
""",
    "op7_jaccard_join": r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT rid, array_to_string(w[i:i + 4], ' ') AS s FROM docs, unnest(range(1, greatest(len(w) - 4, 1) + 1)) t(i) WHERE len(w) > 0
), sizes AS (SELECT rid, count(*) AS n FROM shingles GROUP BY rid
), common AS (
  SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.rid < b.rid GROUP BY ALL
), links AS (
  SELECT x, y FROM common JOIN sizes p ON p.rid = x JOIN sizes q ON q.rid = y WHERE 100 * c >= 80 * (p.n + q.n - c)
), both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reached(x, y) AS (
  SELECT rid, rid FROM sizes UNION SELECT r.x, b.y FROM reached r JOIN both_ways b ON r.y = b.x
)
SELECT d.doc_id, any_value(coalesce(n, 0))::BIGINT AS n_shingles, coalesce(min(o.doc_id), d.doc_id) AS component_id
FROM docs d LEFT JOIN sizes ON sizes.rid = d.rid LEFT JOIN reached ON reached.x = d.rid LEFT JOIN docs o ON o.rid = reached.y GROUP BY d.rid, d.doc_id
""",
    "op11_collocations": r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), pieces AS (
  SELECT rid, lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs
), split AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, w[i:i + size - 1] AS words
  FROM split, unnest(range(1, 6)) s(size), unnest(range(1, len(w) - size + 2)) t(i) WHERE len(w) >= size
), f AS (
  SELECT lang, size, phrase, any_value(words) AS words, count(*) AS f FROM grams GROUP BY lang, size, phrase HAVING count(*) >= 100
), totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM split GROUP BY lang
), candidates AS (SELECT lang, size, phrase, words, f AS a FROM f WHERE size > 1
), cuts AS (
  SELECT lang, size, phrase, a, k, array_to_string(words[1:k], ' ') AS first, array_to_string(words[k + 1:], ' ') AS rest FROM candidates, unnest(range(1, size)) t(k)
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, n, (1000::HUGEINT * c.a * n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.first JOIN f y ON y.lang = c.lang AND y.phrase = c.rest JOIN totals t ON t.lang = c.lang
), lowest AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM scored
), alone AS (
  SELECT * FROM lowest p WHERE place = 1 AND NOT EXISTS (
    SELECT 1 FROM candidates q WHERE q.lang = p.lang AND len(q.phrase) > len(p.phrase) AND contains(' ' || q.phrase || ' ', ' ' || p.phrase || ' ') AND 100 * q.a >= 100 * p.a)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM alone
)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
""",
}

#: A round assigns each part to the nearest entry and replaces the entries that are used.
_ROUND = """
near{k} AS (
  SELECT rid, part, arg_min(entry, d * 256 + entry) AS entry, min(d) AS d
  FROM (SELECT v.rid, v.part, b.entry, sum((v.x - b.x) * (v.x - b.x)) AS d FROM comps v JOIN book{k} b USING (part, place) GROUP BY ALL) GROUP BY rid, part
), book{next} AS (
  SELECT part, b.entry, place, coalesce(s.x, b.x) AS x FROM book{k} b LEFT JOIN (
    SELECT part, entry, place, floor_div(sum(x)::HUGEINT, count(*)) AS x FROM comps JOIN near{k} USING (rid, part) GROUP BY ALL) s USING (part, entry, place)
)"""


def _codes_sql() -> str:
    """The rounds written out, one after the other."""
    rounds = ",".join(_ROUND.format(k=k, next=k + 1) for k in range(vectors.ROUNDS))
    for name in ("floor_div(sum(x)::HUGEINT, count(*))",):
        rounds = rounds.replace(name, "((sum(x)::HUGEINT - ((sum(x)::HUGEINT % count(*)) + count(*)) % count(*)) // count(*))::BIGINT")
    last = _ROUND.format(k=vectors.ROUNDS, next=vectors.ROUNDS + 1).split("), book")[0]
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), comps AS (
  SELECT rid, (i - 1) // (len(embedding) // 4) AS part, (i - 1) % (len(embedding) // 4) AS place, floor(1024 * embedding[i]::DOUBLE)::BIGINT AS x
  FROM kept, unnest(range(1, len(embedding) + 1)) t(i)
), book0 AS (SELECT part, rid - 1 AS entry, place, x FROM comps WHERE rid <= 256),{rounds},{last}
), by_row AS (
  SELECT rid, string_agg(lower(lpad(to_hex(entry), 2, '0')), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near{vectors.ROUNDS} GROUP BY rid
)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, place)) FROM book{vectors.ROUNDS}) AS codebooks_sha256
FROM kept JOIN by_row USING (rid)
"""


SQL["op12_vector_codes"] = _codes_sql()
