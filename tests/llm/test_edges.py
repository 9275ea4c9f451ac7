"""Clashing columns, doc_ids of other types, repeated rows, very long texts and empty tables."""

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontam, jaccard, langid, lines, mixing, quality, suffixes, tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_clashing_columns_are_replaced(spark):
    df = spark.createDataFrame([(1, "a\nb", "en", "s", 3)], DOCS).withColumns({c: F.lit(-5) for c in ("copy", "shuffle_key", "n_lines", "n_dropped", "n_bytes", "n_removed", "n_spans", "held_out", "lang_pred", "score", "m", "d", "h")})
    mixed = mixing.mixed(df, {"s": 1.0})
    assert sorted(mixed.columns) == sorted(df.columns) and mixed.where("copy = -5").count() == 0
    row = lines.dropped(df).head()
    assert (row["n_lines"], row["n_dropped"], row["copy"]) == (2, 0, -5)
    row = suffixes.trimmed(df).head()
    assert (row["n_bytes"], row["n_removed"], row["n_spans"]) == (3, 0, 0)
    assert langid.identified(df).columns == ["doc_id", "held_out", "lang_pred", "score"]
    assert quality.kept(df).columns == df.columns
    assert jaccard.deduplicated(df).columns == df.columns


def test_doc_ids_that_are_texts(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([("b", text), ("a", text + " x"), ("c", "one"), (None, "")], "doc_id string, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.joined(df).collect()}
    assert got == {"b": "a", "a": "a", "c": "c", None: None}
    assert {r["doc_id"] for r in jaccard.deduplicated(df).collect()} == {"a", "c", None}
    for small in (10, 0):
        assert {r["doc_id"]: r["n_dropped"] for r in lines.line_digests(df, small=small, threshold=1).collect()} == {"b": 1, "a": 1, "c": 1, None: 0}
    with pytest.raises(TypeError):
        tokens.write_shards(df, "file:///tmp/none", "none")


def test_very_long_texts(spark):
    words = [f"w{i % 7919}x{i % 101}" for i in range(200_000)]
    df = spark.createDataFrame([(1, " ".join(words), "en", "s", 0), (2, "\n".join(words), "en", "s", 0), (3, "short", "en", "s", 0)], DOCS)
    bench = spark.createDataFrame([(7, " ".join(words[150_000:150_012]))], "item_id long, text string")
    assert [r["n_words"] for r in quality.quality(df).orderBy("doc_id").collect()] == [200_000, 200_000, 1]
    assert [r["contaminated"] for r in decontam.decontaminated(df, bench).orderBy("doc_id").collect()] == [True, True, False]
    assert [r["n_lines"] for r in lines.line_digests(df).orderBy("doc_id").collect()] == [1, 200_000, 1]
    assert {r["doc_id"]: r["component_id"] for r in jaccard.joined(df).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identified(df).collect()} == {1: "en", 2: "en", 3: "en"}


def test_languages_of_repeated_rows_ties_and_empty_tables(spark):
    rows = [(i, "the cat sat on the mat and the dog", "en", "s", 0) for i in range(9)] + [(20 + i, "der hund und die katze auf der matte", "de", "s", 0) for i in range(9)]
    odd = [(50, "the cat sat", None, "s", 0)] * 3 + [(60, "der hund", None, "s", 0), (61, "中文", None, None, 0)]
    got = langid.identified(spark.createDataFrame(rows + odd, DOCS)).collect()
    assert len(got) == len(rows + odd)
    assert {r["lang_pred"] for r in got if r["doc_id"] == 50} == {"en"} and {r["lang_pred"] for r in got if r["doc_id"] == 60} == {"de"}
    # Letters that no sample has cost a phrase each in both, so the larger language does not matter but the bits of a phrase do.
    assert {r["score"] for r in got if r["doc_id"] == 61} <= {x for x in (r["score"] for r in got) if 0 <= x <= 1}
    assert langid.identified(spark.createDataFrame([], DOCS)).count() == 0
