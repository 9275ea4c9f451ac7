"""The pipeline's stages against plain versions, each on its own input."""

import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import queries

from . import brute

DATA = Path("/root/testdata/sf0.001")


def test_stages(spark):
    if not DATA.exists():
        pytest.skip("no test tables")
    duckdb = pytest.importorskip("duckdb")
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    stages = dict(corpus_pipeline.STAGES)

    good = stages["quality_rules"](spark, docs, str(DATA))
    assert good.columns == docs.columns
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({queries.SQL['op2_quality_rules']}) WHERE kept").fetchall()}
    rows = {r["doc_id"]: r["text"] for r in good.collect()}
    assert set(rows) == kept

    single = stages["jaccard_join"](spark, good, str(DATA))
    ids = sorted(rows)
    first = {min(ids[i] for i in g) for g in brute.groups([rows[i] for i in ids])}
    assert {r["doc_id"] for r in single.collect()} == first and single.columns == docs.columns

    clean = stages["decontaminate"](spark, single, str(DATA))
    want = {i for i in first if not brute.hit_words(rows[i], bench)[0]}
    assert {r["doc_id"] for r in clean.collect()} == want and clean.columns == docs.columns

    mixed = stages["mix_sources"](spark, clean, str(DATA)).cache()
    con.register("c", clean.toPandas())
    con.execute("CREATE OR REPLACE VIEW documents AS SELECT * FROM c")
    drawn = sorted(r[0] for r in con.execute(f"SELECT doc_id FROM ({queries.SQL['op3_mix_sources']})").fetchall())
    assert sorted(r["doc_id"] for r in mixed.collect()) == drawn

    order = [r["doc_id"] for r in mixed.collect()]
    out = stages["token_shards"](spark, mixed, str(DATA)).orderBy("start").collect()
    t = Tokenizer.from_file(str(public.path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    assert [r["doc_id"] for r in out] == order != sorted(order)  # the shuffled order stays
    at = 0
    for r in out:
        ids = t.encode(rows[r["doc_id"]], add_special_tokens=False).ids + [0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_stages_of_empty_tables_nulls_and_repeated_rows(spark):
    if not DATA.exists():
        pytest.skip("no test tables")
    pytest.importorskip("public_tokenizers")
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, words, "en", "a", 5), (1, words, "en", "a", 5), (2, None, None, None, None), (3, "", "en", "a", 0), (None, words + " x", None, None, 1)]
    for given in (rows, []):
        docs = spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long")
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(DATA))
            assert out.columns == (docs.columns if name != "token_shards" else ["doc_id", "start", "n_tokens", "ids_crc32"])
            found = sorted((r["doc_id"] or 0 for r in out.collect()))
            if name == "jaccard_join":
                assert found == ([0, 2, 3] if given else [])  # the least doc_id, null first, of a group; texts without words stay
            elif name == "quality_rules":
                assert found == ([0, 1, 1] if given else [])
            elif name != "mix_sources":
                assert len(found) == len(given)


def test_run_gives_the_last_stage(spark):
    if not DATA.exists():
        pytest.skip("no test tables")
    out = corpus_pipeline.run(spark, str(DATA))
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert out.agg(F.max("start")).head()[0] > 0
