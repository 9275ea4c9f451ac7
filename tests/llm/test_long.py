"""Very long urls, pages and records, null ids, clashing columns, short benchmark items: cases of single operators."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, decontam, lines, urls
from tessera.llm.queries import RULES

from . import brute


def test_a_very_long_url_and_page(spark):
    long = "https://www.example.org/" + "freecasinobonus" * 1_000 + "?" + "q" * 100_000
    pages = [(1, long, "<p>" + "word " * 20_000 + "</p>"), (2, "https://a.com/x", None), (3, None, "<b>"), (4, "", ""), (5, "nothing", "x" * 30_000)]
    pages += [(10 + i, f"https://site{i}.net/fr/page", "<p>bonus casino free</p>") for i in range(20)]
    got = {r["page_id"]: r for r in urls.judged(spark.createDataFrame(pages, "page_id long, url string, html string"), RULES).collect()}
    assert len(got) == len(pages) and {r["verdict"] for r in got.values()} <= {"allow", "block"}
    assert (got[1]["host"], len(got[1]["path"]), got[1]["rule"]) == ("www.example.org", 1 + 15 * 1_000, None)
    assert (got[2]["rule"], got[2]["verdict"]) == ("com/", "allow") and got[10]["rule"] == "net/fr/"
    assert [(got[i]["host"], got[i]["path"]) for i in (3, 4, 5)] == [("", "")] * 3


def test_chats_with_columns_of_clashing_names(spark):
    rows = [(1, 0, "user", "hello", 9, 9, "x"), (1, 1, "assistant", "hi </turn>", 9, 9, "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, turns int, part int, formatted string")
    plain = chat.digests(chat.format_parts(chat.canonical_turns(df.select("conv_id", "turn", "role", "text")))).collect()
    assert chat.digests(chat.format_parts(chat.canonical_turns(df))).collect() == plain and plain[0]["n_turns"] == 2


def test_a_very_long_json_record(spark):
    turns = [{"role": "user" if i % 2 == 0 else "assistant", "content": f"turn {i} " + "y" * (500_000 if i == 3 else 5)} for i in range(2000)]
    df = spark.createDataFrame([(1, json.dumps({"messages": turns})), (2, None), (3, "{"), (4, json.dumps({"prompt": "p" * 300_000, "response": "r"}))], "conv_id long, record string")
    found = chat.json_turns(df, "conv_id", "record")
    got = {r["conv_id"]: (r["n"], r["chars"]) for r in found.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).collect()}
    assert got == {1: (2000, sum(len(t["content"]) for t in turns)), 4: (2, 300_001)}


def test_lines_of_documents_without_ids(spark):
    rows = [(None, f"common\nown {i}\n" + "common\n" * (i % 3)) for i in range(12)] + [(1, "common"), (1, "common")]
    texts = [t for _, t in rows]
    want = sorted("\n".join(ls) for ls in brute.kept_lines(texts))
    got = lines.dropped(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["text"] for r in got.collect()) == want


@pytest.mark.parametrize("seed", range(3))
def test_short_items_in_one_pass(spark, seed):
    draw = random.Random(seed)
    word = lambda: draw.choice("abcd")
    docs = [(i, " ".join(word() for _ in range(draw.randrange(40)))) for i in range(40)] + [(90, None), (91, ""), (92, "b")]
    items = [(i, " ".join(word() for _ in range(draw.choice([1, 2, 3, 5, 9, 10, 12])))) for i in range(8)] + [(50, ""), (51, None), (52, "c c")]
    items = [x for x in items if x[1] not in ("a", "b", "c", "d")] + ([(60, "b")] if seed == 1 else [])
    got = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in decontam.decontaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for i, text in docs:
        hit, found = brute.hit_words(text, items)
        want[i] = (len(hit), len(found))
    assert got == want
