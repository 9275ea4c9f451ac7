"""Chat formatting, quality rules, mixing, decontamination."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, decontam, mixing, quality

from . import brute

TURNS = "conv_id long, turn long, role string, text string"


def test_chat_round_trip_of_hostile_texts(spark):
    rng = random.Random(3)
    bits = ["\\", "</turn>", "### ", "<", "/turn>", "\n", "user: ", "é", "🙂", "#", "\\/", "\\#", " ", "a"]
    rows = [(c, t, rng.choice(["user", "assistant", "a: b", "### ", "", None]), None if rng.random() < 0.1 else "".join(rng.choice(bits) for _ in range(rng.randrange(12)))) for c in range(40) for t in range(rng.randrange(1, 150))]
    parts = chat.format_parts(spark.createDataFrame(rows, TURNS))
    got = {r["conv_id"]: r for r in chat.digests(parts).collect()}
    whole = {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame(rows, TURNS)).collect()}
    for c in range(40):
        own = sorted((t, r or "", x or "") for k, t, r, x in rows if k == c)
        assert got[c]["n_turns"] == len(own)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        text = whole[c]["formatted"]
        assert len(text) == got[c]["formatted_chars"]
        import re

        masked = "".join(text[s["start"] : s["start"] + s["length"]] for s in whole[c]["loss_spans"])
        assert re.sub(r"(?s)\\(.)", r"\1", masked) == loss


def test_chat_edge_cases(spark):
    rows = [(1, None, "user", "n"), (1, 0, "user", "b"), (1, 0, "assistant", "a"), (1, 0, "assistant", "a"), (2, 5, None, None), (None, 1, "assistant", "x" * 100_000)]
    got = {r["conv_id"]: r for r in chat.digests(chat.format_parts(spark.createDataFrame(rows, TURNS))).collect()}
    assert got[1]["n_turns"] == 4 and got[1]["loss_chars"] == 2 and got[2]["n_turns"] == 1 and got[None]["loss_chars"] == 100_000
    assert chat.digests(chat.format_parts(spark.createDataFrame([], TURNS))).count() == 0


def test_layouts_by_fingerprint(spark):
    turns = lambda df: [tuple(r) for r in chat.canonical_turns(df).orderBy("turn").collect()]
    clash = spark.createDataFrame([(1, 0, "user", "t", "other", 3)], TURNS + ", prompt string, messages int")
    assert chat.layout_of(clash.schema).name == "turn_rows" and turns(clash) == [(1, 0, "user", "t")]
    shared = spark.createDataFrame([(1, [("human", "q"), ("gpt", None)])], "conv_id long, conversations array<struct<from:string,value:string>>")
    assert turns(shared) == [(1, 0, "user", "q"), (1, 1, "assistant", "")]
    made = spark.createDataFrame([(1, "do", "", "done")], "conv_id long, instruction string, input string, output string")
    assert turns(made) == [(1, 0, "user", "do"), (1, 1, "assistant", "done")]
    with pytest.raises(ValueError):
        chat.layout_of(spark.createDataFrame([], "a int").schema)


def test_json_layouts_differ_by_row(spark):
    rows = [
        (1, '{"messages": [{"role": "user", "content": "a", "more": 1}, {"role": "assistant", "content": "b"}], "extra": 1}'),
        (2, '{"prompt": "p", "completion": "c"}'),
        (3, '{"conversations": [{"from": "human", "value": "h"}]}'),
        (4, '{"unknown": 1}'),
        (5, "no json"),
        (6, None),
    ]
    df = spark.createDataFrame(rows, "conv_id long, record string")
    got = {r["conv_id"]: (r["layout"], r["turns"] and [(t["role"], t["text"]) for t in r["turns"]]) for r in chat.json_layouts(df, "conv_id", "record").collect()}
    assert got[1] == ("messages", [("user", "a"), ("assistant", "b")])
    assert got[2] == ("prompt_completion", [("user", "p"), ("assistant", "c")])
    assert got[3] == ("from_value", [("user", "h")])
    assert got[4] == got[5] == got[6] == (None, None)


def test_layout_of_json_records_from_all_items(spark):
    rows = [
        (1, '{"messages": [null, {"role": "user", "content": "a"}]}'),
        (2, '{"messages": [{"role": "user"}, {"role": "assistant", "content": "b {c} \\"d\\""}]}'),
        (3, '{"conversations": [{"from": "human"}, {"value": "h"}]}'),
        (4, '{"messages": [3, "x", {"role": "user", "content": "a"}]}'),
        (5, '{"messages": [{"role": "user"}, null]}'),
        (6, '{"messages": {"role": "user", "content": "a"}}'),
        (7, '{"messages": []}'),
    ]
    df = spark.createDataFrame(rows, "conv_id long, record string")
    got = {r["conv_id"]: (r["layout"], r["turns"] and [(t["role"], t["text"]) for t in r["turns"]]) for r in chat.json_layouts(df, "conv_id", "record").collect()}
    assert got[1] == ("messages", [("user", "a")])
    assert got[2] == ("messages", [("user", ""), ("assistant", 'b {c} "d"')])
    assert got[3] == ("from_value", [("user", ""), ("", "h")])
    assert got[4] == ("messages", [("user", "a")])
    assert got[5] == got[6] == got[7] == (None, None)


DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string"


def test_quality_counts_and_edges(spark):
    texts = ["", None, " \n\t ", "a b c a b c", "x\nx\n\n \nX\nx", "w " * 60, "a|b #c* $%& <>", "é ñ\v\fo"] + [" ".join(f"w{i}{j}" for j in range(60)) for i in range(5)]
    df = spark.createDataFrame([(i, t, None if i % 2 else "en", None, 0, "clash") for i, t in enumerate(texts)] + [(0, "", "en", None, 0, "again")], DOCS)
    got = quality.quality(df).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        t = texts[r["doc_id"]] or ""
        w = brute.space_words(t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if brute.space_words(x)]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines))), t
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in t)
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert {r["doc_id"] for r in got if r["kept"]} == set(range(8, 13))
    assert quality.quality(df.limit(0)).count() == 0
    assert quality.kept(df).columns == df.columns and quality.kept(df).count() == 5


def test_quality_limits_adapt_to_the_group(spark):
    clean = lambda i, k: " ".join(f"w{i}x{j}" for j in range(100)) + " #" * k
    rows = [(i, clean(i, 0), "en", "plain", 0, "") for i in range(60)] + [(i, clean(i, 40), "en", "code", 0, "") for i in range(100, 160)] + [(200, clean(200, 40), "en", "plain", 0, "")]
    got = {r["doc_id"]: r["kept"] for r in quality.quality(spark.createDataFrame(rows, DOCS)).collect()}
    assert not got[200] and all(got[i] for i in got if i != 200)


def test_sketches_merge_in_any_order(spark):
    rows = spark.createDataFrame([(i, "w " * (50 + i % 7) + f"{i} " * 2, "en", f"s{i % 3}", 0, "") for i in range(90)], DOCS)
    m = rows.select("lang", "source", quality.measured(F.col("text")).alias("m"))
    whole = quality.merged(quality.sketches(m))
    halves = quality.sketches(m.where("source = 's0'")).unionByName(quality.sketches(m.where("source <> 's0'")))
    key = lambda df: sorted(map(tuple, df.select("measure", "bucket", "n").collect()))
    assert key(whole) == key(quality.merged(halves))


def test_mixing_reaches_the_weights_and_is_stable(spark):
    rows = [(i, f"text {i:05d}", "en", "big" if i < 3000 else "small" if i < 3300 else None, 0, "x") for i in range(3400)]
    df = spark.createDataFrame(rows, DOCS)
    out = mixing.mixed(df, {"big": 0.5, "small": 0.4}, seed=2)
    share = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(share["big"] - 1700) < 200 and abs(share["small"] - 1360) < 180 and 200 < share[None] < 480
    key = lambda d: sorted(map(tuple, d.select("doc_id", "copy", "shuffle_key").collect()))
    assert key(out) == key(mixing.mixed(df.repartition(7), {"big": 0.5, "small": 0.4}, seed=2))
    assert out.columns == [*df.columns, "copy", "shuffle_key"]
    assert mixing.mixed(df.limit(0)).count() == 0


def test_poisson_counts_have_the_mean_and_variance(spark):
    for rate in (0.3, 5.0, 40.0):
        rows = [(i, f"{i:06d}", "en", "a", 0, "") for i in range(2000)] + [(-1, "x" * int(6 * 2000 * (rate - 1)) if rate > 1 else "x", "en", "b", 0, "")]
        weights = {"a": 1.0, "b": 0.0} if rate > 1 else {"a": rate}
        counts = mixing.mixed(spark.createDataFrame(rows, DOCS), weights).where("source = 'a'").groupBy("doc_id").count().collect()
        n = [r["count"] for r in counts] + [0] * (2000 - len(counts))
        mean = sum(n) / 2000
        assert abs(mean - rate) < 5 * math.sqrt(rate / 2000) + 0.01, (rate, mean)
        assert abs(sum((x - mean) ** 2 for x in n) / 2000 / rate - 1) < 0.2


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(1)
    word = lambda: rng.choice("abcdefgh") + rng.choice(["", "É", "1"])
    line = lambda n: " ".join(word() for _ in range(n))
    items = [(i, line(rng.choice([1, 2, 3, 9, 10, 11, 30]))) for i in range(12)] + [(50, ""), (51, None), (52, "..."), (53, "a " * 15), (54, "zz")]
    docs = [line(rng.randrange(0, 40)) for _ in range(150)] + [None, "", "a " * 300, "A-a_a,a a a a a a a a"]
    for i in range(40):
        item = brute.item_words(rng.choice(items)[1])
        docs.append(line(8) + " " + ", ".join(item[rng.randrange(3) :]).upper() + " " + line(5))
    df = spark.createDataFrame([(i, t, None, None, 0, "") for i, t in enumerate(docs)] + [(0, docs[0], None, None, 0, "again")], DOCS)
    bench = spark.createDataFrame(items + [(53, "a " * 15)], "item_id long, text string")
    got = decontam.decontaminated(df, bench).collect()
    assert len(got) == len(docs) + 1
    for r in got:
        hit, found = brute.hit_words(docs[r["doc_id"]], items)
        ids = ",".join(sorted(map(str, found)))
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(brute.item_words(docs[r["doc_id"]])), len(hit), len(found), bool(hit)), docs[r["doc_id"]]
        assert r["items_sha256"] == hashlib.sha256(ids.encode()).hexdigest()
    clean = decontam.clean(df, bench)
    assert clean.columns == df.columns and clean.count() == sum(not r["contaminated"] for r in got)
    none = decontam.decontaminated(df, bench.limit(0))
    assert none.where("contaminated").count() == 0 and none.count() == len(docs) + 1
    assert decontam.decontaminated(df.limit(0), bench).count() == 0
