"""Language identification, URL filters, Jaccard join, lines, repeated bytes, token shards."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import jaccard, langid, lines, suffixes, tokens, urls

from . import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string"


def docs_of(spark, texts, extra=()):
    return spark.createDataFrame([(i, t, None, None, 0, "x") for i, t in enumerate(texts)] + list(extra), DOCS)


def greedy_phrases(text, known):
    """Phrases of the longest matches of text in known, a character in no match being one by itself."""
    i, n = 0, 0
    while i < len(text):
        k = 1
        while i + k < len(text) and text[i : i + k + 1] in known:
            k += 1
        i, n = i + k, n + 1
    return n


@pytest.mark.parametrize("dense", [True, False])
def test_phrases_equal_greedy_longest_matches(dense):
    rng = random.Random(2)
    letters = langid.letter_table()
    han = "".join(chr(0x4E00 + i) for i in range(400))
    trains = {"x": "".join(rng.choice("abc ") for _ in range(400)), "y": "".join(rng.choice("ab") * rng.randrange(1, 90) for _ in range(9)), "z": "".join(rng.choice(han) for _ in range(900))}
    codes = {k: langid.reduced(t, letters)[0] for k, t in trains.items()}
    parsers = [langid.Parser(langid.Model(k, c), dense) for k, c in codes.items()]
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 60))) for _ in range(200)] + ["a" * 3000, "ab" * 700, han * 3, "1", "", None]
    texts += ["".join(rng.choice(["a", "b", "c", " ", "aabb", "d", "q\u4e07", han[:9]]) for _ in range(rng.randrange(200, 2000))) for _ in range(40)]
    got = langid.predict(texts, parsers, letters)
    for t, (lang, score) in zip(texts, got):
        r, any_letter = langid.reduced(t or "", letters)
        if not any_letter:
            assert (lang, score) == ("und", 0.0)
            continue
        s = "".join(map(chr, r))
        bits = {k: greedy_phrases(s, "".join(map(chr, c))) * math.log2(len(c) + 1) / len(s) for k, c in codes.items()}
        least, second = sorted(bits.values())[:2]
        assert bits[lang] == least and math.isclose(score, 1 - least / second), t


def test_language_identification(spark):
    path = Path("/root/testdata/sf0.01/documents.parquet")
    if not path.exists():
        pytest.skip("no test tables")
    df = spark.read.parquet(str(path))
    odd = spark.createDataFrame([(-1, None, None), (-2, "12 !?", None), (-3, "", "en")], "doc_id long, text string, lang string")
    both = df.select("doc_id", "text", "lang").unionByName(odd)
    got = langid.identified(both).join(both.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == df.count() + 3
    held = [r for r in got if r["held_out"] and r["doc_id"] >= 0]
    assert sum(r["lang"] == r["lang_pred"] for r in held) > 0.98 * len(held)
    assert {(r["lang_pred"], r["score"]) for r in got if r["doc_id"] < 0} == {("und", 0.0)}
    assert all(0 <= r["score"] <= 1 for r in got)
    none = langid.identified(odd.withColumn("lang", F.lit(None).cast("string")))
    assert [r["lang_pred"] for r in none.collect()] == ["und"] * 3


def test_url_rules_and_words(spark):
    rules = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"))
    cases = [
        ("http://a.EXAMPLE.com/en/1?q", "a.example.com", "/en/1", "example.com/en/", "block"),
        ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("x://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("x://b.com", "b.com", "", None, "allow"),
        ("x://c.net/ES/", "c.net", "/ES/", None, "allow"),
        (None, "", "", None, "allow"),
        ("no scheme/en", "", "", None, "allow"),
        ("x://h#f/", "h", "", None, "allow"),
    ]
    df = spark.createDataFrame([(i, c[0], None, "clash") for i, c in enumerate(cases)], "page_id long, url string, html string, host string")
    got = {r["page_id"]: tuple(r)[1:5] for r in urls.judged(df, rules).collect()}
    for i, c in enumerate(cases):
        assert got[i] == c[1:], c
    assert urls.judged(df.limit(0), rules).count() == 0


PAGES = "page_id long, url string, html string"


def test_segmentation():
    s = urls.Segmenter({"free": 50, "bets": 30, "freeb": 1, "news": 40, "a": 5})
    assert s.words("freebets") == ("free", "bets") and s.words("123") == ("<digits>",) and s.words("newsq") == ("news", "q")
    assert s.words("xyfree") == ("xy", "free") and s.words("") == ()


def test_segmentation_is_the_most_probable():
    rng = random.Random(8)
    for _ in range(100):
        counts = {"".join(rng.choice("ab") for _ in range(rng.randrange(1, 4))): rng.randrange(1, 50) for _ in range(6)} | {"a": 1, "b": 1}
        total = sum(counts.values()) + 1
        piece = "".join(rng.choice("ab") for _ in range(9))
        cuts = [[piece[i:j] for i, j in zip((0, *c), (*c, len(piece)))] for k in range(len(piece)) for c in itertools.combinations(range(1, len(piece)), k)]
        best = max(sum(math.log(counts[w] / total) for w in c) for c in cuts if all(w in counts for w in c))
        assert math.isclose(sum(math.log(counts[w] / total) for w in urls.Segmenter(counts).words(piece)), best)


def rule_of(host, path, rules):
    fits = [(len(h) + len(p), k) for k, (_, h, p) in enumerate(rules) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return rules[max(fits)[1]] if fits else None


def test_many_rules(spark, monkeypatch):
    rng = random.Random(3)
    rules = [(rng.choice(("allow", "block")), rng.choice(("", "a.", "b.a.")) + f"h{rng.randrange(900)}.{rng.choice(('com', 'net'))}", "/" + "xy"[: rng.randrange(3)] * rng.randrange(4)) for _ in range(10_000)]
    rules += [("block", "com", "/x"), ("allow", "net", "")]
    sites = [(f"{rng.choice(('', 'a.', 'c.b.a.', 'z'))}h{rng.randrange(1000)}.{rng.choice(('com', 'net', 'org'))}", rng.choice(("", "/", "/x", "/xyxy/1", "/y"))) for _ in range(500)]
    df = spark.createDataFrame(sorted(set(sites)), "host string, path string")
    for few in (urls.FEW_RULES, 10):
        monkeypatch.setattr(urls, "FEW_RULES", few)
        got = {(r["host"], r["path"]): (r["action"], r["rule"]) for r in urls.ruled(df, rules).collect()}
        want = {s: rule_of(*s, rules) for s in sites}
        assert got == {s: (r[0], r[1] + r[2]) for s, r in want.items() if r}


def pages_with_name(name, pages):
    """Pages of the host www.<name>.org, of two hosts with rules, and others whose texts have a vocabulary of 4,000 words."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(4000)]
    rows = [(i, f"http://{words[i % 50]}.net/art/{i}", "<p>" + " ".join([*words[i % 40 :: 40], "free casino bonus news daily"]) + "</p>") for i in range(400)]
    rows += [(3000 + i, f"http://casino-bonus{'s' * (i % 2)}.biz/win/{i}", "<p>play</p>") for i in range(40)]
    return rows + [(1000 + i, f"http://www.{name}.org/win/{i}", f"<p>welcome to {name}</p>") for i in range(pages)]


NAME_RULES = (("allow", "net", "/"), ("block", "biz", "/"))


@pytest.mark.parametrize("pages", [5, 60])
def test_a_name_with_many_pages_is_still_segmented(spark, pages):
    """No word between punctuation is a word of the blocked hosts: only the segmented name tells."""
    rows = pages_with_name("freecasinobonus", pages) + [(5000, "http://dailynews.org/art/1", "")]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judged(spark.createDataFrame(rows, PAGES), NAME_RULES).collect()}
    assert {v for i, v in got.items() if 1000 <= i < 3000} == {(None, "block")}
    assert {v for i, v in got.items() if i < 1000} == {("net/", "allow")} and got[5000] == (None, "allow")


def test_words_of_any_number_and_without_repetition(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [a + b + c + d for a in letters for b in letters for c in letters[:10] for d in letters[:9]]
    rows = [(i, f"http://h{i}.net/art/{i}", " ".join(words) + " casino") for i in range(2)] + [(8, "http://zzjhcasino.org/art/9", ""), (9, "http://casino.biz/art/9", "")]
    got = {r["page_id"]: r["verdict"] for r in urls.judged(spark.createDataFrame(rows, PAGES), NAME_RULES).collect()}
    assert len(words) > 60_000 and got == {0: "allow", 1: "allow", 8: "block", 9: "block"}


def test_log_odds_equal_one_segmenter_and_model(spark):
    rows = pages_with_name("freecasinobonus", 7) + [(2000, None, None), (2001, "x://Ads.h2.com/A1b22/33/\u00e9t\u00e9", ""), (2001, "x://Ads.h2.com/A1b22/33/\u00e9t\u00e9", ""), (2002, "x://" + "casinonews" * 300 + ".org/", None)]
    df = spark.createDataFrame(rows, PAGES)
    seg = urls.Segmenter({r["word"]: r["n"] for r in urls.word_counts(df).collect()})
    cut = lambda s: [w for piece in re.findall(r"[^\W_]+", s.lower()) for w in seg.words(piece)]
    got = urls.judged(df, NAME_RULES).collect()
    counts = {"block": Counter(), "allow": Counter()}
    of = lambda r: cut(r["host"].rpartition(".")[0]) + cut(r["path"])
    for r in got:
        rule = rule_of(r["host"], r["path"], NAME_RULES)
        assert (rule and rule[1] + rule[2]) == r["rule"]
        if rule:
            counts[rule[0]].update(of(r))
    words = {*counts["block"], *counts["allow"]}
    total = {k: sum(c.values()) + len(words) + 1 for k, c in counts.items()}
    ratio = {w: math.log((counts["block"][w] + 1) / total["block"] / ((counts["allow"][w] + 1) / total["allow"])) for w in words}
    for r in got:
        want = sum(ratio.get(w, 0.0) for w in of(r))
        assert math.isclose(r["log_odds"], want, abs_tol=1e-9), r
    assert len(got) == len(rows)
    only = urls.judged(df, NAME_RULES[1:]).collect()
    assert {r["verdict"] for r in only if not r["rule"]} == {"allow"}


def near_copies(rng):
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(3))
    texts = [" ".join(word() for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    passage = [word() for _ in range(25)]
    base = [word() for _ in range(60)]
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(60)] = word()
        texts.append(" ".join(copy))
    texts += [" ".join(passage + [word() for _ in range(rng.randrange(1, 8))]) for _ in range(40)]
    texts += [" ".join([word() for _ in range(30)] + passage) for _ in range(30)]
    return texts + texts[:5] + ["", None, " \n", "one two", "One  two", "one two three"]


@pytest.mark.parametrize("common,block,columns", [(16, 1024, 2048), (2, 8, 16)])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, common, block, columns):
    monkeypatch.setattr(jaccard, "COMMON", common)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "COLUMNS", columns)
    texts = near_copies(random.Random(common))
    got = {r["doc_id"]: r for r in jaccard.joined(docs_of(spark, texts).repartition(5)).collect()}
    want = brute.groups(texts)
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert (got[i]["n_shingles"], got[i]["component_id"]) == (len(brute.shingles(t)), min(want[i])), t
    kept = jaccard.deduplicated(docs_of(spark, texts).repartition(5))
    assert {r["doc_id"] for r in kept.collect()} == {min(g) for g in want} and kept.columns == docs_of(spark, []).columns


def test_jaccard_edges(spark, monkeypatch):
    assert jaccard.joined(docs_of(spark, [])).count() == 0
    monkeypatch.setattr(jaccard, "BROADCAST", 0)
    t = " ".join(f"w{i}" for i in range(50))
    rows = [(7, t, None, None, 0, ""), (7, t, None, None, 0, ""), (3, t + " x", None, None, 0, ""), (None, t + " y", None, None, 0, ""), (9, "z " * 100_000, None, None, 0, "")]
    got = jaccard.joined(docs_of(spark, [], rows)).collect()
    assert sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in got) == [(-1, 47, 3), (3, 47, 3), (7, 46, 3), (7, 46, 3), (9, 1, 9)]
    assert jaccard.deduplicated(docs_of(spark, [], rows[:2])).count() == 1


def test_blocks_give_a_link_for_every_two_components(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(jaccard, "COLUMNS", 7)
    rng = np.random.default_rng(4)
    base = rng.integers(-(1 << 62), 1 << 62, 40)
    sets = [np.unique(np.where(rng.random(40) < rng.choice([0.02, 0.1, 0.2]), rng.integers(-(1 << 62), 1 << 62, 40), base)) for _ in range(60)]
    label = rng.integers(0, 25, 60)
    for i, j, block in ((0, 1, np.arange(60) % 2), (3, 3, np.full(60, 3))):
        t = pa.table({"i": [i] * 60, "j": [j] * 60, "block": block.astype("i4"), "node": np.arange(60), "n": [len(x) for x in sets], "label": label, "shared": pa.array([x.tolist() for x in sets], pa.list_(pa.int64()))})
        got = jaccard._block_links(t).to_pylist()
        linked = lambda a, b: 180 * len(np.intersect1d(sets[a], sets[b])) >= 80 * (len(sets[a]) + len(sets[b]))
        assert all(linked(r["a"], r["b"]) for r in got)
        want = {(int(label[a]), int(label[b])) for a in range(60) for b in range(60) if block[a] == i and block[b] == j and linked(a, b)}
        joined = [{int(c)} for c in set(label.tolist())]
        for edges, out in ((want, []), ({(int(label[r["a"]]), int(label[r["b"]])) for r in got}, [])):
            at = {c: c for c in set(label.tolist())}
            for _ in at:
                for a, b in edges:
                    at[a] = at[b] = min(at[a], at[b])
            joined.append(at)
        assert joined[-1] == joined[-2]


def test_shingles_equal_those_of_words():
    rng = random.Random(3)
    alphabet = ["a", "B", "b", "\u00e9", "\u4e2d", " ", "  ", "\t", "\n", "\u00a0"]
    texts = ["", " ", "a", "A b", *("".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(300))]
    import pyarrow as pa

    found, at = {}, 0
    for first, n, values, starts, _, _ in jaccard.sets_of(pa.array([t or None for t in texts], pa.string()), 5):
        for k in range(len(n)):
            own = values[starts[k] : starts[k + 1]].tolist()
            want = brute.shingles(texts[first + k])
            assert len(own) == n[k] == len(want) and own == sorted(set(own))
            assert found.setdefault(want, own) == own
            at += 1
    assert at == len(texts) and len({tuple(v) for v in found.values()}) == len(found)


@pytest.mark.parametrize("small", [1_000_000, 0])
def test_line_dedup_equals_brute_force(spark, small):
    rng = random.Random(4)
    pool = ["Common", " common\t", "COMMON ", "", "  ", "É x", "é x", "rare", "other", "ﬁ", "\r", "a b"]
    texts = ["\n".join(rng.choice(pool + [f"u{rng.randrange(500)}"]) for _ in range(rng.randrange(0, 9))) for _ in range(80)] + [None, "", "\n\n"]
    df = docs_of(spark, texts, [(0, "rare\nrare", None, None, 0, "again")])
    all_texts = texts + ["rare\nrare"]
    want = sorted((len((t or "").split("\n")), hashlib.sha256("\n".join(k).encode()).hexdigest()) for t, k in zip(all_texts, brute.kept_lines(all_texts)))
    got = lines.line_digests(df, small=small).collect()
    assert sorted((r["n_lines"], r["kept_sha256"]) for r in got) == want
    assert sum(r["n_dropped"] for r in got) == sum(len((t or "").split("\n")) - len(k) for t, k in zip(all_texts, brute.kept_lines(all_texts)))
    out = lines.dropped(df, small=small)
    assert out.columns == [*df.columns, "n_lines", "n_dropped"] and out.count() == len(all_texts)


def test_line_runs_are_compacted(spark):
    runs = lines.LineRuns(spark, threshold=3, fanout=2)
    for i in range(5):
        runs.add(docs_of(spark, [f"a\nb{i}", "c"]))
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert runs.common().count() == 2
    assert lines.line_digests(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize("big,broadcast", [(50_000, 128 << 20), (1, 0)])
def test_repeated_bytes_equal_brute_force(spark, monkeypatch, big, broadcast):
    monkeypatch.setattr(suffixes, "BIG", big)
    monkeypatch.setattr(suffixes, "BROADCAST", broadcast)
    rng = random.Random(6)
    piece = lambda n: "".join(rng.choice("abé\n") for _ in range(n))
    shared = [piece(n) for n in (15, 25, 60, 200)]
    texts = ["".join(rng.choice(shared + [piece(30)])[: rng.randrange(10, 80)] + piece(rng.randrange(9)) for _ in range(rng.randrange(5))) for _ in range(80)]
    texts += ["ab" * 60, "x" * 50, "x" * 19, "x" * 20, None, "", texts[3], texts[4], texts[4], shared[2], shared[2] + "q"]
    data = [(t or "").encode() for t in texts]
    flags = brute.repeated_bytes(data, 20)
    got = {r["doc_id"]: r for r in suffixes.span_digests(docs_of(spark, texts).repartition(6), 20, 8).collect()}
    assert len(got) == len(texts)
    for i, (t, f) in enumerate(zip(data, flags)):
        kept = bytes(b for b, x in zip(t, f) if not x)
        n_spans = sum(1 for k in range(len(t)) if f[k] and not (k and f[k - 1]))
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(t), sum(f), n_spans, hashlib.sha256(kept).hexdigest()), texts[i]


def test_repeated_bytes_edges(spark, monkeypatch):
    assert suffixes.span_digests(docs_of(spark, [])).count() == 0
    monkeypatch.setattr(suffixes, "BUFFER", 1 << 12)
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefgh") for _ in range(20_000))
    got = {r["doc_id"]: r for r in suffixes.trimmed(docs_of(spark, [long + "1", "2" + long[5000:6000], "é" * 400])).collect()}
    assert got[0]["n_removed"] == 1000 and got[1]["n_removed"] == 1000 and got[1]["text"] == "2" and got[2]["n_removed"] == 800


def test_shards_are_read_at_random_and_checked(spark, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(str(public.path("byte_bpe_50k.json")))
    t.encode_special_tokens = True
    texts = [f"text number {i} " * (i % 50) for i in range(300)] + [None, "", "<|endoftext|> x", "long " * 200_000]
    df = docs_of(spark, texts, [(5, "again", None, None, 0, ""), (None, "no id", None, None, 0, "")])
    folder = f"file://{tmp_path}/shards"
    shards = tokens.write_shards(df, folder, str(public.path("byte_bpe_50k.json")))
    assert tokens.write_shards(df, folder, str(public.path("byte_bpe_50k.json"))) == shards  # a repeated write gives the same files
    rows = tokens.read_shards(spark, folder, shards).orderBy("start").collect()
    assert len(rows) == len(texts) + 2 and rows[0]["doc_id"] is None
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    for r in rows:
        if r["doc_id"] not in (None, 5):
            ids = t.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [0]
            assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    fs, path = tokens.filesystem(folder)
    first = f"{path}/{shards[0][0]}"
    with fs.open_input_file(first) as f:
        reader = tokens.ShardReader(f)
        k = len(reader.docs) - 1
        assert reader.ids(k).tolist() == list(reader.each())[-1][1].tolist()
        assert len(reader.frames) >= 1
    raw = bytearray(Path(first).read_bytes())
    reader_starts = reader.starts
    raw[int(reader_starts[0]) + 20] ^= 255
    Path(first).write_bytes(bytes(raw))
    with fs.open_input_file(first) as f, pytest.raises(Exception):
        list(tokens.ShardReader(f).each())
    assert tokens.tokenized(df.limit(0)).count() == 0
