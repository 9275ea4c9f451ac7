"""Phrase collocations, vector codes and toxicity against plain versions, and their edge cases."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import collocations, splitting, toxicity, vectors

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_collocations(rows, sizes, least, share, top):
    import re

    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for size in range(1, sizes + 1):
                for i in range(len(words) - size + 1):
                    f[lang][tuple(words[i : i + size])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in candidates.items()):
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), " ".join(p), a, counts[p[:k]], counts[p[k:]], n[lang], score))
        out += [(lang, i, *x[3:]) for i, x in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def texts(draw, n):
    words = [*(f"w{i}" for i in range(14)), "Ä", "é!x", "a\tb", "New", "YORK", "\x00", "ß"]
    out = []
    for _ in range(n):
        parts = [draw.choice(words) + draw.choice([" ", "  ", " ", ". ", ", ", "\n", "; ", " \x0b", "\t"]) for _ in range(draw.randrange(30))]
        if draw.random() < 0.4:
            parts.insert(draw.randrange(len(parts) + 1), "the new york stock exchange ")
        out.append("".join(parts))
    return out


@pytest.mark.parametrize(("seed", "sizes", "share", "buffer"), [(0, 5, 100, 200), (1, 3, 80, 1 << 20), (2, 2, 100, 64), (3, 5, 50, 1000)])
def test_collocations_against_counting(spark, monkeypatch, seed, sizes, share, buffer):
    monkeypatch.setattr(splitting, "BUFFER", buffer)
    draw = random.Random(seed)
    rows = [(t, draw.choice(["en", "de", None])) for t in texts(draw, 150)]
    rows += [(None, "en"), ("", "en"), ("...", None), (rows[0][0], rows[0][1]), ("x y " * 200, "xx"), ("rare pair", "yy")]
    # Columns whose names the operator uses itself.
    df = spark.createDataFrame([(t, g, "z", 1) for t, g in rows], "text string, lang string, phrase string, n int").repartition(3)
    got = collocations.collocations(df, sizes, 3, share, 10).collect()
    assert sorted(tuple(r) for r in got) == plain_collocations(rows, sizes, 3, share, 10)


def test_collocations_when_the_sieve_lets_everything_through(spark, monkeypatch):
    monkeypatch.setattr(collocations, "EACH", 1)
    monkeypatch.setattr(collocations, "PART", 1 << 3)
    monkeypatch.setattr(collocations, "SIEVE", 1 << 3)
    assert collocations.PART == 8
    monkeypatch.setattr(collocations, "PART", 1 << 15)
    monkeypatch.setattr(collocations, "SIEVE", 1 << 15)
    draw = random.Random(9)
    rows = [(t, "en") for t in texts(draw, 60)]
    got = collocations.collocations(spark.createDataFrame(rows, "text string, lang string"), 5, 2, 100, 50).collect()
    assert sorted(tuple(r) for r in got) == plain_collocations(rows, 5, 2, 100, 50)


def test_collocations_of_empty_tables_and_long_texts(spark):
    schema = "text string, lang string"
    assert collocations.collocations(spark.createDataFrame([], schema)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None)], schema)).count() == 0
    long = "alpha beta gamma delta " * 60_000 + "x" * 100_000 + ". " + "alpha beta, " * 5
    got = [tuple(r) for r in collocations.collocations(spark.createDataFrame([(long, "en")], schema)).collect()]
    assert sorted(got) == plain_collocations([(long, "en")], 5, 100, 100, 2000)


def plain_codes(rows, entries, rounds=4):
    width = max(-(-max((len(v) for _, v, _ in rows), default=0) // 4), 1)
    most = vectors.limit(width)
    ints = [[max(-most, min(most, math.floor(1024 * x))) if abs(x) < 1e300 else int(math.copysign(most, x)) for x in v] + [0] * (4 * width - len(v)) for _, v, _ in rows]
    parts = [[v[p * width : (p + 1) * width] for v in ints] for p in range(4)]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, ints[i]))[:entries]
    books = [[parts[p][i] for i in order] for p in range(4)]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    near = lambda p, x: min((far(x, c), k) for k, c in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(4):
            members = defaultdict(list)
            for x in parts[p]:
                members[near(p, x)[1]].append(x)
            for k, xs in members.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    found = [[near(p, parts[p][i]) for p in range(4)] for i in range(len(rows))]
    by_label = Counter()
    for (_, _, label), f in zip(rows, found):
        by_label[label] += sum(d for d, _ in f)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((str(r[0]), "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), by_label[r[2]], digest) for r, f in zip(rows, found))


@pytest.mark.parametrize("entries", [4, 16, 256])
def test_vector_codes_against_plain_lloyd(spark, monkeypatch, entries):
    monkeypatch.setattr(vectors, "ENTRIES", entries)
    monkeypatch.setattr(vectors, "HOT", 20)
    draw = random.Random(entries)
    rows = [(i, [draw.choice([-0.5, -0.001, 0.0, 0.25, draw.gauss(0, 1)]) for _ in range(8)], draw.choice([None, 1, 2])) for i in range(80)]
    rows += [(200 + i, rows[3][1], None) for i in range(40)]  # a vector that a third of the rows have
    rows += [(3, rows[4][1], 1), rows[5], (None, [0.5] * 8, 2), (300, [0.5, 0.25, 1.0], 2), (301, [], None), (302, [1e6] * 8, 1)]
    odd = [(400, None, 1), (401, [0.0, None], 1), (402, [float("nan")], 1), (403, [float("inf")] * 8, 2)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows + odd], "vec_id long, embedding array<double>, label int, code string, part int").repartition(5)
    got = sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in vectors.code_digests(df).collect())
    assert got == plain_codes(rows, entries)


def test_vector_codes_of_few_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vectors.code_digests(spark.createDataFrame([], schema)).count() == 0
    assert vectors.code_digests(spark.createDataFrame([(1, None, 1)], schema)).count() == 0
    r = vectors.code_digests(spark.createDataFrame([(1, [0.5] * 64, None)], schema)).head()
    assert (r["code"], r["error"], r["label_error"]) == ("00000000", 0, 0)
    rows, codebook = vectors.compressed(spark.createDataFrame([(1, [0.5] * 8), (2, [0.25] * 8)], "vec_id long, embedding array<float>"))
    assert [r["codes"] for r in rows.orderBy("vec_id").collect()] == [[0] * 4, [1] * 4] and codebook[0] == [[512, 512], [256, 256]]


def test_grammar_marks_what_its_parts_say():
    machine = toxicity.grammar()
    run = lambda *s: machine.run(list(s))
    assert run("target", "other", "insult") == ["target", "other", "insult"]
    assert run("negation", "other", "insult")[-1] == "insult~"
    assert run("negation", *["other"] * toxicity.REACH, "insult")[-1] == "insult"
    assert run("report", "target", "other", "insult")[-1] == 'insult"'
    assert run("report", "negation", "insult")[-1] == 'insult~"'
    assert run("threat", "target")[0] == "threat" and run("intent", "threat", "target")[1] == "meant"
    assert run("intent", "negation", "threat")[-1] == "meant~"
    assert toxicity.mark('insult~"') == "negated reported" and toxicity.mark("meant") == "plain"


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def corpus(draw, n):
    """Texts of two invented languages; one in eight is toxic and holds words of its language's stem; copies of some."""
    clean = {"aa": [f"{draw.choice('bcdfg')}o{draw.choice('lmnr')}a{i}" for i in range(60)], "bb": [f"z{draw.choice('aeiou')}k{i}" for i in range(60)]}
    rude = {"aa": [f"grumpf{s}" for s in ("a", "el", "os", "ik", "um", "en", "ar", "ist")], "bb": ["idiot", "moron", "scum"]}
    docs, labels = [], []
    for i in range(n):
        lang = draw.choice(["aa", "bb"])
        words = [draw.choice(clean[lang]) + draw.choice(["", "", "", ".", ",", "!"]) for _ in range(draw.randrange(5, 60))]
        toxic = draw.random() < 0.125
        for _ in range(draw.randrange(1, 4) if toxic else 0):
            words.insert(draw.randrange(len(words)), draw.choice(rude[lang]).upper() if draw.random() < 0.2 else draw.choice(rude[lang]))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_toxicity_of_held_out_texts(spark):
    draw = random.Random(4)
    docs, labels = corpus(draw, 1500)
    toxic = {i for i, _, t in labels if t}
    docs += [(9000, None), (9001, ""), (9002, "12 !!"), (9003, "he is not an idiot " * 3), (9004, "plain words " * 20_000 + "you are a moron"), (None, "scum")]
    labels += [(9003, 1, None), (None, 1, 1), (5, 1, 0), (8000, 1, 1)]
    df = spark.createDataFrame([(*d, 7, "en") for d in docs], "doc_id long, text string, score int, toxic string")
    got = toxicity.scored(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(docs)
    at = {r["doc_id"]: r for r in got}
    out = [i for i in range(1500) if held(i)]
    missed = [i for i in out if i in toxic and not at[i]["predicted"]]
    wrong = [i for i in out if i not in toxic and at[i]["predicted"]]
    assert len(missed) <= 2 and len(wrong) <= 2, (missed, wrong)
    assert all(at[i]["held_out"] == held(i) for i in range(1500))
    assert at[9000]["score"] == at[9001]["score"] == at[9002]["score"] < 0.1 and at[9000]["predicted"] == 0
    assert at[9004]["predicted"] == 1 and at[None]["predicted"] == 1 and at[None]["held_out"] is False
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)


def test_a_negation_that_the_labels_know(spark):
    """Where negated insults are labelled as clean, the clause and not the word decides."""
    draw = random.Random(5)
    docs, labels = [], []
    for i in range(900):
        words = ["w" + draw.choice("aeiou") + draw.choice("bcdfglmnrs") for _ in range(20)]
        kind = i % 6
        if kind in (0, 1):
            words[draw.randrange(2, 18)] = draw.choice(["moron", "scum", "idiot"])
        if kind == 2:
            k = draw.randrange(2, 18)
            words[k - 1 : k + 1] = ["never", draw.choice(["moron", "scum", "idiot"])]
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(kind in (0, 1))))
    df, known = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.scored(df, known).collect()}
    rate = lambda kinds: sum(got[i] for i in got if held(i) and i % 6 in kinds) / max(sum(held(i) for i in got if i % 6 in kinds), 1)
    assert rate((0, 1)) > 0.9 and rate((2,)) < 0.1 and rate((3, 4, 5)) == 0


def test_toxicity_without_evidence(spark):
    df = spark.createDataFrame([(1, "a text"), (2, None)], "doc_id long, text string")
    schema = "doc_id long, quality int, toxic int"
    for labels in ([], [(1, 1, 0)], [(i, 1, 1) for i in range(30)]):
        got = toxicity.scored(df, spark.createDataFrame(labels, schema)).collect()
        assert len(got) == 2 and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.scored(df.limit(0), spark.createDataFrame([(1, 1, 0)], schema)).count() == 0
    assert toxicity.scored(df.withColumn("doc_id", F.col("doc_id").cast("string")), spark.createDataFrame([("1", 1, 0)], "doc_id string, quality int, toxic int")).count() == 2
