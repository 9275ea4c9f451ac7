"""Links that only the last round of the Jaccard join can find."""

import random

import pytest

from tessera.llm import jaccard

from . import brute


def components(spark, texts, size=1):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: r["component_id"] for r in jaccard.joined(df, size).collect()}


def expected(texts, size=1):
    sets = [brute.shingles(t, size) for t in texts]
    at = list(range(len(texts)))

    def root(a):
        while at[a] != a:
            a = at[a]
        return a

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                at[b] = a
    return {i: root(i) for i in range(len(texts))}


def family(name: str, seed: int) -> list[str]:
    """Two texts a, b that link and share lists first with many others, which are of one component before the last round."""
    draw = random.Random(seed)
    common = [f"{name}a{i}" for i in range(1400)]
    own = lambda who, n: [f"{name}{who}{i}" for i in range(n)]
    out = [common + own("decoy", 400)]
    out += [own("decoy", 400) + own(f"dx{k}", 0) + common[: 200 + k] for k in range(16)]
    for group in "PQ":
        shared, others = draw.sample(common, 700), own(f"o{group}", 194)
        out += [shared + others + own(f"{group}{k}", 105) for k in range(14)]
    out += [[w for w in common if w not in gone] for gone in (set(draw.sample(common, 104 if k == 0 else 90)) for k in range(24))]
    out += [common + own("x", 170), common + own("y", 170)]
    return [" ".join(w) for w in out]


def test_families_whose_lists_shrink(spark):
    texts = [t for k in range(3) for t in family(f"f{k}", k)]
    assert components(spark, texts) == expected(texts)


@pytest.mark.parametrize("seed", range(3))
def test_random_sets_with_short_lists(spark, monkeypatch, seed):
    monkeypatch.setattr(jaccard, "COMMON", 2)
    monkeypatch.setattr(jaccard, "BUCKETS", 2)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "LEVELS", (2, 3, 8, 32, 128, 512))
    draw = random.Random(seed)
    bases = [[f"w{draw.randrange(60)}" for _ in range(draw.randrange(8, 30))] for _ in range(12)]
    texts = []
    for _ in range(120):
        words = list(dict.fromkeys(draw.choice(bases)))
        for _ in range(draw.randrange(4)):
            words[draw.randrange(len(words))] = f"w{draw.randrange(60)}"
        texts.append(" ".join(words))
    assert components(spark, texts) == expected(texts)


def test_bitmaps_go_when_the_sets_are_written(spark, monkeypatch):
    context, made, gone = type(spark.sparkContext), [], []
    send = context.broadcast

    def watched(self, value):
        held = send(self, value)
        end = held.destroy
        held.destroy = lambda *more: (gone.append(held), end(*more))
        made.append(held)
        return held

    monkeypatch.setattr(context, "broadcast", watched)
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(40)) + (" x" if i else "")) for i in range(3)], "doc_id long, text string")
    assert {r["component_id"] for r in jaccard.joined(docs).collect()} == {0}
    assert made and made == gone
