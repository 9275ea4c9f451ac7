"""Plain versions of the operators, for small inputs."""

import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def space_words(text):
    return [w for w in re.split("[ \t\n\v\f\r]+", text or "") if w]


def item_words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER)) if w]


def shingles(text, size=5):
    w = space_words((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def groups(texts):
    """For each text the set of indices that it is linked with over any path, itself included."""
    sets = [shingles(t) for t in texts]
    at = list(range(len(texts)))

    def find(a):
        while at[a] != a:
            a = at[a]
        return a

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                at[find(i)] = find(j)
    out = defaultdict(set)
    for i in range(len(texts)):
        out[find(i)].add(i)
    return [out[find(i)] for i in range(len(texts))]


def hit_words(text, items):
    """(hit word positions, ids of items with a window in the text)."""
    w, hit, found = item_words(text), set(), set()
    for item_id, item in items:
        v = item_words(item)
        n = min(10, len(v))
        windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(item_id)
    return hit, found


def kept_lines(texts, threshold=10):
    key = lambda line: line.strip(" \t\n\v\f\r").translate(LOWER)
    lines = [(t or "").split("\n") for t in texts]
    seen = Counter(k for ls in lines for k in {key(x) for x in ls} if k)
    return [[x for x in ls if not key(x) or seen[key(x)] < threshold] for ls in lines]


def repeated_bytes(texts, length):
    """For each text (bytes) a flag for each byte."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        flags = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                flags[i : i + length] = b"\1" * length
        out.append(flags)
    return out
