"""Toxicity of texts by a weighted grammar over clauses.

A clause is what stands between sentence marks. Words become symbols (insult, threat, intent, target, negation, report, other), and a
composition of small transducers reads them: one marks what follows a negation, one what follows a verb of reporting,
one turns an intent before a threat into a threat that is meant. What matches is an insult or a threat with its
marks, and a clause that names its target adds to it. The clause's weight is that of its strongest match; a text's
score is a logistic function of its clauses' weights, so a word alone counts as its clause says.

Learned from labelled rows: which words insult, as log odds of words and of stems (their first letters) in toxic texts against
others, less their error; what each mark adds; and the curve. Distinct contexts of a word count, with the words before and
after it, so that copies and near copies of a text are no evidence. Marks and the curve are learned with words learned from the other half of the sample.

Defined results: null and empty texts have no clause and score what the sample's texts without matches do; a doc_id
labelled both ways counts as toxic; null labels and null doc_ids teach nothing; without labels of both kinds no word is known and all
scores are the share of toxic labels; repeated rows score alike; an empty table gives an empty table; further columns
are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import splitting
from .common import by_value, scratch, written
from .splitting import byte_kinds, hashes, split
from .suffixes import mixed

#: Rows of the sample for each label; terms of the lexicon at most; letters of a stem; words that a negation reaches.
ROWS, TERMS, STEMS, REACH = 15_000, 20_000, range(4, 9), 4
#: Distinct contexts that a term must have in toxic texts, its least weight, the errors taken off, and the percentage that a
#: stem must have beyond the longer term that it owes most to.
SEEN, WEIGHT, ERRORS, OWN = 4, 1.5, 2.0, 20
#: Score from which a text counts as toxic.
THRESHOLD = 0.7

# Function words of English, German, French and Spanish.
WORDS = {
    "target": "you your yours yourself you're u du dich dir dein deine euch euer tu te toi ton tes vous votre tú ti usted ustedes vosotros",
    "negation": "not no never none isn't aren't don't doesn't wasn't weren't without nicht kein keine keinen nie niemals ohne pas ne jamais aucun sans nunca jamás ningún sin",
    "report": "said says say called calls quote quoted quotes wrote writes reported claimed sagte sagt nannte schrieb zitierte disait dit appelé écrit cité dijo dice llamó escribió citó",
    "intent": "will shall gonna going werde wirst vais vas allons voy vamos",
    "threat": "kill hurt murder destroy stab shoot strangle töten umbringen ermorden verletzen tuer frapper assassiner étrangler matar golpear asesinar apuñalar",
}
#: Bytes that end a clause; those of words are letters, digits, apostrophes and all of further alphabets.
SEPARATORS = b".;!?|\n\x0b\x0c\r"
MARKS = ("plain", "negated", "reported", "negated reported")
#: What a mark adds before anything is learned, and how many clauses that belief is worth.
BELIEF, STRENGTH = {"negated": -2.0, "reported": -2.0, "target": 0.5, "threat": 2.0}, 20.0


@dataclass
class Transducer:
    """Reads symbols and writes one for each: (state, symbol) leads to (state, written). A pair that is not in arcs keeps state 0,
    or the state that rest gives, and writes what it read."""

    arcs: dict[tuple[int, str], tuple[int, str]]
    rest: dict[int, int] = field(default_factory=dict)

    def step(self, state: int, symbol: str) -> tuple[int, str]:
        return self.arcs.get((state, symbol)) or (self.rest.get(state, 0), symbol)


@dataclass
class Composition:
    """Transducers one after the other; its states are made when they are met and kept, as in one large table."""

    parts: list[Transducer]
    table: dict = field(default_factory=dict)

    def step(self, state: tuple[int, ...], symbol: str) -> tuple[tuple[int, ...], str]:
        key = (state, symbol)
        if key not in self.table:
            new = []
            for part, s in zip(self.parts, state):
                s, symbol = part.step(s, symbol)
                new.append(s)
            self.table[key] = (tuple(new), symbol)
        return self.table[key]

    def run(self, symbols: list[str]) -> list[str]:
        state, out = (0,) * len(self.parts), []
        for symbol in symbols:
            state, written_ = self.step(state, symbol)
            out.append(written_)
        return out


def grammar() -> Composition:
    """Symbols to the same with marks: `insult~` is negated, `insult"` reported, `meant` a threat after an intent."""
    meant = Transducer({(0, "intent"): (1, "intent"), **{(s, "threat"): (0, "meant") for s in range(1, REACH + 1)}, **{(s, "intent"): (1, "intent") for s in range(1, REACH + 1)}}, {s: (s + 1) % (REACH + 1) for s in range(1, REACH + 1)})
    # The state counts the words that the negation still reaches.
    negated = {(s, "negation"): (REACH, "negation") for s in range(REACH + 1)}
    for s in range(1, REACH + 1):
        negated |= {(s, "insult"): (s - 1, "insult~"), (s, "meant"): (s - 1, "meant~")}
    negation = Transducer(negated, {s: s - 1 for s in range(1, REACH + 1)})
    reported = {(s, "report"): (1, "report") for s in (0, 1)}
    for symbol in ("insult", "insult~", "meant", "meant~"):
        reported[1, symbol] = (1, symbol + '"')
    return Composition([meant, negation, Transducer(reported, {1: 1})])


def mark(symbol: str) -> str:
    return MARKS[("~" in symbol) + 2 * ('"' in symbol)]


def kinds():
    """Bytes of words, of gaps and between clauses."""
    return byte_kinds(bytes(b for b in range(128) if not (chr(b).isalnum() or chr(b) == "'" or b in SEPARATORS)), SEPARATORS)


def spelled(words):
    """Distinct words in lower case without what is no letter at their ends."""
    import pyarrow as pa
    import pyarrow.compute as pc

    return pc.replace_substring_regex(pc.utf8_lower(words.cast(pa.string())), r"^[^\p{L}]+|[^\p{L}]+$", "")


def terms(word: str) -> list[str]:
    """A word and its stems, which end in *."""
    return [word, *(word[:k] + "*" for k in STEMS if k < len(word))]


def _contexts(batches):
    """(text, toxic, half) to the distinct contexts of a batch's words, but for those that are negated or reported: a hash of the word before,
    the word and the one after in the clause, the labels and the word."""
    import numpy as np
    import pyarrow as pa

    table, listed = kinds(), {name: set(words.split()) for name, words in WORDS.items()}
    for batch in batches:
        group = batch.column(1).to_numpy().astype("u8") * np.uint64(2) + batch.column(2).to_numpy().astype("u8")
        for part in split(batch.column(0), table):
            words = spelled(part.words)
            own = hashes(words)[part.word]
            same = part.piece[1:] == part.piece[:-1]
            negation, report = (np.array([w in listed[name] for w in words.to_pylist()], dtype=bool)[part.word] for name in ("negation", "report"))
            # What a negation or a report may turn round says nothing about the word.
            starts = np.flatnonzero(np.concatenate(([True], ~same)))[: len(own)]
            seen = np.cumsum(report) - report
            marked = seen > seen[starts][np.cumsum(np.concatenate(([True], ~same)))[: len(own)] - 1]
            for reach in range(1, REACH + 1):
                marked[reach:] |= negation[:-reach] & (part.piece[reach:] == part.piece[:-reach])
            before, after = np.zeros(len(own), dtype="u8"), np.zeros(len(own), dtype="u8")
            before[1:] = np.where(same, own[:-1], 0)
            after[:-1] = np.where(same, own[1:], 0)
            context = mixed(mixed(own) + before * np.uint64(3) + after * np.uint64(5)) >> np.uint64(2) << np.uint64(2) | group[part.text]
            use = np.flatnonzero(~marked & np.array([w != "" for w in words.to_pylist()], dtype=bool)[part.word])
            context, first = np.unique(context[use], return_index=True)
            word = words.take(pa.array(part.word[use[first]]))
            yield pa.RecordBatch.from_arrays([pa.array(context.astype("i8")), pa.array((context & np.uint64(3)).astype("i4")), word], names=["context", "group", "word"])


def _counted(batches):
    """Distinct contexts to the number of them that each term has, by group (2 * toxic + half); the empty term has all."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        if not len(batch):
            continue
        coded = batch.column(2).dictionary_encode()
        names = coded.dictionary.to_pylist()
        n = np.bincount(coded.indices.to_numpy().astype("i8") * 4 + batch.column(1).to_numpy(), minlength=4 * len(names)).reshape(-1, 4)
        total = {"": n.sum(axis=0)}
        for word, own in zip(names, n):
            for t in terms(word):
                if t in total:
                    total[t] = total[t] + own
                else:
                    total[t] = own
        n = np.array(list(total.values()))
        yield pa.RecordBatch.from_arrays([pa.array(list(total)), *(pa.array(n[:, k].astype("i8")) for k in range(4))], names=["term", "n0", "n1", "n2", "n3"])


def weight(toxic: float, clean: float, all_toxic: float, all_clean: float) -> float:
    """Log odds of a term in contexts of toxic texts against others, less ERRORS of its standard errors."""
    return math.log((toxic + 0.5) / (all_toxic + 1)) - math.log((clean + 0.5) / (all_clean + 1)) - ERRORS * math.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))


Lexicon = dict[str, float]


def lexicon(counts: list[tuple[str, list[int]]], halves: tuple[int, ...]) -> Lexicon:
    """term to weight, from (term, [clean in half 0, in 1, toxic in 0, in 1]); words that are known as clean have weight 0."""
    pick = lambda n: (sum(n[2 + h] for h in halves), sum(n[h] for h in halves))
    total = pick(dict(counts).get("", [0, 0, 0, 0]))
    if not all(total):
        return {}
    # What a stem owes to the longer term that it owes most to.
    owed: dict[str, int] = {}
    for term, n in counts:
        for stem in terms(term.rstrip("*"))[1:]:
            owed[stem] = max(owed.get(stem, 0), pick(n)[0])
    out = {}
    for term, n in counts:
        toxic, clean = pick(n)
        w = weight(toxic, clean, *total)
        if term and toxic >= SEEN and w >= WEIGHT and not (term.endswith("*") and (toxic - owed.get(term, 0)) * 100 < OWN * toxic):
            out[term] = w
        elif term and not term.endswith("*") and clean >= SEEN:
            out[term] = 0.0
    return out


def insult_weight(word: str, known: Lexicon) -> float:
    """The largest weight of the word and its stems; 0 for words that are known as clean."""
    if known.get(word) == 0.0:
        return 0.0
    return max(known.get(t, 0.0) for t in terms(word))


def matches(column, known: list[Lexicon], choice) -> list[list[tuple[float, str, bool, bool]]]:
    """For each text its clauses' matches (weight of the word, mark, whether the clause has a target, whether it is a threat).
    choice: which lexicon each text is read with."""
    import numpy as np

    symbol_of = {w: name for name, words in WORDS.items() for w in words.split()}
    machine, out = grammar(), [[] for _ in range(len(column))]
    for part in split(column, kinds()):
        if not len(part.word):
            continue
        words = spelled(part.words).to_pylist()
        symbol = [symbol_of.get(w, "other") for w in words]
        weights = np.array([[insult_weight(w, k) if s == "other" else 0.0 for w, s in zip(words, symbol)] for k in known])
        threat = np.array([s == "threat" for s in symbol])
        hit = (weights[choice[part.text], part.word] > 0) | threat[part.word]
        cuts = np.flatnonzero(np.concatenate(([True], part.piece[1:] != part.piece[:-1], [True])))
        for c in np.unique(np.searchsorted(cuts, np.flatnonzero(hit), side="right") - 1).tolist():
            a, b = int(cuts[c]), int(cuts[c + 1])
            text = int(part.text[a])
            own = weights[choice[text]]
            ids = part.word[a:b].tolist()
            read = ["insult" if own[w] > 0 else symbol[w] for w in ids]
            target = "target" in read
            for w, s in zip(ids, machine.run(read)):
                if s.startswith("insult"):
                    out[text].append((c, float(own[w]), mark(s), target, False))
                elif s.startswith("meant") and target:
                    out[text].append((c, 0.0, mark(s), True, True))
    return out


@dataclass
class Model:
    known: Lexicon
    marks: dict[str, float]
    curve: tuple[float, float]


def clause_weight(found, marks: dict[str, float]) -> float:
    """The weight of a match (word's weight, mark, target, threat)."""
    w, name, target, threat = found
    total = w + (marks["threat"] if threat else 0.0) + (marks["target"] if target else 0.0)
    return total + sum(marks[m] for m in ("negated", "reported") if m in name)


def total(found, marks: dict[str, float]) -> float:
    """A text's total: its strongest clause, and the others by falling shares."""
    best: dict[int, float] = {}
    for clause, *match in found:
        best[clause] = max(best.get(clause, 0.0), clause_weight(match, marks))
    return sum(w / (k + 1) for k, w in enumerate(sorted(best.values(), reverse=True)))


def learned_marks(rows) -> dict[str, float]:
    """What each mark adds, from (toxic, weight of the row, matches): log odds of the texts of clauses with it against all with
    a match, and a belief worth STRENGTH clauses."""
    base, with_ = [0.0, 0.0], {m: [0.0, 0.0] for m in BELIEF}
    for toxic, w, found in rows:
        for _, _, name, target, threat in found:
            base[toxic] += w
            for m in [x for x in ("negated", "reported") if x in name] + ["target"] * target + ["threat"] * threat:
                with_[m][toxic] += w
    share = (base[1] + 0.5) / (sum(base) + 1)
    out = {}
    for m, n in with_.items():
        # Smoothed towards the share of all matches, so that a few clauses like the others add nothing.
        evidence = math.log((n[1] + 5 * share) / (n[0] + 5 * (1 - share))) - (math.log(share / (1 - share)) if m != "threat" else 0.0)
        out[m] = (BELIEF[m] * STRENGTH + evidence * sum(n)) / (STRENGTH + sum(n))
    return out


def fitted_curve(rows) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a + b * total))), b >= 0, from (toxic, weight, total) by Newton's method with a weak prior."""
    import numpy as np

    if not rows:
        return 0.0, 1.0
    y, w, x = (np.array(c, dtype="f8") for c in zip(*rows))
    share = ((w * y).sum() + 0.5) / (w.sum() + 1)
    a, b = math.log(share / (1 - share)), 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        g = np.array([(w * (y - p)).sum(), (w * (y - p) * x).sum() - (b - 1)])
        h = w * p * (1 - p)
        m = np.array([[h.sum() + 1e-6, (h * x).sum()], [(h * x).sum(), (h * x * x).sum() + 1]])
        step = np.linalg.solve(m, g)
        step *= min(1.0, 2.0 / max(abs(step).max(), 1e-9))
        a, b = a + step[0], max(b + step[1], 0.0)
        if abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> tuple[DataFrame, dict[int, float]]:
    """text, toxic, half of about rows labelled rows of each label, written; and how many rows one of each label stands for."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    found = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    stands = {t: max(found.get(t, 0) / rows, 1.0) for t in (0, 1)}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    drawn = known.where(draw * F.when(F.col("toxic") == 1, stands[1]).otherwise(stands[0]) < 1.0)
    # About 2 * rows ids, whatever the tables have.
    out = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("text", "toxic", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half"))
    return written(out.where("text is not null").repartition(64), "sample"), stands


def counted(sampled: DataFrame) -> list[tuple[str, list[int]]]:
    """(term, [clean in half 0, in 1, toxic in 0, in 1]) of the terms with SEEN toxic contexts and of words with as many clean ones that
    begin with such a stem, TERMS at most of each, and of the empty term."""
    contexts = sampled.select("text", "toxic", "half").mapInArrow(_contexts, "context bigint, `group` int, word string")
    contexts = contexts.groupBy("context", "group").agg(F.first("word").alias("word"))
    each = contexts.mapInArrow(_counted, "term string, n0 bigint, n1 bigint, n2 bigint, n3 bigint").groupBy("term").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(4)])
    each = written(each, "terms")
    toxic = each.where(f"n2 + n3 >= {SEEN} or term = ''")
    best = toxic.orderBy(F.desc(F.expr("term = ''")), F.desc(F.expr("(n2 + n3) / (n0 + n1 + 1.0D)")), F.desc(F.expr("n2 + n3")), "term").limit(TERMS).collect()
    stems = [r["term"] for r in best if r["term"].endswith("*") and 10 * (r["n2"] + r["n3"]) > r["n0"] + r["n1"]]
    hidden = []
    if stems:
        stem_of = F.array(*[F.concat(F.left("term", F.lit(k)), F.lit("*")) for k in STEMS])
        words = each.where(f"n0 + n1 >= {SEEN} and term <> '' and not endswith(term, '*')").withColumn("stem", F.explode(F.array_distinct(stem_of)))
        with_stem = words.join(F.broadcast(sampled.sparkSession.createDataFrame([(s,) for s in stems], "stem string")), "stem", "left_semi").drop("stem").distinct()
        hidden = with_stem.orderBy(F.desc(F.expr("n0 + n1")), "term").limit(TERMS).collect()
    return [(r["term"], [r["n0"], r["n1"], r["n2"], r["n3"]]) for r in {r["term"]: r for r in [*best, *hidden]}.values()]


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the labelled rows that are not held out; its sample, lexicon and matches are bounded by ROWS and TERMS."""
    sampled, stands = sample(docs, labels)
    counts = counted(sampled)
    halves = [lexicon(counts, (1,)), lexicon(counts, (0,))]
    held = docs.sparkSession.sparkContext.broadcast(halves)

    def found(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("clause", pa.int32()), ("weight", pa.float64()), ("mark", pa.string()), ("target", pa.bool_()), ("threat", pa.bool_())]))
        for batch in batches:
            lists = matches(batch.column(0), held.value, batch.column(2).to_numpy())
            lists = [[dict(zip(("clause", "weight", "mark", "target", "threat"), m)) for m in found] for found in lists]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(lists, kind)], names=["toxic", "found"])

    rows = sampled.select("text", "toxic", "half").mapInArrow(found, "toxic int, found array<struct<clause:int,weight:double,mark:string,target:boolean,threat:boolean>>")
    rows = [(r["toxic"], stands[r["toxic"]], [tuple(m) for m in r["found"]]) for r in rows.collect()]
    marks = learned_marks(rows)
    curve = fitted_curve([(toxic, w, total(m, marks)) for toxic, w, m in rows])
    return Model(lexicon(counts, (0, 1)), marks, curve)


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    with scratch(docs.sparkSession):
        model = learned(docs, labels)
    held = docs.sparkSession.sparkContext.broadcast((model.known, model.marks, model.curve))

    def scores(batches):
        import math

        import numpy as np
        import pyarrow as pa

        known, marks, (a, b) = held.value
        for batch in batches:
            lists = matches(batch.column(0), [known], np.zeros(len(batch), dtype="i8"))
            values = [1 / (1 + math.exp(-max(min(a + b * total(m, marks), 30.0), -30.0))) for m in lists]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(values, pa.float64())], names=["doc_id", "score"])

    rows = docs.select("text", "doc_id").mapInArrow(scores, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


by_value(__name__)
by_value(splitting.__name__)
