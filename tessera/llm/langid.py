"""Language identification by cross-parsing entropy.

From labelled text of each language a suffix automaton is built. A text is parsed from left to right into phrases, each the
longest piece that occurs in the language's training text (or one unknown character). A phrase costs about
log2(length of the training text) bits, so phrases * log2(length) / characters estimates the cross entropy; the
language with the least wins, ties going to the one with more training documents, then the first by name. score is 1 - least / second least.

Texts are reduced to lower-case letters and single spaces (all else). All blocks of BLOCK letters of a batch step through
the automaton together, each as if a text began there; then each block is parsed again from the state that the block before
it ends in, up to the letter where both parses are in one state, and so on until no block ends otherwise. So a text
of any length gets the phrases of one parse from its first letter to its last.

The training sample is bounded by two parameters: for each language the ROWS documents with the least hash of doc_id, and
of these, in that order, the first CHARS letters altogether, which is a dozen texts of usual length. Every letter of the
sample is a class of its own, in any script; a letter outside it is an unknown character. Automata are broadcast as lists
of transitions (some MB a language); workers make tables of them, if these take at most DENSE bytes altogether.

Defined results: null text, or one without a letter, is ``und`` with score 0, as is everything if nothing could be
learned; with one language its score is 1; rows with null lang teach nothing; repeated rows are judged alike and each
stays a row; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_value, kept_by_worker

ROWS, CHARS, BLOCK, DENSE = 300, 24_000, 256, 256 << 20
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def letter_table():
    """1 for the code of a letter."""
    import numpy as np

    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype="u1", count=0x110000)


def reduced(text: str, letters):
    """Code points of a text's letters in lower case, runs of anything else being one space, and whether it has a letter."""
    import numpy as np

    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
    is_letter = letters[codes] == 1
    out = np.where(is_letter, codes, 32)
    space = ~is_letter
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = ~(space[1:] & space[:-1])
    return out[keep], bool(is_letter.any())


def automaton(classes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton's states; 0 is the root."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in classes:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


class Model:
    """Of one language. letters: the sample's, sorted; a letter's class is its place, then come the classes of unknown ones
    and of padding. key (state * classes + class) leads to the state at."""

    def __init__(self, name: str, codes):
        import numpy as np

        self.name, self.bits = name, math.log2(len(codes) + 1)
        self.letters, classes = np.unique(codes, return_inverse=True)
        self.unknown, self.pad = len(self.letters), len(self.letters) + 1
        self.width = self.pad + 1
        states = automaton(classes.tolist())
        steps = sorted((i * self.width + c, s) for i, out in enumerate(states) for c, s in out.items())
        self.n_states = len(states)
        self.key, self.at = (np.array(x, dtype=t) for x, t in zip(zip(*steps), ("i8", "i4")))

    @classmethod
    def restored(cls, state: dict) -> "Model":
        """The model with these attributes: a broadcast holds them alone, so that workers need not know this class."""
        model = cls.__new__(cls)
        model.__dict__.update(state)
        return model

    @property
    def dense_bytes(self) -> int:
        return 4 * self.n_states * self.width


class Parser:
    """A model at work. A step gives the next state, or ~state where a new phrase starts."""

    def __init__(self, model: Model, dense: bool):
        import numpy as np

        self.model = model
        self.class_of = np.full(0x110001, model.unknown, dtype="u2" if model.width < 1 << 16 else "u4")
        self.class_of[model.letters] = np.arange(len(model.letters))
        self.class_of[0x110000] = model.pad
        self.root = np.full(model.width, -1, dtype="i4")
        first = model.key < model.width
        self.root[model.key[first]] = ~model.at[first]
        self.root[model.pad] = 0
        self.table = None
        if dense:
            table = np.tile(self.root, (model.n_states, 1))
            table.reshape(-1)[model.key[~first]] = model.at[~first]
            self.table = table.reshape(-1)

    def step(self, state, classes):
        import numpy as np

        key = state * np.int64(self.model.width) + classes
        if self.table is not None:
            return self.table[key]
        place = np.minimum(np.searchsorted(self.model.key, key), len(self.model.key) - 1)
        return np.where((self.model.key[place] == key) & (state > 0), self.model.at[place], self.root[classes])

    def phrases(self, blocks, follows):
        """Phrases in each block. blocks[k, i]: the k-th class of block i; follows[i]: whether it goes on from block i - 1."""
        import numpy as np

        states = np.empty(blocks.shape, dtype="i4")
        starts = np.empty(blocks.shape, dtype=bool)

        def parse(which, state):
            """Parses the blocks up to where they are in the state held; gives those that end in another."""
            for k in range(len(blocks)):
                state = self.step(state, blocks[k, which])
                start = state < 0
                state = np.where(start, ~state, state)
                apart = states[k, which] != state
                states[k, which], starts[k, which] = state, start
                which, state = which[apart], state[apart]
                if not len(which):
                    break
            return which

        state = np.zeros(blocks.shape[1], dtype="i4")
        for k, row in enumerate(blocks):
            state = self.step(state, row)
            starts[k] = state < 0
            state = state ^ (state >> 31)
            states[k] = state
        again = np.flatnonzero(follows)
        while len(again):
            ended = parse(again, states[-1, again - 1]) + 1
            ended = ended[ended < len(follows)]
            again = ended[follows[ended]]
        return starts.sum(axis=0)


def _sample(docs: DataFrame, rows: int) -> list[tuple[str, str]]:
    """(lang, text) of the training documents, in a fixed order."""
    known = docs.where(docs["lang"].isNotNull() & docs["doc_id"].isNotNull() & ~held_out(docs["doc_id"]))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = known.select("doc_id", "lang").distinct().withColumn("k", F.row_number().over(order)).where(F.col("k") <= rows).collect()
    at = {(r["doc_id"], r["lang"]): r["k"] for r in ids}
    if not at:
        return []
    found = known.where(F.col("doc_id").isin([i for i, _ in at]) & F.col("text").isNotNull()).select("doc_id", "lang", F.substring("text", 1, CHARS).alias("text")).collect()
    picked = [(lang, at[doc_id, lang], text) for doc_id, lang, text in found if (doc_id, lang) in at]
    return [(lang, text) for lang, _, text in sorted(picked)]


def fit(docs: DataFrame, rows: int = ROWS, chars: int = CHARS) -> list[Model]:
    """A model for each language, languages with more training documents first."""
    import numpy as np

    letters = letter_table()
    held: dict[str, list] = {}
    size: Counter = Counter()
    for lang, text in _sample(docs, rows):
        if size[lang] < chars:
            codes, any_letter = reduced(text, letters)
            if any_letter:
                held.setdefault(lang, []).append(codes[: chars - size[lang]])
                size[lang] += len(held[lang][-1])
    documents = dict(docs.where(docs["lang"].isNotNull() & ~held_out(docs["doc_id"])).groupBy("lang").count().collect())
    return [Model(lang, np.concatenate(held[lang])) for lang in sorted(held, key=lambda x: (-documents[x], x))]


def predict(texts: list[str | None], parsers: list[Parser], letters) -> list[tuple[str, float]]:
    """(language, score) of each text; the blocks of all texts are parsed together."""
    import numpy as np

    found = [reduced(t, letters) if t else (None, False) for t in texts]
    use = [i for i, (_, any_letter) in enumerate(found) if any_letter and parsers]
    out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    if not use:
        return out
    lengths = np.array([len(found[i][0]) for i in use])
    starts = np.concatenate(([0], np.cumsum(-(-lengths // BLOCK))))
    codes = np.full(starts[-1] * BLOCK, 0x110000, dtype="u4")
    for k, i in enumerate(use):
        codes[starts[k] * BLOCK : starts[k] * BLOCK + lengths[k]] = found[i][0]
    follows = np.ones(starts[-1], dtype=bool)
    follows[starts[:-1]] = False
    bits = np.empty((len(parsers), len(use)))
    for m, parser in enumerate(parsers):
        blocks = np.ascontiguousarray(parser.class_of[codes].reshape(-1, BLOCK).T)
        bits[m] = np.add.reduceat(parser.phrases(blocks, follows), starts[:-1]) * parser.model.bits / lengths
    best = bits.argmin(axis=0)
    least = bits.min(axis=0)
    rest = np.partition(bits, 1, axis=0)[1] if len(parsers) > 1 else np.full(len(use), np.inf)
    score = np.clip(1 - least / rest, 0, 1)
    for k, i in enumerate(use):
        out[i] = (parsers[best[k]].model.name, float(score[k]))
    return out


def parsers_of(models: list[Model]) -> list[Parser]:
    dense = sum(m.dense_bytes for m in models) <= DENSE
    return [Parser(m, dense) for m in models]


def _predictor(models, name: str):
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        letters, parsers = kept_by_worker(f"langid-{name}", lambda: (letter_table(), parsers_of([Model.restored(m) for m in models.value])))
        for batch in batches:
            texts, first, size = batch.column(1), 0, 0
            lengths = pc.binary_length(texts).fill_null(0).to_pylist()
            got: list[tuple[str, float]] = []
            for i, n in enumerate(lengths):
                size += n
                if size >= 2_000_000 or i + 1 == len(lengths):
                    got += predict(texts.slice(first, i + 1 - first).to_pylist(), parsers, letters)
                    first, size = i + 1, 0
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identified(docs: DataFrame, rows: int = ROWS, chars: int = CHARS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learns from those that are not held out."""
    models = docs.sparkSession.sparkContext.broadcast([vars(m) for m in fit(docs, rows, chars)])
    columns = docs.select("doc_id", "text", F.coalesce(held_out(docs["doc_id"]), F.lit(False)).alias("held_out"))
    return columns.mapInArrow(_predictor(models, uuid.uuid4().hex), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


by_value(__name__)
