"""Compression of vectors to a code a part, by weighted Lloyd over distinct integer parts.

1. Components become integers floor(SCALE * x), and each vector is cut into PARTS equal consecutive parts.
2. Equal parts at one position become one row with a weight (a hash aggregate, added up before the shuffle), so a vector that
   occurs a million times costs no more than one.
3. Rounds of Lloyd run over these rows: tasks assign them to the nearest entry of a broadcast codebook (ENTRIES rows a
   part) and add up weights and components by entry; Spark adds the tasks' sums, and the driver gets a row an entry.
4. The codes and errors of the distinct rows are joined back to the vectors. Parts that more than a HOTth of all vectors
   have, fewer than HOT a position, are broadcast; the others are joined by a shuffle.

All arithmetic is in integers, so results do not depend on the partitions.

Defined results: vectors that are null or hold null or non-finite components are dropped; a vector that is shorter than the
longest, or whose length is no multiple of PARTS, counts as padded with zeros; integers beyond +-limit() are set to it, the largest
whose distances fit 64 bits (2^27 for 64 components); the first codebook takes rows by vec_id (null last), then vector, and
has fewer entries where there are fewer rows; repeated rows take part as often as they occur; a label_error beyond 64 bits is null; an empty
table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, scratch, small, written

PARTS, ENTRIES, ROUNDS, SCALE, HOT = 4, 256, 4, 1024, 1000
#: Distances that a task holds at a time.
CELLS = 1 << 21

Codebook = list[list[list[int]]]


def limit(width: int) -> int:
    """The largest integer of a component, so that squared distances of vectors of PARTS * width fit 64 bits."""
    return math.isqrt((1 << 62) // (PARTS * width)) // 2


def integers(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, int]:
    """row, vec_id, label and parts (an array of PARTS arrays) of the vectors that are kept, written; and the width of a part."""
    x = F.col(vector)
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    kept = vectors.where(x.isNotNull() & whole)
    width = max(-(-(kept.agg(F.max(F.size(x))).head()[0] or 0) // PARTS), 1)
    most = limit(width)
    floor = lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(float(most))), F.lit(float(-most)))).cast("int")
    full = F.concat(F.transform(x, floor), F.array_repeat(F.lit(0), F.lit(PARTS * width) - F.size(x)))
    parts = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda p: F.slice(full, p * width + 1, width))
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int")
    return written(kept.select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).alias("vec_id"), label.alias("label"), parts.alias("parts")), "integers"), width


def distinct(rows: DataFrame) -> DataFrame:
    """part, x, weight: the distinct parts at each position, written."""
    each = rows.select(F.posexplode("parts").alias("part", "x"))
    return written(each.groupBy("part", "x").agg(F.count("*").alias("weight")), "distinct")


def first_codebook(rows: DataFrame) -> Codebook:
    """The parts of the ENTRIES rows with the least vec_id, by position."""
    least = rows.orderBy(F.col("vec_id").asc_nulls_last(), "parts").limit(ENTRIES).select("parts").collect()
    return [[list(r["parts"][p]) for r in least] for p in range(PARTS)]


def _nearest(codebook):
    """f(part, x): index and squared distance of the nearest entry, the least index of several."""
    import numpy as np

    books = [np.array(b, dtype="i8") for b in codebook]
    sizes = [(b * b).sum(axis=1) for b in books]

    def nearest(part, x):
        book = books[part]
        step = max(1, CELLS // len(book))
        code, error = np.empty(len(x), dtype="i8"), np.empty(len(x), dtype="i8")
        largest = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
        # Products in floating point are exact below 2^53, and faster.
        kind = "f8" if largest * largest * book.shape[1] < 1 << 52 else "i8"
        turned = book.T.astype(kind)
        for a in range(0, len(x), step):
            own = x[a : a + step]
            cross = (own.astype(kind) @ turned).astype("i8")
            far = sizes[part] - 2 * cross
            best = far.argmin(axis=1)
            code[a : a + step] = best
            error[a : a + step] = far[np.arange(len(own)), best] + (own * own).sum(axis=1)
        return code, error

    return nearest


def _parts_of(batch):
    """(position, index of its rows, their components) of a batch (part, x, ...)."""
    import numpy as np

    part = batch.column(0).to_numpy()
    x = batch.column(1).flatten().to_numpy().astype("i8").reshape(len(part), -1)
    for p in np.unique(part).tolist():
        at = np.flatnonzero(part == p)
        yield p, at, x[at]


def _sums(codebook, width: int):
    """(part, x, weight) to part, entry, weight and the sum of each component, once a task."""

    def sums(batches):
        import numpy as np
        import pyarrow as pa

        nearest, total = _nearest(codebook.value), {}
        for batch in batches:
            weight = batch.column(2).to_numpy()
            for p, at, x in _parts_of(batch) if len(batch) else ():
                code, w = nearest(p, x)[0], weight[at]
                if p not in total:
                    total[p] = np.zeros((len(codebook.value[p]), width + 1), dtype="i8")
                np.add.at(total[p], code, np.concatenate((w[:, None], x * w[:, None]), axis=1))
        for p, t in total.items():
            used = np.flatnonzero(t[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), p, "i4")), pa.array(used.astype("i4")), pa.array(t[used, 0]), *(pa.array(t[used, k + 1]) for k in range(width))], names=["part", "entry", "weight", *(f"s{k}" for k in range(width))])

    return sums


def lloyd(parts: DataFrame, codebook: Codebook, width: int, rounds: int = ROUNDS) -> Codebook:
    """The codebook after rounds of assignment and componentwise floor(sum / count); unused entries stay."""
    context = parts.sparkSession.sparkContext
    names = [f"s{k}" for k in range(width)]
    for _ in range(rounds):
        held = context.broadcast(codebook)
        each = parts.select("part", "x", "weight").mapInArrow(_sums(held, width), ", ".join(["part int, entry int, weight bigint", *(f"{c} bigint" for c in names)]))
        sums = each.groupBy("part", "entry").agg(F.sum("weight").alias("weight"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in names]).collect()
        codebook = [[list(entry) for entry in book] for book in codebook]
        for r in sums:
            codebook[r["part"]][r["entry"]] = [int(r[c]) // r["weight"] for c in names]
        held.unpersist()
    return codebook


def _assigned(codebook):
    def assigned(batches):
        import numpy as np
        import pyarrow as pa

        nearest = _nearest(codebook.value)
        for batch in batches:
            code, error = np.zeros(len(batch), dtype="i4"), np.zeros(len(batch), dtype="i8")
            for p, at, x in _parts_of(batch) if len(batch) else ():
                code[at], error[at] = nearest(p, x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code), pa.array(error)], names=["part", "x", "weight", "code", "error"])

    return assigned


def coded(rows: DataFrame, parts: DataFrame, codebook: Codebook) -> DataFrame:
    """row, codes (by position) and error of each row: the distinct parts' codes joined back."""
    context = parts.sparkSession.sparkContext
    codes = written(parts.select("part", "x", "weight").mapInArrow(_assigned(context.broadcast(codebook)), "part int, x array<int>, weight bigint, code int, error bigint"), "codes")
    n = rows.count()
    each = rows.select("row", F.posexplode("parts").alias("part", "x"))
    frequent = F.broadcast(codes.where(F.col("weight") * HOT > n).select("part", "x", "code", "error"))
    others = codes.where(F.col("weight") * HOT <= n).select("part", "x", "code", "error")
    known = each.join(frequent, ["part", "x"]).select("row", "part", "code", "error")
    known = known.unionByName(each.join(frequent, ["part", "x"], "left_anti").join(others, ["part", "x"]).select("row", "part", "code", "error"))
    codes_of = F.transform(F.sort_array(F.collect_list(F.struct("part", "code"))), lambda c: c["code"])
    return known.groupBy("row").agg(codes_of.alias("codes"), F.sum("error").alias("error"))


def compressed(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", rounds: int = ROUNDS) -> tuple[DataFrame, Codebook]:
    """vec_id, label, codes (an index a part) and error of each vector kept, written; and the codebook, by part and entry."""
    with scratch(vectors.sparkSession):
        rows, width = integers(vectors, vec_id, vector)
        parts, codebook = distinct(rows), first_codebook(rows)
        if codebook[0]:
            codebook = lloyd(parts, codebook, width, rounds)
            out = rows.join(coded(rows, parts, codebook), "row").select("vec_id", "label", "codes", "error")
        else:
            out = rows.select("vec_id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error"))
        return written(out, "compressed", keep=True), codebook


def code_digests(vectors: DataFrame) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error (of the rows with its label), codebooks_sha256."""
    rows, codebook = compressed(vectors)
    digest = hashlib.sha256(",".join(str(x) for book in codebook for entry in book for x in entry).encode()).hexdigest()
    by_label = rows.groupBy("label").agg(F.expr("try_cast(sum(cast(error as decimal(38,0))) as bigint)").alias("label_error"))
    by_label = small(written(by_label.withColumnRenamed("label", "of"), "labels"))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return rows.join(by_label, rows["label"].eqNullSafe(by_label["of"])).select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


by_value(__name__)
