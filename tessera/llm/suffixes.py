"""Removal of repeated byte strings of LENGTH or more, by prefix doubling over sampled positions.

Ranks are hashes of what follows a position, so equal ranks are equal strings, and Spark's sorts by rank find what
repeats. A first round picks the positions: each window of LENGTH bytes is represented by the GRAM-byte string in it with
the least hash, which depends on the window's bytes alone, so equal windows are represented at equal offsets. A run is the
windows in a row with one representative, about 70 of them. (Doubling over all positions would sort every byte of the corpus
at each offset.) Rounds:

0. equal runs of one text repeat, and all but one of them are settled where the text is read;
1. representatives are sorted by rank (GRAM bytes). A unique rank ends it: no window of the run repeats. So do equal runs
   (a rank of the whole run, LENGTH bytes and more): all of their windows repeat;
2. at growing offsets, pairs of the rank at a position and the rank of as many bytes at the offset are sorted and ranked
   anew, to the right of the representative and to its left: 32, 64 and 116 bytes. A window has at least 84 bytes on one
   side of its representative, so a position that is unique on both sides before then ends;
3. past that, what is left is extended: the runs' bytes are sorted by representative, and each window of LENGTH
   bytes is compared with those at the same offset. One run of each repeated pair takes part as a witness. For
   representatives with over BIG runs, windows are sorted by rank one by one instead, so no group must fit a task.

Texts that occur more than once (hashes of 88 bits) are removed whole, if LENGTH bytes long, and take part once.
The joins of spans to texts broadcast the spans if they take at most BROADCAST bytes, and shuffle both sides beyond that.

Defined results: null text is empty; texts shorter than LENGTH bytes keep everything; repeated rows with LENGTH bytes
are all emptied; an empty table gives an empty table; a character may be cut in two (kept bytes are bytes); further
columns stay in trimmed(), but for those named n_bytes, n_removed or n_spans, which the new ones replace; bytes that are
no longer UTF-8 become U+FFFD there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_value, kept_by_worker, scratch, small, written

LENGTH, GRAM = 200, 32
BUFFER, BIG, BROADCAST = 1 << 21, 50_000, 128 << 20
MULTIPLIER = 0x5851F42D4C957F2D
RUN = "rank bigint, whole bigint, text_id bigint, more int, start int, n int, at int"


def doublings(length: int, gram: int) -> list[tuple[int, int]]:
    """(length known, next length) of each round, up to what a window has at least on one side of its representative."""
    out, known, most = [], gram, gram + -(-(length - gram) // 2)
    while known < most:
        out.append((known, min(2 * known, most)))
        known = out[-1][1]
    return out


def mixed(x):
    """A bijection of 64-bit numbers that spreads their bits (the finaliser of splitmix64)."""
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tables(size: int):
    """Numbers for byte values; powers of the multiplier and of its inverse."""
    import numpy as np

    def powers(base: int):
        out = np.full(size, base, dtype="u8")
        out[0] = 1
        return np.multiply.accumulate(out)

    values = mixed(np.arange(1, 257, dtype="u8") * np.uint64(0x9E3779B97F4A7C15))
    return values, powers(MULTIPLIER), powers(pow(MULTIPLIER, -1, 1 << 64))


def sums(data, numbers):
    """pre: hash of bytes a to b is (pre[b] - pre[a]) * inverse power of a."""
    import numpy as np

    values, power, _ = numbers
    pre = np.zeros(len(data) + 1, dtype="u8")
    np.cumsum(values[data] * power[: len(data)], out=pre[1:])
    return pre


def find_runs(data, ends, numbers, length: int, gram: int):
    """Runs of windows with one representative. data: texts one after the other; ends: where each ends.
    Gives rank, whole, text, start (in the text), n (windows), at (the representative's offset from start), and for each
    round the ranks of the bytes that its offset adds to the right and to the left (0 where the text ends before)."""
    import numpy as np

    inverse = numbers[2]
    pre = sums(data, numbers)
    grams = mixed((pre[gram:] - pre[:-gram]) * inverse[: len(data) - gram + 1])
    # The position in the low bits makes the least hash unique: the leftmost of equal ones.
    least = (grams >> np.uint64(24) << np.uint64(24)) | np.arange(len(grams), dtype="u8")
    width, have = length - gram + 1, 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if width > have:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    chosen = (least & np.uint64(0xFFFFFF)).astype("i8")
    starts = np.concatenate(([0], ends[:-1]))
    text = np.repeat(np.arange(len(ends)), ends - starts)[: len(chosen)]
    valid = np.arange(len(chosen)) + length <= ends[text]
    same = valid[1:] & valid[:-1] & (chosen[1:] == chosen[:-1])
    first = valid.copy()
    first[1:] &= ~same
    last = valid.copy()
    last[:-1] &= ~same
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    n, at = b - a, chosen[a] - a
    end = b - 1 + length
    whole = mixed((pre[end] - pre[a]) * inverse[a]) ^ mixed((n * 4096 + at).astype("u8"))
    place, further = chosen[a], []
    for known, more in doublings(length, gram):
        for p, inside in ((place + more - known, place + more <= ends[text[a]]), (place + gram - more, place + gram - more >= starts[text[a]])):
            p = np.where(inside, p, 0)
            ranks = mixed((pre[np.minimum(p + known, len(data))] - pre[p]) * inverse[p])
            further.append(np.where(inside, np.where(ranks == 0, np.uint64(1), ranks), np.uint64(0)).astype("i8"))
    return grams[place].astype("i8"), whole.astype("i8"), text[a], a - starts[text[a]], n, at, further


def settled(rank, whole, text, start, n):
    """Of runs in order of place: which to sort with the other texts' runs, and (index, start, n) of pieces that repeat
    in their own text. A text that repeats a short period has thousands of equal runs; one of them is enough for others."""
    import numpy as np

    order = np.lexsort((start, whole, rank, text))
    same = np.zeros(len(order), dtype=bool)
    if len(order) > 1:
        a, b = order[1:], order[:-1]
        same[1:] = (text[a] == text[b]) & (rank[a] == rank[b]) & (whole[a] == whole[b])
    further, twice = np.zeros(len(order), dtype=bool), np.zeros(len(order), dtype=bool)
    further[order] = same
    twice[order] = same | np.concatenate((same[1:], [False]))
    at = np.flatnonzero(twice)
    pieces = []
    if len(at):
        joined = (text[at[1:]] == text[at[:-1]]) & (start[at[1:]] == start[at[:-1]] + n[at[:-1]])
        firsts = np.flatnonzero(np.concatenate(([True], ~joined)))
        lasts = np.concatenate((firsts[1:], [len(at)])) - 1
        for a, b in zip(at[firsts], at[lasts]):
            end = start[b] + n[b]
            pieces += [(a, p, min(256, end - p)) for p in range(start[a], end, 256)]
    return ~further, pieces


def buffers(texts: list[bytes], length: int):
    """(index of the text, offset in it, its bytes) in groups of about BUFFER bytes; longer texts in pieces that
    overlap by length - 1."""
    group, size = [], 0
    for i, text in enumerate(texts):
        for offset in range(0, max(len(text) - length + 1, 0), BUFFER):
            piece = text[offset : offset + BUFFER + length - 1]
            if group and size + len(piece) > BUFFER + length:
                yield group
                group, size = [], 0
            group.append((i, offset, piece))
            size += len(piece)
    if group:
        yield group


def _runs(length: int, gram: int):
    def runs(batches):
        import numpy as np
        import pyarrow as pa

        numbers = kept_by_worker("suffix-tables", lambda: tables(2 * BUFFER + 4096))
        seen: set = set()  # the texts that this task has had
        for batch in batches:
            ids, more = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            for k, key in enumerate(zip(ids, more)):
                if key in seen:
                    texts[k] = b""
                else:
                    seen.add(key)
            ids, more = np.array(ids, dtype="i8"), np.array(more, dtype="i4")
            for group in buffers([t or b"" for t in texts], length):
                data = np.frombuffer(b"".join(g[2] for g in group), dtype="u1")
                rank, whole, text, start, n, at, further = find_runs(data, np.cumsum([len(g[2]) for g in group]), numbers, length, gram)
                index = np.array([g[0] for g in group])[text]
                start = start + np.array([g[1] for g in group])[text]
                apart, own = settled(rank, whole, index, start, n)
                rows = [x[apart] for x in (rank, whole, ids[index], more[index], start, n, at, *further)]
                if own:  # ranked by place, so that they spread; at tells them apart
                    i, p, m = (np.array(x) for x in zip(*own))
                    spread = mixed(ids[index[i]].astype("u8") + p.astype("u8")).astype("i8")
                    extra = (spread, spread, ids[index[i]], more[index[i]], p, m, np.full(len(i), -1), *[np.zeros(len(i), "i8")] * len(further))
                    rows = [np.concatenate(x) for x in zip(rows, extra)]
                types = ("i8", "i8", "i8", "i4", "i4", "i4", "i4", *["i8"] * len(further))
                names = ["rank", "whole", "text_id", "more", "start", "n", "at", *(f"further{k}" for k in range(len(further)))]
                yield pa.RecordBatch.from_arrays([pa.array(x.astype(t)) for x, t in zip(rows, types)], names=names)

    return runs


def _identified(docs: DataFrame) -> DataFrame:
    """The columns and text_id, more (hashes of the text), n_bytes; null text is empty."""
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.withColumns({"text_id": F.xxhash64(text), "more": F.crc32(text.cast("binary")).bitwiseAND(F.lit(0xFFFFFF)).cast("int"), "n_bytes": F.octet_length(text).cast("long")})


def ranked(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """The runs whose representative occurs elsewhere: state repeated, or open; witness; big."""
    further = [f"further{k}" for k in range(2 * len(doublings(length, gram)))]
    rows = texts.select("text", "text_id", "more").mapInArrow(_runs(length, gram), ", ".join([RUN, *(f"{c} bigint" for c in further)]))
    # Three numbers and the text's extra bits in one, for narrow rows in the sort.
    place = F.expr("shiftleft(cast(more as bigint), 39) | shiftleft(cast(start as bigint), 8) | (n - 1)")
    rows = rows.select("rank", "whole", "text_id", place.alias("place"), F.col("at").cast("short").alias("at"), *further)
    by_rank = Window.partitionBy("rank").orderBy("whole", "text_id", "place")
    twice = (F.lag("text_id").over(by_rank) == F.col("text_id")) & (F.lag("place").over(by_rank) == F.col("place")) & (F.lag("whole").over(by_rank) == F.col("whole"))
    once = rows.withColumn("twice", twice).where(~F.coalesce("twice", F.lit(False))).drop("twice")
    all_ = Window.partitionBy("rank")
    flag = lambda c: F.coalesce(c, F.lit(False))
    seen = once.select(
        "*",
        flag(F.lag("whole").over(by_rank) == F.col("whole")).alias("before"),
        flag(F.lead("whole").over(by_rank) == F.col("whole")).alias("after"),
        F.count("*").over(all_).alias("group"),
        (F.min("whole").over(all_) != F.max("whole").over(all_)).alias("differ"),
    ).where("group > 1 or at < 0")
    seen = seen.withColumns({"settled": F.col("before") | F.col("after") | (F.col("at") < 0), "right": F.col("rank"), "left": F.col("rank")})
    for k in range(0, len(further), 2):  # the sorts stay inside the partitions by rank
        for side, column in (("right", further[k]), ("left", further[k + 1])):
            pair = F.when((F.col(column) != 0) & F.col(side).isNotNull(), F.xxhash64(side, column))
            seen = seen.withColumn(side, pair).withColumn("same", F.count(side).over(Window.partitionBy("rank", side)))
            seen = seen.withColumn(side, F.when(F.col("same") > 1, F.col(side))).drop("same")
        seen = seen.where("settled or right is not null or left is not null")
    return seen.select(
        "rank",
        "text_id",
        F.expr("cast(shiftright(place, 39) as int)").alias("more"),
        F.expr("cast(shiftright(place, 8) & 2147483647 as int)").alias("start"),
        F.expr("cast((place & 255) + 1 as int)").alias("n"),
        F.col("at").cast("int").alias("at"),
        F.col("settled").alias("repeated"),
        (F.col("after") & ~F.col("before") & F.col("differ") & (F.col("at") >= 0)).alias("witness"),
        (F.col("group") > BIG).alias("big"),
    )


def _with_texts(texts: DataFrame, lists: DataFrame) -> DataFrame:
    """texts joined to lists by text; lists is broadcast if its files show that it is small."""
    lists = lists.select(F.col("text_id").alias("__id"), F.col("more").alias("__more"), *[c for c in lists.columns if c not in ("text_id", "more")])
    return texts.join(small(lists, most=BROADCAST), (texts["text_id"] == lists["__id"]) & (texts["more"] == lists["__more"]))


def _compare(length: int):
    """Streams rows sorted by rank; gives the windows of each run that occur in another of the same rank."""

    def windows_of(rows, numbers):
        """rows: (text_id, more, start, n, at, witness, bytes) of one rank."""
        import numpy as np

        data = np.frombuffer(b"".join(r[6] for r in rows), dtype="u1")
        pre = sums(data, numbers)
        sizes = np.array([len(r[6]) for r in rows])
        base = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        n = sizes - length + 1
        run = np.repeat(np.arange(len(rows)), n)
        i = np.arange(len(run)) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)
        p = base[run] + i
        rank = mixed((pre[p + length] - pre[p]) * numbers[2][p])
        offset = np.array([r[4] for r in rows])[run] - i
        # One place may come twice (copies of a text in several tasks): it is no repetition of itself.
        text = mixed(np.array([(r[0] ^ (r[1] << 39)) & 0xFFFFFFFFFFFFFFFF for r in rows], dtype="u8"))[run]
        place = text + np.array([r[2] for r in rows], dtype="u8")[run] + i.astype("u8")
        order = np.lexsort((place, rank, offset))
        o, r, s = offset[order], rank[order], place[order]
        same = (o[1:] == o[:-1]) & (r[1:] == r[:-1])
        group = np.concatenate(([0], np.cumsum(~same)))
        differ = np.zeros(group[-1] + 1, dtype=bool)
        np.logical_or.at(differ, group[1:][same & (s[1:] != s[:-1])], True)
        hit = np.zeros(len(run), dtype=bool)
        hit[order] = differ[group]
        return run, i, hit

    def compare(batches):
        import numpy as np
        import pyarrow as pa

        held, at, size = [], None, 0

        def done(rows):
            size = sum(len(r[6]) for r in rows)
            numbers = kept_by_worker("suffix-tables", lambda: tables(2 * BUFFER + 4096)) if size < 2 * BUFFER else tables(size + 1)
            run, i, hit = windows_of(rows, numbers)
            edge = np.concatenate(([True], run[1:] != run[:-1]))
            first = np.flatnonzero(hit & (edge | ~np.concatenate(([False], hit[:-1]))))
            last = np.flatnonzero(hit & (np.concatenate((edge[1:], [True])) | ~np.concatenate((hit[1:], [False]))))
            return [(rows[run[a]][0], rows[run[a]][1], rows[run[a]][2] + int(i[a]), rows[run[a]][2] + int(i[b]) + length) for a, b in zip(first, last) if not rows[run[a]][5]]

        def batch_of(found):
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=["text_id", "more", "first", "last"])

        found = []
        for batch in batches:
            for rank, *row in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns))):
                if rank != at and held:
                    if len(held) > 1:
                        found += done(held)
                    held = []
                at = rank
                held.append(row)
            if len(found) > 10_000:
                yield batch_of(found)
                found = []
        if len(held) > 1:
            found += done(held)
        yield batch_of(found)

    return compare


def _windows(length: int):
    """Rank and place of each window of the runs, for representatives too frequent for one task."""

    def windows(batches):
        import numpy as np
        import pyarrow as pa

        numbers = kept_by_worker("suffix-tables", lambda: tables(2 * BUFFER + 4096))
        for batch in batches:
            for text_id, more, start, data in zip(*(batch.column(k).to_pylist() for k in range(4))):
                pre = sums(np.frombuffer(data, dtype="u1"), numbers)
                p = np.arange(len(data) - length + 1)
                rank = mixed((pre[p + length] - pre[p]) * numbers[2][p])
                yield pa.RecordBatch.from_arrays([pa.array(rank.astype("i8")), pa.array(np.full(len(p), text_id)), pa.array(np.full(len(p), more, dtype="i4")), pa.array((start + p).astype("i4"))], names=["rank", "text_id", "more", "first"])

    return windows


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """text_id, more, spans (first, last: bytes to remove, merged and in order) of the texts that lose any."""
    texts = _identified(docs).where(F.col("n_bytes") >= length)
    runs = written(ranked(texts, length, gram), "runs")
    open_ = runs.where("not repeated or witness")
    wanted = written(open_.groupBy("text_id", "more").agg(F.collect_list(F.struct("rank", "start", "n", "at", "repeated", "big")).alias("r")), "open")
    cut = _with_texts(texts.select("text", "text_id", "more"), wanted).select("text_id", "more", F.col("text").cast("binary").alias("b"), F.explode("r").alias("r"))
    cut = cut.select("r.rank", "text_id", "more", "r.start", "r.n", "r.at", F.col("r.repeated").alias("witness"), F.expr(f"substring(b, r.start + 1, r.n + {length - 1})").alias("data"), "r.big")
    few = cut.where("not big").drop("big").repartition("rank").sortWithinPartitions("rank")
    by_run = few.mapInArrow(_compare(length), "text_id bigint, more int, first int, last int")
    found = by_run.unionByName(runs.where("repeated").select("text_id", "more", F.col("start").alias("first"), (F.col("start") + F.col("n") - 1 + length).alias("last")))
    if runs.where("big and (not repeated or witness)").limit(1).count():
        each = cut.where("big").select("text_id", "more", "start", "data").mapInArrow(_windows(length), "rank bigint, text_id bigint, more int, first int")
        same = each.groupBy("rank").agg(F.min(F.struct("text_id", "more", "first")).alias("a"), F.max(F.struct("text_id", "more", "first")).alias("b")).where("a <> b").select("rank")
        found = found.unionByName(each.join(same, "rank").select("text_id", "more", "first", (F.col("first") + length).alias("last")))
    again = texts.groupBy("text_id", "more").agg(F.count("*").alias("k"), F.max("n_bytes").cast("int").alias("last")).where("k > 1")
    found = found.unionByName(again.select("text_id", "more", F.lit(0).alias("first"), "last"))
    order = Window.partitionBy("text_id", "more").orderBy("first", "last")
    gap = F.coalesce(F.col("first") > F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    islands = found.withColumn("gap", gap.cast("int")).withColumn("island", F.sum("gap").over(order))
    merged = islands.groupBy("text_id", "more", "island").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return merged.groupBy("text_id", "more").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans"))


def _cutter(digest: bool):
    def cut(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            lists = batch.column(1)
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            flat = lists.flatten()
            first, last = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            removed, kept = [], []
            for k, text in enumerate(texts):
                a, b = first[ends[k] : ends[k + 1]], last[ends[k] : ends[k + 1]]
                removed.append(int((b - a).sum()))
                if len(a):
                    text = b"".join(text[x:y] for x, y in zip(np.concatenate(([0], b)), np.concatenate((a, [len(text)]))))
                kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode("utf-8", "replace"))
            arrays = [pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64()), pa.array(np.diff(ends).astype("i8")), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(2, batch.num_columns)), *arrays], names=[*batch.schema.names[2:], "__n_bytes", "__n_removed", "__n_spans", "__kept"])

    return cut


def _applied(docs: DataFrame, names: list[str], digest: bool, length: int, gram: int) -> DataFrame:
    with scratch(docs.sparkSession):
        found = written(spans(docs, length, gram), "spans", keep=True)
    texts = _identified(docs.select(F.struct(*names).alias("d"), F.col("text")))
    lists = found.select(F.col("text_id").alias("__id"), F.col("more").alias("__more"), "spans")
    joined = texts.join(small(lists, most=BROADCAST), (texts["text_id"] == lists["__id"]) & (texts["more"] == lists["__more"]), "left")
    none = F.array().cast("array<struct<first:int,last:int>>")
    rows = joined.select(F.coalesce("text", F.lit("")).alias("__text"), F.coalesce("spans", none).alias("__spans"), "d.*")
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*names).schema.fields)
    return rows.mapInArrow(_cutter(digest), f"{fields}__n_bytes bigint, __n_removed bigint, __n_spans bigint, __kept string")


def trimmed(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The documents with the text that is left, and n_bytes, n_removed, n_spans."""
    out = _applied(docs, docs.columns, False, length, gram).withColumn("text", F.col("__kept")).drop("__kept")
    return out.withColumns({c: F.col(f"__{c}") for c in ("n_bytes", "n_removed", "n_spans")}).drop("__n_bytes", "__n_removed", "__n_spans")


def span_digests(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    out = _applied(docs, ["doc_id"], True, length, gram)
    return out.select("doc_id", F.col("__n_bytes").alias("n_bytes"), F.col("__n_removed").alias("n_removed"), F.col("__n_spans").alias("n_spans"), F.col("__kept").alias("kept_sha256"))


by_value(__name__)
