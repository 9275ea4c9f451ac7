"""Exact Jaccard join of documents on word n-grams, by vertical partitioning.

A document's set holds the hashes of its SHINGLE-word shingles. Two documents link when
100 * intersection >= PERCENT * union. The global order of shingles is cut into fragments, ranges of the hash.

1. Count. Each fragment counts, apart from the others, in how many documents its shingles occur. A shingle of one
   document adds to no overlap. Those of two or more go into a bitmap for each level of frequency (LEVELS).
2. Filter. A document's partial counts of shared shingles, summed over the fragments, bound every overlap that it can
   have; documents whose sum is under PERCENT of their set link with no other text, and most go here. Documents
   with equal sets are one class from now on.
3. Candidates. Linked sets share a shingle among the first n - ceil(0.8 n) + 1 of each in any one order. The order is by
   level, rarest first, then by hash; shingles that nobody shares come first and are skipped. What is left of the
   prefix are the lists that a class is in. Rounds: (a) each class meets the leader of its lists, the member with the
   largest part of its set shared, that it shares most lists with; (b) where a list still has several components, all
   members of lists of up to COMMON, and BUCKETS leaders of longer ones, across components; (c) where any list was longer, all
   pairs of the lists made anew, across components, those of longer ones in blocks. A pair needs that the shared shingles of
   both allow a link. Each round leaves components, and only lists with several go on, so a group of copies costs a pair
   or two for each. The last round compares all that could still link, so none is lost.
4. Verify. The sets of candidates are cut into SEGMENTS ranges; the overlap is counted in each and summed for each pair.

Bitmaps are broadcast up to BITMAPS * BROADCAST bytes together; beyond that shingles are joined with their counts.

Defined results: null text, or text without words, has an empty set and links with nothing; fewer words than a shingle
are one shingle of their own length; repeated rows link (unless empty); equal doc_ids are separate documents until
they are named; doc_ids may be of any type that can be compared; an empty table gives an empty table; further columns
stay in deduplicated().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scan import numbered
from . import common
from .common import SPACE, by_value, kept_by_worker, plan_bytes, scratch, written
from .suffixes import mixed, sums, tables

#: BROADCAST: bytes in memory that a side of a join may have to be broadcast; the driver holds it several times while it is made (rows, table,
#: blocks). All bitmaps together may have BITMAPS times as many. Results depend on neither.
SHINGLE, PERCENT, COMMON, BUCKETS, SEGMENTS, BROADCAST, BITMAPS = 5, 80, 16, 16, 8, 32 << 20, 4
#: Classes of a block, and shingles of a range, where blocks are compared.
BLOCK, COLUMNS = 1024, 2048
#: Bytes of text hashed at a time; shingles held before they are dealt to the fragments; bytes of input for a fragment.
BUFFER, HELD, FRAGMENT = 1 << 20, 1 << 22, 8 << 20
#: Documents that a shingle of each level occurs in at least.
LEVELS = (2, COMMON + 1, 128, 1024, 8192, 65535)
#: Bits of a hash that are counted and looked up. Others agree or not when sets are compared.
BITS = 48


def needed(n):
    """Shingles that a set of n must share with any that it links with."""
    return (n * PERCENT + 99) // 100


def byte_tables():
    """Whether a byte separates words; tables for hashing in which A-Z count as a-z."""
    import numpy as np

    def make():
        values, power, inverse = tables(4 * BUFFER)
        values = values.copy()
        values[65:91] = values[97:123]
        space = np.zeros(256, dtype=bool)
        space[list(SPACE.encode())] = True
        return space, (values, power, inverse)

    return kept_by_worker(f"jaccard-tables-{BUFFER}", make)


def word_hashes(data, ends):
    """Hashes of the words of texts laid one after the other, and each word's text."""
    import numpy as np

    space, numbers = byte_tables()
    if len(data) >= 4 * BUFFER:
        grown = tables(len(data) + 1)
        numbers = (numbers[0], grown[1], grown[2])
    inside = ~space[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[0] = edge[-1] = True
    edge[ends] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    pre = sums(data, numbers)
    hashes = mixed((pre[b] - pre[a]) * numbers[2][a]) + mixed((b - a).astype("u8"))
    return hashes, np.searchsorted(ends, a, side="right")


def shingles(words, text, size: int):
    """Distinct shingle hashes from word hashes, sorted in each text, and each one's text."""
    import numpy as np

    times = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(size)], dtype="u8")
    n = len(words) - size + 1
    values, at = np.zeros(0, dtype="u8"), np.zeros(0, dtype="i8")
    if n > 0:
        total = words[:n] * times[0]
        for k in range(1, size):
            total += words[k : k + n] * times[k]
        whole = text[:n] == text[size - 1 :]
        values, at = mixed(total[whole]), text[:n][whole]
    count = np.bincount(text) if len(text) else np.zeros(0, dtype="i8")
    few = np.flatnonzero((count > 0) & (count < size))
    if len(few):
        starts = np.concatenate(([0], np.cumsum(count)))[few]
        total = np.zeros(len(few), dtype="u8")
        for k in range(size - 1):
            more = count[few] > k
            total[more] += words[starts[more] + k] * times[k]
        values, at = np.concatenate((values, mixed(total ^ mixed(count[few].astype("u8"))))), np.concatenate((at, few))
        order = np.argsort(at, kind="stable")
        values, at = values[order], at[order]
    cuts = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1, [len(at)])) if len(at) else [0]
    for a, b in zip(cuts[:-1], cuts[1:]):
        values[a:b].sort()
    new = np.ones(len(at), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (at[1:] != at[:-1])
    return values[new], at[new]


def sets_of(column, size: int):
    """Groups of a batch's texts: (index of the first, n of each, their values, starts, two digests of each)."""
    import numpy as np
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype="i8")[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype="u1")
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BUFFER, side="right")) - 1)
        values, text = shingles(*word_hashes(data[offsets[at] : offsets[end]], offsets[at + 1 : end + 1] - offsets[at]), size)
        n = np.bincount(text, minlength=end - at)
        starts = np.concatenate(([0], np.cumsum(n)))
        spread = mixed(values ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        add = lambda x: np.diff(np.concatenate((np.zeros(1, "u8"), np.cumsum(x)))[starts])
        yield at, n, values, starts, add(mixed(values)), add(spread)
        at = end


def _counted(size: int, bits: int):
    """Texts to rows of a fragment: its shingles among some documents, as sorted differences, and in how many of these each is."""

    def counted(batches):
        import numpy as np
        import pyarrow as pa

        seen: set = set()

        def rows(held):
            values = np.concatenate(held)
            values.sort()
            new = np.ones(len(values), dtype=bool)
            new[1:] = values[1:] != values[:-1]
            at = np.flatnonzero(new)
            times = np.minimum(np.diff(np.append(at, len(values))), 255).astype("u1")
            values = values[at]
            cuts = np.searchsorted(values, np.arange((1 << bits) + 1, dtype="u8") << np.uint64(BITS - bits))
            gaps = np.diff(values, prepend=np.uint64(0))
            out = []
            for f in np.flatnonzero(np.diff(cuts)):
                a, b = cuts[f], cuts[f + 1]
                wide = bool((gaps[a + 1 : b] >> np.uint64(32)).any())
                data = values[a:b].tobytes() if wide else values[a : a + 1].tobytes() + gaps[a + 1 : b].astype("u4").tobytes()
                out.append((int(f), wide, data, times[a:b].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int32(), pa.bool_(), pa.binary(), pa.binary()))], names=["fragment", "wide", "data", "times"])

        held, n_held = [], 0
        for batch in batches:
            for _, n, values, starts, c1, c2 in sets_of(batch.column(0), size):
                new = np.zeros(len(n), dtype=bool)
                for k, key in enumerate(zip(c1.tolist(), c2.tolist())):
                    if n[k] and key not in seen:
                        seen.add(key)
                        new[k] = True
                held.append(values[np.repeat(new, n)] >> np.uint64(64 - BITS))
                n_held += len(held[-1])
                if n_held >= HELD:
                    yield rows(held)
                    held, n_held = [], 0
        if n_held:
            yield rows(held)

    return counted


def _frequent(batches):
    """Rows sorted by fragment to the shingles of two documents or more, with their number."""
    import numpy as np
    import pyarrow as pa

    def merged(parts):
        """Values with their numbers in the low bits, added for equal ones."""
        packed = np.concatenate(parts)
        packed.sort()
        values = packed >> np.uint64(16)
        at = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
        times = np.minimum(np.add.reduceat(packed & np.uint64(0xFFFF), at), 0xFFFF)
        return values[at] << np.uint64(16) | times

    def batch_of(fragment, parts):
        packed = merged(parts)
        packed = packed[packed & np.uint64(0xFFFF) > 1]
        values = packed >> np.uint64(16)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(values), fragment, "i4")), pa.array(values.astype("i8")), pa.array((packed & np.uint64(0xFFFF)).astype("i4"))], names=["fragment", "h", "k"])

    at, parts, size = None, [], 0
    for batch in batches:
        for fragment, wide, data, times in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if fragment != at and parts:
                yield batch_of(at, parts)
                parts, size = [], 0
            at = fragment
            if wide:
                values = np.frombuffer(data, "u8")
            else:
                values = np.cumsum(np.concatenate((np.frombuffer(data[:8], "u8"), np.frombuffer(data[8:], "u4").astype("u8"))))
            parts.append(values << np.uint64(16) | np.frombuffer(times, "u1").astype("u8"))
            size += len(values)
            if size > 4 * HELD:  # one entry for each distinct shingle, however many documents have it
                parts = [merged(parts)]
                size = min(len(parts[0]), 2 * HELD)
    if parts:
        yield batch_of(at, parts)


def _slices(bits: int, sizes: dict[int, int]):
    """Shingles with numbers to parts of the bitmaps: a fragment's part of that of a level."""

    def slices(batches):
        import numpy as np
        import pyarrow as pa

        at, maps = None, {}

        def done():
            keys = [k for k, m in maps.items() if m.any()]
            columns = (pa.array([at] * len(keys), pa.int32()), pa.array(keys, pa.int32()), pa.array([np.packbits(maps[k], bitorder="little").tobytes() for k in keys], pa.binary()))
            return pa.RecordBatch.from_arrays(list(columns), names=["fragment", "level", "data"])

        for batch in batches:
            fragment, h, k = (batch.column(c).to_numpy() for c in range(3))
            cuts = np.concatenate(([0], np.flatnonzero(fragment[1:] != fragment[:-1]) + 1, [len(fragment)])) if len(fragment) else [0]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if fragment[a] != at:
                    if maps:
                        yield done()
                    at, maps = int(fragment[a]), {x: np.zeros(1 << (m - bits), dtype=bool) for x, m in sizes.items()}
                for x, m in sizes.items():
                    maps[x][(h[a:b][k[a:b] >= x] >> (BITS - m)) & ((1 << (m - bits)) - 1)] = True
        if maps:
            yield done()

    return slices


class Bitmaps:
    """level(values): how many levels each hash reaches; 0 for shingles of one document."""

    def __init__(self, maps: list[tuple[int, bytes]]):
        self.maps = maps

    def level(self, values):
        import numpy as np

        out = np.zeros(len(values), dtype="u1")
        at = np.arange(len(values))
        for bits, data in self.maps:
            place = values[at] >> np.uint64(64 - bits)
            hit = np.frombuffer(data, "u1")[(place >> np.uint64(3)).astype("i8")] >> (place & np.uint64(7)).astype("u1") & 1 == 1
            at = at[hit]
            out[at] += 1
        return out


def _filtered(size: int, maps):
    """Texts to n, s (how many are shared, 0 for what cannot link or came before), digests, and the shared shingles in order."""

    def filtered(batches):
        import numpy as np
        import pyarrow as pa

        seen: set = set()
        bitmaps = Bitmaps(maps.value) if maps else None
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for _, n, values, starts, c1, c2 in sets_of(batch.column(1), size):
                level = bitmaps.level(values) if bitmaps else np.ones(len(values), dtype="u1")
                shared = np.diff(np.concatenate(([0], np.cumsum(level > 0)))[starts])
                stay = (n > 0) & (shared * 100 >= n * PERCENT)
                for k in np.flatnonzero(stay):
                    key = (int(c1[k]), int(c2[k]), int(n[k]))
                    stay[k] = key not in seen
                    seen.add(key)
                s = np.where(stay, shared, 0)
                use = np.repeat(stay, n) & (level > 0)
                values, level = values[use], level[use]
                text = np.repeat(np.arange(len(n)), s)
                order = np.lexsort((values, level, text))
                firsts = np.where(stay, shared - needed(n) + 1, 0)
                place = np.arange(len(text)) - np.repeat(np.concatenate(([0], np.cumsum(s)[:-1])), s)
                for column, x in zip(out, (n, s, c1, c2, values, values[order][place < np.repeat(firsts, s)], firsts)):
                    column.append(x)
            n, s, c1, c2, values, first, firsts = (np.concatenate(x) if x else np.zeros(0) for x in out)
            lists = lambda sizes, x: pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype("i8")), pa.array(x.astype("i8"))).cast(pa.list_(pa.int64()))
            numbers = [pa.array(n.astype("i4")), pa.array(s.astype("i4")), pa.array(c1.astype("i8")), pa.array(c2.astype("i8"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *numbers, lists(s, values), lists(firsts, first)], names=["doc_id", "text_hash", "n", "s", "c1", "c2", "shared", "first"])

    return filtered


def _block_links(table):
    """Of one or two blocks of classes: a link for each two components that have one, less those that follow from others."""
    import numpy as np
    import pyarrow as pa

    block, node, n, label = (table.column(c).to_numpy() for c in ("block", "node", "n", "label"))
    shared = table.column("shared").combine_chunks()
    values, ends = shared.flatten().to_numpy().astype("u8"), np.diff(shared.offsets.to_numpy())
    row = np.repeat(np.arange(len(node)), ends)
    x = np.flatnonzero(block == table.column("i")[0].as_py())
    y = np.flatnonzero(block == table.column("j")[0].as_py())
    order = np.argsort(values, kind="stable")
    values, row = values[order], row[order]
    column = np.cumsum(np.concatenate(([0], values[1:] != values[:-1])))
    side = lambda rows: np.bincount(column[np.isin(row, rows)], minlength=column[-1] + 1) > 0
    use = (side(x) & side(y))[column]
    column, row = np.unique(column[use], return_inverse=True)[1], row[use]
    total = np.zeros((len(x), len(y)), dtype="f4")
    at = np.empty(len(node), dtype="i8")
    # The columns are in the global order; each range of them gives partial overlaps, which are added.
    for first in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        part = (column >= first) & (column < first + COLUMNS)
        sides = []
        for rows in (x, y):
            at[:] = -1
            at[rows] = np.arange(len(rows))
            own = part & (at[row] >= 0)
            matrix = np.zeros((len(rows), COLUMNS), dtype="f4")
            matrix[at[row[own]], column[own] - first] = 1
            sides.append(matrix)
        total += sides[0] @ sides[1].T
    link = (total * (100 + PERCENT) >= PERCENT * (n[x][:, None].astype("i8") + n[y])) & (label[x][:, None] != label[y])
    p, q = np.nonzero(link)
    p, q = x[p], y[q]
    _, first = np.unique(np.stack((np.minimum(label[p], label[q]), np.maximum(label[p], label[q]))), axis=1, return_index=True)
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while parent.get(c, c) != c:
            parent[c] = parent.get(parent[c], parent[c])
            c = parent[c]
        return c

    found = []
    for k in first.tolist():
        a, b = root(int(label[p[k]])), root(int(label[q[k]]))
        if a != b:
            parent[a] = b
            found.append((int(node[p[k]]), int(node[q[k]])))
    return pa.table([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def small(df: DataFrame, growth: int = 4) -> DataFrame:
    return common.small(df, growth, BROADCAST)


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node that it is connected with) for the nodes of edges (a, b)."""
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("at"))
        jump = labels.select(F.col("node").alias("n"), F.col("label").alias("further"))
        new = written(least.join(jump, least["at"] == jump["n"]).select("node", F.col("further").alias("label"), (F.col("further") < F.col("old")).alias("changed")), "labels")
        labels = new.select("node", "label")
        if not new.where("changed").limit(1).count():
            return labels


class Join:
    """The steps of one join; docs: doc_id, text."""

    def __init__(self, docs: DataFrame, size: int = SHINGLE):
        self.size = size
        self.docs = docs.select("text", "doc_id", F.xxhash64("text").alias("text_hash"))
        self.id_type = docs.schema["doc_id"].dataType.simpleString()
        self.held = None
        self.bits = min(max((plan_bytes(docs) // FRAGMENT).bit_length(), 5), 18)
        self.rows = written(self._sets().withColumn("node", F.monotonically_increasing_id()), "sets")
        if self.held:
            self.held.destroy()  # the sets are written; else driver and executors keep the bitmaps for the rest of the join
        self.classes = written(self.rows.where("n > 0").groupBy("c1", "c2", "n").agg(F.min("node").alias("node"), F.min(F.when(F.col("s") > 0, F.col("node"))).alias("own")), "classes")
        # Each task gives a class once; the rows of other tasks are few.
        own = self.rows.where("s > 0")
        extra = written(own.select("node").join(self.classes.select(F.col("own").alias("node")), "node", "left_anti"), "extra")
        self.own = own.join(small(extra), "node", "left_anti")

    def _sets(self) -> DataFrame:
        """doc_id, text_hash, n, s, c1, c2, shared, first of each document."""
        spark = self.docs.sparkSession
        blobs = self.docs.select("text").mapInArrow(_counted(self.size, self.bits), "fragment int, wide boolean, data binary, times binary")
        counts = written(blobs.repartition("fragment").sortWithinPartitions("fragment").mapInArrow(_frequent, "fragment int, h bigint, k int"), "counts")
        found = counts.agg(*[F.count(F.when(F.col("k") >= x, 1)) for x in LEVELS]).head()
        found = [n for n in found if n]  # numbers fall from level to level
        sizes = {x: max((16 * n).bit_length(), self.bits + 3) for x, n in zip(LEVELS, found)}
        while sum(1 << m for m in sizes.values()) > 8 * BITMAPS * BROADCAST:
            fewer = {x: max(m - 1, self.bits + 3) for x, m in sizes.items()}
            if fewer == sizes or any((1 << m) < 4 * n for m, n in zip(fewer.values(), found)):  # at least four bits for each
                return self._joined_sets(counts)
            sizes = fewer
        maps = {x: bytearray(1 << (m - 3)) for x, m in sizes.items()}
        for fragment, level, data in counts.mapInArrow(_slices(self.bits, sizes), "fragment int, level int, data binary").toLocalIterator():
            a = fragment * len(data)
            old = int.from_bytes(maps[level][a : a + len(data)], "little")
            maps[level][a : a + len(data)] = (old | int.from_bytes(data, "little")).to_bytes(len(data), "little")
        # Numbers and bytes alone: workers need not know the class. A map goes as its bytes are taken, so that none is held twice.
        self.held = spark.sparkContext.broadcast([(m, bytes(maps.pop(x))) for x, m in sizes.items()])
        types = f"doc_id {self.id_type}, text_hash bigint, n int, s int, c1 bigint, c2 bigint, shared array<bigint>, first array<bigint>"
        return self.docs.select("doc_id", "text", "text_hash").mapInArrow(_filtered(self.size, self.held), types)

    def _joined_sets(self, counts: DataFrame) -> DataFrame:
        """The same by a join of all shingles with their counts, for bitmaps over BITMAPS * BROADCAST."""
        types = f"doc_id {self.id_type}, text_hash bigint, n int, s int, c1 bigint, c2 bigint, shared array<bigint>, first array<bigint>"
        every = self.docs.select("doc_id", "text", "text_hash").mapInArrow(_filtered(self.size, None), types).drop("first")
        every = written(every.withColumn("row", F.monotonically_increasing_id()), "every")
        level = sum((F.col("k") >= x).cast("int") for x in LEVELS)
        each = every.select("row", F.explode("shared").alias("v")).withColumn("h", F.expr(f"shiftrightunsigned(v, {64 - BITS})"))
        known = each.join(counts.select("h", level.alias("level")), "h").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("level", "v"))).alias("l"))
        rows = every.drop("shared").join(known, "row", "left")
        shared, need = F.coalesce(F.size("l"), F.lit(0)), F.expr(f"(n * {PERCENT} + 99) div 100").cast("int")
        stay = (F.col("s") > 0) & F.col("l").isNotNull() & (shared >= need)
        none = F.array().cast("array<bigint>")
        return rows.select("doc_id", "text_hash", "n", F.when(stay, shared).otherwise(0).alias("s"), "c1", "c2", F.when(stay, F.sort_array("l.v")).otherwise(none).alias("shared"), F.when(stay, F.slice("l.v", F.lit(1), shared - need + 1)).otherwise(none).alias("first"))

    @staticmethod
    def _may(na, sa, nb, sb) -> Column:
        """Whether sets of these sizes and shared shingles can link."""
        return F.least(sa, sb) * (100 + PERCENT) >= PERCENT * (F.col(na) + F.col(nb) if isinstance(na, str) else na + nb)

    @staticmethod
    def _ordered(pairs: DataFrame) -> DataFrame:
        """Rows (x, nx, y, ny) as distinct pairs with a < b."""
        swap = F.col("x") > F.col("y")
        pick = lambda p, q: F.when(swap, F.col(q)).otherwise(F.col(p))
        return pairs.select(pick("x", "y").alias("a"), pick("y", "x").alias("b"), pick("nx", "ny").alias("na"), pick("ny", "nx").alias("nb")).distinct()

    def led(self, lists: DataFrame) -> DataFrame:
        """Each class with the leader that it shares most lists with."""
        apart = F.expr("(n - s) * 1000000L div n")
        lead = lists.groupBy("h").agg(F.min(F.struct(apart.alias("o"), "node", "n", "s")).alias("l"), F.count("*").alias("k")).where("k > 1")
        lead = lead.select("h", F.col("l.node").alias("y"), F.col("l.n").alias("ny"), F.col("l.s").alias("sy"))
        met = lists.join(lead, "h").where((F.col("node") != F.col("y")) & self._may("n", "s", "ny", "sy"))
        most = met.groupBy("node", "n", "y", "ny").agg(F.count("*").alias("c"), F.min(F.col("sy") - F.col("ny")).alias("o"))
        best = most.groupBy("node", "n").agg(F.max(F.struct("c", "o", "y", "ny")).alias("l"))
        return self._ordered(best.select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("l.y").alias("y"), F.col("l.ny").alias("ny")))

    def live(self, lists: DataFrame, labels: DataFrame) -> DataFrame:
        """The rows of lists that have several components, with label and k, the list's length."""
        at = lists.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        several = at.groupBy("h").agg(F.count("*").alias("k"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("h", "k")
        return at.join(several, "h")

    def narrowed(self, lists: DataFrame, labels: DataFrame) -> DataFrame:
        """New lists of the classes in lists with several components: only shingles that two components have count.

        Linked sets of different components share only such shingles. Each class keeps them in order of their number
        among the classes that are left, and drops out if they are too few; then others' may be fewer, and so on.
        """
        nodes = written(self.live(lists, labels).select("node", "n", "label").distinct(), "nodes")
        before = nodes.count()
        need = F.expr(f"(n * {PERCENT} + 99) div 100").cast("int")
        while True:
            each = self.own.select("node", "shared").join(small(nodes), "node").select("node", "n", "label", F.explode("shared").alias("h"))
            several = each.groupBy("h").agg(F.count("*").alias("k"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("h", "k")
            known = each.join(several, "h").groupBy("node", "n", "label").agg(F.sort_array(F.collect_list(F.struct("k", "h"))).alias("l")).where(F.size("l") >= need)
            left = written(known.select("node", "n", "label", F.size("l").alias("s"), F.slice("l.h", F.lit(1), F.size("l") - need + 1).alias("first")), "narrowed")
            after = left.count()
            if 10 * after >= 9 * before:
                return left.select("node", "n", "s", F.explode("first").alias("h"))
            nodes, before = left.select("node", "n", "label"), after

    def within(self, live: DataFrame) -> DataFrame:
        """All pairs across components in lists of up to COMMON classes."""
        m = live.where(F.col("k") <= COMMON).groupBy("h").agg(F.sort_array(F.collect_list(F.struct("node", "n", "s", "label"))).alias("m"))
        ok = lambda x, y: (x["label"] != y["label"]) & self._may(x["n"], x["s"], y["n"], y["s"])
        later = lambda x, i: F.transform(F.filter(F.slice(F.col("m"), i + 2, F.size("m")), lambda y: ok(x, y)), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b"), x["n"].alias("na"), y["n"].alias("nb")))
        return m.select(F.explode(F.flatten(F.transform("m", later))).alias("p")).select("p.*").distinct()

    def bucketed(self, live: DataFrame) -> DataFrame:
        """Classes of longer lists with a leader of each bucket of the list, across components."""
        rows = live.where(F.col("k") > COMMON)
        bucket = F.pmod(F.xxhash64("node"), F.lit(BUCKETS))
        lead = rows.groupBy("h", bucket.alias("bucket")).agg(F.min(F.struct(F.expr("(n - s) * 1000000L div n").alias("o"), "node", "n", "s", "label")).alias("l"))
        lead = lead.select("h", *[F.col(f"l.{c}").alias(f"l_{c}") for c in ("node", "n", "s", "label")])
        met = rows.join(lead, "h").where((F.col("label") != F.col("l_label")) & self._may("n", "s", "l_n", "l_s"))
        return self._ordered(met.select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("l_node").alias("y"), F.col("l_n").alias("ny")))

    def across(self, live: DataFrame) -> DataFrame:
        """Links across components among the classes of longer lists, one at most for two components in a task.

        Classes that such lists connect are cut into blocks by component. Two blocks meet in a task unless all of their
        classes are of one component; there overlaps are counted, and only links leave it, not the pairs compared.
        """
        rows = live.where(F.col("k") > COMMON)
        nodes = rows.select("node", "n", "label").distinct()
        lead = rows.groupBy("h").agg(F.min("node").alias("b"))
        joined_ = components(written(rows.select("h", F.col("node").alias("a")).join(lead, "h").select("a", "b").distinct(), "lists"))
        at = written(nodes.join(joined_.select("node", F.col("label").alias("cluster")), "node").withColumn("o", F.struct("label", "n", "node")), "clusters")
        at = written(numbered(at, "o", "place", "cluster").withColumn("block", F.floor((F.col("place") - 1) / BLOCK).cast("int")).drop("o", "place"), "blocks")
        ends = at.groupBy("cluster", "block").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
        other = ends.toDF("cluster", "block2", "lo2", "hi2")
        met = ends.join(other, "cluster").where((F.col("block") <= F.col("block2")) & (F.least("lo", "lo2") < F.greatest("hi", "hi2"))).select("cluster", F.col("block").alias("i"), F.col("block2").alias("j"))
        sides = met.select("cluster", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
        sets = small(written(self.own.join(small(at.select("node")), "node", "left_semi").select("node", "shared"), "across"), 2)
        dealt = at.join(sides, ["cluster", "block"]).repartition("cluster", "i", "j").join(sets, "node").select("cluster", "i", "j", "block", "node", "n", "label", "shared")
        return dealt.groupBy("cluster", "i", "j").applyInArrow(_block_links, "a bigint, b bigint")

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs that link, by overlaps counted in each segment and summed."""
        ends = lambda c: pairs.select(F.col(c).alias("node")).distinct()
        # The upper bits of a hash, as a signed number, name its range.
        part = lambda k: F.filter("shared", lambda v: F.call_function("shiftright", v, F.lit(65 - SEGMENTS.bit_length())) == k - SEGMENTS // 2)
        cut = F.array(*[F.struct(F.lit(k).alias("fragment"), part(k).alias("segment")) for k in range(SEGMENTS)])
        sets = lambda c: self.own.join(small(written(ends(c), "wanted")), "node", "left_semi").select(F.col("node").alias(c), F.inline(cut)).withColumnRenamed("segment", f"s{c}")
        a, b = sets("a"), sets("b")
        few = lambda df: small(written(df, "segments"), 2)
        partial = a.join(small(pairs), "a").join(few(b), ["b", "fragment"]).select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("shared"))
        return partial.groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("shared")).where(F.col("shared") * (100 + PERCENT) >= PERCENT * (F.col("na") + F.col("nb"))).select("a", "b")

    def labels(self) -> DataFrame:
        """node, label of the classes that link with another."""
        lists = written(self.own.select("node", "n", "s", F.explode("first").alias("h")), "lists")
        done = written(self.led(lists), "led")
        links = written(self.linked(done), "links")
        labels = components(links)
        lists = written(self.narrowed(lists, labels), "lists")
        live = written(self.live(lists, labels), "live")
        pairs = written(self.within(live).unionByName(self.bucketed(live)).distinct().join(done, ["a", "b"], "left_anti"), "pairs")
        if pairs.limit(1).count():
            links = links.unionByName(written(self.linked(pairs), "links"))
            labels = components(links)
        if live.where(F.col("k") > COMMON).limit(1).count():
            # Lists made anew may be short where the former were long, so all of them are compared: each two components that
            # still have a link share one of them.
            live = written(self.live(written(self.narrowed(lists, labels), "lists"), labels), "live")
            near = self.within(live).join(done, ["a", "b"], "left_anti").join(pairs, ["a", "b"], "left_anti")
            more = written(self.linked(written(near, "pairs")).unionByName(self.across(live)), "links")
            if more.limit(1).count():
                labels = components(links.unionByName(more))
        return labels

    def members(self) -> DataFrame:
        """doc_id, text_hash, n, group (null for an empty set) of each document."""
        labels = self.labels()
        groups = self.classes.join(labels, self.classes["own"] == labels["node"], "left").select("c1", "c2", "n", F.coalesce("label", self.classes["own"], self.classes["node"]).alias("group"))
        return self.rows.select("doc_id", "text_hash", "n", "c1", "c2").join(groups, ["c1", "c2", "n"], "left").select("doc_id", "text_hash", "n", "group")


def joined(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id of each document."""
    with scratch(docs.sparkSession):
        rows = written(Join(docs, size).members(), "members", keep=True)
    names = rows.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("component_id"))
    return rows.join(names, "group", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def deduplicated(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """One document of each group, the one with the least doc_id, with its columns; all documents with empty sets."""
    with scratch(docs.sparkSession):
        rows = written(Join(docs, size).members(), "members").where("group is not null")
        stays = rows.groupBy("group").agg(F.min(F.struct("doc_id", "text_hash")).alias("s")).select("group", "s.*")
        key = ["doc_id", "text_hash"]
        same = stays.select("group", *(F.col(c).alias(f"s_{c}") for c in key))
        state = rows.join(same, "group").groupBy(*key).agg(F.max((F.col("doc_id").eqNullSafe(F.col("s_doc_id")) & (F.col("text_hash") == F.col("s_text_hash"))).cast("int")).alias("stays"), F.count("*").alias("k"))
        state = written(state.where("stays = 0 or k > 1").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "stays"), "state", keep=True)
    on = lambda s: docs["doc_id"].eqNullSafe(s["__id"]) & (F.xxhash64(docs["text"]) == s["__hash"])
    alone = docs.join(small(state), on(state), "left_anti")
    again = state.where("stays = 1")
    if not again.limit(1).count():
        return alone
    repeated = docs.join(small(again), on(again), "left_semi")
    first = repeated.groupBy("doc_id", F.xxhash64("text").alias("__h")).agg(F.first(F.struct(*docs.columns)).alias("d")).select("d.*")
    return alone.unionByName(first)


by_value(__name__)
by_value(mixed.__module__)
