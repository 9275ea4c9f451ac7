r"""Line deduplication with levelled sorted runs of line hashes.

A line's key is the line without white space at its ends and with A-Z in lower case, as a 128-bit hash. Each batch of documents counts the documents that have each
key; keys that the runs already count as common are taken out by an anti-join, the rest is added as a run of level 0:
a table bucketed and sorted by hash, so that joins with it merge and need no shuffle. When a level has FANOUT runs, they
are merged (counts added) into one run of the next level. A key in THRESHOLD documents or more is common, and all
lines with it are dropped from every document. A whole table is added in batches, one for each BATCH bytes within limits
that let every size use several levels; its keys are written once, with a folder for each batch. The runs are dropped
when the common keys are known.

The common keys go to the workers as a broadcast if there are at most SMALL of them (16 bytes each); with more, each
document is joined with the list of its own common keys.

Defined results: null text is an empty text, which is one empty line; lines whose key has fewer than MIN_CHARS code
points are never dropped and never counted; repeated rows are documents of their own; an empty table gives an empty
table; further columns stay in dropped(), but for those named n_lines or n_dropped, which the new ones replace.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, delete_path, new_path, plan_bytes, scratch, written

THRESHOLD, MIN_CHARS, FANOUT, SMALL = 10, 1, 4, 1_000_000
#: Bytes of a batch; least and most batches of a table.
BATCH, LEAST, MOST = 1 << 30, 6, 64
STRIP = b" \t\n\x0b\x0c\r"


def keys_of(lines: list[bytes], min_chars: int) -> list[bytes]:
    """The hash of each line's key; b"" for a key that is too short."""
    from xxhash import xxh3_128_digest

    out = []
    for line in lines:
        key = line.strip(STRIP).lower()
        out.append(xxh3_128_digest(key) if (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars) else b"")
    return out


def _document_keys(min_chars: int, *names: str):
    """Texts and further columns to the further columns and h1, h2: a row for each key of a document."""

    def keys(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            found, times = [], []
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                own = set(keys_of((text or b"").split(b"\n"), min_chars))
                own.discard(b"")
                found.append(b"".join(own))
                times.append(len(own))
            both = np.frombuffer(b"".join(found), dtype="<i8").reshape(-1, 2)
            at = pa.array(np.repeat(np.arange(batch.num_rows), times))
            yield pa.RecordBatch.from_arrays([*(batch.column(i + 1).take(at) for i in range(len(names))), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=[*names, "h1", "h2"])

    return keys


def document_counts(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """h1, h2, n: documents that have the key."""
    return docs.select("text").mapInArrow(_document_keys(min_chars), "h1 bigint, h2 bigint").groupBy("h1", "h2").agg(F.count("*").alias("n"))


class LineRuns:
    """levels[i]: names of the runs of level i."""

    def __init__(self, spark, threshold: int = THRESHOLD, fanout: int = FANOUT):
        self.spark, self.threshold, self.fanout = spark, threshold, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]

    def _write(self, counts: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        counts.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", new_path(self.spark, name)).saveAsTable(name)
        return name

    def _merged(self, names: list[str]) -> DataFrame:
        """Counts added over runs: sorted buckets of the same hashes meet without a shuffle."""
        out = self.spark.table(names[0])
        for name in names[1:]:
            more = self.spark.table(name).select("h1", "h2", F.col("n").alias("m"))
            out = out.join(more, ["h1", "h2"], "full").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
        return out

    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def common(self) -> DataFrame:
        """h1, h2 of the keys with at least threshold documents."""
        if not self.names():
            return self.spark.createDataFrame([], "h1 bigint, h2 bigint")
        return self._merged(self.names()).where(F.col("n") >= self.threshold).select("h1", "h2")

    def add(self, docs: DataFrame, min_chars: int = MIN_CHARS) -> None:
        self.add_counts(document_counts(docs, min_chars))

    def add_counts(self, counts: DataFrame) -> None:
        """h1, h2, n of one batch."""
        if self.names():
            counts = counts.join(self.common(), ["h1", "h2"], "left_anti")
        self.levels[0].append(self._write(counts))
        at = 0
        while len(self.levels[at]) >= self.fanout:
            if at + 1 == len(self.levels):
                self.levels.append([])
            old, self.levels[at] = self.levels[at], []
            self.levels[at + 1].append(self._write(self._merged(old)))
            self._drop(old)
            at += 1

    def close(self) -> None:
        """Drops all runs."""
        self._drop(self.names())
        self.levels = [[]]

    def _drop(self, names: list[str]) -> None:
        for name in names:
            path = self.spark.sql(f"DESCRIBE FORMATTED {name}").where("col_name = 'Location'").head()["data_type"]
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete_path(self.spark, path)


def _dropper(common, digest: bool, min_chars: int):
    def drop(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        table = common.value if common is not None else None

        def known(keys: list[bytes]) -> list[bool]:
            have = np.frombuffer(b"".join(k or bytes(16) for k in keys), dtype="<i8").reshape(-1, 2)
            at = np.searchsorted(table[:, 0], have[:, 0])
            out = np.zeros(len(have), dtype=bool)
            while True:  # more than once only for equal first halves
                inside = at < len(table)
                same = inside & (table[np.minimum(at, len(table) - 1), 0] == have[:, 0])
                if not same.any():
                    break
                out |= same & (table[np.minimum(at, len(table) - 1), 1] == have[:, 1])
                at = at + 1
                at[~same] = len(table)
            return [bool(k) and x for k, x in zip(keys, out.tolist())]

        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            lists = batch.column(1).to_pylist() if table is None else [None] * len(texts)
            split = [(t or b"").split(b"\n") for t in texts]
            keys = [keys_of(lines, min_chars) for lines in split]
            if table is None:
                gone = [[k in own for k in ks] if own else [False] * len(ks) for ks, own in zip(keys, map(set, (x or () for x in lists)))]
            elif len(table):
                flat, at, gone = known([k for ks in keys for k in ks]), 0, []
                for ks in keys:
                    gone.append(flat[at : at + len(ks)])
                    at += len(ks)
            else:
                gone = [[False] * len(ks) for ks in keys]
            kept = [b"\n".join(x for x, g in zip(lines, out) if not g) if any(out) else text or b"" for lines, out, text in zip(split, gone, texts)]
            result = [hashlib.sha256(k).hexdigest() for k in kept] if digest else [k.decode("utf-8", "replace") for k in kept]
            arrays = [pa.array([len(x) for x in split], pa.int64()), pa.array([sum(x) for x in gone], pa.int64()), pa.array(result, pa.string())]
            rest = list(range(1 if table is not None else 2, batch.num_columns))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), *arrays], names=[*(batch.schema.names[i] for i in rest), "__n_lines", "__n_dropped", "__kept"])

    return drop


def fitted(docs: DataFrame, batches: int | None = None, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> LineRuns:
    """The runs of all documents, added in batches of about the same size."""
    spark = docs.sparkSession
    batches = batches or min(MOST, max(LEAST, plan_bytes(docs) // BATCH))
    runs = LineRuns(spark, threshold)
    with scratch(spark):
        # Documents without an id are spread by their texts.
        spread = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text")))
        rows = docs.select("text", F.pmod(spread, F.lit(batches)).cast("int").alias("batch"))
        keys = written(rows.mapInArrow(_document_keys(min_chars, "batch"), "batch int, h1 bigint, h2 bigint").select("h1", "h2", "batch"), "line-keys", partition="batch")
        for b in range(batches):
            runs.add_counts(keys.where(F.col("batch") == b).groupBy("h1", "h2").agg(F.count("*").alias("n")))
    return runs


def _apply(docs: DataFrame, runs: LineRuns, digest: bool, min_chars: int, small: int) -> DataFrame:
    import numpy as np

    spark, schema = docs.sparkSession, docs.schema
    fields = [f for f in schema.fields if not digest or f.name == "doc_id"]
    out = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in fields)}, __n_lines bigint, __n_dropped bigint, __kept string"
    columns = [F.col(f.name) for f in fields]
    with scratch(spark):
        common = written(runs.common(), "common-lines")
        runs.close()
        if common.count() <= small:
            found = common.orderBy("h1", "h2").toArrow()
            table = np.column_stack([found.column(c).to_numpy() for c in ("h1", "h2")])
            rows = docs.select(F.col("text").alias("__text"), *columns)
            return rows.mapInArrow(_dropper(spark.sparkContext.broadcast(table), digest, min_chars), out)
        base = docs.select("text", "doc_id", F.xxhash64("text").alias("digest"))
        each = base.mapInArrow(_document_keys(min_chars, "doc_id", "digest"), f"doc_id {schema['doc_id'].dataType.simpleString()}, digest bigint, h1 bigint, h2 bigint")
        own = each.join(common, ["h1", "h2"]).groupBy("doc_id", "digest").agg(F.collect_set(F.struct("h1", "h2")).alias("keys"))
        own = written(own.select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"), F.col("keys").alias("__keys")), "own-lines", keep=True)
    joined = docs.join(own, docs["doc_id"].eqNullSafe(own["__id"]) & (F.xxhash64(docs["text"]) == own["__digest"]), "left")
    rows = joined.select(F.col("text").alias("__text"), F.col("__keys"), *columns)
    return rows.mapInArrow(_listed(digest, min_chars), out)


def _listed(digest: bool, min_chars: int):
    drop = _dropper(None, digest, min_chars)

    def with_lists(batches):
        import struct

        import pyarrow as pa

        def packed():
            for batch in batches:
                keys = pa.array([[struct.pack("<qq", k["h1"], k["h2"]) for k in own] if own else None for own in batch.column(1).to_pylist()], pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([batch.column(0), keys, *(batch.column(i) for i in range(2, batch.num_columns))], names=batch.schema.names)

        yield from drop(packed())

    return with_lists


def dropped(docs: DataFrame, small: int = SMALL, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents with the text that is left, and n_lines and n_dropped."""
    out = _apply(docs, fitted(docs, threshold=threshold, min_chars=min_chars), False, min_chars, small)
    return out.withColumn("text", F.col("__kept")).withColumns({"n_lines": F.col("__n_lines"), "n_dropped": F.col("__n_dropped")}).drop("__kept", "__n_lines", "__n_dropped")


def line_digests(docs: DataFrame, small: int = SMALL, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    out = _apply(docs, fitted(docs, threshold=threshold, min_chars=min_chars), True, min_chars, small)
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.col("__kept").alias("kept_sha256"))


by_value(__name__)
