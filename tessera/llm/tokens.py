"""Token-ID output: shards of independent zstandard frames with a trailing seek table and checksums for each frame.

A shard holds documents in ascending doc_id, or in the order that they come in; the shards' names sort in the same order. Layout of a shard:

* data frames, each a complete zstandard frame with the ids of some whole documents (little-endian, unsigned 16 bits
  where the vocabulary allows, else 32). A frame is closed once it holds FRAME bytes;
* a skippable frame (magic 0x184D2A50): one byte for the width of an id, then an INDEX record for each document;
* the seek table of the zstandard seekable format, itself a skippable frame (magic 0x184D2A5E): for each data frame its
  compressed size, its size and the low 32 bits of the XXH64 of its content, then the count and magic 0x8F92EAB1.

A reader gets the tail, then the frames of the documents that it wants. A task writes its shard under a name of
its own and renames it when it is whole, so a repeated or speculative task leaves the same file.

Texts are cut before every single space that precedes a character other than white space, and around single line
breaks between such characters. The byte-level pattern always starts a piece there, so encoding the cut pieces one by
one gives the ids of the whole; a worker keeps the ids of the first CACHE pieces that it meets.

Defined results: null text is empty (the end id alone); null doc_ids come first; equal doc_ids are all written, in any
order; doc_ids that are not integers raise a TypeError before anything is written; strings of special tokens inside a text are ordinary text; an empty table gives no shard and an empty result.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import by_value, kept_by_worker, new_path

FRAME, LEVEL, CACHE, AT_ONCE = 1 << 18, 3, 600_000, 2_000
#: Bytes of text that are cut into pieces at a time.
PIECES = 1 << 22
INDEX = [("doc_id", "<i8"), ("has_id", "u1"), ("frame", "<u4"), ("offset", "<u4"), ("n", "<u4")]
SKIP, SEEK, TAIL = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
SUMMARY = "shard string, n_docs bigint, n_tokens bigint"


def filesystem(uri: str):
    """The file system of a URI and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Encoder:
    """encode(texts) gives each text's ids and the end id as bytes.

    known holds the ids of pieces by key: a key that starts with a line break, or with NUL (a text's first piece or one
    outside the plain form; the NUL is not part of it), stands for itself, any other for a space and itself.
    """

    def __init__(self, model: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.tokenizer.encode_special_tokens = True
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.code = "I" if self.wide else "H"
        self.end = struct.pack(f"<{self.code}", end_id)
        self.known: dict[str, bytes] = {}

    def direct(self, keys: list[str]) -> list[bytes]:
        out = []
        for k in range(0, len(keys), AT_ONCE):  # an encoding takes far more memory than its ids
            found = self.tokenizer.encode_batch_fast([text_of(x) for x in keys[k : k + AT_ONCE]], add_special_tokens=False)
            out += [struct.pack(f"<{len(e.ids)}{self.code}", *e.ids) for e in found]
        return out

    def ids_of(self, keys: list[str]) -> list[bytes]:
        """Each key's ids, from those known or from the tokenizer."""
        found = list(map(self.known.get, keys))
        missing = [k for k, x in zip(keys, found) if x is None]
        if not missing:
            return found
        new = dict(zip(missing, self.direct(missing)))
        room = CACHE - len(self.known)
        self.known.update(new if len(new) <= room else dict(list(new.items())[: max(room, 0)]))
        return [new[k] if x is None else x for k, x in zip(keys, found)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """All texts are cut and their pieces numbered at once; each distinct piece is looked up once."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        simple = [is_plain(t) for t in texts]
        lines = ["\0" + t.replace("\n", " \n") for t, x in zip(texts, simple) if x]
        others = [keys_of(t) for t, x in zip(texts, simple) if not x]
        # Large types: a batch may be one text of any length.
        pieces = [pc.split_pattern(pa.array([" ".join(lines)], pa.large_string()), " ").flatten()] if lines else []
        pieces.append(pa.array([k for keys in others for k in keys], pa.large_string()))
        coded = pa.concat_arrays(pieces).dictionary_encode()
        known = self.ids_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        width = 4 if self.wide else 2
        flat = np.frombuffer(b"".join(known), dtype=f"<u{width}")
        size = np.array([len(x) // width for x in known], dtype="i8")
        start = np.cumsum(size) - size
        at = coded.indices.to_numpy()
        n = size[at]
        ends = np.concatenate(([0], np.cumsum(n)))
        data = flat[np.repeat(start[at] - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        counts = iter([x.count(" ") + 1 for x in lines] + [len(keys) for keys in others])
        times = {flag: [next(counts) for x in simple if x == flag] for flag in (True, False)}
        cuts = ends[np.cumsum([0, *times[True], *times[False]])] * width
        spans = {True: iter(zip(cuts, cuts[1:])), False: iter(zip(cuts[len(lines) :], cuts[len(lines) + 1 :]))}
        return [data[slice(*next(spans[x]))] + self.end for x in simple]


def is_plain(text: str) -> bool:
    """Whether text is made of single spaces and line breaks, apart from each other, between printable characters."""
    return bool(text) and text[0] not in " \n" and text[-1] not in " \n" and not any(x in text for x in ("  ", "\n ", " \n", "\n\n")) and text.replace("\n", "").isprintable()


def text_of(key: str) -> str:
    return key if key[0] == "\n" else key[1:] if key[0] == "\0" else " " + key


def keys_of(text: str) -> list[str]:
    """Keys whose texts make up text, cut only where the byte-level pattern always starts a piece."""
    if not text:
        return []
    if is_plain(text):
        return ("\0" + text.replace("\n", " \n")).split(" ")
    parts = text.split(" ")
    out = ["\0" + parts[0]] if parts[0] else []
    for p in parts[1:]:
        if p and not p[0].isspace():
            out.append("\0 " + p)
        elif out:  # a run of white space stays in one piece with what is before it
            out[-1] += " " + p
        else:
            out.append("\0 " + p)
    return out


class ShardWriter:
    def __init__(self, out, width: int):
        import zstandard

        self.out, self.width = out, width
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.held: list[bytes] = []
        self.size = 0
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple] = []
        self.n_tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // self.width
        self.docs.append((doc_id or 0, doc_id is not None, len(self.frames), self.size // self.width, n))
        self.held.append(ids)
        self.size += len(ids)
        self.n_tokens += n
        if self.size >= FRAME:
            self.flush()

    def flush(self) -> None:
        import xxhash

        if self.held:
            data = b"".join(self.held)
            packed = self.zstd.compress(data)
            self.out.write(packed)
            self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
            self.held, self.size = [], 0

    def close(self) -> None:
        import numpy as np

        self.flush()
        index = bytes([self.width]) + np.array(self.docs, dtype=INDEX).tobytes()
        self.out.write(struct.pack("<II", SKIP, len(index)) + index)
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, TAIL)
        self.out.write(struct.pack("<II", SEEK, len(table)) + table)


class ShardReader:
    """docs: the INDEX records; ids(i): one document's ids; each(): all, frame by frame. Checksums are verified."""

    def __init__(self, file):
        import numpy as np

        self.file, size = file, file.size()
        file.seek(size - 9)
        n, _, magic = struct.unpack("<IBI", file.read(9))
        if magic != TAIL:
            raise ValueError("no seek table")
        file.seek(size - 9 - 12 * n)
        self.frames = np.frombuffer(file.read(12 * n), dtype="<u4").reshape(n, 3)
        self.starts = np.concatenate(([0], np.cumsum(self.frames[:, 0], dtype="i8")))
        file.seek(int(self.starts[-1]))
        magic, length = struct.unpack("<II", file.read(8))
        index = file.read(length)
        self.dtype = f"<u{index[0]}"
        self.docs = np.frombuffer(index, dtype=INDEX, offset=1)

    def frame(self, k: int):
        import numpy as np
        import xxhash
        import zstandard

        self.file.seek(int(self.starts[k]))
        data = zstandard.ZstdDecompressor().decompress(self.file.read(int(self.frames[k, 0])), max_output_size=int(self.frames[k, 1]))
        if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.frames[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(data, dtype=self.dtype)

    def ids(self, i: int):
        d = self.docs[i]
        return self.frame(int(d["frame"]))[d["offset"] : d["offset"] + d["n"]]

    def each(self):
        at, data = -1, None
        for d in self.docs:
            if d["frame"] != at:
                at, data = int(d["frame"]), self.frame(int(d["frame"]))
            yield d, data[d["offset"] : d["offset"] + d["n"]]


def _writer(model, folder: str, end_id: int):
    def write(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        encoder = kept_by_worker(f"encoder-{hash(model.value)}-{end_id}", lambda: Encoder(model.value, end_id))
        task = TaskContext.get()
        fs, path = filesystem(folder)
        part, final = f"{path}/.part-{task.partitionId():08d}-{task.taskAttemptId()}", f"{path}/shard-{task.partitionId():08d}.zst"
        shard, out = None, None
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            upto = np.concatenate(([0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))))
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(upto, upto[a] + PIECES, side="right")) - 1)
                if shard is None:
                    out = fs.open_output_stream(part)
                    shard = ShardWriter(out, 4 if encoder.wide else 2)
                for doc_id, data in zip(ids[a:b].to_pylist(), encoder.encode([t or "" for t in texts[a:b].to_pylist()])):
                    shard.add(doc_id, data)
                a = b
        if shard:
            shard.close()
            out.close()
            fs.move(part, final)
            yield pa.RecordBatch.from_arrays([pa.array([final.rpartition("/")[2]]), pa.array([len(shard.docs)], pa.int64()), pa.array([shard.n_tokens], pa.int64())], names=["shard", "n_docs", "n_tokens"])

    return write


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, by_id: bool = True) -> list[tuple[str, int, int]]:
    """Writes docs (doc_id, text) as shards to the folder; (name, documents, ids) of each shard, in order.

    tokenizer: the path of a tokenizers file on the driver; its content is broadcast. by_id: in ascending doc_id; else
    the order of docs stays (a shard for each partition), as for documents that have been shuffled on purpose.
    """
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("shards hold doc_ids of an integer type")
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        model = spark.sparkContext.broadcast(f.read())
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    if by_id:
        rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return sorted(tuple(r) for r in rows.mapInArrow(_writer(model, folder, end_id), SUMMARY).collect())


def _reader(folder: str):
    def read(batches):
        import numpy as np
        import pyarrow as pa

        fs, path = filesystem(folder)
        for batch in batches:
            for shard, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with fs.open_input_file(f"{path}/{shard}") as file:
                    reader = ShardReader(file)
                    crcs = [zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in reader.each()]
                docs = reader.docs
                n = docs["n"].astype("i8")
                start = base + np.concatenate(([0], np.cumsum(n)[:-1]))
                yield pa.RecordBatch.from_arrays([pa.array(docs["doc_id"], mask=docs["has_id"] == 0), pa.array(start), pa.array(n), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read


def read_shards(spark: SparkSession, folder: str, shards: list[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the shards."""
    rows, base = [], 0
    for name, _, n in shards:
        rows.append((name, base))
        base += n
    table = spark.createDataFrame(rows, "shard string, base bigint").repartition(max(1, len(rows)))
    return table.mapInArrow(_reader(folder), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def tokenized(docs: DataFrame, tokenizer: str | None = None, folder: str | None = None, end_id: int = 0, by_id: bool = True) -> DataFrame:
    """Writes the shards and reads them back: doc_id, start, n_tokens, ids_crc32."""
    folder = folder or new_path(docs.sparkSession, "tokens")
    return read_shards(docs.sparkSession, folder, write_shards(docs, folder, tokenizer or default_tokenizer(), end_id, by_id))


by_value(__name__)
