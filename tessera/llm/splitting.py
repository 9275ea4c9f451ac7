"""Words of whole texts in Arrow batches, by byte classes; shared by the operators that count words in tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from . import suffixes
from .common import by_value, kept_by_worker
from .suffixes import mixed, sums, tables

#: Bytes of text that are split at a time; a longer text is cut after a separator.
BUFFER = 2 << 20
WORD, GAP, SEPARATOR = 0, 1, 2


def byte_kinds(gaps: bytes, separators: bytes):
    """A table from byte to WORD, GAP (between words) or SEPARATOR (between pieces)."""
    import numpy as np

    kinds = np.zeros(256, dtype="u1")
    kinds[list(gaps)] = GAP
    kinds[list(separators)] = SEPARATOR
    return kinds


@dataclass
class Words:
    """The words of a group of texts, one after the other. word: index into words, the distinct ones; text: index of the text
    in the batch; piece: rises from piece to piece, so neighbours with one number are words of one piece."""

    words: object
    word: object
    text: object
    piece: object


def split(column, kinds) -> Iterator[Words]:
    """Words of a column of texts (null: none), in groups of about BUFFER bytes."""
    import numpy as np
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype="i8")[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype="u1")
    group, start = [], 0
    for text, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        while b - a > BUFFER:
            # The last separator of the buffer, or the first after it.
            cut = a + BUFFER - int(np.argmax(kinds[data[a : a + BUFFER][::-1]] == SEPARATOR))
            while kinds[data[cut - 1]] != SEPARATOR and cut < b:
                more = np.flatnonzero(kinds[data[cut : min(cut + BUFFER, b)]] == SEPARATOR)
                cut = cut + int(more[0]) + 1 if len(more) else min(cut + BUFFER, b)
            group.append((text, cut))
            yield _words(data, start, group, kinds)
            group, start, a = [], cut, cut
        group.append((text, b))
        if b - start > BUFFER:
            yield _words(data, start, group, kinds)
            group, start = [], b
    if group:
        yield _words(data, start, group, kinds)


def _words(data, start: int, group: list[tuple[int, int]], kinds) -> Words:
    import numpy as np
    import pyarrow as pa

    texts, ends = (np.array(x, dtype="i8") for x in zip(*group))
    data, ends = data[start : ends[-1]], ends - start
    kind = kinds[data]
    inside = kind == WORD
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[0] = True
    edge[ends] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    # The words' bytes without what is between them, as an Arrow array.
    offsets = np.concatenate(([0], np.cumsum(b - a))).astype("i8")
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(a), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside]))])
    coded = words.dictionary_encode()
    piece = np.cumsum((kind == SEPARATOR) | edge[:-1], dtype="i4")[a] if len(a) else np.zeros(0, dtype="i4")
    return Words(coded.dictionary, coded.indices.to_numpy().astype("i8"), texts[np.searchsorted(ends, a, side="right")], piece)


def hashes(words):
    """64-bit hashes of an Arrow array of strings or binaries without nulls."""
    import numpy as np
    import pyarrow as pa

    words = words.cast(pa.large_binary())
    offsets = np.frombuffer(words.buffers()[1], dtype="i8")[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", dtype="u1")[offsets[0] : offsets[-1]]
    numbers = kept_by_worker("splitting-tables", lambda: tables(1 << 20)) if len(data) < 1 << 20 else tables(len(data) + 1)
    pre, at = sums(data, numbers), offsets - offsets[0]
    return mixed((pre[at[1:]] - pre[at[:-1]]) * numbers[2][np.minimum(at[:-1], len(numbers[2]) - 1)]) + mixed(np.diff(at).astype("u8"))


def factored(keys):
    """(code of each key, how often each code occurs, the first place of each code)."""
    import numpy as np
    import pyarrow as pa

    coded = pa.array(keys).dictionary_encode()
    codes, n = coded.indices.to_numpy().astype("i8"), len(coded.dictionary)
    first = np.zeros(n, dtype="i8")
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    return codes, np.bincount(codes, minlength=n), first


by_value(__name__)
by_value(suffixes.__name__)
