"""Normal forms of a topic key, and Python-like string helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the ASCII punctuation that the summary key removes.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def strip(x: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def trim_key(x: Column) -> Column:
    """Stripped, lower case: the key of provenance, lineage and coverage."""
    return F.lower(strip(x))


def summary_key(x: Column) -> Column:
    """Lower case without ASCII punctuation, not stripped; null gives "": the key of head deduplication."""
    return F.translate(F.lower(F.coalesce(x, F.lit(""))), PUNCTUATION, "")


def joined_summary_key(parts: Column) -> Column:
    """summary_key of an array of parts, joined by spaces."""
    return summary_key(F.array_join(parts, " "))


def or_else(a: Column, b: Column) -> Column:
    """a unless it is null or empty, else b."""
    return F.coalesce(F.nullif(a, F.lit("")), b)


def display_text(summary: Column, shortened: Column, english: Column, raw: Column) -> Column:
    """The first non-empty of the four."""
    out = raw
    for x in (english, shortened, summary):
        out = or_else(x, out)
    return out


def annotated(english: Column, chinese: Column, is_chinese: Column) -> Column:
    """``chinese (english)`` for a row marked Chinese, else english."""
    return F.when(F.coalesce(is_chinese, F.lit(False)) & chinese.isNotNull(), F.concat(chinese, F.lit(" ("), english, F.lit(")"))).otherwise(english)


def composite(*parts: Column) -> Column:
    return F.concat_ws(":", *parts)


def last_part(x: Column) -> Column:
    """After the last colon, stripped, lower case; ``none`` gives null."""
    key = trim_key(F.substring_index(x, ":", -1))
    return F.when(key != "none", key)


def join_name(x: Column) -> Column:
    """The form in which label names of different files are joined: underscores as spaces, lower case, stripped."""
    return strip(F.lower(F.replace(x, F.lit("_"), F.lit(" "))))
