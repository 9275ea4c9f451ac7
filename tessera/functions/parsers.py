"""Parsers of structured model output whose grammar no regular expression covers; Arrow-batched UDFs."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import by_value

MAPPING = T.MapType(T.StringType(), T.ArrayType(T.StringType()))
CLUSTERING = T.StructType([T.StructField("clusters", MAPPING), T.StructField("fenced", T.BooleanType()), T.StructField("valid", T.BooleanType())])
PAIR = T.StructType([T.StructField(c, T.StringType()) for c in ("meta", "sub", "topic", "log_file")])


def objects_in(text: str) -> list[str]:
    """The balanced {...} spans at the outermost level, from left to right; an unclosed one ends the search."""
    out, depth, start = [], 0, -1
    for i, c in enumerate(text):
        if c == "{":
            if depth == 0:
                start = i
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                out.append(text[start : i + 1])
    return out


def strings_of(value) -> list[str]:
    """All scalars of nested lists as strings, in order."""
    if isinstance(value, (list, tuple)):
        return [s for item in value for s in strings_of(item)]
    return [value if isinstance(value, str) else str(value)]


def label_mapping(response: str | None) -> dict[str, list[str]] | None:
    """{output: [inputs]} of an answer, or None without a whole JSON object.

    Keys are stripped, blank ones dropped; keys equal but for case are one (the first spelling), with each value once.
    """
    fence = re.search(r"```(?:json)?(.*?)```", response or "", re.S)
    found = objects_in(fence[1] if fence else response or "")
    if not found:
        return None
    try:
        raw = json.loads(found[0], object_pairs_hook=list)
    except ValueError:
        return None
    spelling: dict[str, str] = {}
    values: dict[str, dict[str, str]] = {}
    for key, value in raw:
        if not (name := key.strip()):
            continue
        merged = name.lower() in spelling
        own = values.setdefault(spelling.setdefault(name.lower(), name), {})
        value = dict(value) if isinstance(value, list) and value and all(isinstance(x, tuple) for x in value) else value
        for n, s in enumerate(s for s in strings_of(value) if s.strip()):
            same = s.strip().lower()
            own.setdefault(same if merged or same not in own else f"{same}\0{n}", s)
    return {k: list(v.values()) for k, v in values.items() if v}


@F.pandas_udf(MAPPING)
def parse_label_mapping(response: pd.Series) -> pd.Series:
    return response.map(label_mapping)


def valid_clustering(clusters, n: int) -> bool:
    """Lists of numbers that name each of 1..n exactly once."""
    if not isinstance(clusters, dict) or not all(isinstance(v, list) for v in clusters.values()):
        return False
    ids = [i for v in clusters.values() for i in v]
    return all(isinstance(i, int) and not isinstance(i, bool) for i in ids) and sorted(ids) == list(range(1, n + 1))


def clustering(response: str | None, topics: list[str]) -> tuple[dict[str, list[str]], bool, bool]:
    """(clusters, fenced, valid). The last fenced object counts, else the last object, else the whole text.

    Numbers name topics from 1; others are ignored, and topics without a cluster get one of their own.
    """
    text = (response or "").rpartition("</think>")[2]
    fences = re.findall(r"```(?:jsonl|json)\s*(\{.*?\})\s*```", text, re.S)
    data = None
    for candidate in [fences[-1]] if fences else [*objects_in(text)[::-1], text]:
        try:
            data = json.loads(candidate.replace("\n", "").replace("\r", ""))
            break
        except ValueError:
            continue
    valid = valid_clustering(data, len(topics))
    out: dict[str, list[str]] = {}
    if not isinstance(data, dict):
        for t in topics:
            name, k = (t[:50] + "..." if len(t) > 50 else t), 1
            while name in out:
                k += 1
                name = f"{t[:50]}... ({k})"
            out[name] = [t]
        return out, bool(fences), False
    used = set()
    for name, ids in data.items():
        members = [i for i in (ids if isinstance(ids, list) else [ids]) if isinstance(i, int) and 1 <= i <= len(topics) and i not in used]
        used.update(members)
        if members:
            out[str(name)] = [topics[i - 1] for i in members]
    for i, t in enumerate(topics, 1):
        if i not in used:
            out[f"cluster_{i}"] = [t]
    return out, bool(fences), valid


@F.pandas_udf(CLUSTERING)
def parse_clustering(response: pd.Series, topics: pd.Series) -> pd.DataFrame:
    rows = [clustering(r, list(t)) for r, t in zip(response, topics)]
    return pd.DataFrame({"clusters": [r[0] for r in rows], "fenced": [r[1] for r in rows], "valid": [r[2] for r in rows]})


#: The markers of the chat dialects that a logged query may carry: (start of the user's turn, its end).
DIALECTS = (
    (r"<｜User｜>", r"<｜Assistant｜>"),
    (r"<\|start_header_id\|>user<\|end_header_id\|>\s*\n", r"<\|eot_id\|>|<\|start_header_id\|>assistant"),
    (r"<\|user\|>\s*\n?", r"<\|assistant\|>"),
)
#: What ends a query wherever it stands, markers to delete, and prefixes to delete.
ENDS = r"<\|/?assistant\|>|<｜Assistant｜>|</think>|</assistant>|</user>"
MARKERS = r"<｜begin▁of▁sentence｜>|<\|begin_of_text\|>|<\|start_header_id\|>.*?<\|end_header_id\|>|<\|eot_id\|>"
PREFIXES = r"(?i)(?:查询|query)\s*[:：]\s*"


#: Starts of lines that instruct, labels of a query, and what separates examples.
INSTRUCTIONS = ("You are", "你是一个", "Example", "示例", "Topic:", "主题:", "Now,", "现在")
LABEL = r"(?:Query|查询)"
EXAMPLES = r"\n\n|\n(?:或者：|或者|再一个|一个例子|最后一个)"


def labelled_query(text: str) -> str | None:
    """The query of a long text: after a topic and a label, else after a label, else the last paragraph that does not instruct.

    None if nothing tells, "" if a label is there without a query.
    """
    if block := re.search(r"Topic:.+?\n\s*Query[:：](.*?)(?:<|$)", text, re.S | re.I):
        return re.sub(rf"^{LABEL}[:：]$", "", block[1].strip())
    if label := re.search(f"{LABEL}[:：]", text):
        return re.split(rf"\n\n|\n{LABEL}|\n或者", text[label.end() :].lstrip(), maxsplit=1)[0].strip()
    paragraphs = [p.strip() for p in re.split(EXAMPLES, text)]
    fits = [p for p in paragraphs if p and len(p) < 300 and "Topic:" not in p and not p.startswith(INSTRUCTIONS[:4])]
    return fits[-1] if len(paragraphs) > 1 and fits else None


def user_message(query: str | None) -> str:
    """The user's text of a logged query, without lines that instruct; empty if what remains is a system text (over 500
    characters, or an instruction)."""
    text = query or ""
    for start, end in DIALECTS:
        if m := re.search(start, text):
            text = re.split(end, text[m.end() :], maxsplit=1)[0]
            break
    text = re.sub(MARKERS, "", re.split(ENDS, text, maxsplit=1)[0]).strip()
    if len(text) > 200 and (found := labelled_query(text)) is not None:
        text = found
    text = re.sub(r"\n{3,}", "\n\n", re.sub(PREFIXES, "", text)).strip()
    lines = [x.strip() for x in text.split("\n")]
    asked = [x for x in lines if x and not x.startswith(INSTRUCTIONS)]
    text = "\n".join(asked) if asked else text
    return "" if len(text) > 500 or text.startswith(INSTRUCTIONS[:2]) else text


@F.pandas_udf(T.StringType())
def parse_user_message(query: pd.Series) -> pd.Series:
    return query.map(user_message)


def expanded(response: str | None, ids: dict[str, list[str]]) -> dict[str, list[str]] | None:
    """An object from the first { to the last }, with #n# placeholders replaced by their values."""
    text = response or ""
    try:
        raw = json.loads(text[text.index("{") : text.rindex("}") + 1])
    except ValueError:
        return None
    return {k: [s for v in strings_of(value) for s in ids.get(v, [v])] for k, value in raw.items()}


def pairs_below(value, at: tuple[str, ...] = ()):
    """(path, object, file) of every [object, "file"] pair at any depth of nested objects and lists."""
    if isinstance(value, list) and len(value) == 2 and isinstance(value[0], dict) and isinstance(value[1], str):
        yield at, value[0], value[1]
    elif isinstance(value, list):
        for item in value:
            yield from pairs_below(item, at)
    elif isinstance(value, dict):
        for k, item in value.items():
            yield from pairs_below(item, (*at, k))


@F.udtf(returnType=PAIR)
class MetaPairs:
    """Rows of a meta-cluster document: cluster, sub-cluster (null in the flat form), topic as JSON, file."""

    def eval(self, document: str):
        for path, topic, file in pairs_below(json.loads(document)):
            yield path[0] if path else None, path[1] if len(path) > 1 else None, json.dumps(topic, ensure_ascii=False), file


by_value(__name__)
