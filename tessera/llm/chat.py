r"""Chat formatting: schema fingerprints select a declarative mapping to canonical turns, a template renders them.

A layout names the nested field paths that its records have. The fingerprint of a layout is a hash of its sorted
paths; that of a schema (or of one JSON record) is the same hash over those of its paths that the layout names. The
first layout in LAYOUTS whose fingerprint agrees converts the records, so further fields, and fields whose names clash
with another layout's, do not matter.

Template: ``### role: text</turn>\n`` for each turn. In texts ``\`` becomes ``\\``, ``</turn>`` becomes ``<\/turn>``
and ``### `` becomes ``#\## ``, so a text never holds a marker and a single backslash always opens a pair; roles are
URL-encoded. Conversations are rendered in parts of PART turns, which bounds a task's work for a conversation of any
length; a conversation's output is its parts one after the other.

Defined results: null role or text is empty; null turn sorts first; turns with equal numbers are ordered by role, then
text; repeated rows are repeated turns; a null conversation id is a conversation of its own; an empty table gives an
empty table; a JSON record of no known layout gives no turns, and its layout is null.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART = 64
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """kind rows: a row for each turn, fields (order, role, text). kind items: an array of structs, fields
    (array, role, text). kind columns: pairs of role and the fields that make its text."""

    name: str
    kind: str
    fields: tuple
    roles: tuple[tuple[str, str], ...] = ()

    @property
    def paths(self) -> tuple[str, ...]:
        if self.kind == "items":
            array, role, text = self.fields
            return (array, f"{array}[].{role}", f"{array}[].{text}")
        return tuple(self.fields) if self.kind == "rows" else tuple(f for _, fields in self.fields for f in fields)

    @property
    def fingerprint(self) -> str:
        return fingerprint(self.paths)


SHARED_ROLES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))
LAYOUTS = (
    Layout("messages", "items", ("messages", "role", "content")),
    Layout("from_value", "items", ("conversations", "from", "value"), SHARED_ROLES),
    Layout("turn_rows", "rows", ("turn", "role", "text")),
    Layout("instruction_input", "columns", (("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("instruction", "columns", (("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("system_prompt_response", "columns", (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt_response", "columns", (("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("prompt_completion", "columns", (("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("question_answer", "columns", (("user", ("question",)), ("assistant", ("answer",)))),
)


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


def field_paths(schema: T.DataType, at: str = "") -> set[str]:
    """The nested field paths of a schema; [] stands for the items of an array."""
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, f"{at}[]")
    if not isinstance(schema, T.StructType):
        return set()
    out = set()
    for f in schema.fields:
        path = f"{at}.{f.name}" if at else f.name
        out |= {path} | field_paths(f.dataType, path)
    return out


def layout_of(schema: T.StructType, layouts: tuple[Layout, ...] = LAYOUTS) -> Layout:
    have = field_paths(schema)
    for layout in layouts:
        if fingerprint(have & set(layout.paths)) == layout.fingerprint:
            return layout
    raise ValueError(f"no layout for the fields {sorted(have)}")


def _role(role: Column, layout: Layout) -> Column:
    out = F.coalesce(role, F.lit(""))
    for raw, canonical in layout.roles:
        out = F.when(role == raw, canonical).otherwise(out)
    return out


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _columns_turns(layout: Layout, get) -> Column:
    """A turn for each role; several fields are joined by a blank line, and empty ones left out."""
    turns = []
    for role, fields in layout.fields:
        text = F.array_join(F.filter(F.array(*[F.coalesce(get(f).cast("string"), F.lit("")) for f in fields]), lambda x: x != ""), "\n\n")
        turns.append(_turn(F.lit(role), text))
    return F.array(*turns)


def canonical_turns(df: DataFrame, conv_id: str = "conv_id", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """conv_id, turn, role, text from a table of any known layout."""
    layout = layout_of(df.schema, layouts)
    if layout.kind == "rows":
        turn, role, text = (df[f] for f in layout.fields)
        return df.select(df[conv_id].alias("conv_id"), turn.cast("long").alias("turn"), _role(role, layout).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    if layout.kind == "items":
        array, role, text = layout.fields
        turns = F.transform(F.filter(df[array], lambda x: x.isNotNull()), lambda x: _turn(_role(x[role], layout), x[text]))
    else:
        turns = _columns_turns(layout, lambda f: df[f])
    return _exploded(df.select(df[conv_id].alias("conv_id"), turns.alias("turns")))


def _exploded(df: DataFrame) -> DataFrame:
    return df.select("conv_id", F.posexplode("turns").alias("turn", "t")).select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


def _objects(record: Column, array: str) -> Column:
    """The items of an array of a JSON record that are objects, as JSON."""
    items = F.from_json(F.get_json_object(record, f"$.{array}"), "array<string>")
    return F.filter(items, lambda x: F.json_object_keys(x).isNotNull())


def json_layouts(df: DataFrame, conv_id: str, record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """conv_id, layout and turns of JSON records whose layouts differ from row to row."""
    text = df[record]
    top = F.coalesce(F.json_object_keys(text), F.array().cast("array<string>"))
    nested = []
    for layout in layouts:
        if layout.kind == "items":
            array = layout.fields[0]
            # The keys of all items: the first may be null or lack a field.
            keys = F.flatten(F.transform(_objects(text, array), F.json_object_keys))
            nested.append(F.transform(F.coalesce(keys, F.array().cast("array<string>")), lambda k: F.concat(F.lit(f"{array}[]."), k)))
    rows = df.select(df[conv_id].alias("conv_id"), text.alias("record"), F.concat(top, *nested).alias("paths"))
    name = F.lit(None).cast("string")
    turns = F.lit(None).cast(TURNS)
    for layout in reversed([x for x in layouts if x.kind != "rows"]):
        have = F.array_sort(F.array_distinct(F.filter("paths", lambda p: p.isin(*layout.paths))))
        same = F.substring(F.sha2(F.array_join(have, "\n"), 256), 1, 16) == layout.fingerprint
        if layout.kind == "items":
            array, role, content = layout.fields
            parsed = F.transform(_objects(F.col("record"), array), lambda x: F.from_json(x, f"struct<`{role}`:string,`{content}`:string>"))
            got = F.transform(parsed, lambda x: _turn(_role(x[role], layout), x[content]))
        else:
            got = _columns_turns(layout, lambda f: F.get_json_object("record", f"$.{f}"))
        name = F.when(same, layout.name).otherwise(name)
        turns = F.when(same, got.cast(TURNS)).otherwise(turns)
    return rows.select("conv_id", name.alias("layout"), turns.alias("turns"))


def json_turns(df: DataFrame, conv_id: str, record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    return _exploded(json_layouts(df, conv_id, record, layouts))


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("</turn>"), F.lit("<\\/turn>"))
    return F.replace(out, F.lit("### "), F.lit("#\\## "))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_parts(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, part, n_turns, formatted, loss_spans (start and length in code points of formatted) from canonical turns."""
    rows = turns.select("conv_id", "turn", F.floor(F.col("turn") / PART).alias("part"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    parts = rows.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def rendered(t: Column) -> Column:
        return F.struct(F.concat(F.lit("### "), F.url_encode(t["role"]), F.lit(": ")).alias("head"), escape(t["text"]).alias("body"), (t["role"] == loss_role).alias("loss"))

    def step(acc: Column, x: Column) -> Column:
        start, length = acc["at"] + F.char_length(x["head"]), F.char_length(x["body"])
        spans = F.when(x["loss"], F.array_append(acc["spans"], F.struct(start.alias("start"), length.alias("length")))).otherwise(acc["spans"])
        return F.struct((start + length + len("</turn>\n")).alias("at"), spans.alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    return parts.select("conv_id", "part", F.transform("turns", rendered).alias("r")).select(
        "conv_id",
        "part",
        F.size("r").alias("n_turns"),
        F.array_join(F.transform("r", lambda x: F.concat(x["head"], x["body"], F.lit("</turn>\n"))), "").alias("formatted"),
        F.aggregate("r", zero, step, lambda acc: acc["spans"]).alias("loss_spans"),
    )


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, n_turns, formatted, loss_spans: the parts of each conversation in one row."""

    def step(acc: Column, p: Column) -> Column:
        moved = F.transform(p["loss_spans"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), s["length"].cast("long").alias("length")))
        return F.struct((acc["at"] + F.char_length(p["formatted"])).alias("at"), F.concat(acc["spans"], moved).alias("spans"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    whole = format_parts(turns, loss_role).groupBy("conv_id").agg(F.sum("n_turns").alias("n_turns"), F.sort_array(F.collect_list(F.struct("part", "formatted", "loss_spans"))).alias("p"))
    return whole.select("conv_id", "n_turns", F.array_join(F.transform("p", lambda x: x["formatted"]), "").alias("formatted"), F.aggregate("p", zero, step, lambda acc: acc["spans"]).alias("loss_spans"))


def read_back(parts: DataFrame) -> DataFrame:
    """conv_id, part, turns (role, text), loss_text and formatted_chars from format_parts' output alone."""
    pieces = F.split("formatted", "</turn>\n")
    turns = F.transform(
        F.slice(pieces, F.lit(1), F.size(pieces) - 1),
        lambda p: F.struct(
            F.url_decode(F.substring_index(F.substring(p, 5, 1 << 30), ": ", 1)).alias("role"),
            unescape(F.substr(p, F.locate(": ", p) + 2)).alias("text"),
        ),
    )
    masked = F.array_join(F.transform("loss_spans", lambda s: F.substr(F.col("formatted"), s["start"] + 1, s["length"])), "")
    return parts.select("conv_id", "part", turns.alias("turns"), unescape(masked).alias("loss_text"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def digests(parts: DataFrame) -> DataFrame:
    """A row for each conversation with the digests of what its formatted parts hold."""
    rows = read_back(parts).select(
        "conv_id",
        "part",
        F.size("turns").cast("long").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
        "loss_text",
        "formatted_chars",
    )
    whole = rows.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("formatted_chars").alias("formatted_chars"), F.sort_array(F.collect_list(F.struct("part", "turns", "loss_text"))).alias("p"))
    joined = whole.select("conv_id", "n_turns", "formatted_chars", F.array_join("p.turns", "").alias("turns"), F.array_join("p.loss_text", "").alias("loss"))
    return joined.select(
        "conv_id",
        "n_turns",
        F.sha2("turns", 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
