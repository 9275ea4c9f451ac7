"""Cleaning and inspection of model output, as expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keys import or_else, strip

HAN = "[\u4e00-\u9fff]"
#: Where an answer may start.
ROLE_MARKERS = r"(?i)<\|assistant\|>|Assistant:|\nassistant\n"
#: Openings of a refusal. A pattern of the table `refusal_patterns` may replace them.
REFUSAL_PATTERNS = (
    r"^I cannot fulfill this request\.",
    r"^As an AI, I am unable to assist with that\.",
    r"^I'm sorry, but I cannot",
    r"^Sorry, I can't help with that\.",
    r"^I cannot help you with that",
    r"^我无法提供",
    r"^很抱歉，我不能",
    r"^抱歉，我无法",
    r"^对不起，我不能",
    r"^我不能协助",
    r"^我不能提供",
    r"^无法回答",
    r"^不能回答",
)
#: Prefix of a text that stands for an answer withheld by a provider's moderation.
SENTINEL = "[MODERATION_BLOCKED]"


def without_thinking(x: Column) -> Column:
    """What follows the first closing tag; empty if a block never closes."""
    end = F.instr(x, "</think>")
    after = F.regexp_replace(F.substr(x, end + len("</think>")), r"(?U)^\s+", "")
    return F.when(end > 0, after).when(F.contains(x, F.lit("<think>")), "").otherwise(x)


def numbered_items(x: Column, most: int | None = None) -> Column:
    """Texts of lines ``1. text``, distinct in order, at most the first `most`."""
    found = F.array_distinct(F.regexp_extract_all(x, F.lit(r"(?md)^\d+\.\s*(.*?)$"), F.lit(1)))
    return found if most is None else F.slice(found, 1, most)


def has_han(x: Column) -> Column:
    return F.coalesce(F.rlike(x, F.lit(HAN)), F.lit(False))


def plain_words(x: Column) -> Column:
    """Lower case, ends stripped of marks, no full stops, no words of one letter, single spaces."""
    bare = F.replace(F.btrim(F.lower(x), F.lit(" ./:\",'()[]")), F.lit("."), F.lit(""))
    return F.array_join(F.filter(F.split(bare, r"(?U)\s+"), lambda w: F.length(w) > 1), " ")


def split_labels(x: Column) -> Column:
    """Parts of a label list at commas and the word or; a leading or/and of a part goes, empty parts stay."""
    parts = F.split(x, r"\s*,\s*|\s+or\s+")
    return F.transform(parts, lambda p: strip(F.regexp_replace(p, r"^(?:or|and)\s+", "")))


def cleaned(x: Column) -> Column:
    """The answer after the last role marker, without thinking blocks, emphasis marks and extra white space."""
    last = F.element_at(F.split(x, ROLE_MARKERS), -1)
    last = F.replace(F.regexp_replace(last, r"(?s)<think>.*?</think>", ""), F.lit("</think>"), F.lit(""))
    straight = F.translate(last, "\u201c\u201d\u2018\u2019*_`", "\"\"''")
    return strip(F.regexp_replace(straight, r"(?U)\s+", " "))


def refusal_fast(x: Column, patterns=REFUSAL_PATTERNS) -> Column:
    """false for null, true for the sentinel or a known opening, else null (not decided). The text is cleaned and searched once."""
    opening = F.rlike(cleaned(x), F.lit(f"(?i)(?:{'|'.join(patterns)})")) if patterns else F.lit(False)
    return F.when(x.isNull(), False).when(F.startswith(x, F.lit(SENTINEL)) | opening, True)


def refusal_legacy(x: Column, patterns=REFUSAL_PATTERNS) -> Column:
    """Any opening in what follows the last ``ssistant``."""
    return F.rlike(F.substring_index(x, "ssistant", -1), F.lit(f"(?i)(?:{'|'.join(patterns)})")) if patterns else F.lit(False)


def probe_text(x: Column) -> Column:
    """The text after the last role marker without marker characters at its ends."""
    return F.btrim(F.element_at(F.split(x, ROLE_MARKERS), -1), F.lit(" <>|:"))


def word_count(x: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(x, F.lit("")), r"(?U)\s+"), lambda w: w != ""))


def summary_of(response: Column, shortened: Column) -> Column:
    """A model's summary line: after the last colon, thinking removed; ``[skip]`` gives null, empty gives shortened."""
    text = strip(without_thinking(strip(F.substring_index(response, ":", -1))))
    return F.when(F.contains(F.lower(text), F.lit("[skip]")), F.lit(None).cast("string")).otherwise(or_else(text, shortened))


def says_yes(x: Column) -> Column:
    return F.coalesce(F.contains(F.lower(F.trim(x)), F.lit("yes")), F.lit(False))


def moderation_reason(x: Column) -> Column:
    """What follows ``: `` in a sentinel text, or ``unknown``; null for other texts."""
    at = F.instr(x, ": ")
    return F.when(F.startswith(x, F.lit(SENTINEL)), F.when(at > 0, F.substr(x, at + 2)).otherwise("unknown"))


def sentinel(reason: Column) -> Column:
    return F.concat(F.lit(f"{SENTINEL}: "), F.coalesce(F.nullif(reason, F.lit("")), F.lit("unknown")))


def filled(template: Column, topic: Column) -> Column:
    """Every {} of the template replaced, doubled braces made single."""
    once = F.replace(template, F.lit("{}"), topic)
    return F.replace(F.replace(once, F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}"))


def numbered(items: Column, style: str = "dot") -> Column:
    """A list for a prompt: ``1. x`` (dot), ``[1] x`` (bracket) or ``- x`` (dash), a line each."""
    mark = {"dot": lambda i: F.concat((i + 1).cast("string"), F.lit(". ")), "bracket": lambda i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] ")), "dash": lambda i: F.lit("- ")}[style]
    return F.array_join(F.transform(items, lambda x, i: F.concat(mark(i), x)), "\n")


def display_name(x: Column) -> Column:
    """Underscores as spaces, first letter upper case, the rest lower."""
    text = F.replace(x, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))


def safe_label(x: Column) -> Column:
    return F.regexp_replace(x, "[^A-Za-z0-9_]", "")


def shortened(x: Column, most: int = 50) -> Column:
    return F.when(F.length(x) > most, F.concat(F.left(x, F.lit(most)), F.lit("..."))).otherwise(x)


def translation(x: Column) -> Column:
    """The text of ``[English: text]``, or null."""
    return F.nullif(F.regexp_extract(x, r"\[English:\s*(.*?)\]", 1), F.lit(""))


def with_translations(items: Column) -> Column:
    """Each item followed by its translation, where it has one, and without the bracket."""
    bare = lambda x: strip(F.regexp_replace(x, r"\s*\[English:.*?\]", ""))
    return F.flatten(F.transform(items, lambda x: F.when(translation(x).isNotNull(), F.array(bare(x), translation(x))).otherwise(F.array(x))))


def listed_queries(x: Column, most: int, least_length: int = 10) -> Column:
    """Queries of a numbered or dashed list that are longer than least_length; if there are too few, other such lines follow."""
    lines = F.transform(F.split(strip(x), "\n"), strip)
    marked = F.filter(lines, lambda s: F.rlike(s, F.lit(r"^[\d-]")))
    item = lambda s: F.when(F.contains(s, F.lit(". ")), F.substr(s, F.instr(s, ". ") + 2)).otherwise(strip(F.regexp_replace(s, "^[- ]+", "")))
    found = F.filter(F.transform(marked, item), lambda s: F.length(s) > least_length)
    more = F.filter(lines, lambda s: (F.length(s) > least_length) & ~F.startswith(s, F.lit("Topic:")))
    rest = F.array_distinct(F.filter(more, lambda s: ~F.array_contains(found, s)))
    return F.slice(F.when(F.size(found) < most, F.concat(found, rest)).otherwise(found), 1, most)


def keywords_in(x: Column, keywords) -> Column:
    return F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(F.lower(x), F.lower(k)))


def boxed_letter(x: Column, letters: str) -> Column:
    """The first of the letters inside the first \\boxed{}, in lower case; null if there is none."""
    box = F.lower(F.regexp_extract(x, r"\\boxed\{([^}]*)\}", 1))
    return F.nullif(F.regexp_extract(box, f"([{letters}])", 1), F.lit(""))


def pairwise_winner(x: Column) -> Column:
    return boxed_letter(x, "ab")


def similarity(x: Column) -> Column:
    """struct<flag, topics> of an answer with \\topic{...} marks and a boxed y or n."""
    text = F.element_at(F.split(F.coalesce(F.try_element_at(F.split(x, "</cache_block>"), F.lit(2)), x), "</thinking>"), -1)
    topics = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\\topic\{([^}]*)\}"), F.lit(1)), lambda s: F.trim(s)), lambda t: (t != "") & (F.lower(t) != "none"))
    return F.struct(F.coalesce(boxed_letter(text, "yn") == "y", F.lit(False)).alias("flag"), topics.alias("topics"))


def fenced(x: Column) -> Column:
    """The first fenced block without a json tag; without fences the text."""
    parts = F.split(x, "```")
    return F.when(F.size(parts) >= 3, strip(F.regexp_replace(parts[1], r"^\s*json", ""))).otherwise(strip(x))


def json_strings(x: Column) -> Column:
    """A JSON list of strings in fenced text; [] for anything else."""
    return F.coalesce(F.from_json(fenced(x), "array<string>"), F.array().cast("array<string>"))


def answer_name(x: Column) -> Column:
    """The name in answer{"name"}, else the first quoted text after the word answer."""
    exact = F.nullif(F.regexp_extract(x, r'answer\{"([^"]+)"\}', 1), F.lit(""))
    return F.coalesce(exact, F.nullif(F.regexp_extract(x, r'(?i)answer.*?"([^"]+)"', 1), F.lit("")))


def reasoning_template(rendered: Column, template: Column) -> Column:
    """A rendered prompt that ends in an opening thinking tag, or a template that emits one."""
    return F.endswith(F.rtrim(rendered), F.lit("<think>")) | F.rlike(template, F.lit(r"<think>"))


def rendered_chat(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: m["content"]), " ")


def thinking_share(responses: Column) -> Column:
    """Whether more than half of the responses close a thinking block."""
    closed = F.size(F.filter(responses, lambda r: F.contains(r, F.lit("</think>"))))
    return closed * 2 > F.size(responses)
