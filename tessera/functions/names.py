"""File names of logs, model names and provider prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed formats: names of log files, one for each reader that accepts them. Groups: date, time, model, and then
#: what the format has of samples, crawls, filter, mode, backend.
_HEAD = r"^crawler_log_(\d{8})_(\d{6})_(.+?)_(\d+)samples_(\d+)crawls_(.+?)filter_"
NAME_FORMATS = {
    "prompt": _HEAD + r"(.+?)prompt_(.+)",
    "vllm": _HEAD + r"(.+?)_vllm()",
    "separate_prompt": _HEAD + r"(.+?)_prompt_(.+)",
    "separate_prefill": _HEAD + r"(.+?)_prefill_(.+)",
    "current": r"^crawler_out_(\d{8})_(\d{6})_(.+?)_(\d+)samples_(\d+)crawls_(.+?)filter_(.+?)prompt_(.+)",
}
#: Providers that may stand before a colon.
PROVIDERS = ("openrouter", "openai", "anthropic", "gemini", "ollama", "lmstudio")
FIELDS = ("date", "time", "model", "samples", "crawls", "filter", "mode", "backend")


def base_name(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.json$", "")


def with_suffix(name: Column) -> Column:
    return F.when(F.endswith(name, F.lit(".json")), name).otherwise(F.concat(name, F.lit(".json")))


def parsed_name(path: Column, *formats: str) -> Column:
    """A struct of FIELDS and ts by the first of the formats that fits; null if none does."""
    base = base_name(path)
    out = F.lit(None)
    for name in reversed(formats or ("prompt",)):
        pattern = NAME_FORMATS[name]
        parts = {f: F.nullif(F.regexp_extract(base, pattern, i + 1), F.lit("")) for i, f in enumerate(FIELDS)}
        ts = F.try_to_timestamp(F.concat(parts["date"], F.lit("_"), parts["time"]), F.lit("yyyyMMdd_HHmmss"))
        typed = parts | {"samples": parts["samples"].cast("int"), "crawls": parts["crawls"].cast("int")}
        made = F.struct(*[v.alias(k) for k, v in typed.items()], ts.alias("ts"))
        out = F.when(F.rlike(base, F.lit(pattern)) & ts.isNotNull(), made).otherwise(out)
    return out


def mode_of(path: Column) -> Column:
    """thought, assistant or user from ``..._mode_prefill...``."""
    return F.nullif(F.regexp_extract(path, r"crawler_log_\d+_\d+_.+?_\d+samples.*?_(thought|assistant|user)_prefill", 1), F.lit(""))


def provider_and_model(x: Column, default: str = "openrouter") -> Column:
    """struct<provider, model>: a known provider before the first colon, else the default and the whole text."""
    prefix = F.lower(F.substring_index(x, ":", 1))
    known = F.contains(x, F.lit(":")) & prefix.isin(*PROVIDERS)
    return F.struct(F.when(known, prefix).otherwise(default).alias("provider"), F.when(known, F.substr(x, F.instr(x, ":") + 1)).otherwise(x).alias("model"))


def mapped_name(x: Column, names: dict[str, str]) -> Column:
    """The name for x in a fixed map, else x."""
    out = x
    for k, v in names.items():
        out = F.when(x == k, v).otherwise(out)
    return out


def preferred(modes: Column, order: tuple[str, ...]) -> Column:
    """The first mode of the order that the array has."""
    return F.coalesce(*[F.when(F.array_contains(modes, m), F.lit(m)) for m in order])
