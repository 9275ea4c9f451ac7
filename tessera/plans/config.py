"""Settings of a run: nested dataclasses with overrides by dotted name, and sweeps over axes."""

from __future__ import annotations

import dataclasses
import itertools
import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class ModelSettings:
    name: str = "target"
    temperature: float = 0.6
    max_tokens: int = 512


@dataclass(frozen=True)
class CrawlSettings:
    steps: int = 10
    batch: int = 2
    warmup: int = 1
    max_topics: int = 1000
    n_probes: int = 10
    threshold: float = 0.25
    per_generation: int = 50


@dataclass(frozen=True)
class ReduceSettings:
    size: int = 50
    target: int = 25
    most: int = 50
    retries: int = 3


@dataclass(frozen=True)
class RankSettings:
    comparisons: int = 5000
    batch: int = 100


@dataclass(frozen=True)
class Settings:
    model: ModelSettings = field(default_factory=ModelSettings)
    crawl: CrawlSettings = field(default_factory=CrawlSettings)
    reduce: ReduceSettings = field(default_factory=ReduceSettings)
    rank: RankSettings = field(default_factory=RankSettings)

    def with_values(self, **values: object) -> Settings:
        """A copy with values by dotted name, as crawl__steps=3 or from a dict of "crawl.steps"; an unknown name is an error."""
        out = self
        for key, value in values.items():
            part, _, name = key.replace("__", ".").partition(".")
            inner = getattr(out, part)
            kind = type(getattr(inner, name))
            out = dataclasses.replace(out, **{part: dataclasses.replace(inner, **{name: kind(value)})})
        return out

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), sort_keys=True)


#: Where providers answer, and the environment variable of their key (None: local, without a key).
ENDPOINTS = {
    "openrouter": ("https://openrouter.ai/api/v1", "OPENROUTER_API_KEY"),
    "openai": ("https://api.openai.com/v1", "OPENAI_API_KEY"),
    "gemini": ("https://generativelanguage.googleapis.com/v1beta/openai/", "GEMINI_API_KEY"),
    "ollama": ("http://localhost:11434/v1", None),
    "lmstudio": ("http://localhost:1234/v1", None),
}


def provider_of(model: str, default: str = "openrouter") -> tuple[str, str]:
    """(provider, model): a known provider before the first colon, else the default and the whole text."""
    prefix, colon, rest = model.partition(":")
    return (prefix.lower(), rest) if colon and prefix.lower() in ENDPOINTS else (default.lower(), model)


def endpoint(model: str, environment: Mapping[str, str], overrides: Mapping[str, str] | None = None, default: str = "openrouter") -> dict[str, str]:
    """model, url and key for a model name; overrides: urls by provider, in any case. An unknown provider or a missing key is a ValueError."""
    provider, name = provider_of(model, default)
    if provider not in ENDPOINTS:
        raise ValueError(f"{provider} is not one of {', '.join(ENDPOINTS)}")
    url, variable = ENDPOINTS[provider]
    key = environment.get(variable, "") if variable else "not-needed"
    if not key:
        raise ValueError(f"{provider} needs a key in {variable}")
    return {"model": name, "url": {k.lower(): v for k, v in (overrides or {}).items()}.get(provider, url), "key": key}


def missing_keys(models: list[str], environment: Mapping[str, str], default: str = "openrouter") -> dict[str, str]:
    """The variables that are not set, by provider, of the providers that the models need; the model "local" needs none."""
    needed = {provider_of(m, default)[0] for m in models if m != "local"}
    return {p: ENDPOINTS[p][1] for p in sorted(needed) if p in ENDPOINTS and ENDPOINTS[p][1] and not environment.get(ENDPOINTS[p][1])}


def sweep(base: Settings, axes: dict[str, list]) -> list[Settings]:
    """Settings for every combination of the axes' values."""
    return [base.with_values(**dict(zip(axes, values))) for values in itertools.product(*axes.values())]


def run_table(spark: SparkSession, runs: dict[str, Settings]) -> DataFrame:
    """run_id, config (JSON), a row for each run."""
    return spark.createDataFrame([(k, v.to_json()) for k, v in runs.items()], "run_id string, config string")
