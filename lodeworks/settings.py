"""Typed settings, from the session's configuration: spark.lodeworks.<name>."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

PREFIX = "spark.lodeworks."
_TRUE, _FALSE = {"true", "1", "yes", "on"}, {"false", "0", "no", "off"}


@dataclass(frozen=True)
class Settings:
    """What the flows take from outside. No secrets are among them, and none has a default that names a place."""

    store: str = ""
    zone: str = "Europe/Istanbul"
    request_delay_s: float = 0.8
    chunk_size: int = 1000
    chunk_overlap: int = 150
    chunk_least: int = 80
    embedding_dim: int = 64
    token_budget: int = 16_384
    retrieve: int = 20
    rerank: int = 3
    session_ttl_s: int = 7200
    history_most: int = 20
    similarity: float = 0.95
    cache_dynamic_ttl_s: int = 1800
    cache_static_ttl_s: int = 86_400
    grade_answers: bool = True

    def __post_init__(self):
        for f in fields(self):
            v = getattr(self, f.name)
            if f.name != "chunk_overlap" and not isinstance(v, (str, bool)) and v <= 0:
                raise ValueError(f"{PREFIX}{f.name} must be positive, not {v}")
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError(f"{PREFIX}chunk_overlap must be less than chunk_size")
        if self.similarity > 1:
            raise ValueError(f"{PREFIX}similarity must be at most 1")


def _typed(name: str, kind: str, text: str):
    try:
        if kind == "bool":
            low = text.strip().lower()
            if low not in _TRUE | _FALSE:
                raise ValueError(text)
            return low in _TRUE
        return {"int": int, "float": float, "str": str}[kind](text)
    except ValueError:
        raise ValueError(f"{PREFIX}{name} must be of type {kind}, not {text!r}") from None


def settings(spark: SparkSession) -> Settings:
    """The session's settings; an unknown name under the prefix of a setting that is misspelt isn't an error, a wrong type or value is."""
    given = {f.name: spark.conf.get(PREFIX + f.name, None) for f in fields(Settings)}
    return Settings(**{f.name: _typed(f.name, f.type, given[f.name]) for f in fields(Settings) if given[f.name] is not None})
