"""Configuration: a JSON file, environment and options. Options win over the file, the file over the environment."""

from __future__ import annotations

import json
import os
import warnings
from dataclasses import dataclass, field

PLACES = ("config.json", "lexigraph.config.json")
KEYS = ("provider", "apiKey", "model", "apiUrl")
PROVIDERS = {"embedding": ("local", "hashing", "openai", "remote"), "reranking": ("none", "local", "cohere", "jina", "remote")}


class ConfigError(ValueError):
    pass


@dataclass
class Config:
    embedding: dict[str, str] = field(default_factory=dict)
    reranking: dict[str, str] = field(default_factory=dict)


def validate(raw: object) -> Config:
    if not isinstance(raw, dict):
        raise ConfigError("the configuration must be an object")
    out = Config()
    for part, names in PROVIDERS.items():
        own = raw.get(part)
        if own is None:
            continue
        if not isinstance(own, dict):
            raise ConfigError(f"{part} must be an object")
        for key in KEYS:
            if key in own and not isinstance(own[key], str):
                raise ConfigError(f"{part}.{key} must be a string")
        if "provider" in own and own["provider"] not in names:
            raise ConfigError(f"{part}.provider must be one of {', '.join(names)}")
        if own.get("provider") in ("openai", "cohere", "jina", "remote") and not own.get("apiKey"):
            warnings.warn(f"{part}.provider {own['provider']} has no apiKey", stacklevel=2)
        setattr(out, part, {k: own[k] for k in KEYS if k in own})
    return out


def load(path: str | None = None) -> Config | None:
    """The first file that is there; None without one."""
    for p in [path] if path else PLACES:
        if os.path.isfile(p):
            with open(p, encoding="utf-8") as f:
                try:
                    return validate(json.load(f))
                except json.JSONDecodeError as x:
                    raise ConfigError(f"{p} isn't JSON: {x}") from x
    return None


def setting(part: str, key: str, option: str | None = None, config: Config | None = None, default: str | None = None) -> str | None:
    own = getattr(config, part) if config else {}
    return option or own.get(key) or os.environ.get(f"LEXIGRAPH_{part}_{key}".upper()) or default
