"""Configuration: defaults, a JSON file with comments, and the environment."""

from __future__ import annotations

import json
import os
import re
import warnings
from dataclasses import dataclass, field

_COMMENT = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/', re.S)
_COMMA = re.compile(r'"(?:\\.|[^"\\])*"|,(?=\s*[}\]])', re.S)


def strip_comments(text: str) -> str:
    """JSON without // and /* */ comments and trailing commas; strings are left alone."""
    keep = lambda m: m[0] if m[0][0] == '"' else ""
    return _COMMA.sub(keep, _COMMENT.sub(keep, text))


def _whole(name: str, value, least: int, warn_over: int | None = None) -> None:
    if isinstance(value, bool) or not isinstance(value, int) or value < least:
        raise ValueError(f"{name} must be a whole number of at least {least}")
    if warn_over and value > warn_over:
        warnings.warn(f"{name} is over {warn_over}", stacklevel=3)


@dataclass(frozen=True)
class Crawler:
    default_max_depth: int = 3
    default_rate_limit: int = 2
    page_timeout: int = 30_000
    user_agent: str = "docquarry/1.0"

    def __post_init__(self):
        _whole("default_max_depth", self.default_max_depth, 1, 10)
        _whole("default_rate_limit", self.default_rate_limit, 1, 10)
        _whole("page_timeout", self.page_timeout, 1000)
        if not self.user_agent:
            raise ValueError("user_agent must not be empty")


@dataclass(frozen=True)
class Cheatsheet:
    max_length: int = 10_000
    filename_suffix: str = "-Cheatsheet.md"

    def __post_init__(self):
        _whole("max_length", self.max_length, 1000)
        if not self.filename_suffix:
            raise ValueError("filename_suffix must not be empty")


@dataclass(frozen=True)
class Config:
    docs_base_path: str = "docs"
    crawler: Crawler = field(default_factory=Crawler)
    cheatsheet: Cheatsheet = field(default_factory=Cheatsheet)

    def __post_init__(self):
        if not isinstance(self.docs_base_path, str) or not self.docs_base_path:
            raise ValueError("docs_base_path must be a non-empty string")


def _snake(d: dict) -> dict:
    return {re.sub(r"(?<!^)([A-Z])", lambda m: "_" + m[1].lower(), k): v for k, v in d.items()}


_cache: dict[str, Config] = {}


def load_config(path: str = "config.json") -> Config:
    """The file over the defaults, section by section; DOCS_BASE_PATH over both."""
    if path in _cache:
        return _cache[path]
    found: dict = {}
    if os.path.exists(path):
        text = open(path, encoding="utf-8").read()
        try:
            found = _snake(json.loads(text))
        except json.JSONDecodeError:
            found = _snake(json.loads(strip_comments(text)))
    base = os.environ.get("DOCS_BASE_PATH") or found.get("docs_base_path") or Config.docs_base_path
    _cache[path] = Config(base, Crawler(**_snake(found.get("crawler", {}))), Cheatsheet(**_snake(found.get("cheatsheet", {}))))
    return _cache[path]


def clear_config_cache() -> None:
    _cache.clear()
