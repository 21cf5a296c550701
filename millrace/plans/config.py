"""Configuration: YAML to checked values, with a hint where a key looks misspelt."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from millrace.operators.scoring import Profile
from millrace.schema import WORK_MODES


class ConfigError(ValueError):
    """What is wrong with a configuration, in words for whoever wrote it."""


@dataclass(frozen=True)
class Search:
    title_keywords_include: tuple[str, ...] = ()
    title_keywords_exclude: tuple[str, ...] = ()
    languages: tuple[str, ...] = ("en",)


@dataclass(frozen=True)
class Config:
    profile: Profile
    search: Search = Search()
    sources: Mapping[str, dict[str, Any]] = field(default_factory=dict)
    storage: Mapping[str, Any] = field(default_factory=dict)
    scoring: Mapping[str, Any] = field(default_factory=dict)
    exporters: Mapping[str, dict[str, Any]] = field(default_factory=dict)


EXAMPLE = """\
profile:
  role: Data engineer
  skills: [Python, Spark, SQL]
  absent_skills: [PHP]
  locations: [France, EU]
  work_mode: remote
search:
  title_keywords_include: []
  title_keywords_exclude: [intern]
  languages: [en]
sources:
  json_board: {enabled: true, path: ./boards, companies: [some-company]}
  rss_feed: {enabled: true, path: ./feeds}
storage: {backend: parquet, path: ./postings}
scoring: {backend: keyword, synonyms: [[k8s, kubernetes]], absent_skill_penalty: 0.34, absent_skill_penalty_cap: 1.0}
exporters:
  markdown: {enabled: true, output_path: ./out/postings.md}
  csv: {enabled: false, output_path: ./out/postings.csv}
"""

_TEXTS = lambda v: isinstance(v, list) and all(isinstance(x, str) for x in v)
_TEXT = lambda v: isinstance(v, str)
_BLOCK = lambda v: isinstance(v, dict)
_BLOCKS = lambda v: isinstance(v, dict) and all(isinstance(x, dict) for x in v.values())
_KEYS: dict[str, dict[str, tuple[Callable[[Any], bool], str]]] = {
    "": {k: (_BLOCK if k in ("profile", "search", "storage", "scoring") else _BLOCKS, "a mapping") for k in ("profile", "search", "sources", "storage", "scoring", "exporters")},
    "profile": {
        "role": (_TEXT, "a text"), "skills": (_TEXTS, "a list of texts"), "absent_skills": (_TEXTS, "a list of texts"), "locations": (_TEXTS, "a list of texts"),
        "work_mode": (lambda v: v in WORK_MODES, f"one of {', '.join(WORK_MODES)}"),
        "experience_years": (lambda v: v is None or isinstance(v, int) and v >= 0, "a number from 0"),
    },
    "search": {k: (_TEXTS, "a list of texts") for k in ("title_keywords_include", "title_keywords_exclude", "languages")},
}


def _checked(where: str, block: dict) -> dict:
    problems, known = [], _KEYS[where]
    for key, value in block.items():
        at = f"{where}.{key}" if where else str(key)
        if key not in known:
            near = difflib.get_close_matches(str(key), known, 1)
            problems.append(f"{at}: unknown key" + (f"; did you mean {near[0]!r}?" if near else ""))
        elif not known[key][0](value):
            problems.append(f"{at}: must be {known[key][1]}")
    if problems:
        raise ConfigError("\n".join(problems))
    return {k: tuple(v) if isinstance(v, list) else v for k, v in block.items()}


def parse_config(raw: Any) -> Config:
    if not isinstance(raw, dict):
        raise ConfigError("the configuration must be a mapping")
    top = _checked("", {k: v for k, v in raw.items() if v is not None})
    profile = _checked("profile", top.get("profile", {}))
    if not profile.get("role"):
        raise ConfigError("profile.role: is required")
    return Config(Profile(**profile), Search(**_checked("search", top.get("search", {}))), *(top.get(k, {}) for k in ("sources", "storage", "scoring", "exporters")))


def load_config(path: str | Path | None = None) -> Config:
    """From ``path``, or config.yaml of the working folder; nothing else is tried."""
    import yaml

    at = Path(path or "config.yaml")
    try:
        raw = yaml.safe_load(at.read_text(encoding="utf-8"))
    except OSError as e:
        raise ConfigError(f"no configuration at {at}: {e.strerror}") from e
    except yaml.YAMLError as e:
        raise ConfigError(f"{at} is not YAML: {e}") from e
    return parse_config(raw)
