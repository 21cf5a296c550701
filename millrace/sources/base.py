"""The contract of a source, and what all sources share: registry, item isolation, statistics, HTTP policy.

A source is a class with ``raw(spark)``, a DataFrame of items with ``unit`` and ``sequence``, and ``normalize(raw)``, which
adds the posting's columns and, for an item that can't be one, ``error_kind`` and ``error_message``. Units that can't be
read at all go to ``errors``. Nothing that one item or unit does costs the others.
"""

from __future__ import annotations

import time
from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import schema
from millrace.functions.language import detect_language
from millrace.functions.urls import normalize_url, posting_id
from millrace.operators.scoring import content
from millrace.scratch import stage
from millrace.sources.http import fetch_pages, http_get


class SourceError(RuntimeError):
    """A source that can't go on."""


class SourceConfigError(SourceError):
    """What only a change of configuration mends."""


class SourceUnavailableError(SourceError):
    """What may be gone the next time."""


# Answers worth another attempt.
RETRYABLE = (429, 500, 502, 503, 504)


@dataclass(frozen=True)
class HttpPolicy:
    timeout: float = 10.0
    max_retries: int = 3
    backoff_base: float = 1.0
    min_request_interval: float = 0.0

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if isinstance(value, bool) or not isinstance(value, (int, float)) or value < 0 or (f.name == "timeout" and value == 0):
                raise SourceConfigError(f"{f.name} can't be {value!r}")

    @classmethod
    def of(cls, name: str, block: dict[str, Any]) -> HttpPolicy:
        """From a source's block; its other options are not looked at."""
        try:
            return cls(**{f.name: block[f.name] for f in fields(cls) if f.name in block})
        except SourceConfigError as e:
            raise SourceConfigError(f"source {name}: {e}") from e


#: (url) -> (status, body); raises OSError where there is no answer.
Transport = Callable[[str, float], tuple[int, str]]


@dataclass
class Fetcher:
    """Requests in an even pace, with retries that wait twice as long each time. The transport and clock are passed in."""

    transport: Transport
    policy: HttpPolicy = field(default_factory=HttpPolicy)
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic
    last: float | None = None

    def get(self, url: str) -> str:
        if self.last is not None and (wait := self.last + self.policy.min_request_interval - self.clock()) > 0:
            self.sleep(wait)
        self.last = self.clock()
        said = ""
        for attempt in range(self.policy.max_retries + 1):
            if attempt:
                self.sleep(self.policy.backoff_base * 2 ** (attempt - 1))
            try:
                status, body = self.transport(url, self.policy.timeout)
            except OSError as e:
                said = str(e)
                continue
            if 200 <= status < 300:
                return body
            if status not in RETRYABLE:
                raise SourceConfigError(f"{url} answered {status}")
            said = f"status {status}"
        raise SourceUnavailableError(f"{url} is unavailable after {self.policy.max_retries + 1} attempts: {said}")


class Source(ABC):
    name = ""
    options: tuple[str, ...] = ()

    def __init__(self, block: dict[str, Any], fetcher: Fetcher | None = None):
        known = {"enabled", *self.options, *(f.name for f in fields(HttpPolicy))}
        if unknown := sorted(set(block) - known):
            raise SourceConfigError(f"source {self.name}: unknown option {', '.join(unknown)}")
        self.block, self.policy, self.fetcher = block, HttpPolicy.of(self.name, block), fetcher
        self.errors: list[str] = []

    @abstractmethod
    def raw(self, spark: SparkSession) -> DataFrame: ...

    @abstractmethod
    def normalize(self, raw: DataFrame) -> DataFrame: ...

    def fetch(self, spark: SparkSession) -> DataFrame:
        """Every item: a posting in the columns of the schema, or its error in error_kind and error_message."""
        self.errors = []
        return finish(self.normalize(self.raw(spark)), self.name)

    def pages(self, spark: SparkSession, urls: dict[str, str]) -> DataFrame:
        """(unit, body) of each unit's page; a unit without one goes to ``errors``. Tasks fetch them, each host at the policy's
        pace; a fetcher that was passed in, which may hold anything, is asked here, unit by unit."""
        if self.fetcher is not None:
            out = {}
            for unit, url in urls.items():
                try:
                    out[unit] = self.fetcher.get(url)
                except SourceError as e:
                    self.errors.append(f"{unit}: {e}")
            return spark.createDataFrame(list(out.items()), "unit string, body string")
        found = self.fetched(spark.createDataFrame(list(urls.items()), "unit string, url string"))
        self.errors += broken_units(found.filter("error IS NOT NULL").select("unit", "error"), F.col("error"))
        return found.filter("error IS NULL").select("unit", "body")

    def fetched(self, urls: DataFrame) -> DataFrame:
        """fetch_pages by this source's policy, written: each url is asked once."""
        policy = self.policy
        return stage(fetch_pages(urls, lambda: Fetcher(http_get, policy)), "fetched")


def finish(items: DataFrame, source: str) -> DataFrame:
    """Key, checks, language and defaults of normalised items (``raw_url``, or ``url`` where that is not given, and the fields
    that the source has)."""
    given = [F.col(c) for c in ("raw_url", "url") if c in items.columns]
    items = items.withColumn("raw_url", F.coalesce(*given))
    have = set(items.columns)
    with_defaults = items.withColumns({n: F.lit(None).cast(schema.POSTING_SCHEMA[n].dataType) for n in schema.COLUMNS if n not in have})
    url = normalize_url(F.col("raw_url"))
    blank = ~schema.not_blank(F.col("title")) | ~schema.not_blank(F.col("company"))
    kind = F.coalesce("error_kind", F.when(url.isNull(), "ValueError").when(blank, "ValidationError"))
    message = F.coalesce("error_message", F.when(url.isNull(), F.concat(F.lit("not an absolute URL: "), F.coalesce("raw_url", F.lit("")))).when(blank, "a blank title or company"))
    empty = F.array().cast("array<string>")
    done = with_defaults.withColumns({"error_kind": kind, "error_message": message, "url": url, "id": posting_id(url), "source": F.lit(source)})
    done = done.withColumns({n: F.coalesce(n, empty) for n in schema.LISTS} | {"status": F.coalesce("status", F.lit("new")), "work_mode": F.coalesce("work_mode", F.lit("unknown")), "description_raw": F.coalesce("description_raw", F.lit(""))})
    done = done.withColumn("detected_language", detect_language(F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce(content(), F.lit("")))))
    return done.select("unit", "sequence", *schema.COLUMNS, "error_kind", "error_message")


#: Units that a source names in its errors; of more only the number is told.
NAMED = 20


def broken_units(units: DataFrame, said: str | Column) -> list[str]:
    """An error for each of the first NAMED of ``units`` (unit, and what ``said`` is made of), and one for all others."""
    many = units.count()
    text = F.lit(said) if isinstance(said, str) else said
    named = [f"{r['unit']}: {r['said']}" for r in units.select("unit", text.alias("said")).orderBy("unit", "said").limit(NAMED).collect()] if many else []
    return named + ([f"{many - NAMED} more units" + (f": {said}" if isinstance(said, str) else "")] if many > NAMED else [])


def errors_of(checks: list[tuple[Column, str, str | Column]]) -> tuple[Column, Column]:
    """error_kind and error_message of the first check that holds."""
    kind = message = None
    for bad, name, text in checks:
        said = F.lit(text) if isinstance(text, str) else text
        kind = F.when(bad, name) if kind is None else kind.when(bad, name)
        message = F.when(bad, said) if message is None else message.when(bad, said)
    return kind, message


# -- registry ----------------------------------------------------------------------------------------------------------

_REGISTERED: dict[str, type[Source]] = {}


def register_source(name: str) -> Callable[[type[Source]], type[Source]]:
    def add(kind: type[Source]) -> type[Source]:
        if name in _REGISTERED:
            raise ValueError(f"there already is a source {name!r}")
        kind.name = name
        _REGISTERED[name] = kind
        return kind

    return add


def source_class(name: str) -> type[Source] | None:
    return _REGISTERED.get(name)


def source_names() -> list[str]:
    return sorted(_REGISTERED)
