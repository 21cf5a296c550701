"""Scopes: which postings are read, in which order, and how a reference finds one."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import Fold, casefold
from millrace.functions.urls import normalize_url, posting_id
from millrace.joins import columns, fresh
from millrace.scratch import stage


@dataclass(frozen=True)
class Scope:
    """All of its conditions hold. A null score is in no score range; an undetermined language is in every list."""

    source: str | None = None
    status: str | None = None
    min_score: int | None = None
    max_score: int | None = None
    scored: bool | None = None
    languages: Sequence[str] = ()
    remote: bool = False

    def __post_init__(self) -> None:
        if self.scored is False and (self.min_score is not None or self.max_score is not None):
            raise ValueError("unscored postings have no score to bound")

    def condition(self) -> Column:
        score, language = F.col("score"), F.col("detected_language")
        wanted = [
            self.source is not None and (F.col("source") == self.source),
            self.status is not None and (F.col("status") == self.status),
            self.min_score is not None and (score >= self.min_score),
            self.max_score is not None and (score <= self.max_score),
            self.scored is not None and (score.isNotNull() if self.scored else score.isNull()),
            bool(self.languages) and (language.isNull() | language.isin(*self.languages)),
            self.remote and (F.col("work_mode") == "remote"),
        ]
        return reduce(lambda a, b: a & b, [w for w in wanted if w is not False], F.lit(True))

    def select(self, postings: DataFrame) -> DataFrame:
        return postings.filter(self.condition())


def resolve_languages(given: Sequence[str], configured: Sequence[str]) -> Sequence[str]:
    """Those given, or the configured ones; ``all`` among those given means no filter."""
    if not given:
        return tuple(configured)
    return () if any(g.lower() == "all" for g in given) else tuple(given)


def title_filter(title: Column, include: Sequence[str] = (), exclude: Sequence[str] = (), fold: Fold = casefold) -> Column:
    """No excluded term in the title, and one of those to include if there are some, both case-folded. An empty term is in
    every title."""
    low = fold(title)
    has = lambda t: F.contains(low, F.lit(t.casefold()))
    out = reduce(lambda a, t: a & ~has(t), exclude, F.lit(True))
    return out & reduce(lambda a, t: a | has(t), include, F.lit(False)) if include else out


# -- order -------------------------------------------------------------------------------------------------------------


def stored_order() -> list[Column]:
    """Newest first; ids make it total, so that pages neither overlap nor skip."""
    return [F.desc("fetched_at"), F.asc("id")]


def order(by: str, fold: Fold = casefold) -> list[Column]:
    folded = lambda c: fold(F.col(c))
    return {
        "score": [F.desc_nulls_last("score"), folded("title"), *stored_order()],
        "date": stored_order(),
        "company": [folded("company"), folded("title"), *stored_order()],
    }[by]


#: Pages that begin after more rows than this are cut by places instead of by the first rows in order.
DEEP = 100_000


def with_places(df: DataFrame, by: list[Column], name: str = "place") -> DataFrame:
    """``df`` with each row's place in a total order, from 1, as a column; written in that order.

    The rows are dealt by ranges of the order and numbered where they are written, once; then the sizes of the ranges, one
    row each, tell where a range begins. No task has more than a range. The ranges are cut by a pass of its own over what the
    order reads; if the rows it sees differ from those that are written (clocks, chance), the ranges are less even, and the
    places are right all the same.
    """
    number, part, before = fresh(df.columns, "number", "part", "before")
    # The id that is given to the rows of a range has the range in its upper bits and the row within it in the lower 33.
    ordered = stage(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(number, F.monotonically_increasing_id()), "ordered")
    parts = ordered.withColumn(part, F.shiftright(number, 33))
    # One row for each range.
    sizes = parts.groupBy(part).agg(F.count(F.lit(1)).alias("rows")).withColumn(before, F.coalesce(F.sum("rows").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = parts.join(F.broadcast(sizes.select(part, before)), part)
    return placed.select(*columns(df.columns), (F.col(before) + F.col(number).bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias(name))


def page(postings: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """In stored order; a page without an end, or one far down, is cut by places, so that no task has all rows."""
    if limit is not None and offset + limit <= DEEP:
        return postings.orderBy(*stored_order()).offset(offset).limit(limit)
    if not offset and limit is None:
        return postings.orderBy(*stored_order())
    (name,) = fresh(postings.columns, "place")
    placed = with_places(postings, stored_order(), name)
    wanted = placed.filter(F.col(name) > offset)
    wanted = wanted if limit is None else wanted.filter(F.col(name) <= offset + limit)
    return wanted.orderBy(name).select(*columns(postings.columns))


def top(postings: DataFrame, by: str = "score", limit: int = 50) -> DataFrame:
    """The first ``limit`` in order; all for 0."""
    out = postings.orderBy(*order(by))
    return out.limit(limit) if limit else out


# -- references --------------------------------------------------------------------------------------------------------

SHORT_ID = re.compile(r"[0-9a-f]{4,12}")


def by_url(postings: DataFrame, url: str) -> DataFrame:
    """By the id, too, where there is one, as the store's files are sorted by it. The two are values, which reach the scan."""
    own = normalize_url(F.lit(url))
    key, short = postings.sparkSession.range(1).select(own, posting_id(own)).first()
    return postings.filter((F.col("url") == F.lit(key)) & ((F.col("id") == F.lit(short)) | F.col("id").isNull()))


def by_id_prefix(postings: DataFrame, prefix: str) -> DataFrame:
    return postings.filter(F.startswith(F.col("id"), F.lit(prefix))).orderBy(*stored_order())


def matching(postings: DataFrame, ref: str) -> DataFrame:
    """What a URL or the first 4 to 12 digits of an id may refer to."""
    if "://" in ref:
        return by_url(postings, ref)
    if not SHORT_ID.fullmatch(ref.lower()):
        raise ValueError(f"{ref!r} is neither a URL nor 4 to 12 hex digits of an id")
    return by_id_prefix(postings, ref.lower())


def resolve(postings: DataFrame, ref: str) -> DataFrame:
    """The one that ``ref`` refers to; two rows mean that it is ambiguous."""
    return matching(postings, ref).limit(2)


def applied_at(status: str, now: Column, explicit: Column | None = None, clear: bool = False) -> Column:
    """Cleared, given, set at the first change to applied, or kept."""
    if clear and explicit is not None:
        raise ValueError("a date can't be both given and cleared")
    if clear:
        return F.lit(None).cast("timestamp")
    if explicit is not None:
        return explicit
    return F.coalesce(F.col("applied_at"), now) if status == "applied" else F.col("applied_at")
