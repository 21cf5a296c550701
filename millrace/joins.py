"""Joins of rows with their groups that no hot group slows down, and names that no column has."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.scratch import few, stage

#: A group of more than 1/HOT of all rows is joined by broadcast; there are fewer than HOT of them.
HOT = 100


def fresh(names: Iterable[str], *labels: str) -> list[str]:
    """Names like ``labels`` that none of ``names`` is, in whatever case."""
    taken, out = {c.lower() for c in names}, []
    for name in labels:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def columns(names: Iterable[str]) -> list[Column]:
    """Columns by their exact names, with dots and backticks or not."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in names]


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], weight: str, total: int, how: str = "inner", share: int = HOT) -> DataFrame:
    """``rows`` joined with ``groups``, a written table with one row a key, so that no key's rows meet in one task.

    ``weight`` is the number of ``total`` rows that a group has (or at least HOT / ``share`` of it). Groups above
    total / share are, by that sum, fewer than ``share``: they are broadcast and their rows stay where they are. All other
    rows are shuffled by key. ``how``: inner or left. ``on`` are columns without nulls.
    """
    hot, cold = groups.filter(F.col(weight) * share > total), groups.filter(F.col(weight) * share <= total)
    # The hot groups are at most ``share`` rows.
    stay = rows.join(F.broadcast(hot), on)
    move = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(cold, on, how)
    return stay.unionByName(move)


def hot_keys(rows: DataFrame, on: list[str]) -> DataFrame:
    """The keys, fewer than HOT, that each have more than 1/HOT of ``rows``; written, for join_around."""
    total = rows.count()
    return stage(few(rows.groupBy(*on).count().filter(F.col("count") * HOT > total).select(*on), total), "hot")


def join_around(rows: DataFrame, groups: DataFrame, on: list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """As join_groups, for groups (one row a key) that do not know their numbers of rows; ``hot`` is what hot_keys found."""
    if hot.isEmpty():
        return rows.join(groups, on, how)
    few = F.broadcast(hot)
    stay = rows.join(few, on, "left_semi").join(F.broadcast(groups.join(few, on, "left_semi")), on, how)
    return stay.unionByName(rows.join(few, on, "left_anti").join(groups, on, how))
