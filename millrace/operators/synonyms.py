"""Synonym classes: which normalised forms count as one skill.

A configuration's few groups are merged on the driver; a table of pairs, however large, by rounds of joins.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.components import components
from millrace.functions.text import python_normalize
from millrace.joins import join_groups
from millrace.scratch import stage


class Synonyms:
    """Groups that share a term are one class, in whatever order they come."""

    def __init__(self, groups: Iterable[Iterable[str]] = ()):
        classes: list[set[str]] = []
        for group in groups:
            own = {t for t in map(python_normalize, group) if t}
            if own:
                touched = [c for c in classes if c & own]
                classes = [c for c in classes if not c & own] + [own.union(*touched)]
        self.classes = {t: frozenset(c) for c in classes for t in c}

    def forms(self, skill: str) -> frozenset[str]:
        """All forms that are an occurrence of ``skill``; none if nothing is left of it when normalised."""
        own = python_normalize(skill)
        return self.classes.get(own, frozenset()) | {own} if own else frozenset()


def synonym_classes(pairs: DataFrame) -> DataFrame:
    """(term, class) of a table of pairs (left, right): the class is the smallest term that pairs reach. Rounds of large-star
    and small-star go on until nothing changes; every round is written into the shared folder. A null is no term.

    Terms are numbered, so that the rounds compare and shuffle numbers instead of text."""
    known = stage(pairs.select("left", "right"), "pairs")
    terms = known.select(F.col("left").alias("term")).unionByName(known.select(F.col("right").alias("term"))).dropna().distinct()
    terms = stage(terms.withColumn("node", F.monotonically_increasing_id()), "terms")
    number = lambda side, as_: terms.select(F.col("term").alias(side), F.col("node").alias(as_))
    edges = known.dropna().join(number("left", "a"), "left").join(number("right", "b"), "right").select("a", "b")
    rooted = stage(terms.join(components(edges), "node", "left").select("term", F.coalesce("root", "node").alias("root")), "rooted")
    # One component may have most of the terms: its smallest is found on the map side, and joined to where they are.
    least = stage(rooted.groupBy("root").agg(F.min("term").alias("class"), F.count(F.lit(1)).alias("held")), "least")
    return join_groups(rooted, least, ["root"], "held", rooted.count()).select("term", "class")
