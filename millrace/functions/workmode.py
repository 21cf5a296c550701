"""Where the work is done, from what a posting says and doesn't rule out."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import Fold, fold, let, python_fold, tokens

# Words that rule out what follows within the window.
NEGATORS = ("no", "not", "never", "neither", "nor", "without", "rarely", "non", "pas", "sans", "aucun", "aucune", "jamais")
NEGATION_WINDOW = 3
REMOTE_MARKERS, HYBRID_MARKERS = ("remote",), ("hybrid",)


def is_asserted(words: Column, marker: str) -> Column:
    """Whether the marker's tokens come in ``words`` at least once without a negator in the window before them."""
    own = [t for t in "".join(c if c.isascii() and c.isalnum() else " " for c in python_fold(marker)).split()]
    if not own:
        return F.lit(False)
    phrase, negators, n = F.array(*map(F.lit, own)), F.array(*map(F.lit, NEGATORS)), len(own)
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))

    def free(i: Column) -> Column:
        before = F.slice(words, F.greatest(F.lit(1), i - NEGATION_WINDOW), F.least(F.lit(NEGATION_WINDOW), i - 1))
        return (F.slice(words, i, F.lit(n)) == phrase) & ~F.arrays_overlap(before, negators)

    return F.exists(starts, free)


def infer_work_mode(
    primary: Column, secondary: Column, remote: Iterable[str] = REMOTE_MARKERS, hybrid: Iterable[str] = HYBRID_MARKERS, fold: Fold = fold
) -> Column:
    """remote, hybrid, onsite (a place and no arrangement) or unknown. ``primary`` comes first; remote before hybrid."""

    def said(words: Column) -> Column:
        any_of = lambda markers: reduce(lambda a, m: a | is_asserted(words, m), sorted(markers), F.lit(False))
        return F.when(any_of(remote), "remote").when(any_of(hybrid), "hybrid")

    each = [let(tokens(F.coalesce(text, F.lit("")), fold), said) for text in (primary, secondary)]
    return F.coalesce(*each, F.when(F.coalesce(primary, F.lit("")) != "", "onsite").otherwise("unknown"))
