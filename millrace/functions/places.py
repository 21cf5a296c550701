"""Who may apply from where, and whether that fits."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import Fold, contains_phrase, fold, joined_tokens, python_fold, strip

# Phrases that state a restriction, and regions that state none.
REMOTE_PLACE = r"(?i)^remote\s*[-–—:]\s*(.+)"
RESTRICTIONS = (
    r"(?i)only candidates (?:based |located )?in ([A-Za-z ,]+)",
    r"(?i)must be (?:based|located) in ([A-Za-z ,]+)",
    r"(?i)open to candidates in ([A-Za-z ,]+)",
)
UNRESTRICTED = ("anywhere in the world", "anywhere", "worldwide")


def eligible_locations(location: Column, description: Column) -> Column:
    """The place after ``Remote -`` and those of the restrictions stated in the text, each once, in order."""
    tail = F.regexp_replace(F.regexp_extract(strip(location), REMOTE_PLACE, 1), r"^[ \-–—()]+|[ \-–—()]+$", "")
    found = [F.transform(F.regexp_extract_all(description, F.lit(p), F.lit(1)), lambda x: strip(F.regexp_replace(strip(x), r"\.+$", ""))) for p in RESTRICTIONS]
    empty = F.array().cast("array<string>")
    every = F.concat(F.array(F.coalesce(tail, F.lit(""))), *[F.coalesce(x, empty) for x in found])
    return F.array_distinct(F.filter(every, lambda x: x != ""))


def region_eligibility(region: Column) -> Column:
    own, empty = strip(region), F.array().cast("array<string>")
    none = region.isNull() | (region == "") | F.lower(own).isin(*UNRESTRICTED)
    return F.when(none, empty).otherwise(F.array(own))


def location_match(location: Column, eligible: Column, wanted: Iterable[str], fold: Fold = fold) -> Column:
    """Whether a wanted place and one of the posting's contain one another as whole tokens; null if either side has none."""
    wanted = list(wanted)
    if not wanted:
        return F.lit(None).cast("boolean")
    places = F.filter(F.concat(F.array(F.coalesce(location, F.lit(""))), F.coalesce(eligible, F.array().cast("array<string>"))), lambda x: x.isNotNull() & (x != ""))
    # A place that folds to no tokens is still a place; it matches nothing.
    mine = [" " + " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in python_fold(w)).split()) + " " for w in wanted]
    sets = F.transform(places, lambda x: joined_tokens(x, fold))

    def fits(place: Column) -> Column:
        hit = F.lit(False)
        for w in mine:
            hit = hit | contains_phrase(place, F.lit(w)) | contains_phrase(F.lit(w), place)
        return hit

    return F.when(F.size(places) > 0, F.exists(sets, fits))


def work_mode_match(work_mode: Column, wanted: str) -> Column:
    return F.lit(None).cast("boolean") if wanted == "unknown" else F.when(work_mode != "unknown", work_mode == wanted)
