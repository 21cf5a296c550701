"""Times of feeds and boards, in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named zones of RFC 822 and their offsets.
ZONES = {"UT": "+0000", "UTC": "+0000", "GMT": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}

_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"
_BASIC = r"^(\d{4})(\d{2})(\d{2})(?:T(\d{2})(\d{2})(\d{2})(Z|[+-]\d{2}:?\d{2})?)?$"


def parse_iso(text: Column) -> Column:
    """ISO 8601, extended or basic; without an offset it is UTC (the session's zone); null where it can't be read."""
    basic = F.regexp_replace(text, _BASIC, "$1-$2-$3T$4:$5:$6$7")
    basic = F.regexp_replace(basic, "T::$", "")
    extended = F.replace(F.when(text.rlike(_BASIC), basic).when(text.rlike(_ISO), text), F.lit(","), F.lit("."))
    return F.try_to_timestamp(extended)


def parse_rfc822(text: Column) -> Column:
    """RFC 822 as feeds have it; without a zone it is UTC; null where it can't be read."""
    bare = F.trim(F.regexp_replace(text, r"^\s*[A-Za-z]{3,9},\s*", ""))
    zone = F.upper(F.regexp_extract(bare, r"([A-Za-z]{1,3})$", 1))
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv]), zone)
    body = F.trim(F.regexp_replace(bare, r"\s*[A-Za-z]{1,3}$", ""))
    whole = F.when(bare.rlike(r"[+-]\d{4}$"), bare).when(offset.isNotNull(), F.concat_ws(" ", body, offset)).when(bare.rlike(r"\d$"), F.concat(bare, F.lit(" +0000")))
    whole = F.regexp_replace(whole, r"^(\d+ \S+ \d+ \d+:\d+) ([+-])", "$1:00 $2")
    return F.try_to_timestamp(whole, F.lit("d MMM yyyy HH:mm:ss Z"))
