"""The posting record: typed and wire schemas, enums, and which wire rows can be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORK_MODES = ("remote", "hybrid", "onsite", "unknown")
STATUSES = ("new", "shortlisted", "applied", "interviewing", "rejected", "closed")

_S, _A = T.StringType(), T.ArrayType(T.StringType())
_FIELDS: list[tuple[str, T.DataType]] = [
    ("url", _S), ("id", _S), ("raw_url", _S), ("title", _S), ("company", _S), ("source", _S), ("description_raw", _S), ("description_clean", _S),
    ("location", _S), ("work_mode", _S), ("contract_type", _S), ("salary_text", _S), ("published_at", T.TimestampType()), ("fetched_at", T.TimestampType()),
    ("detected_language", _S), ("eligible_locations", _A), ("score", T.IntegerType()), ("summary", _S), ("matched_skills", _A), ("unmatched_profile_skills", _A),
    ("missing_requirements", _A), ("penalized_skills", _A), ("location_match", T.BooleanType()), ("work_mode_match", T.BooleanType()), ("status", _S), ("applied_at", T.TimestampType()),
]
POSTING_SCHEMA = T.StructType([T.StructField(n, t) for n, t in _FIELDS])
COLUMNS = POSTING_SCHEMA.names
LISTS = [n for n, t in _FIELDS if t is _A]
TIMES = [n for n, t in _FIELDS if isinstance(t, T.TimestampType)]
FLAGS = [n for n, t in _FIELDS if isinstance(t, T.BooleanType)]
SCORE_COLUMNS = ["score", "summary", "matched_skills", "unmatched_profile_skills", "missing_requirements", "penalized_skills", "location_match", "work_mode_match"]
#: Lists that a table of an older version may lack, so that null stands for an empty one.
LATER_LISTS = ("missing_requirements", "penalized_skills")
#: The text form: lists as JSON, times as ISO 8601 with an offset, flags as 1, 0 or null.
WIRE_SCHEMA = T.StructType([T.StructField(n, T.IntegerType() if n == "score" or n in FLAGS else _S) for n, _ in _FIELDS])

_ISO = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})$"


def iso_time(at: Column) -> Column:
    """ISO 8601 in UTC; microseconds only where there are some."""
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(at, "SSSSSS")
    return F.concat(whole, F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.lit("+00:00"))


def encode(df: DataFrame) -> DataFrame:
    """Typed rows in wire form."""
    return df.select(
        *[
            (F.to_json(F.coalesce(n, F.array())) if n in LISTS else iso_time(F.col(n)) if n in TIMES else F.col(n).cast("int") if n in FLAGS else F.col(n)).alias(n)
            for n in COLUMNS
        ]
    )


def _list(name: str) -> Column:
    parsed = F.from_json(name, "array<string>")
    return F.when(F.col(name).isNull() | (F.col(name) == ""), F.array().cast("array<string>")).otherwise(parsed) if name in LATER_LISTS else parsed


def _time(name: str) -> Column:
    return F.when(F.col(name).rlike(_ISO), F.try_to_timestamp(F.col(name)))


def not_blank(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?U)\S"), F.lit(False))


def readable() -> Column:
    """Whether a wire row still is a valid posting; never null."""
    checks = [
        F.col("url").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"),
        *[not_blank(F.col(n)) for n in ("title", "company", "source")],
        F.col("work_mode").isin(*WORK_MODES),
        F.col("status").isin(*STATUSES),
        _time("fetched_at").isNotNull(),
        *[F.col(n).isNull() | _time(n).isNotNull() for n in ("published_at", "applied_at")],
        *[_list(n).isNotNull() for n in LISTS],
        F.col("score").isNull() | F.col("score").between(0, 100),
    ]
    every = F.lit(True)
    for c in checks:
        every = every & F.coalesce(c, F.lit(False))
    return every


def decode(wire: DataFrame) -> DataFrame:
    """The readable rows in typed form; count the others with ``unreadable``."""
    cast = {n: _list(n) for n in LISTS} | {n: _time(n) for n in TIMES} | {n: F.col(n) == 1 for n in FLAGS}
    return wire.filter(readable()).select(*[cast.get(n, F.col(n)).alias(n) for n in COLUMNS])


def unreadable(wire: DataFrame) -> DataFrame:
    """One row with the number of rows that decode leaves out."""
    return wire.agg(F.count_if(~readable()).alias("unreadable"))
