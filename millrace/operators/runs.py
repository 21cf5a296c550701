"""Counting and limiting what a run does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.joins import fresh


def first_of_key(df: DataFrame, key: str, sequence: str) -> DataFrame:
    """Of rows with one key the first in sequence: an aggregate with a map-side combine, so a key of many rows is no hot task."""
    columns = F.struct(F.col(sequence), *[c for c in df.columns if c != sequence])
    return df.groupBy(F.col(key).alias("__key")).agg(F.min_by(columns, F.col(sequence)).alias("__row")).select("__row.*").select(*df.columns)


def insert_if_absent(stored: DataFrame, batch: DataFrame, sequence: str) -> DataFrame:
    """The rows of ``batch`` to append: the first of each url, and of each id, that is in ``stored`` neither by url nor by id."""
    first = first_of_key(first_of_key(batch, "url", sequence), "id", sequence)
    return first.join(stored.select("url"), "url", "left_anti").join(stored.select("id"), "id", "left_anti").select(*batch.columns)


def limit_kept(items: DataFrame, unit: str, sequence: str, kept: Column, limit: int) -> DataFrame:
    """Of each unit the items up to and with its ``limit``-th kept one, as reading stops there.

    Each task sends at most ``limit`` kept items of a unit on (the rank is filtered, so it is a group limit), whatever
    share of all items the unit has; the sequence at which it ends is then joined to the items, one row a unit.
    """
    place = F.row_number().over(Window.partitionBy(unit).orderBy(sequence))
    first = items.filter(kept).select(unit, sequence).withColumn("__place", place).filter(F.col("__place") <= limit)
    ends = first.groupBy(F.col(unit).alias("__unit")).agg(F.count(F.lit(1)).alias("__kept"), F.max(sequence).alias("__end"))
    joined = items.join(ends, items[unit] == ends["__unit"], "left")
    going_on = F.coalesce(F.col("__kept"), F.lit(0)) < limit
    return joined.filter(going_on | (items[sequence] <= F.col("__end"))).select(*[items[c] for c in items.columns])


def fetch_counters(items: DataFrame) -> DataFrame:
    """By source from (source, error_kind, kept, stored): yielded, skipped, kept, filtered_out, stored, duplicates."""
    good = F.col("error_kind").isNull()
    counted = items.groupBy("source").agg(
        F.count_if(good).alias("yielded"),
        F.count_if(~good).alias("skipped"),
        F.count_if(good & F.col("kept")).alias("kept"),
        F.count_if(good & F.col("kept") & F.col("stored")).alias("stored"),
    )
    return counted.withColumns({"filtered_out": F.col("yielded") - F.col("kept"), "duplicates": F.col("kept") - F.col("stored")})


def error_tallies(items: DataFrame, sequence: str) -> DataFrame:
    """By source and kind of error: how many, and the first message."""
    bad = items.filter(F.col("error_kind").isNotNull())
    return bad.groupBy("source", "error_kind").agg(F.count(F.lit(1)).alias("count"), F.min_by("error_message", sequence).alias("first_message"))


def failed(yielded: Column, errors: Column) -> Column:
    """A source has failed if it has errors and yielded nothing."""
    return (yielded == 0) & (errors > 0)


def within_budget(df: DataFrame, order: list[Column], cost: Column, budget: int, key: str, unit: str | None = None) -> DataFrame:
    """``df`` with, of each row, whether it still is in budget (``scored``), the first that isn't (``stopped``), or untouched
    (``pending``), and what had been spent before it (null where it is untouched). Each unit, or all without one, has the
    budget; every row costs at least 1; ``key`` is unique.

    So no row after the first ``budget + 1`` of a unit is ever tried, and only these are ranked: the rank is filtered, so
    each task sends no more of a unit on, whatever share of all rows the unit has.
    """
    names = dict(zip(("cost", "place", "spent", "fits", "known"), fresh([*df.columns, "outcome", "spent_before"], "cost", "place", "spent", "fits", "known"), strict=True))
    priced = df.withColumn(names["cost"], F.greatest(cost, F.lit(1)))
    if unit is None:
        first = priced.orderBy(*order).limit(budget + 1)
        window = Window.partitionBy(F.lit(0)).orderBy(*order)  # budget + 1 rows
    else:
        window = Window.partitionBy(unit).orderBy(*order)
        first = priced.withColumn(names["place"], F.row_number().over(window)).filter(F.col(names["place"]) <= budget + 1)
    until = window.rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(names["cost"]).over(until), F.lit(0))
    tried = first.withColumn(names["spent"], spent).withColumn(names["fits"], F.col(names["spent"]) + F.col(names["cost"]) <= budget)
    # Once a row does not fit, none after it is tried.
    clear = F.coalesce(F.min(F.col(names["fits"]).cast("int")).over(until), F.lit(1)) == 1
    tried = tried.withColumn(names["place"], clear).filter(names["place"])
    state = tried.select(F.col(key).alias(names["known"]), F.when(F.col(names["fits"]), "scored").otherwise("stopped").alias("outcome"), F.col(names["spent"]).alias("spent_before"))
    rest = [c for c in df.columns if c not in ("outcome", "spent_before")]
    return df.select(*rest).join(state, F.col(key) == F.col(names["known"]), "left").select(*rest, F.coalesce("outcome", F.lit("pending")).alias("outcome"), "spent_before")


def backfill_ids(postings: DataFrame, new_id: Column) -> DataFrame:
    """Fill null ids: an id already held is never given again, of several rows with one new id the smallest url gets it."""
    held = postings.filter(F.col("id").isNotNull()).select(F.col("id").alias("new_id")).distinct()
    missing = postings.filter(F.col("id").isNull()).select("url", new_id.alias("new_id")).filter(F.col("new_id").isNotNull())
    free = missing.join(held, "new_id", "left_anti").groupBy("new_id").agg(F.min("url").alias("url"))
    return postings.join(free, "url", "left").withColumn("id", F.coalesce("id", "new_id")).drop("new_id").select(*postings.columns)
