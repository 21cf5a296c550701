"""Boards that answer with JSON: {"jobs": [{absolute_url, title, updated_at, location: {name}, content}, ...]}.

Boards are read from files (``path``, a folder that Spark reads with one file ``<company>.json`` a board, or with
``lines: true`` one board a line, which has its ``company``, as thousands of small files take longer to open than to read) or by request. ``content`` is HTML that is escaped once more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.dates import parse_iso
from millrace.functions.html import strip_html, unescape
from millrace.functions.places import eligible_locations
from millrace.functions.text import humanize_slug, strip
from millrace.functions.workmode import infer_work_mode
from millrace.sources.base import Source, SourceConfigError, broken_units, errors_of, register_source

BOARD = "struct<jobs:array<struct<absolute_url:string,title:string,updated_at:string,location:struct<name:string>,content:string>>>"


@register_source("json_board")
class JsonBoard(Source):
    options = ("companies", "max_postings_per_company", "path", "url", "lines")

    def __init__(self, block, fetcher=None):
        super().__init__(block, fetcher)
        if not block.get("companies") and not block.get("path"):
            raise SourceConfigError(f"source {self.name}: companies is missing")
        if (most := block.get("max_postings_per_company")) is not None and most < 1:
            raise SourceConfigError(f"source {self.name}: max_postings_per_company must be 1 or more")

    def bodies(self, spark: SparkSession) -> DataFrame:
        """(unit, body)"""
        if path := self.block.get("path"):
            lines, name = bool(self.block.get("lines")), F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.json)?$", 1)
            own = F.coalesce(F.from_json("value", "company string")["company"], name) if lines else name
            files = spark.read.text(path, wholetext=not lines).select(own.alias("unit"), F.col("value").alias("body"))
            wanted = self.block.get("companies")
            return files.filter(F.col("unit").isin(*wanted)) if wanted else files
        return self.pages(spark, {c: self.block["url"].format(company=c) for c in self.block["companies"]})

    def raw(self, spark: SparkSession) -> DataFrame:
        boards = self.bodies(spark).withColumn("board", F.from_json("body", BOARD))
        # A board that is no such object is an error of that unit.
        self.errors += broken_units(boards.filter(F.col("board.jobs").isNull()).select("unit"), "the answer is not an object with a list of jobs")
        return jobs(boards, self.block.get("max_postings_per_company"))

    def normalize(self, raw: DataFrame) -> DataFrame:
        return normalize_jobs(raw)


def jobs(boards: DataFrame, most: int | None = None) -> DataFrame:
    """One row per job of (unit, board), the first ``most`` of each board in its order."""
    own = F.slice("board.jobs", 1, most) if most else F.col("board.jobs")
    return boards.select("unit", F.posexplode(own).alias("sequence", "job"))


def normalize_jobs(raw: DataFrame) -> DataFrame:
    missing = F.concat_ws(", ", *[F.when(F.col(f"job.{c}").isNull(), c) for c in ("absolute_url", "title")])
    kind, message = errors_of([(F.col("job").isNull() | (missing != ""), "KeyError", F.concat(F.lit("missing: "), missing))])
    place = strip(F.col("job.location.name"))
    items = raw.select(
        "unit", "sequence", kind.alias("error_kind"), message.alias("error_message"),
        F.col("job.absolute_url").alias("raw_url"), strip(F.col("job.title")).alias("title"), humanize_slug(F.col("unit")).alias("company"),
        unescape(F.coalesce("job.content", F.lit(""))).alias("description_raw"), F.when(place != "", place).alias("location"),
        parse_iso(F.col("job.updated_at")).alias("published_at"), F.current_timestamp().alias("fetched_at"),
    )
    items = items.withColumn("description_clean", strip_html(F.col("description_raw")))
    return items.withColumns(
        {"work_mode": infer_work_mode(F.col("location"), F.col("description_clean")), "eligible_locations": eligible_locations(F.col("location"), F.col("description_clean"))}
    )
