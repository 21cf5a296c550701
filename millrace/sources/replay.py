"""A source of postings given in its configuration, for tests and replays; it may fail after having yielded them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.base import Source, errors_of, register_source


@register_source("replay")
class Replay(Source):
    options = ("postings", "fail")

    def raw(self, spark: SparkSession) -> DataFrame:
        rows = [(k, p.get("url"), p.get("title"), p.get("company", "Company"), p.get("description"), p.get("work_mode")) for k, p in enumerate(self.block.get("postings", []))]
        if self.block.get("fail"):
            self.errors.append("the source broke off")
        return spark.createDataFrame(rows, "sequence int, raw_url string, title string, company string, description_clean string, work_mode string").withColumn("unit", F.lit("replay"))

    def normalize(self, raw: DataFrame) -> DataFrame:
        kind, message = errors_of([(F.col("raw_url").isNull(), "KeyError", "missing: url")])
        return raw.withColumns({"error_kind": kind, "error_message": message, "fetched_at": F.current_timestamp()})
