"""Feeds in RSS: items with title (``Company: Title``), link, pubDate, description, region.

Feeds are read from files (``path``, a folder with one file ``<feed>.xml`` a feed) or by request. A table of detail pages
(link, html), or the pages that the links lead to (``fetch_full_description``), may replace the summaries of a feed by the
whole description; where there is none, the summary stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.dates import parse_rfc822
from millrace.functions.html import container_html, strip_html
from millrace.functions.places import region_eligibility
from millrace.functions.text import company_and_title, strip
from millrace.sources.base import Source, SourceConfigError, broken_units, errors_of, register_source

MAIN_FEED = "remote-jobs"
FIELDS = ("title", "link", "pubDate", "description", "region")
#: Repeated tags come as lists, of which the first counts.
FEED = "struct<channel:struct<item:array<struct<" + ",".join(f"{f}:array<string>" for f in FIELDS) + ">>>>"


def feed_url(feed: Column, main: str, category: str) -> Column:
    """The site's feed for the main name, else that of the category; ``category`` has a %s."""
    return F.when(feed == MAIN_FEED, F.lit(main)).otherwise(F.format_string(category, feed))


@register_source("rss_feed")
class RssFeed(Source):
    options = ("feeds", "max_postings_per_feed", "path", "url", "category_url", "details", "container", "fetch_full_description")

    def __init__(self, block, fetcher=None):
        super().__init__(block, fetcher)
        self.feeds = block.get("feeds", [MAIN_FEED])
        if not self.feeds:
            raise SourceConfigError(f"source {self.name}: feeds is empty")

    def bodies(self, spark: SparkSession) -> DataFrame:
        if path := self.block.get("path"):
            files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.xml)?$", 1).alias("unit"), F.col("value").alias("body"))
            return files.filter(F.col("unit").isin(*self.block["feeds"])) if self.block.get("feeds") else files
        main, category = self.block["url"], self.block.get("category_url", "")
        return self.pages(spark, {f: main if f == MAIN_FEED else category % f for f in self.feeds})

    def raw(self, spark: SparkSession) -> DataFrame:
        feeds = self.bodies(spark).withColumn("feed", F.from_xml("body", FEED))
        self.errors += broken_units(feeds.filter(F.col("feed.channel").isNull()).select("unit"), "not a feed")
        return items(feeds, self.block.get("max_postings_per_feed"))

    def normalize(self, raw: DataFrame) -> DataFrame:
        details = self.block.get("details")
        if details is None and self.block.get("fetch_full_description"):
            links = raw.filter("link <> ''").select(F.col("link").alias("unit"), F.col("link").alias("url")).distinct()
            details = self.fetched(links).filter("error IS NULL").select(F.col("url").alias("link"), F.col("body").alias("html"))
        if details is None:
            return normalize_items(raw)
        pages = details.select(F.col("link").alias("link"), container_html(F.col("html"), self.block.get("container", "listing-container")).alias("detail"))
        return normalize_items(raw, pages)


def items(feeds: DataFrame, most: int | None = None) -> DataFrame:
    """One flat row per item of (unit, feed), the first ``most`` of each feed in its order."""
    own = F.slice("feed.channel.item", 1, most) if most else F.col("feed.channel.item")
    rows = feeds.select("unit", F.posexplode(own).alias("sequence", "item"))
    return rows.select("unit", "sequence", *[strip(F.get(F.col(f"item.{f}"), F.lit(0))).alias(f) for f in FIELDS])


def normalize_items(raw: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """``details``: (link, detail), at most one row a link; where there is none the feed's summary stays."""
    rows = raw.withColumn("detail", F.lit(None).cast("string")) if details is None else raw.join(details, "link", "left")
    company, title = company_and_title(F.col("title"))
    missing = F.concat_ws(", ", *[F.when(F.coalesce(c, F.lit("")) == "", c) for c in ("title", "link")])
    kind, message = errors_of(
        [(missing != "", "KeyError", F.concat(F.lit("missing: "), missing)), (company.isNull(), "ValueError", F.concat(F.lit("not of the form Company: Title: "), F.col("title")))]
    )
    out = rows.select(
        "unit", "sequence", kind.alias("error_kind"), message.alias("error_message"), F.col("link").alias("raw_url"), title.alias("title"), company.alias("company"),
        F.coalesce("detail", "description", F.lit("")).alias("description_raw"), F.when(F.col("region") != "", F.col("region")).alias("location"),
        F.lit("remote").alias("work_mode"), parse_rfc822(F.col("pubDate")).alias("published_at"), F.current_timestamp().alias("fetched_at"),
        region_eligibility(F.col("region")).alias("eligible_locations"),
    )
    return out.withColumn("description_clean", strip_html(F.col("description_raw")))
