"""The tables of the test data as postings: documents as postings with labels as their status, pages as URLs and HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.urls import posting_id

BASE_TIME = "2026-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _by_language(**places: str) -> Column:
    out = None
    for k, v in places.items():
        out = F.when(F.col("lang") == k, v) if out is None else out.when(F.col("lang") == k, v)
    return out


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents share a fetched_at, so that order needs its tie-break."""
    docs = table(spark, sf_dir, "documents")
    url = F.concat(F.lit("https://corpus.example.org/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"))
    return docs.select(
        "doc_id", url.alias("url"), url.alias("raw_url"), posting_id(url).alias("id"), F.substring_index("text", "\n", 1).alias("title"), F.col("source").alias("company"), "source",
        F.col("text").alias("description_raw"), F.col("text").alias("description_clean"), "lang",
        _by_language(en="Remote - US", fr="Paris, France", de="Berlin, Germany").alias("location"),
        F.coalesce(_by_language(en="remote", fr="onsite", de="onsite"), F.lit("unknown")).alias("work_mode"),
        F.array().cast("array<string>").alias("eligible_locations"),
        (F.to_timestamp(F.lit(BASE_TIME)) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.floor(F.col("doc_id") / 10).cast("decimal(18,6)"))).alias("fetched_at"),
    )


def with_status(spark: SparkSession, sf_dir: str, view: DataFrame) -> DataFrame:
    """Toxic documents are rejected, good ones shortlisted, bad ones closed, those without a label new."""
    status = F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "shortlisted").when(F.col("quality") == 0, "closed").otherwise("new")
    return view.join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left").withColumn("status", status).drop("quality", "toxic")
