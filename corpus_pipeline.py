"""From raw documents to packed training sequences: five stages, each written as Parquet and read again as the next input.

1. language ID: documents without a language (no letters, or a score below MIN_SCORE) go;
2. line dedup: lines that at least three documents share stay in the one with the largest id only;
3. SimHash near-dedup: one document of each group stays;
4. secret scans: secrets are replaced by [SECRET];
5. best-fit packing: the documents' tokens in as few sequences as can be.

Stages 1 to 4 return the columns of ``documents``. SQL can express neither the model nor the fingerprints, so there is no
SQL for the rows; tests/llm holds them against a plain version.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bin_completion, crf_langid, line_runs, secret_ledger, simhash_vptree
from millrace.llm.support import columns, fresh, stage

#: A document's language is accepted from this score on; one that is half in one language and half in another stays.
MIN_SCORE = 0.35


def _keeping(docs: DataFrame, added: tuple[str, ...], apply: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The columns of ``docs`` after ``apply``, whose own columns (``added``) take the place of none of them."""
    names = docs.columns
    aside = iter(fresh([*names, *added], *[f"{c}_aside" for c in names if c.lower() in added]))
    inner = [next(aside) if c.lower() in added else c for c in names]
    return apply(docs.toDF(*inner)).select(*columns(inner)).toDF(*names)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` less those without a language.

    Defined cases: a null or empty text, or one without letters, goes; if no row has a label, all go; a text of any length
    is read whole; ties and repeated rows go or stay together; an empty table stays empty; columns pass through unchanged,
    whatever their names.
    """

    def accepted(rows: DataFrame) -> DataFrame:
        found = crf_langid.predict(rows, crf_langid.train(rows))
        return found.filter((F.col("lang_pred") != crf_langid.UNKNOWN) & (F.col("score") >= MIN_SCORE))

    return _keeping(docs, ("lang_pred", "score"), accepted)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with repeated lines left in the document of the largest id only, and n_chars counted anew.

    Defined cases: those of line_runs.drop_repeated_lines; a null text becomes an empty one, and a document that loses all
    its lines stays as an empty one.
    """
    counted = lambda rows: line_runs.drop_repeated_lines(rows).withColumn("n_chars", F.length("text").cast("long"))
    return _keeping(docs, ("n_lines", "n_dropped"), counted)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies, that of the smallest id. Defined cases: those of simhash_vptree.keep_one;
    all texts without words are one component."""
    return simhash_vptree.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` with each secret replaced by [SECRET] and n_chars counted anew. Defined cases: those of
    secret_ledger.scan_documents and redact; no row goes, a null text stays null."""
    return _keeping(docs, ("findings",), lambda rows: secret_ledger.redact(secret_ledger.scan_documents(rows)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of bin_completion.pack_documents, with its defined cases."""
    return bin_completion.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name)
    return docs
