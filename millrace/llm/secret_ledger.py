"""Secret scans over an incremental ledger of blobs.

Every version of a text is a blob named by the SHA-256 of its content. The ledger lists the (blob, rule version) pairs
that have been scanned, with their findings. A scan looks only at blobs that the ledger does not have under the current
rule version, each once however many documents hold it, and the findings are joined back to every document (path) of the
blob. A ledger is a Parquet folder; scans append to it, so the next scan of a grown or partly changed corpus reads only
what is new, and a new rule version rescans everything once. Two scans at once may both append a blob: it is one all the
same, as the findings of a blob under a version are what they are.

``scan_documents`` takes the documents in versions of the corpus, by rising id: each version is scanned against the ledger
that those before it have left.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.support import columns, fresh, hot_keys, join_around, parts, scratch, stage

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: Of the matches of _HEX those that are long enough.
_LONG_HEX = re.compile(rf"(?<![0-9a-f])[0-9a-f]{{{LEAST['hex']},}}")
#: Of the rules themselves, so that a changed pattern or length is a new version.
RULE_VERSION = zlib.crc32(repr([KINDS, LEAST, *[(p.pattern, p.flags) for p in (_ASSIGN, _ACCESS, _HEX)]]).encode()) >> 1
#: Versions of the corpus that a table is scanned in.
VERSIONS = 2
#: A finding's kind is the position in KINDS; start and end are code points, end exclusive.
FINDINGS = "array<struct<start:int,kind:int,end:int>>"
_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))


def find_secrets(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in that order. Matches of one kind do not overlap; failing ones take their place, too."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), 2, m.end()) for m in _LONG_HEX.finditer(text)]
    return sorted(found)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in parts(b):
            rows = [[{"start": s, "kind": k, "end": e} for s, k, e in find_secrets(t or "")] for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("blob"), pa.array(rows, _ARROW)], ["blob", "findings"])


class BlobLedger:
    """What has been scanned: a Parquet folder of (blob, rule_version, findings)."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch(spark, "ledger")

    def read(self, version: int = RULE_VERSION) -> DataFrame:
        """(blob, findings); a blob that scans at the same time have both appended comes twice."""
        found = self.spark.read.schema(f"blob binary, findings {FINDINGS}, rule_version int")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], f"blob binary, findings {FINDINGS}")
        return found.parquet(self.path).filter(F.col("rule_version") == version).drop("rule_version")

    def scan(self, versions: DataFrame, version: int = RULE_VERSION) -> None:
        """Scan the blobs of ``versions`` (blob, text) that are new under ``version``, each once."""
        fresh = versions.dropDuplicates(["blob"]).join(self.read(version).select("blob"), "blob", "left_anti")
        fresh.mapInArrow(_scan, f"blob binary, findings {FINDINGS}").withColumn("rule_version", F.lit(version)).write.mode("append").partitionBy("rule_version").parquet(self.path)

    def findings(self, version: int = RULE_VERSION) -> DataFrame:
        """(blob, findings) of the blobs that have some, each once."""
        return self.read(version).filter(F.size("findings") > 0).dropDuplicates(["blob"])


def corpus_versions(docs: DataFrame, id_col: str, many: int = VERSIONS) -> list[DataFrame]:
    """``docs`` cut by rising id into ``many`` parts of about the same number of rows; null ids are in the first."""
    own = F.coalesce(columns([id_col])[0].cast("long"), F.lit(-(2**63)))
    cuts = docs.select(own.alias("own")).approxQuantile("own", [k / many for k in range(1, many)], 0.01) if many > 1 else []
    ends = [None, *sorted(set(cuts)), None]
    if len(ends) == 2:
        return [docs]
    above = lambda a: F.lit(True) if a is None else own > F.lit(a)
    below = lambda b: F.lit(True) if b is None else own <= F.lit(b)
    return [docs.filter(above(a) & below(b)) for a, b in zip(ends, ends[1:], strict=False)]


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: BlobLedger | None = None, version: int = RULE_VERSION, versions: int = VERSIONS) -> DataFrame:
    """``docs`` with a column ``findings`` (sorted by start, then kind).

    The texts are content-addressed and scanned in ``versions`` versions of the corpus, each against what the ledger has by
    then: a text that an earlier version or an earlier scan of this ledger has had is not scanned again.

    Defined cases: a null text is an empty one, without findings; a text of any length is scanned whole; repeated rows and
    equal texts are scanned once and all get the findings; ids only decide the version; an empty table gives no rows.
    Every other column passes through unchanged, whatever its name, but one named ``findings`` is replaced.
    """
    ledger = ledger or BlobLedger(docs.sparkSession)
    text = F.coalesce(columns([text_col])[0], F.lit(""))
    blob = F.unhex(F.sha2(text, 256))
    for part in corpus_versions(docs, id_col, versions):
        ledger.scan(part.select(blob.alias("blob"), text.alias("text")), version)
    # Only blobs with findings are joined back, those that very many rows have without moving them; all others have none.
    own, found = fresh(docs.columns, "blob", "found")
    hits = stage(ledger.findings(version).select(F.col("blob").alias(own), F.col("findings").alias(found)), "hits")
    named = docs.withColumn(own, blob)
    joined = join_around(named, hits, [own], hot_keys(named.select(own), [own]), "left")
    rest = columns(c for c in docs.columns if c.lower() != "findings")
    return joined.select(*rest, F.coalesce(found, F.array().cast(FINDINGS)).alias("findings"))


def spans_text(findings):
    """kind:start:end of each finding, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(findings, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def count_kind(findings, kind: str):
    return F.size(F.filter(findings, lambda x: x["kind"] == KINDS.index(kind))).cast("long")


def _without(text: str, found: list[dict]) -> str:
    out, end = [], 0
    for x in found:
        if x["end"] > end:
            if x["start"] >= end:
                out += [text[end : x["start"]], "[SECRET]"]
            end = x["end"]
    return "".join([*out, text[end:]])


def _redact(at: int, findings: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in parts(b, b.schema.names[at]):
                texts = [_without(t, x) if x else t for t, x in zip(part.column(at).to_pylist(), part.column(findings).to_pylist(), strict=True)]
                yield part.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type)).drop_columns([findings])

    return run


def redact(scanned: DataFrame, text_col: str = "text") -> DataFrame:
    """The result of scan_documents with each secret in ``text_col`` replaced by [SECRET], and n_chars, if there, counted anew.

    Defined cases: findings that overlap are one replacement; a null or empty text stays as it is; repeated rows are all
    redacted; an empty table stays empty; every other column passes through, whatever its name.
    """
    # By plain names within, as columns of batches may have any.
    names, at = scanned.columns, scanned.columns.index("findings")
    plain = scanned.toDF(*[f"c{k}" for k in range(len(names))])
    kept = scanned.drop("findings")
    out = plain.mapInArrow(_redact(names.index(text_col), f"c{at}"), plain.drop(f"c{at}").schema).toDF(*kept.columns)
    return out.withColumn("n_chars", F.length(columns([text_col])[0]).cast("long")) if "n_chars" in kept.columns else out
