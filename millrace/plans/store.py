"""The store: postings in wire form, as batches of Parquet files that are only ever added.

A change writes its rows to a folder of its own below ``_writing``, where no reader looks, and then renames that folder to
the batch after the last one that it has *read*, which a file system does as one step and refuses if another writer has taken
the number. So a change that dies at any point leaves nothing that a reader sees, and a change that was made from rows which
another change has since replaced is refused (``StoreConflict``) and made again from what is there, ``tries`` times.

There are three kinds of batches. ``new`` ones hold rows whose url and id no earlier batch has, ``edit`` ones new versions of
rows of earlier batches, and an ``all`` batch stands for everything before it. Reading merges the edits: their urls with
their latest batch, at most ``EDITS`` rows, are sent to where the rows are, so no posting is shuffled; a change that brings
the edits above that bound ends with ``compact``, which writes one batch for all.

Beside each batch of rows that are new there is a Bloom filter of their urls and ids, as a small table of 64-bit words. An
insert looks its keys up there first and reads the keys of those batches only that may hold one of them.

Each batch is sorted by id, so the statistics of its files lead a look-up by id, or by url (from which the id follows), to
few row groups. Paths are Hadoop paths.
"""

from __future__ import annotations

import re
import uuid
from abc import ABC, abstractmethod
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from millrace import schema
from millrace.functions.urls import normalize_url, posting_id
from millrace.operators.filters import Scope, by_id_prefix, by_url, matching, page
from millrace.joins import fresh
from millrace.operators.runs import backfill_ids, first_of_key
from millrace.scratch import stage_counted, write_counted

VERSION = 4


class StoreError(RuntimeError):
    """A store that can't be used as it is."""


class StoreConflict(StoreError):
    """A change that another one has overtaken."""


class StoreUnreachable(StoreError):
    """A store whose place can't be read or written."""


class Store(ABC):
    """What a run needs of a store. ``unreadable_rows`` tells how many rows the last read left out."""

    unreadable_rows = 0

    @abstractmethod
    def save(self, postings: DataFrame, sequence: str | None = None) -> int: ...

    @abstractmethod
    def update_scores(self, scored: DataFrame) -> int: ...

    @abstractmethod
    def update_status(self, url: str, status: str, applied_at: Column | None = None) -> bool: ...

    @abstractmethod
    def list(self, scope: Scope | None = None, limit: int | None = None, offset: int = 0) -> DataFrame: ...

    @abstractmethod
    def count(self, scope: Scope | None = None) -> int: ...

    @abstractmethod
    def get(self, url: str) -> DataFrame: ...

    @abstractmethod
    def find(self, prefix: str) -> DataFrame: ...

    @abstractmethod
    def resolve(self, ref: str) -> DataFrame: ...


#: The number of a batch, its kind and, of edits, their number of rows. Earlier stores have ``more``, which may be any.
_BATCH = re.compile(r"batch=(\d{8})-(all|more|new|edit-(\d+))$")
#: Edits since the last batch for all; more than these are compacted. Their urls are what a read broadcasts.
EDITS = 500_000
#: Bits of a filter for each url and id, at least; a key sets PROBES of the 64 bits of one word.
KEY_BITS, PROBES = 24, 5


def _words(rows: DataFrame, size: Column) -> DataFrame:
    """For each url and id of ``rows``: its word of a filter of ``size`` words, and the bits that it sets there."""
    keys = rows.select(F.explode(F.array("url", "id")).alias("key")).filter(F.col("key").isNotNull())
    other = F.xxhash64("key", F.lit(1))
    bits = reduce(lambda a, k: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(other, 6 * k), F.lit(64)).cast("int"))), range(PROBES), F.lit(0).cast("long"))
    return keys.select(F.pmod(F.xxhash64("key"), size).alias("word"), bits.alias("bits"))


class PostingStore(Store):
    def __init__(self, spark: SparkSession, path: str, tries: int = 3):
        self.spark, self.path, self.tries, self.unreadable_rows = spark, path.rstrip("/"), tries, 0
        try:
            self._fs = self._at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            self._fs.mkdirs(self._at())
        except Py4JJavaError as e:
            raise StoreUnreachable(f"the store {path} can't be reached: {e.java_exception.getMessage()}") from e
        self.migrate()

    # -- batches -------------------------------------------------------------------------------------------------------

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at())]
        if strange := [n for n in names if n != "_writing" and not re.fullmatch(r"format=\d+", n)]:
            raise StoreError(f"{self.path} is not a store of postings: it has {strange[0]}")
        return sorted(int(n.removeprefix("format=")) for n in names if n != "_writing")

    def _batches(self, version: int = VERSION) -> list[str]:
        """The folders that count, oldest first: from the last one that stands for all before it."""
        if not self._fs.exists(self._at(f"format={version}")):
            return []
        names = sorted(n for s in self._fs.listStatus(self._at(f"format={version}")) if _BATCH.match(n := s.getPath().getName()))
        whole = max((k for k, n in enumerate(names) if n.endswith("-all")), default=0)
        return names[whole:]

    def _draft(self) -> str:
        return f"_writing/{uuid.uuid4().hex}"

    def _add(self, wire: DataFrame, whole: bool = False, version: int = VERSION, seen: list[str] | None = None, edit: bool = False) -> int:
        """Write ``wire`` as the batch after the last of ``seen``, those that it was made from; how many rows, of which none
        make no batch unless it stands for all."""
        names, draft = self._batches(version) if seen is None else seen, self._draft()
        rows = write_counted(wire.sortWithinPartitions("id" if "id" in wire.columns else "url"), f"{self.path}/{draft}", rows=F.count(F.lit(1)))["rows"]
        if not rows and not whole:
            self._fs.delete(self._at(draft), True)
            return 0
        if not edit and "id" in wire.columns:
            self._filter(draft, rows)
        number = int(_BATCH.match(names[-1])[1]) + 1 if names else 0
        kind = "all" if whole else f"edit-{rows}" if edit else "new"
        self._publish(draft, f"format={version}/batch={number:08d}-{kind}", number, version)
        return rows

    def _filter(self, draft: str, rows: int) -> None:
        """The filter of a draft's keys, in a folder of it that readers pass over: (size, word, bits), words that are not 0."""
        size = 1 << max(0, (2 * rows * KEY_BITS // 64).bit_length())
        words = _words(self.spark.read.parquet(f"{self.path}/{draft}"), F.lit(size)).groupBy("word").agg(F.bit_or("bits").alias("bits"))
        words.select(F.lit(size).cast("long").alias("size"), "word", "bits").write.parquet(f"{self.path}/{draft}/_keys")

    def _publish(self, draft: str, name: str, number: int, version: int) -> None:
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        self._fs.mkdirs(self._at(f"format={version}"))
        if any(int(_BATCH.match(n)[1]) >= number for n in self._batches(version)):
            raise StoreConflict(f"another change of {self.path} came first; read it again")
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at().toUri(), conf).rename(self._at(draft), self._at(name), none)
        except Py4JJavaError as e:
            if self._fs.exists(self._at(name)):
                raise StoreConflict(f"another change of {self.path} came first; read it again") from e
            raise StoreError(f"could not add to {self.path}: {e.java_exception.getMessage()}") from e

    def _changed(self, make: Callable[[list[str]], DataFrame], edit: bool = False, whole: bool = False) -> int:
        """Add what ``make`` makes of the batches that are there; again if another change comes between."""
        for left in range(self.tries - 1, -1, -1):
            seen = self._batches()
            try:
                rows = self._add(make(seen), whole, seen=seen, edit=edit)
                break
            except StoreConflict:
                if not left:
                    raise
        if edit and self._edits(self._batches())[1] > EDITS:
            self.compact()
        return rows

    @staticmethod
    def _edits(names: list[str]) -> tuple[list[str], float]:
        """The batches that replace rows of others, and how many rows they have at most."""
        own = [(n, m) for n in names[1:] if (m := _BATCH.match(n))[2] == "more" or m[3]]
        return [n for n, _ in own], sum(int(m[3] or 0) if m[3] else float("inf") for _, m in own)

    def may_hold(self, rows: DataFrame, names: list[str]) -> list[str]:
        """Those of the batches ``names`` that may hold a url or an id of ``rows``, by their filters. Edits hold no new keys."""
        found = [n for n in names if not _BATCH.match(n)[3]]
        filtered = [n for n in found if self._fs.exists(self._at(f"format={VERSION}", n, "_keys"))]
        if not filtered:
            return found
        # One row a word of each filter: KEY_BITS bits a key, where the keys themselves are some 80 bytes.
        reads = [self.spark.read.parquet(f"{self.path}/format={VERSION}/{n}/_keys").withColumn("batch", F.lit(n)) for n in filtered]
        filters = reduce(DataFrame.unionByName, reads)
        # Sizes are powers of two, so there are few.
        sizes = [r[0] for r in filters.select("size").distinct().collect()]
        asked = reduce(DataFrame.unionByName, [_words(rows, F.lit(s)).select(F.lit(s).cast("long").alias("size"), "word", F.col("bits").alias("own")) for s in sizes] or [_words(rows, F.lit(1)).select(F.lit(0).cast("long").alias("size"), "word", F.col("bits").alias("own"))])
        hits = filters.join(asked, ["size", "word"]).filter(F.col("bits").bitwiseAND(F.col("own")) == F.col("own")).select("batch").distinct()
        held = {r[0] for r in hits.collect()}  # at most a row a batch
        return [n for n in found if n in held or n not in filtered]

    def _rows(self, version: int = VERSION, names: list[str] | None = None) -> DataFrame:
        """Every version of every row of the batches, with its ``batch``."""
        names = self._batches(version) if names is None else names
        if not names:
            return self.spark.createDataFrame([], schema.WIRE_SCHEMA).withColumn("batch", F.lit("").cast("string"))
        top = f"{self.path}/format={version}"
        return self.spark.read.option("basePath", top).parquet(*[f"{top}/{n}" for n in names])

    def _latest(self, names: list[str] | None = None, where: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
        """Of each url the row of the latest of the batches, of the rows that ``where`` selects by what never changes."""
        names = self._batches() if names is None else names
        rows, (edits, many) = where(self._rows(names=names)), self._edits(names)
        if not edits:
            return rows.drop("batch")
        own = [c for c in rows.columns if c != "batch"]
        if many > EDITS:
            return rows.groupBy(F.col("url").alias("key")).agg(F.max_by(F.struct(*own), "batch").alias("row")).select("row.*")
        last = where(self._rows(names=edits)).groupBy(F.col("url").alias("key")).agg(F.max("batch").alias("last"))
        # At most EDITS rows.
        merged = rows.join(F.broadcast(last), F.col("url") == F.col("key"), "left")
        return merged.filter(F.col("last").isNull() | (F.col("batch") >= F.col("last"))).select(*own)

    def wire(self, names: list[str] | None = None) -> DataFrame:
        return self._latest(names)

    def compact(self) -> None:
        """One batch for all; the ones before it stay until they are cleared away, for those who read them."""
        self._changed(self.wire, whole=True)

    def rows(self) -> DataFrame:
        """All readable postings, typed; the rest is counted."""
        return self._readable(self.wire())

    def _readable(self, wire: DataFrame) -> DataFrame:
        self.unreadable_rows = schema.unreadable(wire).first()[0]
        return schema.decode(wire)

    # -- versions ------------------------------------------------------------------------------------------------------

    def migrate(self) -> int:
        """Bring the newest older table to this version in one plan and one batch."""
        found = self._versions()
        if found and found[-1] > VERSION:
            raise StoreError(f"{self.path} was written by a later version")
        if found and found[-1] < VERSION:
            version = found[-1]
            df = self._rows(version)
            names = [c for c in df.columns if c != "batch"]
            df = df.groupBy(F.col("url").alias("key")).agg(F.max_by(F.struct(*names), "batch").alias("row")).select("row.*")
            if version < 3:
                if "missing_skills" in df.columns:
                    df = df.withColumnRenamed("missing_skills", "unmatched_profile_skills")
                df = df.withColumns({c: F.lit("[]") for c in schema.LATER_LISTS} | {c: F.lit(None).cast("int") for c in schema.FLAGS})
            if version < 4:
                df = df.withColumns({"id": F.lit(None).cast("string"), "detected_language": F.lit(None).cast("string")})
                df = backfill_ids(df, posting_id(normalize_url(F.col("url"))))
            self._add(df.select(*schema.COLUMNS), whole=True)
        return VERSION

    # -- changes -------------------------------------------------------------------------------------------------------

    def save(self, postings: DataFrame, sequence: str | None = None) -> int:
        """Insert what is new by url and by id; of rows with one key in the batch the first in ``sequence``, or without one
        the first by fetched_at and raw_url. Returns how many."""
        batch = postings if sequence else postings.withColumn("sequence", F.struct("fetched_at", "raw_url", F.xxhash64("title", "description_raw")))
        order, draft = sequence or "sequence", self._draft()
        # Read once: the keys are looked up before the rows are inserted. Written as they come: only keys are shuffled.
        (row,) = fresh(batch.columns, "row")
        batch.withColumn(row, F.monotonically_increasing_id()).write.parquet(f"{self.path}/{draft}")
        whole = self.spark.read.schema(StructType([*batch.schema, StructField(row, LongType())])).parquet(f"{self.path}/{draft}")
        keys = whole.select("url", "id", F.struct(F.col(order).alias("sequence"), F.col(row).alias("row")).alias("order"))
        first = first_of_key(first_of_key(keys, "url", "order"), "id", "order").select("url", "id", F.col("order.row").alias("row"))
        first, found = stage_counted(first, "first", rows=F.count(F.lit(1)))
        total = whole.count()

        def fresh_rows(seen: list[str]) -> DataFrame:
            left, names = first, self.may_hold(first, seen)
            if names:
                stored = self._rows(names=names)
                left = first.join(stored.select("url"), "url", "left_anti").join(stored.select("id"), "id", "left_anti")
            elif found["rows"] == total:
                return whole
            # Of most batches few rows are left out, or few are new; either are sent to where the rows are.
            left, kept = (left, found) if left is first else stage_counted(left, "left", rows=F.count(F.lit(1)))
            left = left.select(F.col("row").alias(row))
            if total - kept["rows"] <= EDITS:
                return whole.join(F.broadcast(whole.select(row).join(left, row, "left_anti")), row, "left_anti")
            return whole.join(F.broadcast(left) if kept["rows"] <= EDITS else left, row, "left_semi")

        many = self._changed(lambda seen: schema.encode(fresh_rows(seen).select(*schema.COLUMNS)))
        self._fs.delete(self._at(draft), True)
        return many

    def update(self, changes: DataFrame, columns: list[str], where: Callable[[DataFrame], DataFrame] = lambda df: df) -> int:
        """New versions of the stored rows with ``columns`` by url from ``changes`` (typed, one row a url); returns how many.
        Only these are written; ``where`` may select a part of the stored ones that has them all."""
        full = changes.select("url", *columns).withColumns({c: F.lit(None).cast(schema.POSTING_SCHEMA[c].dataType) for c in schema.COLUMNS if c not in (*columns, "url")})
        new = schema.encode(full.withColumn("url", normalize_url(F.col("url")))).select("url", F.struct(*columns).alias("new"))
        new, found = stage_counted(new, "changes", rows=F.count(F.lit(1)))

        def changed(seen: list[str]) -> DataFrame:
            """The stored rows that may change: those of up to EDITS urls are found where they are."""
            rows = self._latest(seen, where)
            return rows.join(F.broadcast(new.select("url")), "url", "left_semi") if found["rows"] <= EDITS else rows

        made = lambda seen: changed(seen).join(new, "url").select(*[F.col(f"new.{c}" if c in columns else c).alias(c) for c in schema.COLUMNS])
        return self._changed(made, edit=True)

    def update_scores(self, scored: DataFrame) -> int:
        return self.update(scored, schema.SCORE_COLUMNS)

    def update_status(self, url: str, status: str, applied_at: Column | None = None) -> bool:
        if status not in schema.STATUSES:
            raise ValueError(f"unknown status {status!r}")
        at = F.lit(None).cast("timestamp") if applied_at is None else applied_at
        one = self.spark.range(1).select(F.lit(url).alias("url"), F.lit(status).alias("status"), at.cast("timestamp").alias("applied_at"))
        return self.update(one, ["status", "applied_at"], lambda df: by_url(df, url)) > 0

    # -- reads ---------------------------------------------------------------------------------------------------------

    def list(self, scope: Scope | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
        """A page of the scope in stored order. Unreadable rows take places of a page, and are then left out."""
        # Times in wire form sort as text only within one format, so the page is cut on the parsed time.
        own = self.wire().withColumn("raw_time", F.col("fetched_at")).withColumn("fetched_at", F.try_to_timestamp("fetched_at"))
        cut = page((scope or Scope()).select(own), limit, offset)
        return self._readable(cut.withColumn("fetched_at", F.col("raw_time")).drop("raw_time"))

    def count(self, scope: Scope | None = None) -> int:
        """Unreadable rows count."""
        return (scope or Scope()).select(self.wire()).count()

    def get(self, url: str) -> DataFrame:
        """A key never changes, so the versions of other rows need not be read."""
        return self._readable(self._latest(where=lambda df: by_url(df, url)))

    def find(self, prefix: str) -> DataFrame:
        return self._readable(self._latest(where=lambda df: by_id_prefix(df, prefix)))

    def resolve(self, ref: str) -> DataFrame:
        """What a URL or the first digits of an id refer to; two rows mean that it is ambiguous."""
        return self._readable(self._latest(where=lambda df: matching(df, ref)).limit(2))


# -- backends ----------------------------------------------------------------------------------------------------------

_BACKENDS: dict[str, Callable[[SparkSession, dict], Store]] = {}


def register_store(name: str) -> Callable:
    def add(make: Callable[[SparkSession, dict], Store]) -> Callable[[SparkSession, dict], Store]:
        if name in _BACKENDS:
            raise ValueError(f"there already is a store {name!r}")
        _BACKENDS[name] = make
        return make

    return add


def store_names() -> list[str]:
    return sorted(_BACKENDS)


def open_store(spark: SparkSession, block: dict) -> Store:
    """The store of a configuration's storage block. StoreUnreachable: its place is not there; StoreError: what is there is
    no store, or there is no such backend."""
    name = block.get("backend", "parquet")
    if name not in _BACKENDS:
        raise StoreError(f"unknown storage backend {name!r}; known: {', '.join(store_names())}")
    return _BACKENDS[name](spark, {k: v for k, v in block.items() if k != "backend"})


@register_store("parquet")
def _parquet(spark: SparkSession, options: dict) -> Store:
    if unknown := sorted(set(options) - {"path"}):
        raise StoreError(f"unknown storage option: {', '.join(unknown)}")
    return PostingStore(spark, options.get("path", "./postings"))
