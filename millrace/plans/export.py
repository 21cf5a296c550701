"""Exports: ranked postings as CSV, JSON or Markdown, with each format's own escaping.

Records are columns and become lines of text on the executors, which write them in parallel, dealt by ranges of the order.
``output_path`` is one file, as a reader of such a file wants: the parts are put together in their order byte by byte, and
no row comes to Python. With ``parts: true`` they stay a folder.

A format is a class that is registered by name: its options are checked, and its ``export`` gets the postings.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import defuse_formula, markdown_destination, markdown_text
from millrace.operators.filters import order, with_places
from millrace.schema import iso_time
from millrace.scratch import scratch

# The columns of a CSV file and the keys of a JSON record, in order.
EXPORT_COLUMNS = (
    "score", "title", "company", "source", "status", "work_mode", "location", "eligible_locations", "detected_language", "url",
    "published_at", "salary_text", "summary", "matched_skills", "missing_requirements", "penalized_skills",
)
LISTS = ("eligible_locations", "matched_skills", "missing_requirements", "penalized_skills")


class ExportError(RuntimeError):
    """An export that can't be done as asked, in words for whoever asked."""


@dataclass(frozen=True)
class ExportResult:
    exported: int
    detail: str


def record(name: str) -> Column:
    return iso_time(F.col(name)) if name == "published_at" else F.col(name)


def json_record(pretty: bool = False) -> Column:
    """One posting as a JSON object; absent values are null."""
    return F.to_json(F.struct(*[record(c).alias(c) for c in EXPORT_COLUMNS]), {"ignoreNullFields": "false", "pretty": str(pretty).lower()})


def csv_cells() -> list[Column]:
    """Lists joined, absent values empty, and no text that a spreadsheet would run."""
    cells = []
    for c in EXPORT_COLUMNS:
        text = F.array_join(c, "; ") if c in LISTS else record(c)
        cells.append((F.col(c).cast("string") if c == "score" else defuse_formula(F.coalesce(text, F.lit("")))).alias(c))
    return [F.coalesce(x, F.lit("")).alias(c) for x, c in zip(cells, EXPORT_COLUMNS, strict=True)]


def csv_line() -> Column:
    """A cell with a comma, a quote or a line break is quoted, and quotes in it are doubled."""
    quoted = [F.when(c.rlike(r'[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c) for c in csv_cells()]
    return F.concat_ws(",", *quoted)


def markdown_bullet() -> Column:
    label = F.concat(markdown_text(F.col("title")), F.lit(" — "), markdown_text(F.col("company")))
    link = F.concat(F.lit("**"), F.coalesce(F.col("score").cast("string"), F.lit("n/a")), F.lit("** — ["), label, F.lit("]("), markdown_destination(F.col("url")), F.lit(")"))
    places = F.array_join(F.transform("eligible_locations", markdown_text), ", ")
    parts = F.concat_ws(
        " · ",
        link,
        F.when(F.col("work_mode") != "unknown", F.col("work_mode")),
        F.when(F.col("location") != "", markdown_text(F.col("location"))),
        F.when(F.size("eligible_locations") > 0, F.concat(F.lit("eligible: "), places)),
    )
    return F.concat(F.lit("- "), parts)


# -- exporters ---------------------------------------------------------------------------------------------------------


class Exporter(ABC):
    """``options`` are those of its own besides ``enabled``; a ``needed`` one may not be missing or empty."""

    name = ""
    options: tuple[str, ...] = ()
    needed: tuple[str, ...] = ()

    def __init__(self, block: dict):
        if unknown := sorted(set(block) - {"enabled", *self.options}):
            raise ExportError(f"unknown option for {self.name}: {', '.join(unknown)}; known: {', '.join(self.options) or 'none'}")
        if missing := [o for o in self.needed if not block.get(o)]:
            raise ExportError(f"the {self.name} exporter needs {'an' if missing[0][0] in 'aeiou' else 'a'} {missing[0]}")
        self.block = block

    @abstractmethod
    def export(self, postings: DataFrame) -> ExportResult:
        """Write ``postings``, best score first; ExportError says what to change where that can't be done."""


_REGISTERED: dict[str, type[Exporter]] = {}


def register_exporter(name: str) -> Callable[[type[Exporter]], type[Exporter]]:
    def add(kind: type[Exporter]) -> type[Exporter]:
        if name in _REGISTERED:
            raise ValueError(f"there already is an exporter {name!r}")
        kind.name = name
        _REGISTERED[name] = kind
        return kind

    return add


def export_formats() -> list[str]:
    return sorted(_REGISTERED)


def export(postings: DataFrame, fmt: str, options: dict) -> ExportResult:
    if fmt not in _REGISTERED:
        raise ExportError(f"unknown export format {fmt!r}; known: {', '.join(export_formats())}")
    return _REGISTERED[fmt](options).export(postings)


class TextExporter(Exporter):
    """A format of lines: ``line``, what is before them and after them, for a number of postings."""

    options, needed = ("output_path", "parts"), ("output_path",)

    @abstractmethod
    def line(self) -> Column: ...

    def head(self, many: int) -> str:
        return ""

    def tail(self, many: int) -> str:
        return ""

    def between(self) -> str:
        """Before each line but the first."""
        return ""

    def export(self, postings: DataFrame) -> ExportResult:
        path, spark = self.block["output_path"], postings.sparkSession
        placed = with_places(postings, order("score"), "export_place")
        later = F.when(F.col("export_place") > 1, self.between()).otherwise("")
        text = F.concat(later, self.line()) if self.between() else self.line()
        # The files of the places are in order, and so are those made of them; each has at most one line more than it needs.
        drafts = path if self.block.get("parts") else scratch(spark, "export")
        many = placed.count()
        try:
            lines = placed.repartitionByRange("export_place").sortWithinPartitions("export_place").select(text.alias("value"))
            lines.write.mode("overwrite").text(drafts)
            if not self.block.get("parts"):
                _together(spark, drafts, path, self.head(many), self.tail(many))
        except Py4JJavaError as e:
            raise ExportError(f"could not write to {path}: {e.java_exception.getMessage()}") from e
        except Exception as e:  # Spark's own errors of paths that can't be written
            raise ExportError(f"could not write to {path}: {e}") from e
        return ExportResult(many, f"wrote {many} postings to {path}")


def _together(spark, folder: str, path: str, head: str, tail: str) -> None:
    """The part files of ``folder`` as one file, between ``head`` and ``tail``: bytes only, copied by the JVM."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(folder), jvm.org.apache.hadoop.fs.Path(path)
    store, into = source.getFileSystem(conf), target.getFileSystem(conf)
    names = sorted(s.getPath().toString() for s in store.listStatus(source) if s.getPath().getName().startswith("part-"))
    out = into.create(target, True)
    try:
        out.write(bytearray(head.encode()))
        for name in names:
            part = store.open(jvm.org.apache.hadoop.fs.Path(name))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 16, False)
            finally:
                part.close()
        out.write(bytearray(tail.encode()))
    finally:
        out.close()


@register_exporter("csv")
class Csv(TextExporter):
    line = staticmethod(csv_line)

    def head(self, many: int) -> str:
        return ",".join(EXPORT_COLUMNS) + "\n"


@register_exporter("json")
class Json(TextExporter):
    def line(self) -> Column:
        return json_record(pretty=True)

    def between(self) -> str:
        return ","

    def head(self, many: int) -> str:
        return f'{{\n"count": {many},\n"postings": [\n'

    def tail(self, many: int) -> str:
        return "]\n}\n"


@register_exporter("markdown")
class Markdown(TextExporter):
    line = staticmethod(markdown_bullet)

    def head(self, many: int) -> str:
        return "# Job postings\n\n" + (f"_{many} postings, sorted by score (highest first)._\n\n" if many else "_No postings to export._\n")
