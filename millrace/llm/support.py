"""What several operators share: constants of text, joins of rows with their groups, intermediate tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from millrace.joins import HOT, columns, fresh, hot_keys, join_around, join_groups
from millrace.scratch import few, scratch, shared_dir, stage, stage_counted

#: The bytes that count as white space in the contracts: ``[\x20\x09-\x0D]``.
WHITE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(column):
    return F.translate(column, UPPER, LOWER)


#: Rows and (beyond the first of them) bytes of text that become Python strings at once.
TEXTS, TEXT_BYTES = 500, 1 << 21


def parts(batch: pa.RecordBatch, column: str = "text", texts: int = TEXTS, size: int = TEXT_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of at most ``texts`` rows and ``size`` bytes of ``column``, or of one row with a longer text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    begin = held = 0
    for k, n in enumerate(sizes):
        if k > begin and (k - begin >= texts or held + n > size):
            yield batch.slice(begin, k - begin)
            begin, held = k, 0
        held += n
    if begin < len(sizes):
        yield batch.slice(begin)


__all__ = ["HOT", "LOWER", "TEXTS", "TEXT_BYTES", "UPPER", "WHITE", "ascii_lower", "columns", "few", "fresh", "hot_keys", "join_around", "join_groups", "parts", "scratch", "shared_dir", "stage", "stage_counted"]
