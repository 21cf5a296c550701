"""WARC archives: one gzip member per record, written by tasks into the shared folder and read back sequentially.

Pages with equal payloads of at least ``MIN_REVISIT`` bytes are stored once: the one with the largest page id is a
response record, the others are revisit records that refer to it. Payloads are equal when they have one length and one
SHA-256; the SHA-1 of the format is only written and verified. Each task writes archives of its own under names of
its own attempt and reports them as rows; only reported archives are read, so a task that is run again or twice leaves
at most a file that nobody reads. The reader inflates member by member with bounded buffers, takes each block by its
Content-Length, and verifies block and payload digests.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.support import join_groups, parts, scratch, stage

MIN_REVISIT, ROLL, CHUNK, LEVEL = 1000, 128 << 20, 1 << 16, 4
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """An archive that does not hold what its records say."""


def _digest(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def write_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", "".join(c if c.isprintable() and c != " " else "%" + "%".join(f"{b:02X}" for b in c.encode()) for c in url)))
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head += [("WARC-Payload-Digest", _digest(payload)), ("WARC-Block-Digest", _digest(block)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return deflate.compress(raw) + deflate.flush()


class _Member:
    """Reads one gzip member of ``source`` piece by piece; what follows it is left in ``rest``."""

    def __init__(self, source: BinaryIO, rest: bytes):
        self.source, self.inflate, self.input, self.buffer = source, zlib.decompressobj(31), rest, bytearray()

    def more(self) -> bool:
        """Inflate up to CHUNK more bytes; false at the end of the member."""
        while not self.inflate.eof:
            raw = self.inflate.unconsumed_tail or self.input or self.source.read(CHUNK)
            self.input = b""
            if not raw:
                raise WarcError("the archive ends within a record")
            out = self.inflate.decompress(raw, CHUNK)
            if out:
                self.buffer += out
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        while (at := self.buffer.find(mark)) < 0:
            if not self.more():
                raise WarcError("a record without the end of its header")
        out = bytes(self.buffer[:at])
        del self.buffer[: at + len(mark)]
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes as they are inflated."""
        while n:
            if not self.buffer and not self.more():
                raise WarcError("a block shorter than its Content-Length")
            out = bytes(self.buffer[:n])
            del self.buffer[:n]
            n -= len(out)
            yield out

    def end(self) -> bytes:
        """The member must end with two line ends; returns what was read beyond it."""
        while self.more():
            pass
        if self.buffer != b"\r\n\r\n":
            raise WarcError("a block longer than its Content-Length")
        return self.inflate.unused_data


def _told(digest) -> str:
    return "sha1:" + base64.b32encode(digest.digest()).decode()


def read_records(source: BinaryIO, with_payload: bool = True) -> Iterator[tuple[dict[str, str], bytes, bytes | None, int]]:
    """(header fields in lower case, HTTP header, payload, its bytes) of each record of an archive; digests are verified.
    Without payloads (None) a block is never held whole."""
    rest = b""
    while rest or (rest := source.read(CHUNK)):
        member = _Member(source, rest)
        version, *lines = member.until(b"\r\n\r\n").decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise WarcError("not a WARC record")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        block, own, size, http, head, kept = hashlib.sha1(), hashlib.sha1(), 0, None, bytearray(), []
        for piece in member.pieces(int(fields["content-length"])):
            block.update(piece)
            if http is None:
                head += piece
                if (at := head.find(b"\r\n\r\n")) < 0:
                    continue
                http, piece = bytes(head[:at]), bytes(head[at + 4 :])
            own.update(piece)
            size += len(piece)
            if with_payload:
                kept.append(piece)
        rest = member.end()
        if "warc-block-digest" in fields and _told(block) != fields["warc-block-digest"]:
            raise WarcError("a block that does not have its digest")
        if fields["warc-type"] == "response" and "warc-payload-digest" in fields and _told(own) != fields["warc-payload-digest"]:
            raise WarcError("a payload that does not have its digest")
        yield fields, bytes(head) if http is None else http, b"".join(kept) if with_payload else None, size


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        out, path, records, size = None, "", 0, 0
        done: list[tuple[str, int, int]] = []
        for b in batches:
            for page, url, payload, top, many in (row for part in parts(b, "payload") for row in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "payload", "top", "many")), strict=True)):
                if out is None:
                    path, records, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(path, compression=None)
                raw = write_record(page, url, payload, top, bool(many) and page != top)
                out.write(raw)
                records, size = records + 1, size + len(raw)
                if size >= ROLL:
                    out.close()
                    done.append((path, records, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, records, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    return run


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``pages`` (page_id, url, html) below ``folder``, a URI that all executors reach; returns the written table of
    archives (path, records, bytes). A null html is an empty payload, a null url a record without a target."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    small = rows.filter(F.octet_length("payload") < MIN_REVISIT)
    large = rows.filter(F.octet_length("payload") >= MIN_REVISIT).withColumn("key", F.concat(F.unhex(F.sha2("payload", 256)), F.unhex(F.lpad(F.hex(F.octet_length("payload")), 16, "0"))))
    groups = stage(large.groupBy("key").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("many")), "payloads")
    total = groups.agg(F.sum("many")).first()[0] or 0
    again = F.col("many") > 1
    # Small pages are no revisits and need no join; a page that very many rows equal stays where it is.
    joined = join_groups(large, groups, ["key"], "many", total).select("page_id", "url", "payload", F.when(again, F.col("top")).alias("top"), F.when(again, F.col("many")).alias("many"))
    alone = small.select("page_id", "url", "payload", F.lit(None).cast("long").alias("top"), F.lit(None).cast("long").alias("many"))
    return stage(joined.unionByName(alone).mapInArrow(_write(folder), "path string, records long, bytes long"), "archives")


_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _page(urn: str) -> int | None:
    number = urn.strip("<>").rpartition(":")[2]
    return int(number) if number else None


def _read(folder: str, with_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = fs.FileSystem.from_uri(folder)
        names = [x.split()[0] for x in _READ.split(", ")]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for b in batches:
            for path in b.column("path").to_pylist():
                rows, held = [], 0
                with store.open_input_stream(path, compression=None) as source:
                    for fields, http, payload, length in read_records(source, with_payload):
                        size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        if fields["warc-type"] == "response" and size != length:
                            raise WarcError("a payload shorter than its Content-Length")
                        digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                        refers = fields.get("warc-refers-to")
                        rows.append((_page(fields["warc-record-id"]), fields.get("warc-target-uri"), size, digest, fields["warc-type"], refers and _page(refers), payload))
                        held += len(payload) if with_payload else 200
                        if held >= 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return run


def read_archives(archives: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of ``archives`` (path), each archive read by one task from its start to its end."""
    count = archives.count()
    return archives.select("path").repartition(max(1, count)).mapInArrow(_read(folder, with_payload), _READ)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Defined cases: a null html is an empty payload; rows that repeat a page_id are records of their own, and those with
    the largest page_id of equal payloads all are responses; a null page_id is below all others; of equal payloads whose
    page_ids all are null every record is a response; a page of any length is one record; an empty table gives no rows.
    Other columns are not read, whatever their names.
    """
    folder = scratch(pages.sparkSession, "warc")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    return read_archives(write_archives(pages, folder), folder, with_payload=False).drop("payload", "url")
