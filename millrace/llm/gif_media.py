"""Media columns: GIF.

Bytes are stored as the samples of 64 pixels wide, 8-bit grey GIF frames with LZW code streams, and GIFs are read into
timed frames: code streams are decoded, palettes applied, and frames laid over the canvas under the rules of disposal
and transparency. Each frame has a histogram of its colours. Codes of a stream are cut out of the bits by whole runs
between clear codes, as their widths follow from their number alone.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.support import parts

WIDTH, ROWS, DELAY_MS, BINS = 64, 1024, 40, 8
#: A canvas of more pixels is an error: a header of a few bytes could ask for gigabytes.
MOST_PIXELS = 1 << 26
_FULL = 4096


class GifError(ValueError):
    """Bytes that are not a GIF as its header and blocks say."""


# -- code streams ------------------------------------------------------------------------------------------------------


def _widths(first: int, count: int, bits: int) -> np.ndarray:
    """The widths of the codes number first, first + 1, ... after a clear code."""
    free = (1 << bits) + 2 + np.maximum(0, np.arange(first, first + count) - 1)
    return np.clip(np.ceil(np.log2(free + 1)).astype(np.int64), bits + 1, 12)


def lzw_encode(data: bytes) -> bytes:
    """The LZW code stream of 8-bit samples."""
    runs: list[list[int]] = []
    if data:
        codes: list[int] = []
        table: dict[int, int] = {}
        get, append, free = table.get, codes.append, 258
        prefix = data[0]
        for c in data[1:]:
            key = prefix << 8 | c
            code = get(key)
            if code is not None:
                prefix = code
                continue
            append(prefix)
            prefix = c
            if free < _FULL:
                table[key] = free
                free += 1
            else:
                runs.append(codes)
                codes, free = [], 258
                append = codes.append
                table.clear()
        append(prefix)
        runs.append(codes)
    numbers = [np.array([256])]
    widths = [np.array([9])]
    for k, run in enumerate(runs):
        last = k == len(runs) - 1
        numbers.append(np.array([*run, 257 if last else 256]))
        widths.append(_widths(0, len(run) + 1, 8))
    if not runs:
        numbers.append(np.array([257]))
        widths.append(np.array([9]))
    code, width = np.concatenate(numbers), np.concatenate(widths)
    at = np.cumsum(width) - width
    value, byte = code << (at & 7), at >> 3
    out = np.zeros(int(at[-1] + width[-1] + 7) // 8 + 3)
    for k in range(3):
        out += np.bincount(byte + k, (value >> 8 * k) & 255, minlength=len(out))
    return out[: int(at[-1] + width[-1] + 7) // 8].astype(np.uint8).tobytes()


def lzw_decode(stream: bytes, bits: int = 8) -> bytes:
    """The samples of a code stream with ``bits`` bits a sample."""
    raw = np.frombuffer(stream + bytes(4), np.uint8).astype(np.int64)
    clear, total = 1 << bits, 8 * len(stream)
    base = [bytes([k]) for k in range(clear)] + [b"", b""]
    out: list[bytes] = []
    table, previous, at, number = base.copy(), None, 0, 0
    while at < total:
        width = _widths(number, 4096, bits)
        ends = at + np.cumsum(width)
        many = int(np.searchsorted(ends, total, "right"))
        if not many:
            break
        starts, width = (ends - width)[:many], width[:many]
        byte = starts >> 3
        codes = ((raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (starts & 7)) & ((1 << width) - 1)
        stops = np.flatnonzero((codes == clear) | (codes == clear + 1))
        run = codes[: stops[0]].tolist() if len(stops) else codes.tolist()
        append, add = out.append, table.append
        free = len(table)
        for c in run:
            if previous is None:
                if c >= clear:
                    raise GifError("a code stream that begins with a code not in the table")
                entry = base[c]
            elif c < free:
                entry = table[c]
                if free < _FULL:
                    add(previous + entry[:1])
                    free += 1
            elif c == free and free < _FULL:
                entry = previous + previous[:1]
                add(entry)
                free += 1
            else:
                raise GifError("a code beyond the table")
            append(entry)
            previous = entry
        if len(stops):
            at = int(ends[stops[0]])
            if codes[stops[0]] == clear + 1:
                break
            table, previous, number = base.copy(), None, 0
        else:
            at, number = int(ends[many - 1]), number + many
    return b"".join(out)


def _blocks(raw: bytes) -> bytes:
    """Cut into sub-blocks of at most 255 bytes, with the empty one at the end."""
    full = len(raw) // 255
    body = np.empty((full, 256), np.uint8)
    body[:, 0] = 255
    body[:, 1:] = np.frombuffer(raw[: 255 * full], np.uint8).reshape(full, 255)
    rest = raw[255 * full :]
    return body.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


# -- files -------------------------------------------------------------------------------------------------------------


def padded(raw: bytes) -> bytes:
    """``raw`` with zeros up to a positive multiple of WIDTH."""
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def encode_gif(payload: bytes, rows: int = ROWS, delay_ms: int = DELAY_MS) -> bytes:
    """A GIF whose frames, WIDTH wide and at most ``rows`` high, hold ``payload`` one sample a byte."""
    height = len(payload) // WIDTH
    grey = bytes(k for v in range(256) for k in (v, v, v))
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(height, rows), 0xF7, 0, 0), grey]
    for top in range(0, height, rows):
        part = payload[top * WIDTH : (top + rows) * WIDTH]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", 1 << 2, delay_ms // 10, 0, 0))
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0) + b"\x08" + _blocks(lzw_encode(part)))
    return b"".join([*out, b"\x3b"])


@dataclass
class Frame:
    """``samples``: palette indices of the frame's own rectangle; ``canvas``: what is shown, (height, width, RGBA)."""

    left: int
    top: int
    delay_ms: int
    samples: np.ndarray
    canvas: np.ndarray


def _deinterlaced(height: int) -> list[int]:
    return [y for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(start, height, step)]


def decode_gif(raw: bytes) -> Iterator[Frame]:
    """The frames of a GIF, one at a time; GifError where it is none or breaks off, after the frames before."""
    try:
        yield from _frames_of(raw)
    except (IndexError, struct.error, ValueError) as e:
        raise e if isinstance(e, GifError) else GifError("a GIF that breaks off") from e


def _frames_of(raw: bytes) -> Iterator[Frame]:
    if raw[:6] not in (b"GIF87a", b"GIF89a"):
        raise GifError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", raw, 6)
    at = 13

    def palette(flags: int) -> np.ndarray | None:
        nonlocal at
        if not flags & 0x80:
            return None
        n = 2 << (flags & 7)
        colours = np.full((256, 4), 255, np.uint8)
        colours[:n, :3] = np.frombuffer(raw, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
        return colours

    def blocks() -> bytes:
        nonlocal at
        parts = []
        while n := raw[at]:
            parts.append(raw[at + 1 : at + 1 + n])
            at += 1 + n
        at += 1
        return b"".join(parts)

    shared = palette(flags)
    if width * height > MOST_PIXELS:
        raise GifError("a canvas beyond MOST_PIXELS")
    canvas = np.zeros((height, width, 4), np.uint8)
    delay, disposal, transparent = 0, 0, None
    while at < len(raw):
        kind = raw[at]
        at += 1
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = raw[at]
            at += 1
            control = blocks()
            if label == 0xF9:
                packed, hundredths, index = struct.unpack("<BHB", control[:4])
                delay, disposal, transparent = 10 * hundredths, packed >> 2 & 7, index if packed & 1 else None
            continue
        if kind != 0x2C:
            raise GifError("an unknown block")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", raw, at)
        at += 9
        own = palette(flags)
        colours = shared if own is None else own
        if colours is None:
            raise GifError("a frame without a palette")
        bits = raw[at]
        at += 1
        samples = np.frombuffer(lzw_decode(blocks(), bits), np.uint8)
        if len(samples) < w * h:
            raise GifError("a frame with too few samples")
        samples = samples[: w * h].reshape(h, w)
        if flags & 0x40:
            rows = np.empty_like(samples)
            rows[_deinterlaced(h)] = samples
            samples = rows
        before = canvas.copy() if disposal == 3 else None
        seen = samples[: max(0, height - top), : max(0, width - left)]
        area = canvas[top : top + h, left : left + w]
        shown = colours[seen]
        if transparent is not None:
            shown = np.where((seen == transparent)[..., None], area, shown)
        canvas[top : top + h, left : left + w] = shown
        yield Frame(left, top, delay, samples, canvas.copy())
        if disposal == 2:
            canvas[top : top + h, left : left + w] = 0
        elif before is not None:
            canvas = before
        delay, disposal, transparent = 0, 0, None
    raise GifError("a GIF without its end")


def histogram(frame: Frame) -> np.ndarray:
    """Pixels of the frame's rectangle on the canvas by brightness, in BINS bins; those never painted are not counted."""
    h, w = frame.samples.shape
    area = frame.canvas[frame.top : frame.top + h, frame.left : frame.left + w]
    light = area[..., :3].sum(-1, dtype=np.int64) // 3 * BINS // 256
    return np.bincount(light[area[..., 3] > 0].ravel(), minlength=BINS)


# -- columns -----------------------------------------------------------------------------------------------------------

_STORED = "id long, n_bytes long, media binary"


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in parts(b):
            texts = [t.encode() for t in part.column("text").to_pylist()]
            media = pa.array([encode_gif(padded(t)) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(t) for t in texts], pa.int64()), media], ["id", "n_bytes", "media"])


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8 bytes as a GIF. A null text is an empty one: a frame of one row."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_store, _STORED)


_FRAME = [
    ("id", pa.int64()), ("frame", pa.int32()), ("left", pa.int32()), ("top", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("delay_ms", pa.int32()),
    ("samples", pa.binary()), ("rgb", pa.binary()), ("histogram", pa.list_(pa.int64())), ("error", pa.string()),
]


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    one = lambda row: pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(row, _FRAME, strict=True)], [n for n, _ in _FRAME])
    for b in batches:
        for at in range(b.num_rows):
            i, raw, k = b.column("id")[at].as_py(), b.column("media")[at].as_py(), 0
            try:
                if raw is None:
                    raise GifError("no media")
                for f in decode_gif(raw):
                    h, w = f.samples.shape
                    yield one([i, k, f.left, f.top, w, h, f.delay_ms, f.samples.tobytes(), f.canvas[..., :3].tobytes(), histogram(f).tolist(), None])
                    k += 1
            except GifError as e:
                yield one([i, k, *[None] * 8, str(e)])


def frames(media: DataFrame) -> DataFrame:
    """One row per frame of ``media`` (id, media): place, time, samples, the canvas as RGB bytes, colour histogram.

    Defined cases: a medium that is null, no GIF or broken gives the frames before the break and then a row with what is
    wrong in ``error``, all else null but id and frame; it costs no other row. Ids may be null or repeated; media without
    rows give none. Other columns are not read, whatever their names.
    """
    return media.select("id", "media").mapInArrow(
        _frames, "id long, frame int, left int, top int, width int, height int, delay_ms int, samples binary, rgb binary, histogram array<long>, error string"
    )


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for b in batches:
        rows = []
        for i, n, raw in zip(*(b.column(c).to_pylist() for c in ("id", "n_bytes", "media")), strict=True):
            digest, size, tail, bins, many = hashlib.sha256(), 0, b"", np.zeros(BINS, np.int64), 0
            for f in decode_gif(raw):
                samples = f.samples.tobytes()
                digest.update(samples)
                size, tail, bins, many = size + len(samples), samples[-WIDTH:], bins + histogram(f), many + 1
            feature = f"frames={many};histogram=" + ",".join(map(str, bins.tolist()))
            rows.append((i, n, size, digest.hexdigest(), zlib.crc32(tail), len(raw), hashlib.sha256(raw).hexdigest(), feature))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's text stored as a GIF, read back frame by frame and summed up.

    Defined cases: null and empty texts are one row of zeros; equal texts give equal values; a text of any length is stored
    whole, as frames of ROWS rows; ids may be null or repeated, each row gives a row; an empty table gives no rows; other
    columns are not read, whatever their names. ``feature`` is the number of frames and, over all of them, the number of
    samples by brightness in BINS equal bins, the padding included.
    """
    out = store_media(docs, id_col, text_col).mapInArrow(
        _features, "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
    return out.withColumnRenamed("id", id_col)
