"""WARC, GIF and the pipeline."""

import hashlib
import io
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_dedup import brute_lines, brute_roots, documents, plain_fingerprint, same
from test_text_ops import VOCABULARY, plain_secrets, texts_of
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import bin_completion, gif_media, warc
from millrace.llm.gif_media import decode_gif, encode_gif, histogram, lzw_decode, lzw_encode, padded

# -- WARC --------------------------------------------------------------------------------------------------------------


def pages(spark, rows):
    return spark.createDataFrame([(i, f"https://e.org/{i} x\ny" if i else None, h) for i, h in rows], "page_id long, url string, html string")


def test_archives(spark):
    big, bigger = "<p>é</p>" * 200, "x" * 300_000
    rows = [(1, big), (2, big), (3, "small"), (4, "small"), (5, None), (6, ""), (7, bigger), (8, "y" * 1000), (9, "y" * 1000), (10, big), (None, big), (11, "z" * 999), (12, "z" * 999), (10, big), (13, "a\r\n\r\nb"), (None, "n" * 1500), (None, "n" * 1500)]
    rows += [(100 + k, "a page that very many rows have " * 40) for k in range(150)]
    got = warc.archive_pages(pages(spark, rows).withColumns({"top": F.lit(1), "KEY": F.lit(2), "payload": F.lit(3)})).collect()
    groups = defaultdict(list)
    for i, h in rows:
        groups[h or ""].append(i)
    want = []
    for i, h in rows:
        raw = (h or "").encode()
        top = max((x for x in groups[h or ""] if x is not None), default=None)
        again = len(raw) >= 1000 and i != top
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", top if again else None))
    same(got, want)
    assert warc.archive_pages(pages(spark, [])).count() == 0


def test_reader_checks_what_it_reads():
    records = [warc.write_record(1, "u", b"abc" * 50_000, None, False), warc.write_record(2, None, b"", None, False), warc.write_record(3, "u", b"abc" * 50_000, 1, True)]
    found = list(warc.read_records(io.BytesIO(b"".join(records))))
    assert [(f["warc-type"], len(p), n) for f, _, p, n in found] == [("response", 150_000, 150_000), ("response", 0, 0), ("revisit", 0, 0)]
    assert [(p, n) for _, _, p, n in warc.read_records(io.BytesIO(b"".join(records)), False)] == [(None, 150_000), (None, 0), (None, 0)]
    plain = zlib.decompress(records[0], 31)

    def broken(raw):
        z = zlib.compressobj(1, zlib.DEFLATED, 31)
        return z.compress(raw) + z.flush()

    for bad in (broken(plain.replace(b"abcabc", b"abcabd", 1)), broken(plain[:-10]), broken(plain + b"x"), records[0][:-20], broken(b"HTTP/1.1\r\n\r\n")):
        for with_payload in (True, False):
            with pytest.raises(warc.WarcError):
                list(warc.read_records(io.BytesIO(bad), with_payload))


# -- GIF ---------------------------------------------------------------------------------------------------------------


def test_code_streams():
    rng = random.Random(1)
    cases = [b"", b"a", b"a" * 64, b"ab" * 9000, bytes(range(256)) * 200, b"\0" * 300_000, rng.randbytes(70_000), bytes(rng.choice(b"abc ") for _ in range(120_000))]
    assert all(lzw_decode(lzw_encode(c)) == c for c in cases)


def test_payloads():
    for n in [*range(130), 64 * 1024, 64 * 1024 + 1, 200_000]:
        raw = random.Random(n).randbytes(n)
        own = padded(raw)
        assert len(own) % 64 == 0 and own.startswith(raw) and len(own) - n <= 64 and own
        frames = list(decode_gif(encode_gif(own)))
        assert b"".join(f.samples.tobytes() for f in frames) == own
        assert sum(histogram(f).sum() for f in frames) == len(own)
        assert all(f.delay_ms == 40 for f in frames)


def image(left, top, w, h, samples, disposal=0, transparent=None, delay=7, palette=None, interlace=False):
    control = b"\x21\xf9\x04" + struct.pack("<BHBB", disposal << 2 | (transparent is not None), delay, transparent or 0, 0)
    flags = (0x80 | 7 if palette else 0) | (0x40 if interlace else 0)
    return control + b"\x2c" + struct.pack("<HHHHB", left, top, w, h, flags) + (palette or b"") + b"\x08" + gif_media._blocks(lzw_encode(bytes(samples)))


def test_frames_follow_disposal_and_transparency():
    colours = bytes(x for k in range(256) for x in (k, 0, 255 - k))
    other = bytes(x for k in range(256) for x in (0, k, 0))
    head = b"GIF89a" + struct.pack("<HHBBB", 4, 4, 0xF7, 0, 0) + colours + b"\x21\xfe\x03abc\x00"
    raw = head + image(0, 0, 4, 4, [1] * 16) + image(1, 1, 2, 2, [5, 9, 9, 5], 3, 9) + image(0, 0, 1, 1, [7], 2) + image(3, 3, 1, 1, [8], palette=other) + b"\x3b"
    a, b, c, d = list(decode_gif(raw))
    red = lambda f: f.canvas[..., 0].tolist()
    assert red(a) == [[1] * 4] * 4
    assert red(b) == [[1] * 4, [1, 5, 1, 1], [1, 1, 5, 1], [1] * 4]
    assert red(c) == [[7, 1, 1, 1]] + [[1] * 4] * 3  # the frame before was undone
    assert d.canvas[0, 0, 3] == 0 and d.canvas[3, 3].tolist() == [0, 8, 0, 255]  # cleared, and a palette of its own
    assert (a.delay_ms, histogram(c).sum()) == (70, 1)
    rows = [0, 4, 2, 6, 1, 3, 5, 7]
    laced = b"GIF89a" + struct.pack("<HHBBB", 1, 8, 0xF7, 0, 0) + colours + image(0, 0, 1, 8, rows, interlace=True) + b"\x3b"
    assert next(decode_gif(laced)).samples.ravel().tolist() == list(range(8))
    huge = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0)
    for bad in (b"PNG", b"GIF89a", head, head + b"\x2c" + struct.pack("<HHHHB", 0, 0, 9, 9, 0) + b"\x08\x00", huge, head[:40], *(raw[:n] for n in range(780, len(raw) - 1))):
        with pytest.raises(gif_media.GifError):
            list(decode_gif(bad))


def test_broken_media_cost_no_other_row(spark):
    good = encode_gif(padded(b"abc" * 50))
    rows = [(1, good), (2, None), (3, good[:-30]), (None, b""), (4, good), (4, good)]
    media = spark.createDataFrame(rows, "id long, media binary").withColumns({"frame": F.lit(1), "error": F.lit("x")})
    got = gif_media.frames(media).collect()
    assert sorted((r["id"] or 0, r["frame"], r["error"] is None) for r in got) == [(0, 0, False), (1, 0, True), (2, 0, False), (3, 0, False), (4, 0, True), (4, 0, True)]
    assert gif_media.frames(media.limit(0)).count() == 0


def read_gif(raw):
    """The samples of each frame, read code by code and bit by bit, of a GIF with a global palette of 256 greys."""
    at, out = 13 + 768, []
    assert raw[10] & 0x87 == 0x87 and raw[13:at] == bytes(v for k in range(256) for v in (k, k, k))
    while raw[at] != 0x3B:
        if raw[at] == 0x21:
            at += 2
        else:
            size = struct.unpack_from("<HH", raw, at + 5)
            at += 11
        body = b""
        while raw[at]:
            body += raw[at + 1 : at + 1 + raw[at]]
            at += 1 + raw[at]
        at += 1
        if len(body) == 4 and raw[at] == 0x2C and body[0] == 4:
            continue
        bits, got, width, table, last, k = int.from_bytes(body, "little"), bytearray(), 9, [], b"", 0
        while True:
            code = bits >> k & (1 << width) - 1
            k += width
            if code == 257:
                break
            if code == 256:
                table, width, last = [bytes([v]) for v in range(256)] + [b"", b""], 9, b""
                continue
            entry = table[code] if code < len(table) else last + last[:1]
            if last and len(table) < 4096:
                table.append(last + entry[:1])
            got, last = got + entry, entry
            if len(table) == 1 << width and width < 12:
                width += 1
        assert len(got) == size[0] * size[1]
        out.append(bytes(got))
    return out


def test_media_columns(spark):
    rows = [(1, "abc"), (2, None), (3, ""), (4, "é" * 32), (5, "x" * 100_000), (None, "abc"), (1, "abc")]
    docs = documents(spark, rows)
    got = gif_media.media_features(docs.withColumns({"media": F.lit(1), "ID": F.lit(2), "n_bytes": F.lit(3)})).collect()
    assert gif_media.media_features(docs.limit(0)).count() == 0
    for (i, t), r in zip(sorted(rows, key=repr), sorted(got, key=lambda r: repr((r["doc_id"], next(t for k, t in rows if k == r["doc_id"])))), strict=True):
        own = padded((t or "").encode())
        stored = encode_gif(own)
        want = (i, len((t or "").encode()), len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-64:]), len(stored), hashlib.sha256(stored).hexdigest())
        assert tuple(r)[:7] == want
        read = read_gif(stored)
        assert b"".join(read) == own
        bins = Counter(8 * v // 256 for v in own)
        assert r["feature"] == f"frames={len(read)};histogram=" + ",".join(str(bins[k]) for k in range(8))
    frames = gif_media.frames(gif_media.store_media(docs.filter("doc_id = 5"))).orderBy("frame").collect()
    assert [(f["frame"], f["height"], len(f["rgb"])) for f in frames] == [(0, 1024, 64 * 1024 * 3), (1, 539, 64 * 1024 * 3)]
    assert np.array([f["histogram"] for f in frames]).sum() == 100_032


# -- pipeline ----------------------------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    rng = random.Random(9)
    langs = sorted(VOCABULARY)
    texts = ["\n".join(texts_of(rng, langs[k % 3], rng.randint(20, 60)) for _ in range(3)) for k in range(60)]
    for k in range(6, 12):
        texts[k] += "\nthis line is on some documents of the corpus"
    texts[20] += " token=abcdef123456"
    texts += [texts[3], texts[4] + " ", "123 456", "", None]
    rows = list(enumerate(texts))
    spark.createDataFrame([(i, t, langs[i % 3] if i < 60 else None, "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = rows
    for name, apply in corpus_pipeline.STAGES[:4]:
        before = kept
        docs = corpus_pipeline.stage(apply(spark, docs, str(tmp_path)), name)
        found = {r["doc_id"]: r for r in docs.collect()}
        kept = sorted((i, r["text"]) for i, r in found.items())
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "language_id":
            assert kept == [(i, t) for i, t in rows if i < 62]
        elif name == "line_dedup":
            assert kept == [(i, t) for i, t, _, _ in brute_lines(before)]
            assert all(r["n_chars"] == len(r["text"]) for r in found.values())
        elif name == "near_dedup":
            root = brute_roots([plain_fingerprint(t) for _, t in before]).tolist()
            assert kept == [x for k, x in enumerate(before) if root[k] == k]
        else:
            assert [i for i, _ in kept] == [i for i, _ in before]
            assert [plain_secrets(t) for _, t in kept] == [[]] * len(kept)
            assert [t for i, t in kept if i != 20] == [t for i, t in before if i != 20]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = []
    for i, t in kept:
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        for k, at in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[at : first if k == 0 else at + 1024]
            pieces.append((i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    same([tuple(r)[:5] for r in packed], pieces)
    taken = Counter((r["sequence_id"], k) for r in packed for k in range(r["offset"], r["offset"] + r["length"]))
    ends = Counter(s for s, _ in taken)
    assert set(taken.values()) == {1} and all((s, n - 1) in taken and n <= 1024 for s, n in ends.items())
    assert len(ends) == sum(n for _, n in bin_completion.bin_completion(Counter(p[3] for p in pieces))) <= -(-sum(p[3] for p in pieces) // 1024) + 1
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_on_odd_tables(spark):
    """Nulls in any column, empty and long texts, repeated rows, an empty table, columns that are named like the stages' own."""
    rng = random.Random(4)
    langs = sorted(VOCABULARY)
    rows = [(k, texts_of(rng, langs[k % 3], rng.randint(20, 60)), langs[k % 3], None if k % 4 else "s", None if k % 5 else 7) for k in range(40)]
    rows += [rows[3]] * 3 + [(None, rows[5][1], None, None, None)] * 2 + [(50, None, "en", "s", 0), (51, "", None, None, None), (52, texts_of(rng, "en", 30_000) + " token=abcdef123456", None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    extra = {c: F.lit(k) for k, c in enumerate(("score", "LANG_PRED", "n_lines", "N_dropped", "findings", "fp", "id", "th", "root", "blob", "found", "a.b", "score_aside"))}
    docs = docs.withColumns(extra)
    many = []
    for name, apply in corpus_pipeline.STAGES[:4]:
        assert apply(spark, docs.limit(0), "").count() == 0, name
        docs = corpus_pipeline.stage(apply(spark, docs, ""), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *extra], name
        found = docs.collect()
        assert {tuple(r)[5:] for r in found} == {tuple(range(len(extra)))}, name
        many.append(len(found))
    assert many == [46, 46, 41, 41]
    assert next(r["text"] for r in found if r["doc_id"] == 52).endswith(" [SECRET]")
    assert corpus_pipeline.packing(spark, docs, "").select("doc_id").distinct().count() == 41
    assert corpus_pipeline.packing(spark, docs.limit(0), "").count() == 0
