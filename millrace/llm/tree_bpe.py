"""Byte-level BPE encoding by tree concatenation, and decoding.

A text is halved again and again, wherever the halves happen to meet, down to leaves of ``SPAN`` characters (a third of an
ordinary document); the leaves are encoded by themselves and joined in pairs, level by level. To join two encoded halves,
a window of text around the place where they meet is encoded again. It grows, to the next cut that no pre-token crosses
(before white space that follows a visible character, where the pre-token pattern always begins anew), until both sides
agree with it exactly: a cut falls between two of a side's own tokens, and the window's outermost token is the side's own.
A side without such a cut is encoded again as a whole. The tokens outside the window stay.

A pre-token without such cuts that is longer than ``LEAF`` (thousands of letters without a space) is a tree of bytes: the
last k tokens of the left and the first k of the right are decoded and encoded again; if the result still begins with the
left's own token and ends with the right's, all adjacent pairs of the joined tokens are pairs that BPE itself leaves side
by side, and a sequence of tokens is the encoding of its bytes exactly if all its adjacent pairs are such. Otherwise k
doubles.

Leaves and joins of a level do not depend on each other. Texts longer than ``SPREAD`` are dealt by leaf: their leaves are
rows that all tasks encode, and come together by document for the joins only.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm.rank_sync_counts import _byte_symbols
from millrace.llm.support import parts

LEAF, WINDOW, SPAN, SPREAD = 1024, 8, 512, 1 << 16
_CUT = re.compile(r"(?<=\S)(?=[ \n\r\t])")
_BLANK = re.compile(r"\s{%d}" % LEAF)
#: Pre-tokens of these characters are the same in every edition of Unicode.
_LATIN = re.compile(r"[\x00-ɏ]*\Z")


class TreeBpe:
    """Encoder and decoder of one byte-level tokenizer file; ids are bytes, little-endian unsigned 32 bits each."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        back = {s: b for b, s in enumerate(_byte_symbols())}
        table = {i: bytes(back[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in self.special}
        ranks = {b: i for i, b in table.items()}
        self.base = tiktoken.Encoding("base", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        for t in spec["added_tokens"]:
            table[t["id"]] = t["content"].encode()
        self.table = [table.get(i, b"") for i in range(max(table) + 1)]

    @functools.cached_property
    def library(self) -> Tokenizer:
        """Loaded where a text has special strings or rare characters."""
        library = Tokenizer.from_file(self.path)
        library.no_truncation()
        library.no_padding()
        return library

    # -- pieces ------------------------------------------------------------------------------------------------------

    def _ids(self, piece: str) -> bytes:
        """Of a piece between two cuts."""
        if any(s in piece for s in self.special):
            ids = self.library.encode(piece, add_special_tokens=False).ids
        elif len(piece) > LEAF:
            # The library's own pre-tokens are strings in which each character stands for a byte.
            return b"".join(self.unsplit(w) for w in self._pretokens(piece))
        elif _LATIN.match(piece):
            ids = self.base.encode_ordinary(piece)
        else:
            ids = self.library.encode(piece, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def _pretokens(self, piece: str) -> list[bytes]:
        return [piece[a:b].encode() for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(piece)]

    def unsplit(self, word: bytes, leaf: int = LEAF, window: int = WINDOW) -> bytes:
        """Ids of one pre-token of any length."""
        parts = [self.base._encode_single_piece(word[k : k + leaf]) for k in range(0, len(word), leaf)]
        while len(parts) > 1:
            joined = [self.join(a, b, window) for a, b in zip(parts[::2], parts[1::2], strict=False)]
            parts = joined + parts[len(parts) - len(parts) % 2 :]
        return np.array(parts[0] if parts else [], "<u4").tobytes()

    def join(self, left: list[int], right: list[int], window: int = WINDOW) -> list[int]:
        """The encoding of two encoded neighbours' bytes in one pre-token."""
        while True:
            a, b = left[-window:], right[:window]
            again = self.base._encode_single_piece(b"".join(map(self.table.__getitem__, a + b)))
            if (len(a) == len(left) or again[0] == a[0]) and (len(b) == len(right) or again[-1] == b[-1]):
                return left[: len(left) - len(a)] + again + right[len(b) :]
            window *= 2

    # -- texts -------------------------------------------------------------------------------------------------------

    def encode(self, text: str, span: int = SPAN) -> bytes:
        """Ids of a whole text."""
        leaves = [text[k : k + span] for k in range(0, len(text), span)]
        return self.concatenate(leaves, [self.leaf(x) for x in leaves])

    def leaf(self, text: str) -> bytes:
        """Of a text that is encoded at once; without long pieces, special strings or rare characters it needs no cutting."""
        if not any(map(text.__contains__, self.special)) and (text.isascii() or _LATIN.match(text)) and (len(text) <= LEAF or max(map(len, text.split()), default=0) <= LEAF and not _BLANK.search(text)):
            return np.array(self.base.encode_ordinary(text), "<u4").tobytes()
        return b"".join(map(self._ids, _CUT.split(text)))

    def concatenate(self, texts: list[str], ids: list[bytes]) -> bytes:
        """The ids of neighbouring texts' concatenation."""
        while len(ids) > 1:
            pairs = range(0, len(ids) - 1, 2)
            ids = [self.meet(texts[k], ids[k], texts[k + 1], ids[k + 1]) for k in pairs] + ids[len(ids) - len(ids) % 2 :]
            texts = [texts[k] + texts[k + 1] for k in pairs] + texts[len(texts) - len(texts) % 2 :]
        return ids[0] if ids else b""

    def meet(self, left: str, left_ids: bytes, right: str, right_ids: bytes, window: int = 24) -> bytes:
        """The ids of ``left + right``."""
        lefts, rights = self._cuts_before(left, left_ids, window), self._cuts_after(right, right_ids, window)
        (begin, before), (end, after) = next(lefts), next(rights)
        while True:
            again = self.leaf(left[begin:] + right[:end])
            # A side that is taken whole has nothing left to agree with.
            agree_left = begin == 0 or again[:4] == left_ids[len(left_ids) - before :][:4]
            agree_right = end == len(right) or again[-4:] == right_ids[:after][-4:]
            if agree_left and agree_right:
                return left_ids[: len(left_ids) - before] + again + right_ids[after:]
            if not agree_left:
                begin, before = next(lefts)
            if not agree_right:
                end, after = next(rights)

    def _cuts_before(self, left: str, ids: bytes, window: int) -> Iterator[tuple[int, int]]:
        """(place of the cut, bytes of ``ids`` after it), each farther from the end than the one before; last the whole."""
        edge = len(left)
        while edge > 0:
            low = max(0, len(left) - window)
            # A cut needs the character before and after it, so the window's first place has none.
            for at in reversed([m.start() for m in _CUT.finditer(left, low)]):
                if 0 < at < edge and (many := self._tokens_of(ids, len(left[at:].encode()), from_end=True)) is not None:
                    yield at, many
                    edge = at
            edge, window = min(edge, low), window * 2
        yield 0, len(ids)

    def _cuts_after(self, right: str, ids: bytes, window: int) -> Iterator[tuple[int, int]]:
        edge = 0
        while edge < len(right):
            high = min(len(right), window)
            # A place whose next character may be beyond the window is looked at with the next one.
            for at in [m.start() for m in _CUT.finditer(right, edge, high)]:
                if at > edge and (many := self._tokens_of(ids, len(right[:at].encode()), from_end=False)) is not None:
                    yield at, many
                    edge = at
            if high == len(right):
                break
            edge, window = max(edge, high - 2), window * 2
        yield len(right), len(ids)

    def _tokens_of(self, ids: bytes, size: int, from_end: bool) -> int | None:
        """Bytes of ``ids`` at one end that stand for exactly ``size`` bytes of text; None if a token crosses there."""
        k, n = 0, len(ids) // 4
        while size > 0 and k < n:
            at = 4 * (n - 1 - k if from_end else k)
            size -= len(self.table[int.from_bytes(ids[at : at + 4], "little")])
            k += 1
        return None if size else 4 * k

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


#: The pre-token pattern of byte-level BPE, a fixed value of the format.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: From batches of (id, ids) to others.
Finish = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


@functools.lru_cache(2)
def tree_bpe(path: str) -> TreeBpe:
    return TreeBpe(path)


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tree_bpe(path)
        for b in batches:
            for part in parts(b):
                ids = [bpe.encode(t) for t in part.column("text").to_pylist()]
                at = part.schema.get_field_index("text")
                yield part.set_column(at, pa.field("ids", pa.binary()), pa.array(ids, pa.binary()))

    return run


def _leaves(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tree_bpe(path)
        for b in batches:
            for part in parts(b):
                yield part.append_column("ids", pa.array([bpe.leaf(t) for t in part.column("text").to_pylist()], pa.binary()))

    return run


def _joined(path: str, finish: Finish):
    def run(leaves: pa.Table) -> pa.Table:
        own = leaves.sort_by("number")
        ids = tree_bpe(path).concatenate(own.column("text").to_pylist(), own.column("ids").to_pylist())
        whole = pa.RecordBatch.from_arrays([own.column("id")[:1].combine_chunks(), pa.array([ids], pa.binary())], ["id", "ids"])
        return pa.Table.from_batches(list(finish(iter([whole]))))

    return run


def encode_documents(rows: DataFrame, path: str, finish: Finish = iter, schema: str = "id long, ids binary", span: int = SPAN, spread: int = SPREAD) -> DataFrame:
    """(id, ids) of ``rows`` (id long, text string, not null); ids are binary, unsigned 32 bits each.

    ``finish`` turns the batches of (id, ids) into those of ``schema`` within the same Python worker, so that a task has
    one worker's memory and the ids need not leave it.
    """
    encode = _encoded(path)
    short = rows.filter(F.length("text") <= spread).mapInArrow(lambda batches: finish(encode(batches)), schema)
    # A text's leaves meet again in one task, as the row that they are of does.
    long = rows.filter(F.length("text") > spread).withColumn("row", F.monotonically_increasing_id())
    starts = F.sequence(F.lit(0), F.ceil(F.length("text") / F.lit(span)).cast("int") - 1)
    leaves = long.select("row", "id", F.posexplode(F.transform(starts, lambda k: F.substring(F.col("text"), k * span + 1, F.lit(span)))).alias("number", "text"))
    encoded = leaves.repartition("row", "number").mapInArrow(_leaves(path), "row long, id long, number int, text string, ids binary")
    return short.unionByName(encoded.groupBy("row").applyInArrow(_joined(path, finish), schema))


def _digests(path: str) -> Finish:
    names, types = ["id", "n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tree_bpe(path)
        for b in batches:
            rows = [(i, len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(bpe.decode(x).encode()).hexdigest()) for i, x in zip(b.column("id").to_pylist(), b.column("ids").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    return run


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each row.

    Defined cases: a null text is an empty one with no ids; ids may be null or repeated, each row gives a row; a text of any
    length is encoded whole; an empty table gives no rows. Other columns are not read, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = encode_documents(rows, path, _digests(path), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
