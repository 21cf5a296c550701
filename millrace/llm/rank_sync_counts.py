"""Token counts by rank-synchronous array merging.

A batch's texts are cut at white space into chunks; each distinct chunk is normalised and cut into pre-tokens once. All
pre-tokens of the batch lie in one ragged numpy array of symbol ids (values and row numbers). In each round every
sequence finds the lowest rank among its adjacent pairs and merges all occurrences of that pair from left to right;
sequences without a mergeable pair drop out. The symbols that are left are counted by sequence. A merge makes pairs only
with the symbol that it makes, and all merges of that symbol rank after the one that makes it; so no pair of a lower rank
can come up before all occurrences are merged, and the counts are those of one-at-a-time merging.

Counts of chunks are kept from batch to batch in a table that is emptied when it has too many entries or characters, and
chunks that are longer than words are not kept; texts are taken a few megabytes at a time. So memory is bounded by a
parameter and the longest single text.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.support import parts

#: Entries and characters of the table; a chunk longer than KEPT_LENGTH is counted each time it comes.
KEPT, KEPT_CHARACTERS, KEPT_LENGTH = 1_000_000, 16_000_000, 64
LIMIT = 2048
#: Characters of long chunks whose symbols are merged at once.
ROUND_CHARACTERS = 1 << 20


class WordBpe:
    """What the counts need of a tokenizer file with word ends: symbols, merges, normaliser, pre-tokenizer."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_re = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.bytes = _byte_symbols()
        vocab = self.vocab
        left = np.array([vocab[a] for a, _ in model["merges"]], np.int64)
        right = np.array([vocab[b] for _, b in model["merges"]], np.int64)
        made = np.array([vocab[a + b] for a, b in model["merges"]], np.int64)
        self.pairs, self.pair_rank = _hashed(left << 32 | right)
        self.made = made
        self.inner = np.array([vocab[s] for s in self.bytes], np.int64)
        self.last = np.array([vocab[s + self.end] for s in self.bytes], np.int64)
        self.known: dict[str, int] = {}
        self.characters = 0

    def pretokens(self, chunk: str) -> list[str]:
        """Of a chunk without white space or special strings."""
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk)
            # The library lower-cases each character by itself, Python a final sigma by its place.
            chunk = chunk.replace("Σ", "σ")
        return self.split.findall(chunk.lower())

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; the number of merges where a pair is none."""
        pair = left << 32 | right
        at = _slot(pair, len(self.pairs))
        found = self.pairs[at]
        rank = np.where(found == pair, self.pair_rank[at], len(self.made))
        on = np.flatnonzero((found != pair) & (found >= 0))
        while len(on):  # the next slots of those that met another pair
            at[on] = (at[on] + 1) % len(self.pairs)
            found = self.pairs[at[on]]
            hit = found == pair[on]
            rank[on[hit]] = self.pair_rank[at[on[hit]]]
            on = on[~hit & (found >= 0)]
        return rank

    def count_pretokens(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each pre-token (UTF-8, not empty)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last[raw[ends]]
        row = np.repeat(np.arange(len(words)), sizes)
        counts, none = np.zeros(len(words), np.int64), len(self.made)

        def ranked(at: np.ndarray) -> np.ndarray:
            """The ranks of the pairs that begin at ``at``; none at a sequence's end."""
            out = np.full(len(at), none, np.int64)
            inside = np.flatnonzero(at < len(row) - 1)
            inside = inside[row[at[inside]] == row[at[inside] + 1]]
            out[inside] = self.ranks(symbols[at[inside]], symbols[at[inside] + 1])
            return out

        rank = ranked(np.arange(len(symbols)))
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            low = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.r_[starts, len(symbols)])
            alive = low < none
            if not alive.all():
                # Sequences without a pair to merge are done.
                counts[row[starts[~alive]]] = lengths[~alive]
                keep = np.repeat(alive, lengths)
                symbols, row, rank = symbols[keep], row[keep], rank[keep]
                low, lengths = low[alive], lengths[alive]
                if not len(symbols):
                    break
            # In a run of overlapping hits (a pair of two equal symbols) every second one merges, from the left.
            at = np.flatnonzero(rank == np.repeat(low, lengths))
            begins = np.r_[True, np.diff(at) != 1]
            at = at[(at - at[begins][np.cumsum(begins) - 1]) % 2 == 0]
            symbols[at] = self.made[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, row, rank = symbols[keep], row[keep], rank[keep]
            at -= np.arange(len(at))  # where the merged symbols are now
            again = np.union1d(at, at[at > 0] - 1)
            rank[again] = ranked(again)
        return counts

    def learn(self, chunks: list[str]) -> dict[str, int]:
        """The counts of ``chunks``."""
        words, owner = [], []
        for k, chunk in enumerate(chunks):
            for w in self.pretokens(chunk):
                words.append(w.encode("utf-8", "surrogatepass"))
                owner.append(k)
        totals = np.zeros(len(chunks), np.int64)
        if words:
            np.add.at(totals, np.array(owner), self.count_pretokens(words))
        return dict(zip(chunks, totals.tolist(), strict=True))

    def chunks(self, text: str) -> tuple[list[str], int]:
        """The chunks between white space, and the number of special strings between them."""
        special = 0
        if self.special_re and "<|" in text:
            parts = self.special_re.split(text)
            special, text = len(parts) - 1, " ".join(parts)
        # str.split also splits at four separators that a pattern's \\s doesn't have.
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return regex.split(r"\s+", text), special
        return text.split(), special

    def count(self, texts: list[str]) -> list[int]:
        cut = [self.chunks(t) for t in texts]
        if len(self.known) > KEPT or self.characters > KEPT_CHARACTERS:
            self.known, self.characters = {}, 0
        fresh: set[str] = set()
        for chunks, _ in cut:
            fresh.update(chunks)
        new = [c for c in fresh if c not in self.known]
        long = [c for c in new if len(c) > KEPT_LENGTH]
        short = [c for c in new if len(c) <= KEPT_LENGTH]
        for k in range(0, len(short), 50_000):
            self.known.update(self.learn(short[k : k + 50_000]))
        self.characters += sum(map(len, short))
        once: dict[str, int] = {}
        for part in _runs(long, ROUND_CHARACTERS):
            once.update(self.learn(part))
        if not once:
            return [sum(map(self.known.__getitem__, chunks)) + special for chunks, special in cut]
        return [sum(self.known[c] if c in self.known else once[c] for c in chunks) + special for chunks, special in cut]


def _runs(chunks: list[str], characters: int) -> Iterator[list[str]]:
    """``chunks`` in runs of about so many characters, or of one longer chunk."""
    run, held = [], 0
    for c in chunks:
        if run and held + len(c) > characters:
            yield run
            run, held = [], 0
        run.append(c)
        held += len(c)
    if run:
        yield run


def _slot(pair: np.ndarray, size: int) -> np.ndarray:
    return ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & (size - 1)


def _hashed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An open table of ``keys`` (its size a power of two, at most a quarter full; -1: empty) and their positions."""
    size = 1 << max(4, int(4 * len(keys)).bit_length())
    table, position = np.full(size, -1, np.int64), np.zeros(size, np.int64)
    for k, (key, at) in enumerate(zip(keys.tolist(), _slot(keys, size).tolist(), strict=True)):
        while table[at] >= 0:
            at = (at + 1) % size
        table[at], position[at] = key, k
    return table, position


def _byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@functools.lru_cache(2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for b in batches:
            counts = [n for part in parts(b) for n in bpe.count(part.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_bytes"), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row, with ``path`` the tokenizer file, readable on every executor.

    Defined cases: a null text is an empty one and has no tokens; ids may be null or repeated, each row gives a row; a
    text of any length is counted whole; an empty table gives no rows. Other columns are not read, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    counted = rows.mapInArrow(_counted(path), "id long, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
