"""Spelling variants by dense prefix-suffix tiles.

Two different words are one edit apart if their common prefix and common suffix together reach the longer length less one.
Then one of the two reaches half of that, so words are brought together by the halves they can share: for each longer
length M (a word's own and the next), a word has a key of its first and one of its last ceil((M - 1) / 2) code points.
A pair is counted under its prefix key if the common prefix is that long, else under its suffix key, so exactly once.

The words of a key are padded matrices of code points, aligned left and right, which are compared block by block: a tile is
all pairs of two blocks, whose common prefixes and suffixes are running products along the matrices. Keys with more than
``CELL`` words are cut into blocks by a hash and each pair of blocks is a task. A tile returns, for each word, the number of
near words and the best one, never pairs.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.support import LOWER, UPPER, parts, stage

RUN = re.compile(r"[A-Za-zÀ-ÿ]+")
_FOLD = str.maketrans(UPPER, LOWER)
#: One run in DAMAGED loses a code point; words count from LETTERS and TIMES on; a form is RATIO times as frequent.
DAMAGED, LETTERS, TIMES, RATIO = 199, 6, 5, 5
#: Different words of a task that are counted before they are sent on.
HELD = 200_000
#: Words of a key from which it is cut; small keys to a task; code points of a tile.
CELL, TASK, TILE = 4000, 20_000, 1 << 22


def runs(doc_id: str, text: str | None) -> Iterator[tuple[str, int]]:
    """The words of a text after damage, each with a count; a word may come several times."""
    for run, n in Counter(RUN.findall((text or "").translate(_FOLD))).items():
        h = zlib.crc32(f"{doc_id}:{run}".encode())
        if h % DAMAGED == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, n


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()
    flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
    for b in batches:
        for part in parts(b):
            for i, t in zip(part.column("id").to_pylist(), part.column("text").to_pylist(), strict=True):
                for word, n in runs(i, t):
                    if len(word) >= LETTERS:
                        held[word] += n
            if len(held) >= HELD:
                yield flush()
                held.clear()
    if held:
        yield flush()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words of at least LETTERS code points with at least TIMES occurrences."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= TIMES)


# -- tiles -------------------------------------------------------------------------------------------------------------


def _points(words: list[str], width: int, right: bool) -> np.ndarray:
    """The code points of ``words``, padded to ``width`` with what no code point is."""
    padded = "".join(w.rjust(width, "\0") if right else w.ljust(width, "\0") for w in words)
    return np.frombuffer(padded.encode("utf-32-le"), np.uint32).reshape(len(words), width)


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The lengths of the common prefixes of all rows of ``a`` with all rows of ``b``."""
    out = np.zeros((len(a), len(b)), np.int32)
    going = np.ones((len(a), len(b)), bool)
    for k in range(a.shape[1]):
        going &= a[:, k][:, None] == b[:, k][None, :]
        if not going.any():
            break
        out += going
    return out


class Best:
    """Of each word of a cell the number of near words and the near word that is most frequent (ties: least)."""

    def __init__(self, words: np.ndarray, n: np.ndarray):
        self.words, self.n = words, n
        self.order = np.argsort(np.lexsort((words, -n)))  # places by falling n, then by code points
        self.near, self.best = np.zeros(len(n), np.int64), np.full(len(n), len(n), np.int64)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        for a, b in ((i, j), (j, i)):
            np.add.at(self.near, a, 1)
            np.minimum.at(self.best, a, self.order[b])

    def rows(self) -> pd.DataFrame:
        on = np.flatnonzero(self.near)
        form = np.argsort(self.order)[self.best[on]]
        return pd.DataFrame({"word": self.words[on], "near": self.near[on], "form": self.words[form], "form_n": self.n[form]})


def _tiles(best: Best, words: list[str], at: np.ndarray, block: np.ndarray, longer: int, prefix: bool) -> None:
    """Tell ``best`` the near pairs of one key's words (at: their places): of two blocks those between them, else all."""
    half, size = longer // 2, np.array([len(w) for w in words])  # longer // 2 = ceil((longer - 1) / 2)
    left, right = _points(words, longer, False), _points(words, longer, True)[:, ::-1]
    step = max(1, min(len(words), int((TILE // longer) ** 0.5)))
    one = block.min() == block.max()
    for r in range(0, len(words), step):
        for c in range(r, len(words), step):
            x, y = slice(r, r + step), slice(c, c + step)
            # The padding must not count: the shorter word ends the common part.
            least = np.minimum(size[x][:, None], size[y][None, :])
            p = np.minimum(_common(left[x], left[y]), least)
            near = np.maximum(size[x][:, None], size[y][None, :]) == longer
            near &= (p >= half) if prefix else (p < half)
            if not near.any():
                continue
            s = np.minimum(_common(right[x], right[y]), least)
            near &= p + s >= longer - 1
            if not one:
                near &= block[x][:, None] != block[y][None, :]
            i, j = np.nonzero(near)
            i, j = i + r, j + c
            ahead = i < j
            best.add(at[i[ahead]], at[j[ahead]])


def _compare(cell: pd.DataFrame) -> pd.DataFrame:
    """Near words of one cell: several small keys, or two blocks of one."""
    words = cell["word"].to_numpy(object)
    names, place = np.unique(words, return_inverse=True)
    n = np.zeros(len(names), np.int64)
    n[place] = cell["n"].to_numpy()
    best = Best(names, n)
    longer, prefix, key, block = (cell[c].to_numpy() for c in ("longer", "prefix", "key", "own"))
    order = np.lexsort((key, prefix, longer))
    cuts = np.flatnonzero((np.diff(key[order]) != 0) | (np.diff(prefix[order].astype(np.int8)) != 0) | (np.diff(longer[order]) != 0)) + 1
    for group in np.split(order, cuts):
        if len(group) > 1:
            _tiles(best, words[group].tolist(), place[group], block[group], int(longer[group[0]]), bool(prefix[group[0]]))
    return best.rows()


def near_words(counts: DataFrame, cell: int = CELL, task: int = TASK) -> DataFrame:
    """(word, n_near, form, form_n) of the words of ``counts`` (word, n; a written table) that have near words: the most
    frequent near word, ties to the least in code-point order."""
    length, half = F.length("word"), F.floor(F.col("longer") / 2).cast("int")
    keyed = counts.select("word", "n", F.explode(F.array(length, length + 1)).alias("longer")).select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("prefix"))
    keyed = keyed.withColumn("key", F.xxhash64(F.when(F.col("prefix"), F.substring("word", F.lit(1), half)).otherwise(F.substring("word", -half, half))))
    keyed = stage(keyed, "keyed")
    key = ["longer", "prefix", "key"]
    sizes = stage(keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("held")).filter("held > 1"), "keys")
    # Keys are bounded by the words that differ in their other half only; no share of all words has one key.
    rows = keyed.join(sizes, key)
    many = max(1, -(-keyed.count() // task))
    blocks = F.when(F.col("held") > cell, F.ceil(2 * F.col("held") / cell)).otherwise(1).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    deal = F.when(F.col("blocks") > 1, F.xxhash64(*key)).otherwise(F.pmod(F.xxhash64(*key), F.lit(many)))
    cells = rows.groupBy(deal.alias("deal"), F.col("blocks").alias("of"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    found = cells.applyInPandas(_compare, "word string, near long, form string, form_n long")
    first = F.min(F.struct((-F.col("form_n")).alias("k"), "form")).alias("first")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), first).select("word", "n_near", F.col("first.form").alias("form"), (-F.col("first.k")).alias("form_n"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cell: int = CELL, task: int = TASK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word that is frequent enough.

    Defined cases: a null text has no words, a null id is the empty string in the damage; a text or a run of any length is
    read whole; rows that repeat an id each count; of near words with the same n the least in code-point order is the
    form; a word without a form is its own root; an empty table gives no rows. Other columns are not read.
    """
    counts = stage(word_counts(docs, id_col, text_col), "words")
    near = near_words(counts, cell, task)
    enough = F.col("form_n") >= RATIO * F.col("n")
    words = counts.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("form")).alias("form"), F.when(enough, F.col("form_n")).alias("form_n"))
    words = stage(words, "forms")
    # A form is RATIO times as frequent, so chains are short: log of the largest count; each turn halves what is left.
    up = stage(words.filter("form is not null").select("word", F.col("form").alias("root")), "up")
    while True:
        step = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = stage(up.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "up")
        up = after.select("word", "root")
        if after.filter("moved").isEmpty():
            break
    return words.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
