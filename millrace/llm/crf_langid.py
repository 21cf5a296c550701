"""Language identification with a linear-chain conditional random field.

Words are the states' positions and languages the states. A word's features are its affixes, its letter n-grams and its
place in the lexicons of frequent words of each language, hashed into one weight table; transitions between languages
are learned with them, from whole texts of which every other one is a mosaic of two languages, so that the field follows
text that switches language. Forward-backward over the whole text gives each word's distribution, a document's is the mean
over its words.

A text is one chain, however long. It is worked on in blocks of ``BLOCK`` words: the product of a block's transfer matrices
tells what a message from before the block is after it, so messages pass from block to block first, and then all words of
all blocks follow at once. That is the forward-backward of the whole chain, without approximation.

The model is fitted on the driver on a bounded sample of rows: of each label at most ``PER_LANGUAGE`` labelled documents, and
fewer of each (one at least) where all would be more than ``ROWS``, drawn by a hash of their id, each as a whole.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain as flatten

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from millrace.llm.support import columns, parts

ROWS, PER_LANGUAGE, BLOCK = 10_000, 100, 32
#: Of one step of the fit: about BATCH words, in whole texts.
SLOTS, LEXICON, EPOCHS, BATCH, RATE, PENALTY = 1 << 17, 200, 3, 2048, 0.3, 1e-5
#: Words and characters whose emissions a task keeps.
KEPT, KEPT_CHARACTERS = 800_000, 12_000_000
#: Words (and their characters) whose features are looked up at once; blocks that are worked on at once.
WORDS, CHARACTERS, BLOCKS = 8192, 1 << 17, 4096
_MIX = np.uint64(0x9E3779B97F4A7C15)
UNKNOWN = "und"


def letters(token: str) -> str:
    return token.lower() if token.isalpha() else "".join(c for c in token.lower() if c.isalpha())


def features(words: list[str], lexicons: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The places of all words' features in the weight table, word by word, and how many each word has.

    Letter n-grams within the word's marks, affixes of up to four letters, the word if it is in a lexicon, and which.
    """
    chars = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(len(words)), sizes)
    left = sizes[word] - (np.arange(len(chars)) - starts[word])  # characters from here to the word's end
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def add(at: np.ndarray, length: int, kind: int) -> None:
        h = np.full(len(at), kind, np.uint64)
        for k in range(length):
            h = (h ^ chars[at + k]) * _MIX
        found.append((word[at], (h >> np.uint64(40)).astype(np.int64) % SLOTS))

    for n in (2, 3):
        add(np.flatnonzero(left >= n), n, n)
    for n in (1, 2, 3, 4):
        own = np.flatnonzero(sizes - 2 >= n)
        add(starts[own] + 1, n, 10 + n)
        add(starts[own] + sizes[own] - 1 - n, n, 20 + n)
    known = [(k, s) for k, w in enumerate(words) if w in lexicons for s in (zlib.crc32(w.encode()) % SLOTS, *lexicons[w])]
    if known:
        found.append(tuple(np.array(known, np.int64).T))
    of, slot = (np.concatenate(x) for x in zip(*found, strict=True))
    return slot[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(words))


def _normal(messages: np.ndarray) -> np.ndarray:
    return messages / messages.sum(-1, keepdims=True)


class Chains:
    """Texts of words, each text a chain, laid out in blocks of BLOCK words. ``text``: each word's text, in order."""

    def __init__(self, text: np.ndarray):
        first = np.r_[True, text[1:] != text[:-1]] if len(text) else np.zeros(0, bool)
        place = np.arange(len(text)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        opens = np.flatnonzero(place % BLOCK == 0)
        self.block, self.place = np.cumsum(place % BLOCK == 0) - 1, place % BLOCK
        self.length = np.diff(np.r_[opens, len(text)])
        #: Whether a block is its text's first, or last.
        self.first = first[opens]
        self.last = np.r_[self.first[1:], True] if len(opens) else self.first
        self.opens = np.r_[opens, len(text)]

    def parts(self) -> Iterator[tuple[slice, slice]]:
        """(blocks, words) that are worked on at once."""
        for k in range(0, len(self.length), BLOCKS):
            end = min(k + BLOCKS, len(self.length))
            yield slice(k, end), slice(self.opens[k], self.opens[end])


def forward_backward(emission: Callable[[slice], np.ndarray], chains: Chains, transition: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Marginals (words, states) of each chain as a whole; with ``pairs`` also the sum of the marginals of neighbours.

    ``emission`` gives the scores (words, states) of a slice of words.
    """
    states, many = len(start), len(chains.length)
    move = np.exp(transition - transition.max())

    def psi_of(blocks: slice, words: slice) -> np.ndarray:
        psi = np.ones((blocks.stop - blocks.start, BLOCK, states))
        own = emission(words)
        psi[chains.block[words] - blocks.start, chains.place[words]] = np.exp(own - own.max(-1, keepdims=True))
        return psi

    # What a block makes of a message: a row vector before its first word's score, times this, is that at its last word.
    through = np.empty((many, states, states))
    for blocks, words in chains.parts():
        psi, length = psi_of(blocks, words), chains.length[blocks]
        q = np.eye(states) * psi[:, 0, None, :]
        for t in range(1, BLOCK):
            on = length > t
            if not on.any():
                break
            q[on] = (q[on] @ move) * psi[on, t, None, :]
            q[on] /= q[on].sum((1, 2), keepdims=True)
        through[blocks] = q
    into, back = np.tile(np.exp(start - start.max()), (many, 1)), np.ones((many, states))
    at = np.flatnonzero(chains.first)
    at = at[~chains.last[at]]
    while len(at):
        into[at + 1] = _normal(np.einsum("nk,nkl->nl", into[at], through[at]) @ move)
        at = at[~chains.last[at + 1]] + 1
    at = np.flatnonzero(chains.last)
    at = at[~chains.first[at]]
    while len(at):
        back[at - 1] = _normal(np.einsum("nkl,nl->nk", through[at], back[at]) @ move.T)
        at = at[~chains.first[at - 1]] - 1

    marginals, sums, edge = np.empty((len(chains.block), states)), np.zeros((states, states)), None
    for blocks, words in chains.parts():
        psi, length = psi_of(blocks, words), chains.length[blocks]
        alpha, beta = np.empty_like(psi), np.empty_like(psi)
        alpha[:, 0] = _normal(into[blocks] * psi[:, 0])
        for t in range(1, BLOCK):
            alpha[:, t] = _normal((alpha[:, t - 1] @ move) * psi[:, t])
        beta[:, -1] = back[blocks]
        for t in range(BLOCK - 2, -1, -1):
            beta[:, t] = np.where((t + 1 < length)[:, None], _normal((psi[:, t + 1] * beta[:, t + 1]) @ move.T), back[blocks])
        where = (chains.block[words] - blocks.start, chains.place[words])
        marginals[words] = _normal((alpha * beta)[where])
        if pairs:
            seen = psi * beta
            both = alpha[:, :-1, :, None] * move * seen[:, 1:, None, :]
            both /= both.sum((-1, -2), keepdims=True)
            sums += (both * (np.arange(1, BLOCK) < length[:, None])[..., None, None]).sum((0, 1))
            # Over the edges of blocks, and of the blocks that are worked on at once.
            ends = alpha[np.arange(len(length)), length - 1]
            left = np.concatenate([ends[:0] if edge is None else edge, ends])
            right = seen[:, 0] if edge is not None else seen[1:, 0]
            inner = ~chains.first[blocks] if edge is not None else ~chains.first[blocks][1:]
            across = left[:-1][inner][:, :, None] * move * right[inner][:, None, :]
            sums += (across / across.sum((-1, -2), keepdims=True)).sum(0)
            edge = ends[-1:]
    return (marginals, sums) if pairs else marginals


@dataclass
class LanguageField:
    """The learned weights; ``known`` keeps emissions of words within a task and is emptied when full."""

    languages: list[str]
    lexicons: dict[str, list[int]]
    weights: np.ndarray
    transition: np.ndarray
    start: np.ndarray
    known: dict[str, int] = field(default_factory=dict)
    rows: list[np.ndarray] = field(default_factory=list)
    characters: int = 0

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "rows": [], "characters": 0}

    def emissions(self, words: list[str]) -> np.ndarray:
        slot, sizes = features(words, self.lexicons)
        return np.add.reduceat(self.weights[slot], np.cumsum(sizes) - sizes, axis=0)

    def _look_up(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """A table of emissions and each token's row there; -1 for a token without letters."""
        if len(self.known) > KEPT or self.characters > KEPT_CHARACTERS:
            self.known, self.rows, self.characters = {}, [], 0
        fresh: set[str] = set()
        for tokens in texts:
            fresh.update(tokens)
        new = [t for t in fresh if t not in self.known]
        self.characters += sum(map(len, new))
        words = [letters(t) for t in new]
        real = [k for k, w in enumerate(words) if w]
        at = sum(map(len, self.rows))
        self.known.update((t, -1) for t in new)
        self.known.update((new[k], at + i) for i, k in enumerate(real))
        if real:
            # In blocks, as a word has some 25 features while it is looked up.
            self.rows = [np.concatenate([*self.rows, *(self.emissions(run).astype(np.float32) for run in _runs([words[k] for k in real]))])]
        flat = np.array(list(map(self.known.__getitem__, flatten.from_iterable(texts))), np.int64)
        return self.rows[0] if self.rows else np.zeros((0, len(self.languages)), np.float32), flat

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each word's distribution and the text that it is of."""
        tokens = [t.split() for t in texts]
        table, row = self._look_up(tokens)
        text = np.repeat(np.arange(len(texts)), [len(t) for t in tokens])[row >= 0]
        row = row[row >= 0]
        if not len(row):
            return np.zeros((0, len(self.languages))), text
        return forward_backward(lambda part: table[row[part]].astype(float), Chains(text), self.transition, self.start), text

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        each, text = self.words(texts)
        count = np.bincount(text, minlength=len(texts))
        total = np.stack([np.bincount(text, each[:, k], len(texts)) for k in range(len(self.languages))], 1)
        best = total.argmax(1)
        score = np.clip(total[np.arange(len(texts)), best] / np.maximum(count, 1), 0, 1)
        return [(self.languages[b], float(s)) if n else (UNKNOWN, 0.0) for b, s, n in zip(best.tolist(), score, count, strict=True)]


def _runs(words: list[str]) -> Iterator[list[str]]:
    """``words`` in runs of at most WORDS and about CHARACTERS characters, or of one longer word."""
    begin = held = 0
    for k, w in enumerate(words):
        if k > begin and (k - begin >= WORDS or held + len(w) > CHARACTERS):
            yield words[begin:k]
            begin, held = k, 0
        held += len(w)
    if begin < len(words):
        yield words[begin:]


def _mosaic(a: list[str], b: list[str], labels: tuple[int, int], rng: np.random.Generator) -> tuple[list[str], list[int]]:
    """All words of two texts, in turns of 4 to 60 words."""
    words, own, left, turn = [], [], [a, b], int(rng.integers(2))
    while left[0] or left[1]:
        if left[turn]:
            n = int(rng.integers(4, 61))
            words += left[turn][:n]
            own += [labels[turn]] * min(n, len(left[turn]))
            left[turn] = left[turn][n:]
        turn = 1 - turn
    return words, own


def fit(texts: dict[str, list[list[str]]], seed: int = 7) -> LanguageField:
    """Learn from the words of whole texts by language: log-likelihood of the field by adaptive gradient steps."""
    languages = sorted(texts)
    many = len(languages)
    rng = np.random.default_rng(seed)
    pools = [[[w for w in map(letters, s) if w] for s in texts[k]] for k in languages]
    pools = [[s for s in p if s] for p in pools]
    counts = [Counter(w for s in p for w in s) for p in pools]
    lexicons: dict[str, list[int]] = {}
    for k, c in enumerate(counts):
        for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicons.setdefault(w, []).append(k)
    model = LanguageField(languages, lexicons, np.zeros((SLOTS, many)), np.zeros((many, many)), np.zeros(many))
    if many < 2 or not any(pools):
        return model
    index = {w: i for i, w in enumerate(dict.fromkeys(w for p in pools for s in p for w in s))}
    looked = [features(run, lexicons) for run in _runs(list(index))]
    own = [x for slot, sizes in looked for x in np.split(slot, np.cumsum(sizes)[:-1])]
    most = max(map(len, pools))
    chains: list[tuple[np.ndarray, np.ndarray]] = []
    for k, pool in enumerate(pools):
        # Every language gets as many texts; every other one is laid out with one of a second language.
        for i in range(most if pool else 0):
            words, labels = pool[i % len(pool)], [k] * len(pool[i % len(pool)])
            other = int(rng.integers(many))
            if i % 2 and pools[other]:
                words, labels = _mosaic(words, pools[other][int(rng.integers(len(pools[other])))], (k, other), rng)
            chains.append((np.array([index[w] for w in words]), np.array(labels)))
    sums = [np.zeros_like(x) + 1e-8 for x in (model.weights, model.transition, model.start)]
    for _ in range(EPOCHS):
        part: list[tuple[np.ndarray, np.ndarray]] = []
        order = rng.permutation(len(chains)).tolist()
        for n, i in enumerate(order):
            part.append(chains[i])
            if sum(len(w) for w, _ in part) < BATCH and n + 1 < len(order):
                continue
            _step(model, sums, part, own)
            part = []
    model.weights = model.weights.astype(np.float32)
    return model


def _step(model: LanguageField, sums: list[np.ndarray], part: list[tuple[np.ndarray, np.ndarray]], own: list[np.ndarray]) -> None:
    """One gradient step on whole chains (words, labels); ``own``: each word's places in the weight table."""
    many, words, labels = len(model.languages), np.concatenate([w for w, _ in part]), np.concatenate([x for _, x in part])
    distinct, word = np.unique(words, return_inverse=True)
    feats = [own[w] for w in distinct.tolist()]
    sizes = np.fromiter(map(len, feats), np.int64, len(feats))
    flat = np.concatenate(feats)
    scores = np.add.reduceat(model.weights[flat], np.r_[0, np.cumsum(sizes)[:-1]], axis=0)
    chains = Chains(np.repeat(np.arange(len(part)), [len(w) for w, _ in part]))
    marginal, both = forward_backward(lambda x: scores[word[x]], chains, model.transition, model.start, pairs=True)
    share = len(words) / BLOCK
    gap = -marginal
    gap[np.arange(len(words)), labels] += 1
    by_word = np.stack([np.bincount(word, gap[:, k], len(distinct)) for k in range(many)], 1) / share
    hit, back = np.unique(flat, return_inverse=True)
    spread = np.repeat(by_word, sizes, axis=0)
    step = np.stack([np.bincount(back, spread[:, k], len(hit)) for k in range(many)], 1) - PENALTY * model.weights[hit]
    sums[0][hit] += step**2
    model.weights[hit] += RATE * step / np.sqrt(sums[0][hit])
    moves = sum(np.bincount(x[:-1] * many + x[1:], minlength=many * many) for _, x in part).reshape(many, many)
    begin = chains.opens[:-1][chains.first]
    for held, s, g in ((model.transition, sums[1], (moves - both) / share), (model.start, sums[2], gap[begin].sum(0) / share)):
        s += g**2
        held += RATE * g / np.sqrt(s)


# -- Spark -------------------------------------------------------------------------------------------------------------


def is_held_out(id_column):
    return F.crc32(id_column.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageField:
    """Fit on a bounded sample of the labelled documents of ``docs`` that are not held out: of each label at most PER_LANGUAGE
    rows, and no more than its share of ROWS but for one, whole texts. Every label is learned."""
    own = columns([id_col, text_col, lang_col])
    rows = docs.select(own[0].alias("id"), own[1].alias("text"), own[2].alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull() & ~is_held_out(F.col("id")))
    # One row a label.
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()}
    if not counts:
        return LanguageField([], {}, np.zeros((1, 0)), np.zeros((0, 0)), np.zeros(0))
    each = max(1, min(PER_LANGUAGE, ROWS // len(counts)))
    # A few times as many are drawn as are taken; the rank is filtered, so each task sends at most ``each`` of a label on.
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 2 * max(each, 20) / n))])
    drawn = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 62)) < share[F.col("lang")] * float(1 << 62))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", F.xxhash64("text")))
    taken = drawn.withColumn("place", place).filter(F.col("place") <= each)
    out: dict[str, list[list[str]]] = {k: [] for k in counts}
    # At most ROWS rows, or one a label.
    for r in sorted(taken.select("lang", "place", "text").collect()):
        out[r["lang"]].append(r["text"].split())
    return fit(out)


def _predicted(model: LanguageField, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in parts(b, b.schema.names[at]):
                found = model.predict([t or "" for t in part.column(at).to_pylist()])
                yield part.append_column("lang_pred", pa.array([x for x, _ in found], pa.string())).append_column("score", pa.array([s for _, s in found], pa.float64()))

    return run


def predict(docs: DataFrame, model: LanguageField, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred (``und`` for a text that is null or has no letters) and score; only the text is looked at.

    Defined cases: a text of any length is one chain; repeated rows get equal results; without any learned language all are
    ``und``; an empty table stays empty. All columns pass through, whatever their names, but those two (in whatever case)
    are replaced.
    """
    names = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    # By plain names within, as columns of batches may have any.
    rows = docs.select(*columns(names)).toDF(*[f"c{k}" for k in range(len(names))])
    schema = StructType([*rows.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rows.mapInArrow(_predicted(model, names.index(text_col)), schema).toDF(*names, "lang_pred", "score")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score) of each row, with a field trained on the rows that are not held out.

    Defined cases: a text that is null or without letters is ``und`` with score 0, as are all where no row has a label;
    rows with a null id or label are predicted and not learned from, and a null id is not held out; repeated rows get equal
    results; a text of any length is one chain; an empty table gives no rows. Other columns are not read, whatever their
    names.
    """
    model = train(docs, id_col, text_col, lang_col)
    own, text = columns([id_col, text_col])
    rows = docs.select(own.cast("long").alias("id"), F.coalesce(is_held_out(own), F.lit(False)).alias("held_out"), text.alias("text"))
    return predict(rows, model).select(F.col("id").alias(id_col), "held_out", "lang_pred", "score")


__all__ = ["Chains", "LanguageField", "fit", "forward_backward", "identify", "predict", "train"]
