"""MinHash near-dedup with bottom-k sketches of one hash function and inverted lists.

A document's set is its distinct 2-word shingles. Documents with equal sets are one node. A node's sketch is the ``K``
smallest hashes of its set (the whole set, where it is no larger), ascending. The keys of the inverted lists are the runs of
``RUN`` consecutive hashes among a sketch's first ``WIDTH``, so how many unlinked sets a list has does not follow how often
single shingles occur. Two sets at a similarity of 0.8 or more have such a run in common: of the u hashes of their union, in
order, at most u / 5 are not shared, so the others are at least 4u / (u + 5) in a row somewhere, more than two for u above 5;
the one link of a smaller union, of 4 shingles with 5, has two in a row (``runs``). Where only the first WIDTH of the union
are known, none of their runs is shared with a chance of less than 3 in 10^13.

The lists are not turned into all pairs. In each round a list has one pivot, and each node is held against that pivot
only which it meets in most lists; sketches of the union estimate a pair's similarity, whole texts decide it, links join components, and a list whose
members are in one component is done. When few pairs of different components are left in the lists, or rounds bring
nothing more, all of these pairs are gone through (``Lists.rest``): groups whose lists have the same members again and
again meet once, block by block, each pair of blocks a task that returns a forest of their links. No pair is left out, so
the components are those of all links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from millrace.components import components
from millrace.llm.support import few, hot_keys, join_around, join_groups, parts, stage, stage_counted

#: A link is intersection * 100 >= union * LEAST.
LEAST = 80
K = 128
#: Once the cells that counted how often a value occurs; there is no such count now, and a test still sets it.
CELLS = 1 << 20
#: Hashes in a row that are the key of a list, and how many of a sketch's hashes have runs.
RUN, WIDTH = 3, 80
#: Of the values that the sketch of a union has, links have at least half in common but for one in 10^12.
HALF = K // 2
#: Lists that a node must meet a pivot in, or one for each SMALL shingles of its set where these are fewer.
SHARED, SMALL = 3, 8
#: Members of a list whose pairs are made by a join; rows of a block of longer lists.
SHORT, BLOCK, BLOCK_BYTES = 64, 1000, 1 << 25
#: A group meets as a whole if its nodes squared are at most so many times the pairs of its lists.
DENSE = 8
#: Keys that are sent to where large rows are; more are brought together with them.
SENT = 500_000
#: Rounds of pivots go on while the lists hold more pairs than this for each of their members.
FEW, ROUNDS = 4, 8
#: Pairs of sketches, texts, and pairs of texts that a task is worth.
SKETCHED, HELD, READ = 4000, 4000, 500
#: Words whose hashes a task keeps.
KEPT = 1 << 19
_MIX1, _MIX2, _MIX3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


def words(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased; of bytes, whose lower and split know ASCII only."""
    return (text or "").encode().lower().split()


def shingles(text: str | None) -> set:
    """The set of a text: pairs of words, the one word of a text of one word, or nothing."""
    w = words(text)
    return set(zip(w, w[1:], strict=False)) if len(w) > 1 else set(w)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT:
            self.clear()
        out = self[word] = xxh64_intdigest(word)
        return out


def _hashed(w: list[bytes], known: _Hashes) -> np.ndarray:
    """The distinct 64-bit hashes of the shingles of ``w``, ascending."""
    h = np.array([known[x] for x in w], np.uint64)
    x = h[:-1] * _MIX1 + (h[1:] ^ _MIX3) * _MIX2 if len(h) > 1 else h
    x ^= x >> np.uint64(33)
    x *= _MIX3
    x ^= x >> np.uint64(29)
    return np.unique(x)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Hashes()
    for b in batches:
        for part in parts(b):
            n, digest, sketch = [], [], []
            sizes = pc.binary_length(part.column("text")).cast(pa.int64())
            for text in part.column("text").to_pylist():
                w = words(text)
                found = _hashed(w, known)
                n.append(len(set(zip(w, w[1:], strict=False))) if len(w) > 1 else len(w))
                digest.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                sketch.append(found[:K].view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("th"), sizes, pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sketch, pa.list_(pa.int64()))], ["id", "th", "bytes", "n", "digest", "sketch"])


def _mixed(v: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` consecutive values."""
    x = np.full(len(v) - length + 1, length, np.uint64)
    for k in range(length):
        x = (x ^ v[k : len(v) - length + 1 + k]) * _MIX1
        x ^= x >> np.uint64(29)
    return x


def runs(sketch: np.ndarray, n: int) -> np.ndarray:
    """The keys of the lists of a set of ``n`` shingles, of which a different set linked to it has one at least."""
    v = sketch[:WIDTH].view(np.uint64)
    if n < 4:  # a different set within 0.8 has at least 4 shingles, and so has this one
        return v[:0].view(np.int64)
    keys = [_mixed(v, k) for k in ((RUN,) if n > 5 else (RUN - 1, RUN)) if len(v) >= k]
    return np.unique(np.concatenate(keys)).view(np.int64)


def needed(n: int) -> int:
    """The values that the sketch of a set of ``n`` shares with that of any set linked to it.

    Of a link, the larger set has at most n / LEAST * 100 elements, of which at most 100 - LEAST in 100 are not shared; so
    many may be missing among the K smallest. For large sets, where that says little, it is HALF by chance.
    """
    return min(-(-LEAST * n // 100), max(HALF, K - n * (100 - LEAST) // LEAST))


def _alike(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> bool:
    """Whether the sketch of the union leaves a link possible."""
    common = np.intersect1d(a, b, assume_unique=True)
    if len(common) < max(needed(na), needed(nb)):
        return False
    both = np.union1d(a, b)
    if max(na, nb) > K:
        both = both[:K]
    shared = np.isin(common, both, assume_unique=True).sum()
    # The union of a link has at most (na + nb) / 1.8 elements, of which a fifth are not shared.
    return 100 * shared >= LEAST * len(both) if max(na, nb) <= K else shared >= max(HALF, len(both) - (100 - LEAST) * (na + nb) // (100 + LEAST))


def _estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("na", "nb")]
        sa, sb = b.column("sa"), b.column("sb")
        get = lambda s, k: s[k].values.to_numpy().view(np.uint64)
        keep = [k for k, (na, nb) in enumerate(zip(*cols, strict=True)) if _alike(get(sa, k), get(sb, k), na, nb)]
        yield b.select(["a", "b"]).take(pa.array(keep, pa.int64()))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for part in parts(b, "tb"):
            keep, last, left = [], None, set()
            for k, (a, ta, tb) in enumerate(zip(part.column("a").to_pylist(), part.column("ta"), part.column("tb"), strict=True)):
                if a != last:
                    last, left = a, shingles(ta.as_py())
                right = shingles(tb.as_py())
                shared = len(left & right)
                if 100 * shared >= LEAST * (len(left) + len(right) - shared):
                    keep.append(k)
            yield part.select(["a", "b"]).take(pa.array(keep, pa.int64()))


def _sizes_fit(a: str, b: str) -> Column:
    """Whether sets of these sizes may be linked."""
    return F.greatest(a, b) * LEAST <= F.least(a, b) * 100


def _with(pairs: DataFrame, side: str, values: DataFrame) -> DataFrame:
    """``pairs`` with ``values`` (node, ...) of their ``side``, of which one node may have most."""
    keyed = values.withColumnRenamed("node", side)
    return join_around(pairs, keyed, [side], hot_keys(pairs, [side]))


class Lists:
    """The inverted lists of ``nodes`` and the links found in them."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, short: int, block: int):
        self.docs, self.nodes, self.short, self.block = docs, nodes, short, block

        def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keys = [runs(sketch.values.to_numpy(), n) for n, sketch in zip(b.column("n").to_pylist(), b.column("sketch"), strict=True)]
                many = [len(k) for k in keys]
                if any(many):
                    node, n = (np.repeat(b.column(c).to_numpy(), many) for c in ("node", "n"))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(node), pa.array(n)], ["value", "node", "n"])

        postings = nodes.select("node", "n", "sketch").mapInArrow(post, "value long, node long, n long")
        # One shuffle of three numbers a posting; a list of any length is counted as it is sorted, and may spill.
        members = postings.withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("value"))).filter("members > 1")
        self.members, found = stage_counted(members, "members", n=F.count(F.lit(1)))
        self.total = found["n"] or 0
        self.edges = None

    @staticmethod
    def _only(rows: DataFrame, on: list[str], asked: DataFrame) -> DataFrame:
        """``rows`` whose ``on`` is in ``asked`` (written), with its other columns. Rows are large, so up to SENT keys go to
        where the rows are."""
        return rows.join(F.broadcast(asked) if asked.count() <= SENT else asked, on)

    def texts(self, asked: DataFrame) -> DataFrame:
        """(node, text) of the nodes in ``asked`` (node, once each, written), written: of one row of each node."""
        reps = self._only(self.nodes.select("node", "rep"), ["node"], asked)
        reps = stage(reps.select("node", F.col("rep.id").isNull().alias("none"), F.coalesce("rep.id", F.lit(0)).alias("id"), F.col("rep.th").alias("th")), "reps")
        docs = self.docs.select(F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0)).alias("id"), "th", "text")
        return stage(few(self._only(docs, ["none", "id", "th"], reps).select("node", "text").dropDuplicates(["node"]), asked.count(), HELD), "texts")

    def confirm(self, pairs: DataFrame) -> bool:
        """Add to the edges those of ``pairs`` (a, b) that are links; whether there are any."""
        pairs, found = stage_counted(pairs, "pairs", n=F.count(F.lit(1)))
        if not found["n"]:
            return False
        both = lambda df, n: stage(few(df.select(F.explode(F.array("a", "b")).alias("node")).distinct(), n), "both")
        known = stage(self._only(self.nodes.select("node", "n", "sketch"), ["node"], both(pairs, found["n"])), "sketches")
        sketch = lambda s: known.select("node", F.col("n").alias(f"n{s}"), F.col("sketch").alias(f"s{s}"))
        likely = few(_with(_with(pairs, "a", sketch("a")), "b", sketch("b")), found["n"], SKETCHED).mapInArrow(_estimate, "a long, b long")
        likely, found = stage_counted(likely, "likely", n=F.count(F.lit(1)))
        if not found["n"]:
            return False
        texts = self.texts(both(likely, found["n"]))
        text = lambda s: texts.select("node", F.col("text").alias(f"t{s}"))
        return self.join(stage(few(_with(_with(likely, "b", text("b")), "a", text("a")), found["n"], READ).mapInArrow(_verify, "a long, b long"), "links"))

    def join(self, links: DataFrame) -> bool:
        if links.isEmpty():
            return False
        self.edges = links if self.edges is None else self.edges.unionByName(links)
        self.roots = stage(components(self.edges), "roots")
        return True

    def labelled(self) -> DataFrame:
        """The members of lists that hold pairs of different components, written: value, node, n, label, members, left (the
        pairs of different components)."""
        plain = self.members.select("value", "node", "n")
        rows = plain.withColumn("label", F.col("node")) if self.edges is None else plain.join(self.roots, "node", "left").select("value", "node", "n", F.coalesce("root", "node").alias("label"))
        rows = stage(rows, "labelled")
        # One component may have most of the members.
        counts = rows.groupBy("value", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("value").agg(F.sum("c").alias("members"), (F.sum("c") ** 2 - F.sum(F.col("c") ** 2)).alias("left"))
        lists = stage(few(counts.filter("left > 0").withColumn("left", (F.col("left") / 2).cast("long")), self.total), "open")
        return stage(few(join_groups(rows, lists, ["value"], "members", self.total), self.total), "members")

    def by_pivot(self, rows: DataFrame, turn: int) -> DataFrame:
        """Pairs (a, b) of a node and, of the pivots of its lists that are of other components, the one of most lists."""
        order = F.xxhash64("node", F.lit(turn))
        total = rows.count()
        pivots = stage(few(rows.groupBy("value").agg(F.min(F.struct(order.alias("o"), "node", "label", "n")).alias("p"), F.count(F.lit(1)).alias("members")), total), "pivots")
        met = join_groups(rows.drop("members"), pivots, ["value"], "members", total).filter((F.col("label") != F.col("p.label")) & _sizes_fit("n", "p.n"))
        often = met.groupBy("node", "n", F.col("p.node").alias("pivot")).count()
        # Links that meet in fewer pivots are left to the end, where all lists of a pair count.
        often = often.filter(F.col("count") >= F.least(F.lit(SHARED), F.ceil(F.col("n") / SMALL)))
        best = often.groupBy("node").agg(F.max(F.struct("count", "pivot")).alias("best"))
        return few(best.select(F.greatest("node", "best.pivot").alias("a"), F.least("node", "best.pivot").alias("b")).distinct(), total)

    def groups(self, rows: DataFrame) -> DataFrame:
        """(node, root) of the nodes of groups whose lists have the same members again and again, written.

        They are what pivots that a member has often enough, and the pivots of long lists, connect: mostly the copies of a
        template or the documents with one passage. A group all of whose pairs are many more than its lists have (a chain) is
        none.
        """
        long = rows.filter(F.col("members") > self.short)
        total = long.count()
        first = stage(few(long.groupBy("value").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("size")), total), "first")
        stars = join_groups(long.select("value", "node"), first, ["value"], "size", total).select(F.col("node").alias("a"), "b")
        roots = stage(components(self.by_pivot(rows, ROUNDS).unionByName(few(stars, total))), "roots")
        held = stage(rows.select("value", "node").join(roots, "node"), "held")
        lists = held.groupBy("root", "value").agg(F.count(F.lit(1)).cast("double").alias("c")).groupBy("root").agg(F.sum(F.col("c") * F.col("c")).alias("pairs"))
        nodes = roots.groupBy("root").agg(F.count(F.lit(1)).alias("nodes"))
        cost = nodes.join(lists, "root").filter(F.col("nodes").cast("double") * F.col("nodes") <= DENSE * F.col("pairs"))
        cost = stage(few(cost, rows.count()), "cost")
        return stage(join_groups(roots, cost, ["root"], "nodes", roots.count()).select("node", "root"), "groups")

    def meet(self, met: DataFrame) -> bool:
        """Join what is linked of the nodes (node, aside) of each ``g``, all pairs but those with one ``aside``, block by block
        with their whole texts."""
        met = met.join(self.nodes.select("node", "n", "bytes"), "node")
        label = F.col("node") if self.edges is None else F.coalesce("label", "node")
        met = stage(met if self.edges is None else met.join(self.roots.withColumnRenamed("root", "label"), "node", "left"), "met").withColumn("label", label)
        total = met.count()
        groups = stage(few(met.groupBy("g").agg(F.count(F.lit(1)).alias("held"), F.sum("bytes").alias("all")), total), "sizes")
        blocks = F.greatest(F.ceil(2 * F.col("held") / self.block), F.ceil(2 * F.col("all") / BLOCK_BYTES))
        dealt = join_groups(met, groups, ["g"], "held", total)
        dealt = dealt.withColumn("blocks", F.when((F.col("held") > self.block) | (F.col("all") > BLOCK_BYTES), blocks).otherwise(1).cast("int"))
        own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        told = dealt.join(self.texts(stage(few(met.select("node").distinct(), total), "asked")), "node").select("g", "node", "aside", "label", "n", "text", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        cells = told.groupBy("g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        return self.join(stage(cells.applyInPandas(_linked, "a long, b long"), "found"))

    def rest(self, rows: DataFrame) -> None:
        """Go through all pairs of different components in the lists: first those within groups, each of which meets once;
        then what short lists have, pair by pair, and each long list, without the pairs of one group."""
        rows = rows.withColumn("aside", F.col("node"))
        if not rows.filter(F.col("members") > self.short).isEmpty():
            groups = self.groups(rows)
            if not groups.isEmpty() and self.meet(groups.select(F.col("root").alias("g"), "node", F.col("node").alias("aside"))):
                rows = self.labelled()
            rows = rows.drop("aside").join(groups.withColumnRenamed("root", "aside"), "node", "left").withColumn("aside", F.coalesce("aside", "node"))
        rows = stage(rows.select("value", "node", "n", "label", "members", "aside"), "asides")
        short, long = rows.filter(F.col("members") <= self.short), rows.filter(F.col("members") > self.short)
        other = short.select("value", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"), F.col("aside").alias("ab"))
        pairs = short.select("value", F.col("node").alias("a"), "n", "label", "aside").join(other, "value")
        self.confirm(pairs.filter("a > b and label <> lb and aside <> ab").filter(_sizes_fit("n", "nb")).select("a", "b").distinct())
        total = long.count()
        mixed = long.groupBy("value").agg(F.count(F.lit(1)).alias("all"), F.min("aside").alias("lo"), F.max("aside").alias("hi")).filter("lo < hi").select("value", "all")
        mixed = stage(few(mixed, total), "mixed")
        if not mixed.isEmpty():
            self.meet(join_groups(long.select("value", "node", "aside"), mixed, ["value"], "all", total).select(F.col("value").alias("g"), "node", "aside"))

    def links(self) -> None:
        rows, before = self.labelled(), None
        for turn in range(ROUNDS):
            total, left = rows.select(F.count(F.lit(1)), F.sum(F.col("left") / F.col("members"))).first()
            # Pivots end when few pairs are left, or when a round has hardly joined any of them.
            if not total or left <= FEW * total or (before and left > 0.9 * before):
                break
            before = left
            if self.confirm(self.by_pivot(rows, turn)):
                rows = self.labelled()
        if not rows.isEmpty():
            self.rest(rows)


def _possible(sets: list[np.ndarray], n: np.ndarray, differ: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places i > j that differ and whose sketches share as many values as those of links do; those that share most first."""
    row = np.repeat(np.arange(len(sets)), [min(K, len(s)) for s in sets])
    value, of = np.unique(np.concatenate([s[:K] for s in sets]), return_inverse=True)
    often = np.bincount(of, minlength=len(value)) > 1
    row, of = row[often[of]], (np.cumsum(often) - 1)[of[often[of]]]
    shared = np.zeros((len(sets), len(sets)), np.float32)
    for begin in range(0, int(often.sum()), 4096):  # columns of the incidence at once
        part = (of >= begin) & (of < begin + 4096)
        held = np.zeros((len(sets), 4096), np.float32)
        held[row[part], of[part] - begin] = 1
        shared += held @ held.T
    both, large = n[:, None] + n[None, :], np.maximum(n[:, None], n[None, :])
    # The intersection of a link has this many elements at least; the larger set's others may be missing.
    least = -(-LEAST * both // (100 + LEAST))
    need = np.where(large <= K, least, np.maximum(HALF, K - (large - least)))
    i, j = np.nonzero(np.tril((shared >= need) & differ & (large * LEAST <= 100 * np.minimum(n[:, None], n[None, :])), -1))
    order = np.argsort(-shared[i, j] / np.minimum(K, large[i, j]), kind="stable")
    return i[order], j[order]


def _linked(cell: pd.DataFrame) -> pd.DataFrame:
    """Links that join the rows of a pair of blocks (own: which of the two) as all of their links would: a pair is looked at
    if it is of different components, and only while nothing has joined them."""
    own, label, node, n, aside = (cell[c].to_numpy() for c in ("own", "label", "node", "n", "aside"))
    known, split = _Hashes(), [words(t) for t in cell["text"]]
    sets = [_hashed(w, known) for w in split]
    across = (own[:, None] != own[None, :]) | (own.min() == own.max())
    root = {x: x for x in label.tolist()}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for i, j in zip(*map(np.ndarray.tolist, _possible(sets, n, across & (label[:, None] != label[None, :]) & (aside[:, None] != aside[None, :]))), strict=True):
        a, b = find(label[i]), find(label[j])
        if a == b:
            continue
        shared = len(sets[i]) + len(sets[j]) - len(np.union1d(sets[i], sets[j]))
        whole = len(sets[i]) == n[i] and len(sets[j]) == n[j]
        if whole and 100 * shared < LEAST * (n[i] + n[j] - shared):
            continue
        # Hashes can only say more than is shared: what they find, and sets with hashes that fell together, is looked up.
        left, right = (set(zip(w, w[1:], strict=False)) if len(w) > 1 else set(w) for w in (split[i], split[j]))
        if 100 * len(left & right) >= LEAST * len(left | right):
            root[a] = b
            out.append((max(node[i], node[j]), min(node[i], node[j])))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", short: int = SHORT, block: int = BLOCK) -> DataFrame:
    """(id, n_shingles, component_id) of each row: the smallest id that links reach.

    Defined cases: a null or empty text, or one without words, has an empty set, is linked with nothing and is its own
    component (with its own id, null included); a text of any length is read whole; texts with equal sets are one node and
    in one component; null ids never are a component_id unless all of the component are null; rows that repeat an id each
    give a row, and an id whose rows are in several components does not join them; an empty table gives no rows. Other
    columns are not read, whatever their names.
    """
    th = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    source = docs.select(F.col(id_col).cast("long").alias("id"), th.alias("th"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = stage(source.mapInArrow(_sketches, "id long, th long, bytes long, n long, digest binary, sketch array<long>"), "sets")
    some = own.filter("n > 0")
    first = some.groupBy("digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.min(F.struct("id", "th")).alias("rep"), F.min_by(F.struct("n", "bytes", "sketch"), F.struct("id", "th")).alias("x"))
    nodes = stage(first.select(F.monotonically_increasing_id().alias("node"), "digest", "least", "copies", "rep", "x.*"), "nodes")
    lists = Lists(source, nodes, short, block)
    lists.links()
    named = nodes.select("node", "digest", "least", "copies")
    if lists.edges is not None:
        rooted = stage(named.join(lists.roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
        smallest = stage(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("held")), "smallest")
        named = stage(join_groups(rooted, smallest, ["root"], "held", rooted.count()).select("digest", "copies", "component_id"), "classes")
    else:
        named = named.select("digest", "copies", F.col("least").alias("component_id"))
    rows = some.select("id", "n", "digest")
    found = join_groups(rows, named, ["digest"], "copies", rows.count()).select("id", "n", "component_id")
    alone = own.filter("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return found.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
