"""SimHash near-dedup with vantage-point trees.

Equal fingerprints are one node. The nodes are dealt to shards by a vantage-point tree whose points and radii come from a
bounded sample: at each tree node a fingerprint goes to the near or the far side of the radius. For exact pairs across a
side's edge, a near fingerprint within ``RADIUS`` of the edge also visits the far side, and a visitor goes to each side
that the triangle bound leaves possible. Every shard then goes on with the same tree over its own fingerprints down to
small blocks, whose pairs are compared. So each pair at ``RADIUS`` or fewer differing bits is met in exactly the shard
where one of the two is at home. A shard returns a spanning forest of its links, never all pairs of a group, and the
forests are joined by rounds of large-star and small-star over written tables.

The sample only decides how even the shards are: its size is ``SAMPLE``, and the number of shards follows the number of
fingerprints. A shard that has more than ``CELL`` rows all the same (many visitors, or more fingerprints close to each
other than a tree can tell apart) is cut into blocks by a hash, and each pair of its blocks is a task of its own; so what
a task reads does not grow with the corpus, though the rows of such a shard are sent once for each of its blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from millrace.components import components
from millrace.llm.support import columns, fresh, join_groups, parts, stage

RADIUS, SHINGLE, SEED = 2, 3, 42
SAMPLE, SHARD, CELL, BLOCK = 4096, 6000, 40_000, 1 << 21
#: Hashes whose bits are counted at once.
COUNTED = 1 << 16


def fingerprint(text: str) -> int:
    """64-bit SimHash of the word 3-shingles of a whole text (repeats included; fewer words: the sequence; none: 0)."""
    words = text.encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.r_[0, ends[:-SHINGLE]].tolist()
        hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)], np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), COUNTED):
        counts += np.unpackbits(hashes[k : k + COUNTED].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [fingerprint(t) for part in parts(b) for t in part.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("th"), pa.array(np.array(found, np.uint64).view(np.int64))], ["id", "th", "fp"])


def _text_hash(text_col: str):
    """Tells rows of one id apart that have different texts."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, fp) of each row, with th a hash of the text."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), _text_hash(text_col).alias("th"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_fingerprints, "id long, th long, fp long")


# -- the tree ----------------------------------------------------------------------------------------------------------


def _distance(fps: np.ndarray, point) -> np.ndarray:
    return np.bitwise_count(fps ^ point).astype(np.int64)


def _vantage(fps: np.ndarray) -> tuple[np.uint64, int, np.ndarray]:
    """Of a few candidates the point with the widest spread of distances; the radius nearest to halves; the distances."""
    few = fps[np.linspace(0, len(fps) - 1, 512).astype(int)] if len(fps) > 512 else fps
    candidates = few[np.linspace(0, len(few) - 1, 12).astype(int)]
    point = max(candidates, key=lambda p: _distance(few, p).std())
    d = _distance(fps, point)
    below = np.cumsum(np.bincount(d, minlength=65))
    radius = int(np.argmin(np.abs(below - len(fps) / 2))) + 1  # near: a distance below it
    return point, radius, d


class Router:
    """The top of the tree, in heap order, as far down as the sample has rows for each node to have a point of its own;
    below, all nodes of a level have one point and radius. A leaf is a shard."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth, self.own = depth, min(depth, max(0, int(np.log2(max(1, len(sample) / 16)))))
        self.points, self.radii = np.zeros(1 << self.own, np.uint64), np.zeros(1 << self.own, np.int64)
        parts = {1: sample}
        for node in range(1, 1 << self.own):
            part = parts.pop(node)
            if len(part):
                self.points[node], self.radii[node], d = _vantage(part)
                near = d < self.radii[node]
                parts[2 * node], parts[2 * node + 1] = part[near], part[~near]
            else:
                parts[2 * node] = parts[2 * node + 1] = part
        # Points far from each other in the sample's order, which is by hash.
        rest = [sample[k] for k in np.linspace(0, len(sample) - 1, depth - self.own).astype(int)] if len(sample) else []
        self.shared = [(p, int(np.median(_distance(sample, p)))) for p in rest] or [(np.uint64(0), 32)] * (depth - self.own)

    def route(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shard, fingerprint, at home) for each shard that a fingerprint lives in or visits."""
        node, home = np.ones(len(fps), np.int64), np.ones(len(fps), bool)
        for level in range(self.depth):
            point, r = (self.points[node], self.radii[node]) if level < self.own else self.shared[level - self.own]
            d = _distance(fps, point)
            near = np.where(home, d < r, d < r + RADIUS)
            far = np.where(home, d >= r, d >= r - RADIUS)
            edge = home & near & (d >= r - RADIUS)
            node = np.concatenate([2 * node[near], 2 * node[far] + 1, 2 * node[edge] + 1])
            fps, home = np.concatenate([fps[near], fps[far], fps[edge]]), np.concatenate([home[near], home[far], np.zeros(edge.sum(), bool)])
        return node, fps, home


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest reachable position of each of ``n``."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        on = la != lb
        if not on.any():
            return label
        a, b, la, lb = a[on], b[on], la[on], lb[on]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(jumped := label[label], label):
            label = jumped


def _linked(fps: np.ndarray, home: np.ndarray) -> np.ndarray:
    """For each of a shard's fingerprints the position of the smallest position that its links reach."""
    label = np.arange(len(fps))

    def merge(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal label
        if len(a):
            held = np.flatnonzero(label != np.arange(len(fps)))
            label = _roots(len(fps), np.r_[held, a], np.r_[label[held], b])

    def compare(home: np.ndarray, visit: np.ndarray) -> None:
        both = np.r_[home, visit]
        step = max(1, BLOCK // max(1, len(both)))
        for k in range(0, len(home), step):
            own = home[k : k + step]
            i, j = np.nonzero(np.bitwise_count(fps[own][:, None] ^ fps[both[k:]][None, :]) <= RADIUS)
            merge(own[i], both[k:][j])

    stack = [(np.flatnonzero(home), np.flatnonzero(~home))]
    while stack:
        home, visit = stack.pop()
        if len(home) * (len(home) + len(visit)) > BLOCK:
            point, r, d = _vantage(fps[home])
            near = d < r
            if near.any() and not near.all():
                v = _distance(fps[visit], point)
                stack.append((home[near], visit[v < r + RADIUS]))
                stack.append((home[~near], np.r_[visit[v >= r - RADIUS], home[near & (d >= r - RADIUS)]]))
                continue
        compare(home, visit)
    return label


def _links(shard: pd.DataFrame) -> pd.DataFrame:
    fps = shard["fp"].to_numpy(np.int64).view(np.uint64)
    label = _linked(fps, shard["home"].to_numpy(bool))
    on = np.flatnonzero(label != np.arange(len(fps)))
    a, b = fps[on].view(np.int64), fps[label[on]].view(np.int64)
    return pd.DataFrame({"a": np.maximum(a, b), "b": np.minimum(a, b)})


def links(nodes: DataFrame, sample: int = SAMPLE, shard: int = SHARD, cell: int = CELL) -> DataFrame:
    """Links (a > b) that join the distinct ``nodes`` (fp, a written table) as all pairs within RADIUS would."""
    count = nodes.count()
    depth = max(0, int(np.ceil(np.log2(max(1, count / shard)))))
    # Bounded: the sample's rows, whatever the number of nodes.
    rows = nodes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()
    router = Router(np.array([r[0] for r in rows], np.int64).view(np.uint64), depth)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node, fps, home = router.route(b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(fps.view(np.int64)), pa.array(home)], ["shard", "fp", "home"])

    dealt = stage(nodes.select("fp").mapInArrow(deal, "shard long, fp long, home boolean"), "dealt")
    sizes = stage(dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("rows")).withColumn("blocks", F.when(F.col("rows") > cell, F.ceil(2 * F.col("rows") / cell)).otherwise(1).cast("int")), "shards")
    placed = join_groups(dealt, sizes, ["shard"], "rows", dealt.count())
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    # Of a cut shard, blocks i < j are a task; each block meets every other one, and within a pair its own rows.
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: (F.col("blocks") == 1) | (j != own))
    cells = placed.select("shard", "fp", "home", own.alias("own"), F.explode(others).alias("other"))
    return cells.groupBy("shard", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")).applyInPandas(_links, "a long, b long")


def _classes(docs: DataFrame, id_col: str, text_col: str, sample: int, shard: int, cell: int) -> DataFrame:
    own = stage(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = stage(own.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies")), "nodes")
    roots = components(links(nodes, sample, shard, cell))
    rooted = stage(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", "copies", F.coalesce("root", "fp").alias("root")), "rooted")
    smallest = stage(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members")), "smallest")
    total = nodes.count()
    classes = stage(join_groups(rooted, smallest, ["root"], "members", total).select("fp", "copies", "root", "component_id"), "classes")
    return join_groups(own, classes, ["fp"], "copies", own.count())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, shard: int = SHARD, cell: int = CELL) -> DataFrame:
    """(id, fp, component_id) of each row: the smallest id that links of at most RADIUS differing bits reach.

    Defined cases: a null text is an empty one; texts without words have the fingerprint 0 and are linked like any other;
    a text of any length is read whole; equal texts are one node and always in one component; null ids never are a
    component_id unless all of the component are null; rows that repeat an id each give a row; an empty table gives no
    rows. Other columns are not read, whatever their names.
    """
    return _classes(docs, id_col, text_col, sample, shard, cell).select(F.col("id").alias(id_col), "fp", "component_id")


def hex_digits(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, shard: int = SHARD, cell: int = CELL) -> DataFrame:
    """Exactly one row of each component of ``docs``, with its columns: that of the smallest id.

    Defined cases: those of near_duplicates; where several rows of a component have its smallest id, or all of its ids are
    null, the one with the smallest hash of text stays, and of rows with that text, too, one by a hash of all columns; an
    empty table stays empty. All columns pass through unchanged, whatever their names.
    """
    found = _classes(docs, id_col, text_col, sample, shard, cell)
    # Nulls come last, so a component with an id has one here.
    first = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0)).alias("k"), "th")).alias("x")).select("x.*")
    names = fresh(docs.columns, "none", "k", "th", "rows", "order")
    keys = dict(zip(names, (F.col(id_col).isNull(), F.coalesce(F.col(id_col).cast("long"), F.lit(0)), _text_hash(text_col)), strict=False))
    first = first.toDF(*names[:3])
    # The rows of each key that stays; nearly always it is one.
    stay = stage(found.select(F.col("id").isNull().alias(names[0]), F.coalesce("id", F.lit(0)).alias(names[1]), F.col("th").alias(names[2])).join(first, names[:3]).groupBy(*names[:3]).agg(F.count(F.lit(1)).alias(names[3])), "stay")
    rows, total, own = docs.withColumns(keys), found.count(), columns(docs.columns)
    once = join_groups(rows, stay.filter(F.col(names[3]) == 1), names[:3], names[3], total)
    many = stay.filter(F.col(names[3]) > 1)
    if many.isEmpty():
        return once.select(*own)
    again = join_groups(rows, many, names[:3], names[3], total)
    one = again.groupBy(*names[:3]).agg(F.min_by(F.struct(*own), F.xxhash64(*own)).alias(names[4])).select(f"{names[4]}.*")
    return once.select(*own).unionByName(one)
