"""Connected components of a table of edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.joins import HOT, join_groups
from millrace.scratch import few, stage, stage_counted

#: A node with fewer edges than this is no hub, whatever its share of all edges.
HUB = 100_000
#: Edges (16 bytes each) that a task joins at once.
HELD = 1 << 18


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of these edges but the roots, and their roots: the smallest node that the edges reach."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    at, root = at.reshape(2, -1), np.arange(len(nodes))
    while not np.array_equal(*(ends := root[at])):
        np.minimum.at(root, ends.max(0), ends.min(0))
        while not np.array_equal(root, up := root[root]):
            root = up
    below = root != np.arange(len(nodes))
    return nodes[below], nodes[root[below]]


def _starred(held: int):
    """Edges (a, b) to those of stars, ``held`` edges at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0
        made = lambda: pa.RecordBatch.from_arrays([pa.array(x) for x in stars(*map(np.concatenate, zip(*kept, strict=True)))], ["a", "b"])
        for b in batches:
            for k in range(0, b.num_rows, max(1, held)):
                part = b.slice(k, max(1, held))
                if n and n + part.num_rows > held:
                    yield made()
                    kept, n = [], 0
                kept.append([part.column(c).to_numpy() for c in ("a", "b")])
                n += part.num_rows
        if n:
            yield made()

    return run


def _with_least(edges: DataFrame, key: str, other: str, hub: int) -> DataFrame:
    """``edges`` with ``m``, the least ``other`` of their ``key``; where there are hubs, their edges stay where they are."""
    least = edges.groupBy(key).agg(F.min(other).alias("m"), F.count(F.lit(1)).alias("degree"))
    total, most = edges.groupBy(key).count().agg(F.sum("count"), F.max("count")).first()
    if (most or 0) >= hub and most * HOT > total:
        return join_groups(edges, stage(least, "least"), [key], "degree", total).drop("degree")
    return edges.join(least.drop("degree"), key)


def components(edges: DataFrame, hub: int = HUB, held: int = HELD) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b), root its smallest reachable node: large-star, small-star.

    Each task first makes stars of its edges, ``held`` at once. What is left of them goes to one task where it is no more than
    that, so few edges need no shuffle; more go through rounds. In the end the edges of a component are a star, so its root is
    a hub of as many edges as the component has nodes; those of hubs (``hub`` edges and a share of 1/HOT of all) are not
    brought together in one task.
    """
    own = edges.filter("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    e, found = stage_counted(own.mapInArrow(_starred(held), "a long, b long"), "edges", n=F.count(F.lit(1)))
    state = lambda: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
    small = (found["n"] or 0) <= held
    if small:
        e = stage(e.coalesce(1).mapInArrow(_starred(held), "a long, b long"), "stars")
    else:
        seen, now = None, state()
        while now not in (seen, (0, None)):
            both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
            # So few edges have no hub among them, which need not be looked for.
            least = (lambda d, k, o: d.join(d.groupBy(k).agg(F.min(o).alias("m")), k)) if 2 * now[0] < hub else (lambda d, k, o: _with_least(stage(d, "large"), k, o, hub))
            large = least(both, "u", "v").filter("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b")).distinct()
            joined = least(large, "a", "b")
            star = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b"))).distinct()
            e = stage(star, "stars")
            seen, now = now, state()
    out = e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    return few(out, 2 * held, 2 * held) if small else out
