"""Connected components: whole results however the edges are dealt, and few tasks for few edges."""

import glob

import numpy as np
import pytest

from millrace.components import components, stars
from millrace.scratch import shared_dir


def _expected(edges):
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    return root


def _edges(seed):
    rng = np.random.default_rng(seed)
    chain = [(k, k + 1) for k in range(1000, 1060)]
    return [(int(a), int(b)) for a, b in rng.integers(-40, 160, (110, 2))] + [chain[k] for k in rng.permutation(60)] + [(7, 7), (-9000000000000000000, 9000000000000000000)]


def test_stars_of_a_task():
    for seed in range(20):
        edges = [e for e in _edges(seed) if e[0] != e[1]]
        node, root = stars(*np.array(edges, np.int64).T)
        expected = _expected(edges)
        assert dict(zip(node.tolist(), root.tolist(), strict=True)) == {k: v for k, v in expected.items() if k != v}


@pytest.mark.parametrize(("held", "hub"), [(1 << 18, 100_000), (16, 100_000), (1, 8)])
def test_components_however_dealt(spark, held, hub):
    edges = _edges(3)
    rows = components(spark.createDataFrame(edges, "a long, b long").repartition(3), hub, held).collect()
    got = dict(map(tuple, rows))
    assert len(rows) == len(got) and got == _expected(edges)


def test_few_edges_take_no_rounds(spark):
    """Each round wrote a table, in as many files as a shuffle has tasks."""
    chain = spark.createDataFrame([(k, k + 1) for k in range(300)], "a long, b long").repartition(2)
    top = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    before = set(glob.glob(f"{top}/*"))
    assert {r["root"] for r in components(chain).collect()} == {0}
    made = [d for d in glob.glob(f"{top}/*") if d not in before]
    assert len(made) == 2 and sum(len(glob.glob(f"{d}/part-*")) for d in made) <= 3
