"""The keys of the inverted lists of op11_minhash."""

import random

import numpy as np

from millrace.llm import minhash_lists


def _set(values):
    return np.array(sorted(values), np.uint64)


def _runs(s):
    return set(minhash_lists.runs(s[: minhash_lists.K].view(np.int64), len(s)).tolist())


def test_links_have_a_run_in_common():
    rng = random.Random(4)
    for _ in range(3000):
        union = rng.choice([*range(4, 40), 70, 90, 130, 300, 1000])
        values = rng.sample(range(1 << 62), union)
        apart = union // 5
        if not apart:
            continue
        cut = rng.randint(0, apart)
        a, b = _set(values[cut:]), _set(values[:cut] + values[apart:])
        if min(len(a), len(b)) >= 4:
            assert _runs(a) & _runs(b)


def test_lists_do_not_follow_the_frequency_of_shingles():
    """Every value is in half of the sets, and no two sets are linked."""
    rng = random.Random(5)
    values = rng.sample(range(1 << 62), 400)
    keys = [_runs(_set(rng.sample(values, 200))) for _ in range(60)]
    shared = [len(a & b) for k, a in enumerate(keys) for b in keys[:k]]
    # A run of three in common has a chance of (1/3)^3 a place.
    assert sum(shared) / len(shared) < 6
    assert minhash_lists.runs(_set(values[:3]).view(np.int64), 3).size == 0
