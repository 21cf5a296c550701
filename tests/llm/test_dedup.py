"""Exact dedup, line dedup and near-dedup against brute force."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from millrace.llm import block_naming, line_runs, simhash_vptree
from millrace.llm.simhash_vptree import RADIUS, Router, _linked, _roots, components, fingerprint, majority

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)


def corpus(seed=1):
    """Copies, near copies, shared lines, empty, null, blank and long texts, repeated rows, null ids."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7)))
    line = lambda n: " ".join(word() for _ in range(n))
    shared = [f"  Shared line number {k} of the corpus\t" for k in range(4)]
    texts = []
    for _ in range(60):
        parts = [line(rng.randint(0, 30)) for _ in range(rng.randint(1, 6))]
        parts.insert(rng.randint(0, len(parts)), rng.choice(shared + [s.strip().upper() for s in shared]))
        texts.append("\n".join(parts))
    texts += [texts[0]] * 9 + texts[1:4] + [texts[5] + " x", "", "", None, " \n\t", "x" * 20_000, "x" * 20_000, "x" * 19_999 + "y", line(4000), "a\r\nb", "short\nshort\nshort"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return rows + [rows[3], rows[3], (None, texts[0]), (None, None), (7, "another text of id seven")]


def same(got, want):
    key = lambda r: repr(r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("fp", [F.xxhash64, lambda c: F.pmod(F.xxhash64(c), F.lit(3))])
@pytest.mark.parametrize("block", [16, 4096])
def test_exact_dedup(spark, fp, block):
    rows = corpus()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    want = []
    for i, t in rows:
        own = groups[t or ""]
        keep = max((k for k in own if k is not None), default=None)
        want.append((i, keep, len(own), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    same(block_naming.exact_dedup(documents(spark, rows), block_bytes=block, fingerprint=fp).collect(), want)


def test_exact_dedup_of_nothing(spark):
    assert block_naming.exact_dedup(documents(spark, [])).count() == 0
    clash = documents(spark, [(1, "a")]).withColumns({"name": F.lit(1), "fp": F.lit(2), "id": F.lit(3), "block": F.lit(4)})
    assert block_naming.exact_dedup(clash).first()["keep_id"] == 1


def test_a_block_and_a_pair_that_very_many_documents_share(spark):
    rng = random.Random(4)
    rows = [(k, "h" * 64 + "i" * 32 + ("x" * rng.randint(0, 40) if k % 3 else "")) if k % 2 else (k, f"{k % 90} some other text of a few blocks {rng.random()}") for k in range(400)]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    want = [(i, max(groups[t]), len(groups[t]), i == max(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows]
    for fp in (F.xxhash64, lambda c: F.pmod(F.xxhash64(c), F.lit(2))):
        same(block_naming.exact_dedup(documents(spark, rows), block_bytes=16, fingerprint=fp).collect(), want)


def brute_lines(rows, min_length=20, min_docs=3):
    white, lower = " \t\n\x0b\f\r", str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rank = lambda i: -(2**63) if i is None else i
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            held[x.strip(white).translate(lower)].add(rank(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        gone = [len(k := x.strip(white).translate(lower)) >= min_length and len(held[k]) >= min_docs and max(held[k]) != rank(i) for x in lines]
        out.append((i, "\n".join(x for x, g in zip(lines, gone, strict=True) if not g), len(lines), sum(gone)))
    return out


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (4, 2), (5, 3)])
def test_line_dedup(spark, batches, fanout):
    rows = corpus(batches)
    got = line_runs.drop_repeated_lines(documents(spark, rows), batches=batches, fanout=fanout)
    want = brute_lines(rows)
    assert sum(w[3] for w in want) > 20
    same(got.select("doc_id", "text", "n_lines", "n_dropped").collect(), want)


def test_line_dedup_of_nothing(spark):
    assert line_runs.drop_repeated_lines(documents(spark, [])).count() == 0
    rows = corpus(7)
    clash = documents(spark, rows).withColumns({n: F.lit(77) for n in ("key", "pos", "id", "batch", "N_LINES", "n_dropped", "d_pos", "d_id", "D_TH", "gone_at", "split_at", "__id", "__th", "__split", "a.b`c")})
    got = line_runs.drop_repeated_lines(clash)
    assert got.columns == [*[c for c in clash.columns if c not in ("N_LINES", "n_dropped")], "n_lines", "n_dropped"]
    same([(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect()], brute_lines(rows))
    assert all(r["__id"] == r["D_TH"] == r["a.b`c"] == 77 for r in got.collect())
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_a_line_that_very_many_later_documents_share(spark):
    """It is settled in the first batch, where only three documents have it."""
    common = "this line is in a third of all documents of the corpus"
    rows = [(k, f"some line of document number {k}" + ("\n" + common if k >= 597 or k % 3 == 0 and k < 400 else "")) for k in range(600)] + [(None, common)] * 90
    got = line_runs.drop_repeated_lines(documents(spark, rows))
    same(got.select("doc_id", "text", "n_lines", "n_dropped").collect(), brute_lines(rows))


def plain_fingerprint(text):
    words = [w for w in "".join(c if c not in " \t\n\x0b\f\r" else " " for c in text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark):
    texts = ["", " \n", "one", "one two", "One TWO three", "one two three four four four four", "É é ÿ x Kelvin K", "a\x0bb\x0cc\x1cd e"] + [t or "" for _, t in corpus()]
    assert [fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]
    got = spark.createDataFrame([("one two three",)], "t string").select(F.xxhash64("t")).first()[0]
    import numpy as np

    assert majority(np.array([got], np.int64).view(np.uint64)) == fingerprint("one two three")


def spread(rng, count=700):
    """Fingerprints with clusters, chains and one dense ball."""
    base = [rng.getrandbits(64) for _ in range(count)]
    flip = lambda x, k: x ^ sum(1 << b for b in rng.sample(range(64), k))
    out = set(base)
    for x in base[:200]:
        out.add(flip(x, rng.randint(1, 4)))
    x = base[0]
    for _ in range(60):
        out.add(x := flip(x, 2))
    out |= {flip(base[1], rng.randint(1, 3)) for _ in range(400)}
    return sorted(out)


def brute_roots(fps):
    import numpy as np

    own = np.array(fps, np.uint64)
    i, j = np.nonzero(np.bitwise_count(own[:, None] ^ own[None, :]) <= RADIUS)
    return _roots(len(own), i, j)


@pytest.mark.parametrize("depth", [0, 1, 4, 8])
def test_shards_lose_no_link(depth):
    import numpy as np

    fps = np.array(spread(random.Random(depth)), np.uint64)
    shard, dealt, home = Router(fps[::3], depth).route(fps)
    assert sorted(dealt[home].tolist()) == fps.tolist()
    a, b = [], []
    for s in np.unique(shard):
        own = dealt[shard == s]
        label = _linked(own, home[shard == s])
        a.append(np.searchsorted(fps, own))
        b.append(np.searchsorted(fps, own[label]))
    assert (_roots(len(fps), np.concatenate(a), np.concatenate(b)) == brute_roots(fps.tolist())).all()


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 7), (200, 201), (300, 300)] + [(500, 501 + k) for k in range(30)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {k: 0 for k in [*range(41), 100]} | {200: 200, 201: 200} | {k: 500 for k in range(500, 531)}


def test_near_duplicates(spark):
    rows = corpus()
    got = simhash_vptree.near_duplicates(documents(spark, rows), sample=16, shard=8).collect()
    fps = [plain_fingerprint(t or "") for _, t in rows]
    root = brute_roots(fps)
    least = {}
    for (i, _), r in zip(rows, root.tolist(), strict=True):
        least[r] = i if least.get(r) is None else least[r] if i is None else min(i, least[r])
    want = [(i, fps[k] - (1 << 64 if fps[k] >> 63 else 0), least[r]) for k, ((i, _), r) in enumerate(zip(rows, root.tolist(), strict=True))]
    same(got, want)
    kept = [r["doc_id"] for r in simhash_vptree.keep_one(documents(spark, rows)).collect()]
    assert sorted(kept) == sorted(least.values())
    assert simhash_vptree.near_duplicates(documents(spark, [])).count() == 0


def test_one_row_of_a_component_stays(spark):
    long = "one two three four five six seven " * 9000
    rows = [(1, "a b c"), (1, "a b c"), (1, "A B  c"), (2, "a b c"), (None, None), (None, ""), (None, " "), (5, long), (6, long + "x"), (None, long), (7, "other words here"), (7, "more words there")]
    docs = documents(spark, rows).withColumns({"fp": F.lit(1), "TH": F.lit("x"), "rows": F.lit(2), "root": F.lit(3), "none": F.lit(True), "a`b": F.lit(4), "id": F.lit(5), "k": F.lit(6)})
    got = simhash_vptree.keep_one(docs)
    assert got.columns == docs.columns
    found = got.collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in found) == [(False, 1), (False, 5), (False, 7), (False, 7), (True, 0)]
    assert [r["TH"] for r in found] == ["x"] * 5 and {r["a`b"] for r in found} == {4}
    assert simhash_vptree.keep_one(docs.limit(0)).count() == 0


def test_no_task_has_a_whole_dense_shard(spark, monkeypatch):
    """A template farm: all fingerprints within four bits of one, which no tree tells apart."""
    import numpy as np

    rng = random.Random(3)
    fps = sorted({(1 << 60) ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 4))) for _ in range(3000)} | {rng.getrandbits(63) for _ in range(300)})
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")

    def links(shard):
        return simhash_vptree.pd.DataFrame({"a": [len(shard)], "b": [int(shard["home"].sum())]})

    path = simhash_vptree.stage(nodes, "nodes")
    found = simhash_vptree.links(path, sample=64, shard=200, cell=400).collect()
    monkeypatch.setattr(simhash_vptree, "_links", links)
    largest = [r["a"] for r in simhash_vptree.links(path, sample=64, shard=200, cell=400).collect()]
    # Blocks are of half a cell on average.
    assert len(largest) > 30 and max(largest) <= 2 * 400
    at = {f: k for k, f in enumerate(fps)}
    a, b = (np.array([at[r[k]] for r in found]) for k in ("a", "b"))
    assert (_roots(len(fps), a, b) == _roots(len(fps), *np.nonzero(np.bitwise_count(np.array(fps, np.int64)[:, None] ^ np.array(fps, np.int64)[None, :]) <= RADIUS))).all()
