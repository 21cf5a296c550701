"""MinHash near-dedup, spelling variants and conversation repair against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from millrace.llm import minhash_lists, spelling_tiles, turn_repair

DOCS = "doc_id long, text string"
TURNS = "conv_id long, turn long, role string, text string"


def same(got, want):
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)


# -- MinHash -----------------------------------------------------------------------------------------------------------


def components_by_pairs(rows):
    """(id, size of set, smallest id) from all pairs of rows."""
    sets = []
    for _, text in rows:
        words = (text or "").translate({k: k + 32 for k in range(65, 91)}).replace(" ", " ")
        words = [w for w in words.translate(dict.fromkeys(map(ord, "\t\n\x0b\f\r"), " ")).split(" ") if w]
        sets.append({" ".join(words[k : k + 2]) for k in range(len(words) - 1)} or set(words))
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(sets[k]), least.get(find(k))) for k, (i, _) in enumerate(rows)]


def near_corpus():
    """Chains of near copies of many lengths, a farm whose members differ by a few words, a passage that many texts share."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 6)))
    texts = [None, "", " \n", "one", "One", "two words", "a b c", "x " * 30]
    for n in (3, 4, 5, 6, 9, 20, 90, 130, 160, 260, 700):
        now = [word() for _ in range(n)]
        for _ in range(8):
            texts.append(" ".join(now))
            now = list(now)
            for _ in range(max(1, n // 14)):
                now[rng.randrange(len(now))] = word()
    base, passage = [word() for _ in range(120)], [word() for _ in range(100)]
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 12)):
            copy[rng.randrange(len(copy))] = word()
        texts.append(" ".join(copy).upper())
        texts.append(" ".join(passage + [word() for _ in range(rng.randint(20, 60))]))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    return [*rows, rows[0], rows[1], (None, texts[20]), (None, "nobody else has this"), (3, "another text of id three")]


@pytest.mark.parametrize(("short", "block"), [(64, 1000), (2, 8)])
def test_minhash(spark, short, block, monkeypatch):
    if short == 2:
        monkeypatch.setattr(minhash_lists, "ROUNDS", 1)
        monkeypatch.setattr(minhash_lists, "CELLS", 1 << 10)
    rows = near_corpus()
    got = minhash_lists.near_duplicates(spark.createDataFrame(rows, DOCS), short=short, block=block)
    same(got.collect(), components_by_pairs(rows))


def test_minhash_of_nothing_and_clashes(spark):
    assert minhash_lists.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    clash = spark.createDataFrame([(1, "a b c", 1, 2, 3), (2, "A  b\tc", 4, 5, 6)], DOCS + ", node int, sketch int, component_id int")
    same(minhash_lists.near_duplicates(clash).collect(), [(1, 2, 1), (2, 2, 1)])


def test_needed_is_met():
    """Of sets at the least similarity, of which one holds the other, no sketches share fewer values."""
    rng = random.Random(1)
    for small in (4, 12, 60, 100, 110, 140, 200, 255):
        large = small * 100 // 80
        for _ in range(50):
            hashes = rng.sample(range(1 << 60), large)
            a, b = sorted(hashes[:small])[: minhash_lists.K], sorted(hashes)[: minhash_lists.K]
            shared = len(set(a) & set(b))
            assert shared >= minhash_lists.needed(small) and shared >= minhash_lists.needed(large)


# -- spelling ----------------------------------------------------------------------------------------------------------


def variants_by_deletion(rows):
    """The result from the words that are left when one code point goes."""
    counts = Counter()
    for i, text in rows:
        run = ""
        for c in [*(text or ""), " "]:
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            elif run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                counts[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
                run = ""
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    left, near = defaultdict(set), defaultdict(set)
    for w in counts:
        for k in range(len(w)):
            cut = w[:k] + w[k + 1 :]
            left[k, cut].add(w)
            if cut in counts:
                near[w].add(cut)
                near[cut].add(w)
    for words in left.values():
        for w in words:
            near[w] |= words - {w}
    forms = {w: min(near[w], key=lambda x: (-counts[x], x)) for w in counts if near[w]}
    forms = {w: f for w, f in forms.items() if counts[f] >= 5 * counts[w]}

    def root(w):
        return root(forms[w]) if w in forms else w

    return [(w, forms.get(w), root(w), n, len(near[w]), counts.get(forms.get(w))) for w, n in counts.items()]


def spelled(seed=5):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abÀéñ×") for _ in range(rng.randint(5, 9))) for _ in range(300)]
    words += [w[:k] + rng.choice("abcÿ") + w[k + rng.randint(0, 1) :] for w in words for k in (0, 3, len(w))]
    weights = [rng.choice([1, 1, 2, 8, 60, 400]) for _ in words]
    rows = [(k, " ".join(rng.choices(words, weights, k=rng.randint(0, 400))).title()) for k in range(150)]
    return [*rows, (None, rows[3][1]), rows[4], rows[4], (9, None), (10, ""), (11, "x" * 5000 + " " + "x" * 5001), *[(k, "x" * 5000 + " " + "x" * 4999 + "y") for k in range(20, 26)]]


@pytest.mark.parametrize(("cell", "task"), [(4000, 20_000), (5, 50)])
def test_variants(spark, cell, task, monkeypatch):
    if cell == 5:
        monkeypatch.setattr(spelling_tiles, "TILE", 1 << 8)
        monkeypatch.setattr(spelling_tiles, "HELD", 10)
    rows = spelled()
    got = spelling_tiles.variants(spark.createDataFrame(rows, DOCS), cell=cell, task=task)
    want = variants_by_deletion(rows)
    assert any(r[1] for r in want)
    same(got.collect(), want)


def test_variants_of_nothing_and_clashes(spark):
    assert spelling_tiles.variants(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(k, "letters letters") for k in range(5)] + [(1, "lettres")]
    clash = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], DOCS + ", n int, key string, word int")
    same(spelling_tiles.variants(clash).collect(), variants_by_deletion(rows))


# -- conversations -----------------------------------------------------------------------------------------------------

NEXT = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
NAME = {"u": "user", "a": "assistant"}


def repaired_by_strings(rows):
    """Whole audits and texts, from the last row to the first."""
    conversations = defaultdict(list)
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if h == 1 else text.translate({46: None, 33: None, 63: None}) if h == 2 else text
        conversations[c] += [(t is not None, t or 0, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    out = []
    for c, turns in conversations.items():
        turns.sort()
        numbers, faults, seen = [t[1] for t in turns if t[0]], [], set()
        for t in turns:
            bare = t[3].strip(" \t\n\x0b\f\r")
            faults.append("blank" if not bare else "duplicate" if t[2:] in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add(t[2:])
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))

        def inserting(v):
            for _ in range(4):
                for s, ways in NEXT.items():
                    for o, to in ways.items():
                        if o in "ua" and to in v:
                            found = (v[to][0] + 2, "I" + v[to][1], [NAME[o] + ":", *v[to][2]])
                            v[s] = min(v.get(s, found), found)
            return v

        after = inserting({"": (0, "", []), "a": (0, "", [])})
        for t, fault in zip(reversed(turns), reversed(faults), strict=True):
            here = {}
            for s, ways in NEXT.items():
                found = [(after[s][0] + 3, "D" + after[s][1], after[s][2])] if s in after else []
                for o, to in ways.items():
                    if fault not in ("blank", "duplicate") and to in after:
                        cost, more = after[to][0] + (fault == "truncated"), after[to]
                        found += [(cost, "K" + more[1], [f"{t[2]}:{t[3]}", *more[2]])] if t[2][:1] == o else []
                        found += [(cost + 2, "R" + more[1], [f"{NAME[o]}:{t[3]}", *more[2]])] if o in NAME else []
                if found:
                    here[s] = min(found)
            after = inserting(here)
        cost, audit, lines = after[""]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out.append((c, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def conversations(n=200, seed=3):
    rng = random.Random(seed)
    rows = []
    for c in [None, *range(n)]:
        for t in range(rng.randint(0, 12) if c else 300):
            role = rng.choice(["user", "assistant", "system", "tool", None, "", "User"])
            rows.append((c, rng.choice([None, t, t, t, t, t // 2, t + 3]), role, rng.choice(["a.", "b", "", None, " \n", "Long text here!", "x? \t", "é.", " e ", "end?\n"])))
    rng.shuffle(rows)
    return [*rows, rows[0], rows[1], rows[1]]


@pytest.mark.parametrize("bits", [12, 2, 0])
def test_repair(spark, bits, monkeypatch):
    monkeypatch.setattr(turn_repair, "CHUNK_BITS", bits)
    rows = conversations()
    same(turn_repair.repair_damaged(spark.createDataFrame(rows, TURNS).repartition(5)).collect(), repaired_by_strings(rows))


def test_repair_of_long_text_and_clashes(spark):
    assert turn_repair.repair_damaged(spark.createDataFrame([], TURNS)).count() == 0
    rows = [(k, t, r, "word " * 50_000 + ".") for k in range(3) for t, r in enumerate(["user", "assistant"])] + [(5, 7, "system", "only this.")]
    clash = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], TURNS + ", at int, none int, conv string")
    same(turn_repair.repair_damaged(clash).collect(), repaired_by_strings(rows))


def test_repaired_turns_are_the_digest(spark):
    rows = conversations(60, 9)
    repair = turn_repair.Repair(turn_repair.damage(turn_repair._filled(spark.createDataFrame(rows, TURNS), *[c.split()[0] for c in TURNS.split(", ")])))
    lines = defaultdict(list)
    for r in repair.turns().orderBy("at", "k").collect():
        lines[r.none, r.conv].append(f"{r.role}:{r.text}")
        assert r.role[:1] in "sua"
    want = {(c is None, " " if c is None else str(c)): d for c, *_, d in repaired_by_strings(rows)}
    for k, digest in want.items():
        assert hashlib.sha256("\n".join(lines[k]).encode()).hexdigest() == digest
