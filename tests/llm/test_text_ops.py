"""Secrets, token counts, BPE, packing and language ID."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_dedup import corpus, documents, same
from tokenizers import Tokenizer

from millrace.llm import bin_completion, crf_langid, rank_sync_counts, secret_ledger, support, tree_bpe
from millrace.llm.bin_completion import _best_fit

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "  a", "a  ", "\n\n", "a\n\nb", "x <|endoftext|>y \n", "<|startoftext|>Hi<|endoftext|>", "don't I'LL we've 'S", "ΑΣ ΟΔΟΣ Σ", "İstanbul ǅ", "é ́a", "a\x1cb\x1d c",
    "12345 ½", "日本語テキスト", "a　b\x85c d", "👨‍👩‍👧 ok", "'s's''t", "a​b", "ẞ ß ﬁ", "<|EndOfText|>", "a\x00b", "x" * 3000, "ab" * 2500, "!?" * 2000, " " * 1500 + "x", "\n" * 1200, "日本" * 1500,
]


def odd_texts(count=800, seed=5):
    rng = random.Random(seed)
    pool = "abcde 'sStTlLΣσİ́é日½1 <|>\n\t\x1f\xa0.,!-_ǅﬁ　    "
    return ODD + ["".join(rng.choice(pool) for _ in range(rng.randint(1, 60))) for _ in range(count)]


# -- secrets -----------------------------------------------------------------------------------------------------------


def plain_secrets(text):
    out = []
    for k, (pattern, good) in enumerate(
        (
            (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
            (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
            (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
        )
    ):
        # The kelvin sign and the long s are no letters k and s here.
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text, re.A) if good(m)]
    return sorted(out)


SECRETS = [
    "password = 'hunter22' and Token:abcdef", "token=abc token=abcdef1", "secret: token=abcdef", "token=token:abcdef1", "apikey=AKIA" + "A" * 16, "AKIA1AKIA" + "B" * 15, "AKIA" + "C" * 15,
    "f" * 23, "f" * 24, "g" + "0123456789abcdef" * 3 + "x", "API_KEY\"  :  \"a.b-c/d+e=", "Key toKen=abcdefg ſecret=abcdefg", "é password=ünïcode passwd=longenough1", "password=" + "a" * 5000, "",
]


def test_secrets():
    rng = random.Random(2)
    bits = ["password", "token", "secret", "api_key", "=", ":", " ", "'", "abc", "def123", "AKIA", "ABCDEFGH12", "0f" * 8, "x", "\n"]
    for text in SECRETS + ["".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(3000)]:
        assert secret_ledger.find_secrets(text) == plain_secrets(text), text


def test_ledger(spark):
    rows = list(enumerate([*SECRETS, *SECRETS[:3], None])) + [(None, SECRETS[0]), (3, SECRETS[3]), (3, SECRETS[3])]
    docs = documents(spark, rows)
    ledger = secret_ledger.BlobLedger(spark)
    clash = docs.withColumns({"Findings": F.lit(1), "blob": F.lit(2), "found": F.lit(3), "own": F.lit(4), "a.b`c": F.lit(5), "__of": F.lit(77)})
    got = secret_ledger.scan_documents(clash, ledger=ledger)
    assert got.columns == [*docs.columns, "blob", "found", "own", "a.b`c", "__of", "findings"]
    same([(r["doc_id"], r["__of"], [(x["start"], x["kind"], x["end"]) for x in r["findings"]]) for r in got.collect()], [(i, 77, plain_secrets(t or "")) for i, t in rows])
    known = lambda v: spark.read.parquet(ledger.path).filter(F.col("rule_version") == v).count()
    own, first = secret_ledger.RULE_VERSION, len(set(SECRETS))
    assert known(own) == first
    secret_ledger.scan_documents(docs.unionByName(documents(spark, [(99, "token=new-secret")])), ledger=ledger).count()
    assert known(own) == first + 1
    secret_ledger.scan_documents(docs, ledger=ledger, version=2).count()
    assert known(2) == first
    # Two scans at the same time have both appended all they know.
    ledger.read().withColumn("rule_version", F.lit(own)).write.mode("append").partitionBy("rule_version").parquet(ledger.path + "-twice")
    for _ in range(2):
        spark.read.parquet(ledger.path + "-twice").write.mode("append").partitionBy("rule_version").parquet(ledger.path)
    same([(r["doc_id"], len(r["findings"])) for r in secret_ledger.scan_documents(docs, ledger=ledger).collect()], [(i, len(plain_secrets(t or ""))) for i, t in rows])
    texts = {r["doc_id"]: r["text"] for r in secret_ledger.redact(got).collect()}
    assert texts[0] == "[SECRET]' and [SECRET]"
    assert all(not plain_secrets(t or "") for t in texts.values())
    spans = got.filter("doc_id = 0").select(secret_ledger.spans_text("findings")).first()[0]
    assert spans == "assign:0:20,assign:26:38"
    assert secret_ledger.redact(secret_ledger.scan_documents(docs.limit(0))).count() == 0


def test_a_later_version_scans_only_what_is_new(spark, monkeypatch):
    """The batches that are scanned are those of one file a scan."""
    texts = [f"token=secret-{k % 7}" for k in range(40)] + [f"token=secret-{k}" for k in range(5, 12)]
    docs = documents(spark, list(enumerate(texts)))
    assert [p.count() for p in secret_ledger.corpus_versions(docs, "doc_id", 2)] == pytest.approx([23.5] * 2, abs=1)
    assert [p.count() for p in secret_ledger.corpus_versions(docs.limit(0), "doc_id", 2)] == [0]
    ledger = secret_ledger.BlobLedger(spark)
    scanned = []
    plain = ledger.scan

    def scan(versions, version):
        plain(versions, version)
        scanned.append(ledger.read(version).count())

    monkeypatch.setattr(ledger, "scan", scan)
    secret_ledger.scan_documents(docs, ledger=ledger)
    assert scanned == [7, 12]


def test_a_text_that_very_many_rows_have(spark):
    rows = [(k, "token=hot-secret" if k % 2 else f"password=cold-{k}" if k % 3 else None) for k in range(600)]
    got = secret_ledger.scan_documents(documents(spark, rows)).collect()
    same([(r["doc_id"], [(x["start"], x["kind"], x["end"]) for x in r["findings"]]) for r in got], [(i, plain_secrets(t or "")) for i, t in rows])


# -- tokens ------------------------------------------------------------------------------------------------------------


def test_token_counts(spark):
    library = Tokenizer.from_file(WORDS)
    texts = odd_texts()
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert rank_sync_counts.WordBpe(WORDS).count(texts) == want
    rows = [(k, t) for k, t in enumerate(texts[:60])] + [(None, None), (3, "word " * 3000)]
    got = rank_sync_counts.count_tokens(documents(spark, rows), WORDS).collect()
    same(got, [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in rows])


def test_the_table_of_counts_is_bounded(spark, monkeypatch):
    library, own = Tokenizer.from_file(WORDS), rank_sync_counts.WordBpe(WORDS)
    for name, value in (("KEPT_CHARACTERS", 400), ("KEPT_LENGTH", 12), ("ROUND_CHARACTERS", 100)):
        monkeypatch.setattr(rank_sync_counts, name, value)
    rng = random.Random(6)
    for _ in range(6):
        texts = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 40))) + " xyz " + "q" * 500 for _ in range(30)]
        assert own.count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
        assert max(map(len, own.known)) <= 12 and sum(map(len, own.known)) == own.characters
    clash = documents(spark, [(1, "a b"), (None, None)]).withColumns({"id": F.lit(1), "n_tokens": F.lit(7), "N_BYTES": F.lit(8)})
    same(rank_sync_counts.count_tokens(clash, WORDS).collect(), [(1, 3, 2, False), (None, 0, 0, False)])
    assert rank_sync_counts.count_tokens(documents(spark, []), WORDS).count() == 0


def test_bpe(spark):
    library, own = Tokenizer.from_file(BYTES), tree_bpe.TreeBpe(BYTES)
    for t in odd_texts():
        ids = library.encode(t, add_special_tokens=False).ids
        raw = own.encode(t)
        assert np.frombuffer(raw, "<u4").tolist() == ids, t[:60]
        assert own.decode(raw) == library.decode(ids, skip_special_tokens=False)
    assert own.decode(np.array([128, 50256, 300], "<u4").tobytes()) == library.decode([128, 50256, 300], skip_special_tokens=False)
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, None)]
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), digest(np.array(ids, "<u4").tobytes()), digest(library.decode(ids, skip_special_tokens=False).encode())))
    same(tree_bpe.round_trip(documents(spark, rows), BYTES).collect(), want)


def test_windows_grow_until_both_sides_agree(monkeypatch):
    library, own = Tokenizer.from_file(BYTES), tree_bpe.TreeBpe(BYTES)
    rng = random.Random(2)
    tried = []
    plain = own.leaf
    monkeypatch.setattr(own, "leaf", lambda t: (tried.append(len(t)), plain(t))[1])
    for _ in range(40):
        text = " ".join("".join(rng.choice("etaoin") for _ in range(rng.randint(1, 90))) for _ in range(20))
        for split in (1, 17, len(text) // 2):
            a, b = text[:split], text[split:]
            ids = own.meet(a, plain(a), b, plain(b), window=2)
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert max(tried) > 100 and min(tried) < 60


def test_bpe_of_odd_tables(spark):
    clash = documents(spark, [(1, "a b"), (None, None)]).withColumns({"id": F.lit(1), "ids": F.lit(2), "N_TOKENS": F.lit(7), "row": F.lit(8), "number": F.lit(9)})
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in tree_bpe.round_trip(clash, BYTES).collect()) == [(0, 0), (1, 2)]
    assert tree_bpe.round_trip(documents(spark, []), BYTES).count() == 0


@pytest.mark.parametrize("span", [1, 7, 64, 4096])
def test_texts_are_joined_exactly(span):
    library, own = Tokenizer.from_file(BYTES), tree_bpe.TreeBpe(BYTES)
    rng = random.Random(span)
    texts = [t for t in odd_texts(300, span) if len(t) < 200 * span] + [" ".join(rng.choice(["ab", "é,", "x\ny", "12", "  ", "don't", "<|endoftext|>"]) for _ in range(120))]
    for t in texts:
        assert np.frombuffer(own.encode(t, span), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t[:60]


def test_long_texts_are_dealt_by_leaf(spark):
    own = tree_bpe.TreeBpe(BYTES)
    rows = [(k, t) for k, t in enumerate(odd_texts(40))] + [(None, "word and " * 300), (1, "y" * 5000), (1, "y" * 5000)]
    df = spark.createDataFrame(rows, "id long, text string")
    got = tree_bpe.encode_documents(df, BYTES, span=50, spread=120).collect()
    same([(r["id"], bytes(r["ids"])) for r in got], [(i, own.leaf(t)) for i, t in rows])


def test_whole_vocabulary_encodes_to_itself_alike():
    library, own = Tokenizer.from_file(BYTES), tree_bpe.TreeBpe(BYTES)
    for b in own.table[:50256:7]:
        try:
            text = b.decode()
        except UnicodeDecodeError:
            continue
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("leaf", "window"), [(1, 1), (3, 1), (64, 8)])
def test_tree_joins_exactly(leaf, window):
    own = tree_bpe.TreeBpe(BYTES)
    rng = random.Random(leaf)
    for alphabet in ("ab", "etaoinshrdlu", "0123456789", "!?-", "日本é"):
        for n in (1, 2, 5, 50, 700):
            word = "".join(rng.choice(alphabet) for _ in range(n)).encode()
            assert np.frombuffer(own.unsplit(word, leaf, window), "<u4").tolist() == own.base._encode_single_piece(word)


# -- packing -----------------------------------------------------------------------------------------------------------


def used_by(patterns, capacity):
    used = Counter()
    for lengths, times in patterns:
        assert times > 0 and sum(s * n for s, n in lengths) <= capacity
        for s, n in lengths:
            used[s] += n * times
    return used


def fewest(sizes, capacity):
    """The least number of bins, by trying all."""
    sizes = sorted(sizes, reverse=True)
    for bins in range(-(-sum(sizes) // capacity), len(sizes) + 1):
        room = [capacity] * bins

        def place(k):
            if k == len(sizes):
                return True
            seen = set()
            for b in range(bins):
                if room[b] >= sizes[k] and room[b] not in seen:
                    seen.add(room[b])
                    room[b] -= sizes[k]
                    if place(k + 1):
                        return True
                    room[b] += sizes[k]
            return False

        if place(0):
            return bins
    return 0


def test_bin_completion():
    rng = random.Random(4)
    gaps = 0
    for _ in range(150):
        sizes = [rng.randint(1, 30) for _ in range(rng.randint(0, 14))]
        found = bin_completion.bin_completion(Counter(sizes), 30)
        assert used_by(found, 30) == Counter(sizes)
        gaps += sum(n for _, n in found) - fewest(sizes, 30)
    assert gaps == 0
    many = Counter(min(1024, max(1, int(rng.lognormvariate(5.5, 1.2)))) for _ in range(40_000))
    found = bin_completion.bin_completion(many)
    assert used_by(found, 1024) == many
    counts = [many.get(k, 0) for k in range(1025)]
    bound = -(-sum(s * n for s, n in many.items()) // 1024)
    assert sum(n for _, n in found) <= bound + 1 <= sum(n for _, n in _best_fit(counts, 1024)) + 1


@pytest.mark.parametrize(("triples", "seed"), [(30, 0), (30, 2), (300, 1)])
def test_sequences_of_three_without_waste_are_found(triples, seed):
    rng = random.Random(seed)
    sizes = []
    for _ in range(triples):
        a = rng.randint(260, 450)
        b = rng.randint(250, 774 - a)
        sizes += [a, b, 1024 - a - b]
    found = bin_completion.bin_completion(Counter(sizes))
    assert used_by(found, 1024) == Counter(sizes) and sum(n for _, n in found) == triples


def test_few_lengths_need_what_the_relaxed_problem_needs():
    for seed in range(12):
        rng = random.Random(seed)
        histogram = {rng.randint(60, 500): rng.randint(100, 5000) for _ in range(rng.choice((2, 3, 5, 8)))}
        found = bin_completion.bin_completion(histogram)
        counts = [histogram.get(k, 0) for k in range(1025)]
        whole, bound = bin_completion._relaxed(counts, 1024, _best_fit(counts, 1024))
        assert used_by(found, 1024) == Counter(histogram) and used_by(whole, 1024) <= Counter(histogram)
        assert sum(n for _, n in found) == math.ceil(bound - 1e-6)


def test_every_count_of_a_length_is_tried():
    counts = [0] * 31
    counts[5], counts[7], counts[4] = 3, 2, 1
    got = list(bin_completion._fillings(counts, [4, 5, 7], 24))
    want = []
    for a in range(3):
        for b in range(4):
            for c in range(2):
                waste = 24 - 7 * a - 5 * b - 4 * c
                if waste >= 0 and not any(counts[s] > n and s <= waste for s, n in ((7, a), (5, b), (4, c))):
                    want.append((waste, tuple((s, n) for s, n in ((7, a), (5, b), (4, c)) if n)))
    assert sorted(got) == sorted(want) and [w for w, _ in got] == sorted(w for w, _ in got)
    for n in (7, 1000):
        found = bin_completion.bin_completion({240: 3 * n, 152: 2 * n})
        assert used_by(found, 1024) == {240: 3 * n, 152: 2 * n} and sum(k for _, k in found) == n


def test_packing(spark):
    library = Tokenizer.from_file(BYTES)
    rows = corpus() + [(500 + k, "word " * k) for k in range(0, 40)] + [(900, "ab " * 3000)]
    got = bin_completion.pack_documents(documents(spark, rows), BYTES, capacity=128).collect()
    pieces = []
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 128 or 128
        for k, at in enumerate([0, *range(first, len(ids), 128)]):
            part = ids[at : first if k == 0 else at + 128]
            pieces.append((i, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    same([tuple(r)[:5] for r in got], pieces)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 128
    bound = -(-sum(p[3] for p in pieces) // 128)
    assert len(by) <= bound + 1
    assert bin_completion.pack_documents(documents(spark, []), BYTES).count() == 0
    cut = bin_completion.cut_pieces(documents(spark, rows[:9]), BYTES).withColumns({"Offset": F.lit(1), "salt": F.lit(2), "number": F.lit(3), "a.b": F.lit(4)})
    packed = bin_completion.pack(cut)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids", "salt", "number", "a.b", "sequence_id", "offset"]
    assert {tuple(r)[5:8] for r in packed.collect()} == {(2, 3, 4)}


@pytest.mark.parametrize(("salts", "salt_rows"), [(1, 10_000), (1, 7), (64, 1)])
def test_every_piece_has_a_place_whatever_the_salts(spark, salts, salt_rows):
    rng = random.Random(salts)
    # A third of the pieces have one length, and some rows are repeated.
    lengths = [50 if k % 3 == 0 else rng.randint(1, 50) for k in range(600)]
    rows = [(k, n) for k, n in enumerate(lengths)] + [(None, lengths[0])] * 60
    pieces = spark.createDataFrame(rows, "doc_id long, length long")
    got = bin_completion.pack(pieces, 50, salts, salt_rows).collect()
    same([(r["doc_id"], r["length"]) for r in got], rows)
    taken = Counter((r["sequence_id"], k) for r in got for k in range(r["offset"], r["offset"] + r["length"]))
    assert set(taken.values()) == {1}
    ends = Counter(r["sequence_id"] for r in got for _ in range(r["length"]))
    assert all(max(k for s, k in taken if s == i) + 1 == n <= 50 for i, n in list(ends.items())[:40])


# -- language ----------------------------------------------------------------------------------------------------------

VOCABULARY = {"en": "the of and to in that with river stone", "fr": "le la les des une dans avec pierre rivière", "de": "der die das und mit nicht stein fluss über"}


def texts_of(rng, lang, n):
    return " ".join(rng.choice(VOCABULARY[lang].split()) for _ in range(n))


@pytest.mark.parametrize(("block", "blocks"), [(3, 2), (2, 100), (32, 4096)])
def test_forward_backward_is_exact_over_whole_texts(monkeypatch, block, blocks):
    monkeypatch.setattr(crf_langid, "BLOCK", block)
    monkeypatch.setattr(crf_langid, "BLOCKS", blocks)
    rng = np.random.default_rng(0)
    many, lengths = 3, [1, 7, 4, 2, 8]
    scores, transition, start = 2 * rng.normal(size=(sum(lengths), many)), rng.normal(size=(many, many)), rng.normal(size=many)
    want, pairs, at = np.zeros_like(scores), np.zeros((many, many)), 0
    for n in lengths:
        total, own, both = 0.0, np.zeros((n, many)), np.zeros((many, many))
        for path in np.ndindex(*[many] * n):
            weight = np.exp(start[path[0]] + sum(scores[at + t, s] for t, s in enumerate(path)) + sum(transition[a, b] for a, b in zip(path, path[1:], strict=False)))
            total += weight
            for t, s in enumerate(path):
                own[t, s] += weight
            for a, b in zip(path, path[1:], strict=False):
                both[a, b] += weight
        want[at : at + n] = own / total
        pairs += both / total
        at += n
    got, found = crf_langid.forward_backward(lambda x: scores[x], crf_langid.Chains(np.repeat(np.arange(len(lengths)), lengths)), transition, start, pairs=True)
    assert np.allclose(got, want) and np.allclose(found, pairs)
    assert crf_langid.forward_backward(lambda x: scores[x], crf_langid.Chains(np.zeros(0, int)), transition, start).shape == (0, many)


def plain_prediction(model, text):
    """Of one text: the mean of its words' marginals, by one pass word by word."""
    words = [w for w in (crf_langid.letters(t) for t in text.split()) if w]
    if not words:
        return "und", 0.0
    psi = np.exp(np.stack([model.emissions([w])[0] for w in words]))
    move, n = np.exp(model.transition), len(words)
    alpha, beta = [np.exp(model.start) * psi[0]], [np.ones(len(move))]
    for t in range(1, n):
        a = (alpha[-1] / alpha[-1].sum() @ move) * psi[t]
        alpha.append(a)
    for t in range(n - 1, 0, -1):
        b = move @ (psi[t] * beta[-1])
        beta.append(b / b.sum())
    each = np.array(alpha) * np.array(beta[::-1])
    mean = (each / each.sum(1, keepdims=True)).mean(0)
    return model.languages[mean.argmax()], mean.max()


def test_predictions_are_those_of_whole_texts_however_they_are_dealt(monkeypatch):
    rng = random.Random(8)
    model = crf_langid.fit({k: [texts_of(rng, k, 20).split() for _ in range(20)] for k in VOCABULARY})
    texts = [None, "", "123", *(texts_of(rng, rng.choice(list(VOCABULARY)), rng.randint(1, 400)) for _ in range(60)), " ".join(texts_of(rng, k, 9) for k in [*VOCABULARY] * 30), "x" * 5000]
    want = [plain_prediction(model, t or "") for t in texts]
    for name, value in (("WORDS", 3), ("CHARACTERS", 20), ("BLOCKS", 5), ("KEPT_CHARACTERS", 100)):
        monkeypatch.setattr(crf_langid, name, value)
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    cut = list(support.parts(batch, "text", 7, 900))
    assert [t for p in cut for t in p.column("text").to_pylist()] == texts and max(p.num_rows for p in cut) <= 7
    got = [x for p in crf_langid._predicted(model, 0)(iter(cut)) for x in zip(p.column("lang_pred").to_pylist(), p.column("score").to_pylist(), strict=True)]
    assert [x for x, _ in want] == [x for x, _ in got]
    assert np.allclose([x for _, x in want], [x for _, x in got], atol=1e-4)


def test_the_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(crf_langid, "PER_LANGUAGE", 5)
    seen = {}
    monkeypatch.setattr(crf_langid, "fit", lambda texts: seen.update(texts))
    rows = [(1 if k < 300 else k, "word " * (k + 1), "en" if k % 3 else "fr") for k in range(900)] + [(901, "x", f"dirty {k}") for k in range(9)]
    crf_langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    # A few times as many rows of a label are drawn as are taken, of which id 1 has a third or none; rare labels are learned.
    assert {"en", "fr"} < set(seen) and all(k in ("en", "fr") or k.startswith("dirty") for k in seen) and all(1 <= len(v) <= 5 for v in seen.values())
    assert all(len(t) in {k + 1 for k in range(900)} for v in seen.values() for t in v)


def test_language(spark):
    rng = random.Random(3)
    langs = sorted(VOCABULARY)
    rows = [(k, texts_of(rng, langs[k % 3], rng.randint(5, 80)), langs[k % 3]) for k in range(240)]
    rows += [(1000, None, "en"), (1001, "123 ...", "fr"), (1002, "", None), (None, texts_of(rng, "de", 20), "de"), (1003, texts_of(rng, "en", 3000), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit(0.1), "LANG_PRED": F.lit("x"), "a`b.c": F.lit(1), "id": F.lit(2)})
    got = {r["doc_id"]: r for r in crf_langid.identify(docs).collect()}
    assert len(got) == len(rows)
    held = [(r[2], got[r[0]]["lang_pred"]) for r in rows[:240] if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert all(got[r[0]]["held_out"] == (zlib.crc32(str(r[0]).encode()) % 5 == 0) for r in rows[:240])
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert [got[k]["lang_pred"] for k in (1000, 1001, 1002, None, 1003)] == ["und", "und", "und", "de", "en"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    mixed = crf_langid.train(docs)
    each, _ = mixed.words([texts_of(rng, "en", 12) + " " + texts_of(rng, "fr", 12)])
    best = [mixed.languages[k] for k in each.argmax(1)]
    assert best[:10].count("en") >= 9 and best[-10:].count("fr") >= 9
    blank = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in crf_langid.identify(blank).collect()} == {"und"}
    assert crf_langid.identify(docs.limit(0)).count() == 0
    other = crf_langid.predict(docs.withColumnRenamed("text", "body").withColumn("text", F.lit("kept")), mixed, "body")
    assert other.columns == ["doc_id", "body", "lang", "a`b.c", "id", "text", "lang_pred", "score"]
    assert [tuple(r)[3:6] for r in other.limit(3).collect()] == [(1, 2, "kept")] * 3
    assert {r["doc_id"]: r["lang_pred"] for r in other.collect()} == {k: r["lang_pred"] for k, r in got.items()}


def test_pack_with_every_length_busy(spark, monkeypatch):
    """More pieces than one salt takes of each of 1,024 lengths, with a trivial packing in place of the search."""
    monkeypatch.setattr(bin_completion, "bin_completion", lambda histogram, capacity: [(((s, 1),), n) for s, n in histogram.items()])
    pieces = spark.range(3 * 1024).select((F.col("id") % 1024 + 1).alias("length"))
    got = bin_completion.pack(pieces, salts=1, salt_rows=2).collect()
    assert len({r["sequence_id"] for r in got}) == len(got) == 3072 and {r["offset"] for r in got} == {0}


def test_every_label_is_learned(spark, monkeypatch):
    """More labels than rows that the sample may have: one of each."""
    monkeypatch.setattr(crf_langid, "ROWS", 3)
    letters = "abcdefghij"
    rows = [(k, f"{c}{c}{c} {c}{c}", c, "s", 5) for k, c in enumerate(letters * 12)]
    model = crf_langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    assert sorted(model.languages) == list(letters)
