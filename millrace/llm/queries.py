"""One thin query per operator, with production parameters, over its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import (
    bin_completion,
    block_naming,
    crf_langid,
    gif_media,
    line_runs,
    minhash_lists,
    rank_sync_counts,
    secret_ledger,
    simhash_vptree,
    spelling_tiles,
    tree_bpe,
    turn_repair,
    warc,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_vptree.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash_vptree.hex_digits("fp").alias("fingerprint"), "component_id")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_completion.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_runs.drop_repeated_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_ledger.scan_documents(_table(spark, sf_dir, "documents"))
    spans = secret_ledger.spans_text("findings")
    counts = [secret_ledger.count_kind("findings", k).alias(f"n_{k}") for k in secret_ledger.KINDS]
    return found.select("doc_id", *counts, F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


def op6_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif_media.media_features(_table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_naming.exact_dedup(_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_sync_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree_bpe.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf_langid.identify(_table(spark, sf_dir, "documents"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash_lists.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_tiles.variants(_table(spark, sf_dir, "documents"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair_damaged(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_simhash, op2_warc, op3_packing, op4_line_dedup, op5_secrets, op6_gif, op7_exact_dedup, op8_token_counts, op9_bpe, op10_language, op11_minhash, op12_spelling, op13_repair)
}

_ASCII = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
#: The table of CRC-32, and the CRC-32 of a text by it.
_CRC_TABLE = """t AS (SELECT list_transform(range(256), lambda k: list_reduce(list_prepend(k, range(8)),
                lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t)"""
_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, strlen({0})),
                lambda i: CAST('0x' || hex(encode({0}))[2 * i + 1:2 * i + 2] AS BIGINT))), lambda c, b: xor(c // 256, t[1 + xor(c, b) % 256])))"""


def _way(cost: str, edit: str, line: str, to: str) -> str:
    """An edit before the best way from a state on: its cost, its edits and its lines."""
    return f"{{'c': {to}.c + {cost}, 'e': '{edit}' || {to}.e, 'x': {f'list_prepend({line}, {to}.x)' if line else f'{to}.x'}}}"


def _repair_step() -> dict[str, str]:
    """By state (n: nothing yet, s, u, a: the last turn's initial) the best way on from a row; then those with a turn inserted."""
    name = {"u": "user", "a": "assistant"}
    best = lambda *ways: f"list_sort(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))[1]"
    keep = lambda to: f"CASE WHEN good AND init = '{to}' THEN {_way('cut', 'K', "'' || line", to)} END"
    change = lambda to: f"CASE WHEN good THEN {_way('2 + cut', 'R', f"'{name[to]}:' || text", to)} END"
    insert = lambda to: _way("2", "I", f"'{name[to]}:'", to)
    after = {"n": "su", "s": "u", "u": "a", "a": "u"}
    rows = {at: best(_way("3", "D", "", at), *map(keep, outs), *[change(o) for o in outs if o in name]) for at, outs in after.items()}
    return rows | {f"{at}+": best(at, insert("a" if at == "u" else "u")) for at in after}


_STEP = _repair_step()

ORACLE_SQL = {
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
        t AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
        FROM t""",
    "op4_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, generate_subscripts(a, 1) AS pos, unnest(a) AS line
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)
        ),
        k AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM l
        ),
        f AS (
            SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
        ),
        m AS (SELECT k.doc_id, pos, line, f.key IS NOT NULL AND k.doc_id <> f.top AS gone FROM k LEFT JOIN f ON k.key = f.key)
        SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, CAST(count(*) OVER g AS BIGINT) AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op11_minhash": rf"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), {_ASCII}), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
        ),
        s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s FROM w),
        u AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n, unnest(s) AS x FROM s),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS i FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM c WHERE 100 * i >= 80 * (na + nb - i)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM s JOIN (SELECT node, min(root) AS component_id FROM r GROUP BY node) ON node = doc_id""",
    "op12_spelling": rf"""
        WITH RECURSIVE {_CRC_TABLE},
        r AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, {_ASCII}), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL),
        h AS (SELECT run, n, {_CRC.format('k')} AS h FROM (SELECT run, n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS k FROM r), t),
        v AS (
            SELECT word, CAST(sum(n) AS BIGINT) AS n
            FROM (SELECT n, CASE WHEN h % 199 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM h)
            WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
        ),
        d AS (SELECT word, n, k, word[1:k - 1] || word[k + 1:] AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM v)),
        p AS (
            SELECT a.word, b.word AS other, b.n FROM d a JOIN d b ON a.k = b.k AND a.cut = b.cut AND a.word <> b.word
            UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.cut = v.word UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.cut = v.word
        ),
        b AS (SELECT word, CAST(count(*) AS BIGINT) AS n_near, first(other ORDER BY n DESC, other) AS best, max(n) AS best_n FROM p GROUP BY word),
        f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * v.n THEN best END AS form, CASE WHEN best_n >= 5 * v.n THEN best_n END AS form_n FROM v LEFT JOIN b ON b.word = v.word),
        c AS (SELECT word, word AS at FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.at WHERE f.form IS NOT NULL)
        SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM f JOIN c ON c.word = f.word JOIN f last ON last.word = c.at WHERE last.form IS NULL""",
    "op13_repair": f"""
        WITH RECURSIVE {_CRC_TABLE},
        k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
        h AS (SELECT *, {_CRC.format('k')} % 20 AS h FROM k, t),
        d AS (
            SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE h <> 0
        ),
        o AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, left(role, 1) AS init
            FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM d)
        ),
        f AS (
            SELECT *, role || ':' || text AS line, lag(init) OVER (PARTITION BY conv_id ORDER BY i) || init AS pair, count(*) OVER (PARTITION BY conv_id) AS many,
                   CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'ok' END AS fault FROM o
        ),
        g AS (SELECT *, fault IN ('ok', 'truncated') AS good, CAST(fault = 'truncated' AS INT) AS cut FROM f),
        r AS (
            SELECT DISTINCT conv_id, many + 1 AS i, {{'c': 0, 'e': '', 'x': CAST([] AS VARCHAR[])}} AS n, {{'c': 4, 'e': 'II', 'x': ['user:', 'assistant:']}} AS s, {{'c': 2, 'e': 'I', 'x': ['assistant:']}} AS u, {{'c': 0, 'e': '', 'x': CAST([] AS VARCHAR[])}} AS a FROM g
            UNION ALL
            SELECT conv_id, i, {_STEP["n+"]} AS n, {_STEP["s+"]} AS s, u, a
            FROM (SELECT conv_id, i, n, s, {_STEP["u+"]} AS u, {_STEP["a+"]} AS a
                  FROM (SELECT g.conv_id, g.i, {_STEP["n"]} AS n, {_STEP["s"]} AS s, {_STEP["u"]} AS u, {_STEP["a"]} AS a
                        FROM r JOIN g ON g.conv_id IS NOT DISTINCT FROM r.conv_id AND g.i = r.i - 1))
        ),
        q AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
                   count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id
        )
        SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
               CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(r.n.c, 0) AS BIGINT) AS cost, coalesce(r.n.e, '') AS audit, sha256(coalesce(array_to_string(r.n.x, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN q ON q.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM c.conv_id AND r.i = 1""",
}
