"""Exact document dedup by deterministic block naming (Karp, Miller and Rosenberg), in DataFrame operations alone.

Every text is cut into blocks of a fixed number of UTF-8 bytes. Distinct blocks are sorted and numbered, so a block
becomes an integer name; then adjacent names are paired, distinct pairs are sorted and numbered in turn, and so on until
one name is left of each document. Two documents of the same height have the same last name exactly if their bytes are
equal, so the identity has no collisions.

What is shuffled: the distinct blocks once (after a map-side combine, so a block that a third of all documents share is
sent once by each task), and then only integers. Blocks are matched to their names by a 64-bit fingerprint; the
fingerprints that two different blocks share are found first, and only those blocks are matched by their bytes.
A document of b blocks takes part in ceil(log2(b)) levels, each with half the rows of the one before. Names go back to
blocks and pairs by joins that leave the rows of a very frequent block or pair where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.support import join_groups, stage

BLOCK_BYTES = 4096


def _numbered(distinct: DataFrame, by: list[str]) -> DataFrame:
    """Integer names in sorted order within each shard; the caller writes them at once, which fixes them."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def name_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, fingerprint=F.xxhash64
) -> DataFrame:
    """(id, sha, height, name) for each row of ``docs``; (height, name) is the identity of its text.

    A null text is an empty one. Rows that repeat an id with other texts are told apart by the digest of the text, and
    rows that repeat both each give a row. ``fingerprint`` maps a block to a long; it may collide (tests pass one that
    does), which costs time and no correctness.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = docs.select(
        F.col(id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("sha"), F.encode(text, "UTF-8").alias("bytes")
    )
    count = F.greatest(F.ceil(F.octet_length("bytes") / F.lit(block_bytes)), F.lit(1)).cast("int")
    blocks = (
        cut.select("id", "sha", "bytes", count.alias("n"))
        .select(
            "id", "sha", "n",
            F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring("bytes", i * block_bytes + 1, F.lit(block_bytes)))).alias("pos", "block"),
        )
        .withColumn("fp", fingerprint("block"))
    )
    counted = lambda rows, *keys: rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    named = stage(_numbered(counted(blocks, "fp", "block"), ["fp", "block"]).select("fp", "name", "rows"), "blocks")
    total = named.agg(F.sum("rows")).first()[0] or 0
    shared = named.groupBy("fp").agg(F.count(F.lit(1)).alias("many"), F.sum("rows").alias("rows")).filter("many > 1").drop("many")
    keys = blocks.select("id", "sha", "n", "pos", "fp")
    if shared.isEmpty():
        cur = join_groups(keys, named, ["fp"], "rows", total)
    else:
        # Different blocks of one fingerprint: these few are named below the others, by their bytes.
        shared = stage(shared, "shared")
        own = stage(named.join(shared.select("fp"), "fp", "left_anti"), "own")
        same = join_groups(blocks, shared, ["fp"], "rows", total).drop("rows")
        again = stage(_numbered(counted(same, "fp", "block"), ["fp", "block"]).select("fp", "block", (-1 - F.col("name")).alias("name"), "rows"), "again")
        one = join_groups(keys, own, ["fp"], "rows", total).select("id", "sha", "n", "pos", "name")
        cur = one.unionByName(join_groups(same, again, ["fp", "block"], "rows", total).select("id", "sha", "n", "pos", "name"))
    level0 = stage(cur.select("id", "sha", "n", "pos", "name"), "level0")
    tall = level0.filter("n > 1")
    done: list[DataFrame] = []
    cur, height, most = tall, 0, tall.agg(F.max("n")).first()[0] or 1
    while most > 1:
        height, most = height + 1, (most + 1) // 2
        side = lambda k: F.max(F.when(F.col("pos") % 2 == k, F.col("name")))
        pairs = stage(
            cur.groupBy("id", "sha", ((F.col("n") + 1) / 2).cast("int").alias("n"), (F.col("pos") / 2).cast("int").alias("pos"))
            .agg(side(0).alias("a"), side(1).alias("b0"))
            .withColumn("b", F.coalesce("b0", F.lit(-(2**62))))
            .drop("b0"),
            "pairs",
        )
        names = stage(_numbered(counted(pairs, "a", "b"), ["a", "b"]).select("a", "b", "name", "rows"), "names")
        level = join_groups(pairs, names, ["a", "b"], "rows", names.agg(F.sum("rows")).first()[0] or 0).select("id", "sha", "n", "pos", "name")
        level = stage(level, "level") if most > 1 else level
        done.append(level.filter("n = 1").select("id", "sha", F.lit(height).alias("height"), "name"))
        cur = level.filter("n > 1")
    out = level0.filter("n = 1").select("id", "sha", F.lit(0).alias("height"), "name")
    if done:
        last = done[0]
        for x in done[1:]:
            last = last.unionByName(x)
        first = tall.filter("pos = 0").select(F.col("id").alias("l_id"), F.col("sha").alias("l_sha"))
        rows = first.join(last, F.col("l_id").eqNullSafe(F.col("id")) & (F.col("l_sha") == F.col("sha")))
        out = out.unionByName(rows.select("id", "sha", "height", "name"))
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, fingerprint=F.xxhash64) -> DataFrame:
    """One row per row of ``docs``: its id, keep_id (largest id among equal texts), group_size (rows of that text), kept,
    text_sha256.

    Defined cases: a null text equals an empty one; a null id counts in group_size and stays only if all ids of its group
    are null; rows that repeat id and text get equal results; a text of any length is read whole; an empty table gives no
    rows. Other columns are not read, whatever their names.
    """
    named = stage(name_documents(docs, id_col, text_col, block_bytes, fingerprint), "identity")
    groups = stage(named.groupBy("height", "name").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    kept: Column = F.col("id").eqNullSafe(F.col("keep_id"))
    return join_groups(named, groups, ["height", "name"], "group_size", named.count()).select(
        F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )
