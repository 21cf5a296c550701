"""Line dedup over levelled sorted runs of line hashes.

The documents are taken in batches of falling document id. A run is a table of (line hash, documents, lines, largest id), hash
bucketed and sorted by the hash. Each batch sums up its own lines, drops by a merge anti-join with the runs the hashes
that these already know to be settled (found often enough; with falling ids their largest id cannot change any more),
and adds what is left as a run of level 0. Whenever a level holds ``fanout`` runs they are merged into one of the next
level, so a hash is rewritten once per level. As every run is bucketed and sorted alike, joins and merges of runs need
no shuffle.

At the end the settled hashes are joined to the lines, those that very many lines have by broadcast, and the positions to
drop go back to their documents. A hash that more than 1/share of all lines have, spread over all batches, has at least
1/(share * batches) of them in one batch; so the sums of the batches, before the anti-join, tell which these are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.support import HOT, WHITE, ascii_lower, columns, fresh, hot_keys, join_around, join_groups, scratch, stage

MIN_LENGTH, MIN_DOCS, BATCHES, FANOUT = 20, 3, 4, 2
#: A batch of more documents than this is cut further; a bucket of a run has about so many hashes at most.
BATCH_DOCS, BUCKET_LINES = 20_000_000, 10_000_000


class LineRuns:
    """The runs, by level; each holds (key, docs, lines, top) with key once."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT, lines: int = 0):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines // BUCKET_LINES))
        self.levels: list[list[str]] = []

    def _write(self, df: DataFrame, dealt: bool = False) -> str:
        """``dealt``: the rows already come by bucket, as those of two joined runs do."""
        name = f"line_run_{uuid.uuid4().hex}"
        path = scratch(self.spark, "run")
        df = df if dealt else df.repartition(self.buckets, "key")
        df.write.bucketBy(self.buckets, "key").sortBy("key").option("path", path).saveAsTable(name)
        return name

    def settled(self) -> list[DataFrame]:
        return [self.spark.table(t).filter(F.col("docs") >= self.min_docs) for level in self.levels for t in level]

    def add(self, batch: DataFrame) -> None:
        """``batch``: (key, docs, lines, top), key once; its tops are below those of all earlier batches."""
        for run in self.settled():
            batch = batch.join(run.select("key").hint("merge"), "key", "left_anti")
        self._push(self._write(batch), 0)

    def _push(self, table: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(table)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._push(self._merge(old), level + 1)

    def _merge(self, tables: list[str]) -> str:
        # Keys are once in a run, so runs are merged by full outer merge joins, which their buckets need no shuffle for.
        merged = self.spark.table(tables[0])
        for t in tables[1:]:
            other = self.spark.table(t).select("key", *[F.col(c).alias(f"other_{c}") for c in ("docs", "lines", "top")]).hint("merge")
            both = [(F.coalesce(c, F.lit(0)) + F.coalesce(f"other_{c}", F.lit(0))).alias(c) for c in ("docs", "lines")]
            merged = merged.join(other, "key", "full_outer").select("key", *both, F.greatest("top", "other_top").alias("top"))
        table = self._write(merged, dealt=True)
        for t in tables:
            self.spark.sql(f"DROP TABLE {t}")
        return table

    def compact(self) -> DataFrame:
        """All runs as one."""
        tables = [t for level in self.levels for t in level]
        self.levels = [[self._merge(tables)]] if len(tables) > 1 else [tables]
        return self.spark.table(self.levels[0][0])

    def drop(self) -> None:
        """Take the runs' names out of the catalog; their files stay in the shared folder."""
        for level in self.levels:
            for t in level:
                self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        self.levels = []


def _key(line):
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


def _lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT
) -> DataFrame:
    """``docs`` with its text less the lines dropped, and n_lines, n_dropped.

    A line's key is the line stripped of white space at both ends, A-Z lower-cased. A key of at least ``min_length`` code
    points held by at least ``min_docs`` documents loses its lines in all documents but the one with the largest id.

    Defined cases: a null or empty text is one empty line and comes out empty; a text of any length is read whole; rows of
    one id are one document for the count and keep or drop a key together; rows with a null id are one document whose id is
    below all others; a document all of whose lines go has the text ''; an empty table gives no rows. Every other column
    passes through unchanged, whatever its name, but n_lines and n_dropped (in whatever case) are replaced.
    """
    spark = docs.sparkSession
    low = F.lit(-(2**63)).cast("long")
    text_of = columns([text_col])[0]
    own = {"id": F.coalesce(columns([id_col])[0].cast("long"), low), "th": F.xxhash64(F.coalesce(text_of, F.lit("")))}
    batches = max(batches, -(-docs.count() // BATCH_DOCS))
    cuts = docs.select(own["id"].alias("id")).approxQuantile("id", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    number = F.lit(0)
    for c in cuts:
        number = number + (F.col("id") <= F.lit(c)).cast("int")
    keys = F.filter(F.transform(_lines(text_of), lambda x, i: F.struct(i.alias("pos"), _key(x).alias("key"))), lambda x: F.length(x["key"]) >= min_length)
    lines = (
        docs.select(own["id"].alias("id"), own["th"].alias("th"), F.explode(keys).alias("line"))
        .select("id", "th", F.col("line.pos").alias("pos"), F.unhex(F.substring(F.sha2("line.key", 256), 1, 32)).alias("key"))
        .withColumn("batch", number)
    )
    lines = stage(lines, "lines", ("batch",))
    total = lines.count()
    runs, hot = LineRuns(spark, min_docs, fanout, total), None
    for k in range(batches):
        held = lines.filter(F.col("batch") == k).groupBy("key").agg(F.countDistinct("id").alias("docs"), F.count(F.lit(1)).alias("lines"), F.max("id").alias("top"))
        held = stage(held, "held")
        runs.add(held)
        many = held.filter(F.col("lines") * HOT * batches > total).select("key", "lines")
        hot = many if hot is None else hot.unionByName(many)
    # Fewer than HOT * batches rows.
    hot = hot.groupBy("key").agg(F.max("lines").alias("most"))
    frequent = runs.compact().filter(F.col("docs") >= min_docs).select("key", "top")
    frequent = stage(frequent.join(F.broadcast(hot), "key", "left").select("key", "top", F.coalesce("most", F.lit(0)).alias("most")), "frequent")
    runs.drop()
    hits = join_groups(lines, frequent, ["key"], "most", total, share=HOT * batches)
    d_id, d_th, gone_at, split_at = fresh(docs.columns, "d_id", "d_th", "gone_at", "split_at")
    drops = hits.filter("id <> top").groupBy(F.col("id").alias(d_id), F.col("th").alias(d_th)).agg(F.collect_set("pos").alias(gone_at))
    # The split text is a column of its own: inside the lambda below it would be split again for each line.
    named = docs.withColumns({d_id: own["id"], d_th: own["th"]})
    joined = join_around(named, drops, [d_id, d_th], hot_keys(named.select(d_id, d_th), [d_id, d_th]), "left").withColumn(split_at, _lines(text_of))
    split = F.col(split_at)
    gone = F.coalesce(F.col(gone_at), F.array().cast("array<int>"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), gone)
    text = F.when(F.size(gone) == 0, F.coalesce(text_of, F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get(split, i)), "\n"))
    rest = [c if n != text_col else text.alias(n) for c, n in zip(columns(docs.columns), docs.columns, strict=True) if n.lower() not in ("n_lines", "n_dropped")]
    return joined.select(*rest, F.size(split).cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_dropped"))
