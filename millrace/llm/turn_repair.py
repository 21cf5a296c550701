"""Conversation structure repair by divide and conquer over four-state cost vectors.

The rows of all conversations are put in one order by ranges and cut into chunks of at most ``CHUNK`` rows, so a
conversation of any size is a sequence of chunks. What a row can do is a small step: from each of four states (nothing yet,
after a system, a user, an assistant turn) to each, the cheapest edits and, of these, the ASCII-least. Steps compose: a
chunk, too, is a step, with the cost from each state to each and the order of the audits behind them.

``crossings`` finds the states on the best way through a sequence of steps as Hirschberg's algorithm does: forward costs of
the first half and backward costs of the second meet in the middle, the best crossing is chosen, and each half is solved
alone, in linear space. Two audits of one part end with the edit of the same row, so neither begins the other unless they
are equal; the order of audits is thus the order of their parts, and is carried as ranks beside the costs: the crossing
that is chosen is the audit-least. It is called for the chunks of each conversation and then for the rows of each chunk.

The repaired text of a conversation is one digest, which cannot be computed in parts: its rows pass through one task in
order, a batch at a time, nothing held but the state of the digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import cache, lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.support import WHITE, join_groups, parts, stage

CHUNK_BITS = 12
CHUNK = 1 << CHUNK_BITS
#: Code points of a text by which rows that are equal otherwise are dealt to ranges.
LEADING = 64
NONE, SYSTEM, USER, ASSISTANT = range(4)
INF = 1 << 60
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: A row's kind: its role (system, user, assistant, other), 4 for a truncated row, 8 for one that must go.
ROLES = "sua"
#: Outputs that a state allows, with the states they lead to.
_AFTER = {NONE: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: What is inserted before a row leads from a state to a state; none is of use twice.
_ENDS = {NONE: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}

Step = tuple[tuple[tuple[int, ...], ...], tuple[tuple[int, ...], ...]]
Vector = tuple[tuple[int, int], ...]


def _ranks(values: list) -> dict:
    return {v: k for k, v in enumerate(sorted(set(values)))}


@cache
def moves(kind: int) -> dict[tuple[int, int], tuple[int, str, str]]:
    """By states before and after: cost, edits and the roles of what comes out of a row of ``kind``.

    At most three turns inserted before a row can be of use: what follows them only depends on the state.
    """
    role, more, found = ROLES[kind & 3] if kind & 3 < 3 else "", TRUNCATED if kind & 4 else 0, {}

    def offer(a: int, b: int, cost: int, edits: str, out: str) -> None:
        if (a, b) not in found or (cost, edits) < found[a, b][:2]:
            found[a, b] = (cost, edits, out)

    for a in range(4):
        ways = [(a, 0, "", "")]
        for state, cost, edits, out in ways:
            offer(a, state, cost + DELETE, edits + "D", out + "-")
            if kind < 8:
                for made, to in _AFTER[state].items():
                    if made == role:
                        offer(a, to, cost + more, edits + "K", out + "k")
                    if made in "ua":
                        offer(a, to, cost + REROLE + more, edits + "R", out + made)
            if len(edits) < 3:
                ways += [(to, cost + INSERT, edits + "I", out + made.upper()) for made, to in _AFTER[state].items() if made in "ua"]
    return found


@cache
def row_step(kind: int) -> Step:
    found = moves(kind)
    rank = _ranks([m[1] for m in found.values()])
    cost = tuple(tuple(found[a, b][0] if (a, b) in found else INF for b in range(4)) for a in range(4))
    return cost, tuple(tuple(rank[found[a, b][1]] if (a, b) in found else 0 for b in range(4)) for a in range(4))


def compose(first: Step, second: Step) -> Step:
    """Two steps as one: the least cost, then the least audit."""
    (c1, r1), (c2, r2) = first, second
    best = [min((c1[a][m] + c2[m][b], r1[a][m], r2[m][b]) for m in range(4)) for a in range(4) for b in range(4)]
    rank = _ranks([x[1:] for x in best])
    flat = [(min(x[0], INF), rank[x[1:]]) for x in best]
    return tuple(tuple(x[0] for x in flat[k : k + 4]) for k in (0, 4, 8, 12)), tuple(tuple(x[1] for x in flat[k : k + 4]) for k in (0, 4, 8, 12))


@lru_cache(maxsize=1 << 15)
def _short(kinds: bytes) -> Step:
    step = row_step(kinds[0])
    for k in kinds[1:]:
        step = compose(step, row_step(k))
    return step


def chunk_step(kinds: bytes) -> Step:
    """The rows of a chunk as one step."""
    if len(kinds) <= 16:
        return _short(kinds)
    step = _short(kinds[:16])
    for k in range(16, len(kinds), 16):
        step = compose(step, _short(kinds[k : k + 16]))
    return step


def _forward(steps: Sequence[Step], start: int) -> Vector:
    v = [(0, 0) if s == start else (INF, 0) for s in range(4)]
    for cost, rank in steps:
        best = [min((v[m][0] + cost[m][b], v[m][1], rank[m][b]) for m in range(4)) for b in range(4)]
        order = _ranks([x[1:] for x in best])
        v = [(min(x[0], INF), order[x[1:]]) for x in best]
    return tuple(v)


def _backward(steps: Sequence[Step], ends: Vector) -> Vector:
    v = ends
    for cost, rank in reversed(steps):
        best = [min((cost[a][m] + v[m][0], rank[a][m], v[m][1]) for m in range(4)) for a in range(4)]
        order = _ranks([x[1:] for x in best])
        v = tuple((min(x[0], INF), order[x[1:]]) for x in best)
    return v


#: What turns after the last row cost, by state, and the order of their audits.
FINISH: Vector = tuple((INSERT * len(_ENDS[s]), len(_ENDS[s])) for s in range(4))


def crossings(steps: Sequence[Step], start: int = NONE, ends: Vector = FINISH) -> list[int]:
    """The state after each step on the cheapest way from ``start`` to ``ends``, of these the audit-least; forward and
    backward vectors meet in the middle, then each half for itself."""
    out: list[int] = []
    todo = [(0, len(steps), start, ends)] if steps else []
    while todo:
        lo, hi, begin, goal = todo.pop()
        if hi - lo == 1:
            cost, rank = steps[lo]
            out.append(min((cost[begin][t] + goal[t][0], rank[begin][t], goal[t][1], t) for t in range(4))[3])
            continue
        mid = (lo + hi) // 2
        f, b = _forward(steps[lo:mid], begin), _backward(steps[mid:hi], goal)
        cross = min((f[s][0] + b[s][0], f[s][1], b[s][1], s) for s in range(4))[3]
        only = tuple((0, 0) if s == cross else (INF, 0) for s in range(4))
        todo += [(mid, hi, cross, goal), (lo, mid, begin, only)]
    return out


@lru_cache(maxsize=1 << 15)
def edits(kinds: bytes, start: int, end: int, last: bool) -> tuple[int, tuple[str, ...], tuple[str, ...]]:
    """Cost, and for each row of a chunk its edits and what comes out, on the best way from ``start`` to ``end``; ``last``:
    the turns that are inserted after it belong to the last row."""
    only = tuple((0, 0) if s == end else (INF, 0) for s in range(4))
    total, audit, out, at = 0, [], [], start
    for kind, to in zip(kinds, crossings([row_step(k) for k in kinds], start, only), strict=True):
        cost, e, o = moves(kind)[at, to]
        total, at = total + cost, to
        audit.append(e)
        out.append(o)
    if last and _ENDS[end]:
        total += INSERT * len(_ENDS[end])
        audit[-1] += _ENDS[end]
        out[-1] += "UA" if end == SYSTEM else "A"
    return total, tuple(audit), tuple(out)


# -- damage and faults -------------------------------------------------------------------------------------------------


def _filled(docs: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(none, conv, turn, role, text, h): nulls of role and text are one space, and so are those of the damage's key."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.pmod(F.crc32(F.concat(text(id_col), F.lit(":"), text(turn_col)).cast("binary")), F.lit(20))
    return docs.select(F.col(id_col).isNull().alias("none"), text(id_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"), h.alias("h"))


def damage(rows: DataFrame) -> DataFrame:
    """``rows`` (of _filled) with a fault planted in a quarter of them, and ``copy``: 1 for the second of a repeated row."""
    h = F.col("h")
    text = F.when(h == 1, "").when(h == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(h == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.filter(h != 0).select("none", "conv", "turn", F.when(h == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies)


def in_order(rows: DataFrame) -> DataFrame:
    """``rows`` written in the order of conversation, turn (nulls first), role and text, with ``at``, a number that grows in
    that order. Ranges are cut by the first LEADING code points of texts, too, so no conversation or turn is one task."""
    keys = [F.col("none"), F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role")]
    lead = F.substring("text", 1, LEADING)
    ranged = rows.repartitionByRange(*keys, lead).sortWithinPartitions(*keys, "text", "copy")
    return stage(ranged.withColumn("at", F.monotonically_increasing_id()), "ordered")


def _last(column: str) -> Column:
    return F.right(F.rtrim(column, F.lit(WHITE)), F.lit(1))


def faults(ordered: DataFrame) -> DataFrame:
    """(none, conv, turn, at, initial, fault) of each row, fault: blank, duplicate, truncated or ok."""
    blank = F.btrim("text", F.lit(WHITE)) == ""
    own = ["none", "conv", "role", "digest"]
    rows = ordered.select("none", "conv", "turn", "role", "at", blank.alias("blank"), _last("text").isin(".", "!", "?").alias("ended"), F.sha2("text", 256).alias("digest"))
    rows = stage(rows, "digests")
    full = rows.filter("not blank")
    again = full.groupBy(*own).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    # Most rows are the only ones of their text: they have no row in ``again``.
    marked = join_groups(full, stage(again, "repeated"), own, "times", full.count(), "left")
    fault = F.when(F.col("at") > F.col("first"), "duplicate").when(F.col("ended"), "ok").otherwise("truncated")
    out = ["none", "conv", "turn", "at", F.substring("role", 1, 1).alias("initial")]
    return marked.select(*out, fault.alias("fault")).unionByName(rows.filter("blank").select(*out, F.lit("blank").alias("fault")))


# -- repair ------------------------------------------------------------------------------------------------------------


def _kind() -> Column:
    """A row's kind as a code point, so that a chunk's kinds are one short string."""
    role = F.coalesce(F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2), F.lit(3))
    fault = F.when(F.col("fault") == "truncated", 4).when(F.col("fault").isin("blank", "duplicate"), 8).otherwise(0)
    return F.char(role + fault + 64)


def chunks(rows: DataFrame) -> DataFrame:
    """One row a conversation and chunk: kinds (a string of a code point a row), counts of faults, first and last initial,
    and illegal, the neighbours within the chunk that must not follow each other."""
    held = F.sort_array(F.collect_list(F.struct("at", _kind().alias("kind"), "initial")))
    counts = [F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")]
    grouped = rows.groupBy("none", "conv", F.shiftright("at", CHUNK_BITS).alias("chunk")).agg(held.alias("held"), *counts)
    pairs = F.zip_with(F.slice("held.initial", 1, F.size("held") - 1), F.slice("held.initial", 2, F.size("held")), lambda x, y: F.concat(x, y))
    illegal = F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).cast("long")
    ends = F.element_at("held.initial", 1).alias("head"), F.element_at("held.initial", -1).alias("tail")
    return grouped.select("none", "conv", "chunk", "blank", "duplicate", "truncated", F.array_join("held.kind", "").alias("kinds"), illegal.alias("illegal"), *ends)


def _codes(kinds: str) -> bytes:
    return bytes(ord(c) - 64 for c in kinds)


def _steps(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for kinds in batches:
        yield pd.Series([[x for part in chunk_step(_codes(k)) for row in part for x in row] for k in kinds])


def _ways(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """For each conversation the states before and after each of its chunks."""
    for found in batches:
        out = []
        for flat in found:
            steps = [tuple(tuple(tuple(int(x) for x in f[k : k + 4]) for k in range(h, h + 16, 4)) for h in (0, 16)) for f in flat]
            after = crossings(steps)
            out.append([4 * a + b for a, b in zip([NONE, *after], after, strict=False)])
        yield pd.Series(out)


def _edit(kinds: pd.Series, way: pd.Series, last: pd.Series) -> pd.DataFrame:
    rows = [edits(_codes(k), w >> 2, w & 3, bool(z)) for k, w, z in zip(kinds, way, last, strict=True)]
    return pd.DataFrame({"cost": [r[0] for r in rows], "audit": ["".join(r[1]) for r in rows], "out": [" ".join(r[2]) for r in rows]})


def solve(found: DataFrame) -> DataFrame:
    """``found`` (of chunks, written) with cost, audit and out: for each row of a chunk, blank-joined, what comes out of it
    (k: itself, u or a: itself in that role, -: nothing, U or A: an empty turn of that role)."""
    step = F.pandas_udf(_steps, "array<long>")
    way = F.pandas_udf(_ways, "array<int>")
    edit = F.pandas_udf(_edit, "cost long, audit string, out string")
    # A conversation has one step for each CHUNK of its rows.
    steps = found.select("none", "conv", "chunk", step("kinds").alias("step"))
    ways = steps.groupBy("none", "conv").agg(F.sort_array(F.collect_list(F.struct("chunk", "step"))).alias("s")).select("none", "conv", F.col("s.chunk").alias("chunks"), way("s.step").alias("ways"))
    each = ways.select("none", "conv", F.posexplode(F.arrays_zip("chunks", "ways")).alias("k", "w"), F.size("ways").alias("of"))
    each = each.select("none", "conv", F.col("w.chunks").alias("chunk"), F.col("w.ways").alias("way"), (F.col("k") == F.col("of") - 1).alias("last"))
    joined = found.join(stage(each, "ways"), ["none", "conv", "chunk"])
    return joined.withColumn("e", edit("kinds", "way", "last")).select(*found.columns, "e.*")


#: What comes out of a row: itself, itself with another role, turns inserted before or behind it.
_MADE = {"u": ("user", True), "a": ("assistant", True), "U": ("user", False), "A": ("assistant", False)}
_TURN = {"none": pa.bool_(), "conv": pa.string(), "at": pa.int64(), "k": pa.int32(), "role": pa.string(), "text": pa.string()}
_TURNS = "none boolean, conv string, at long, k int, role string, text string"


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired turns of rows (role, text) in order, each chunk of them behind its own row (out)."""
    outs: Iterator[str] = iter(())
    for b in batches:
        for part in parts(b):
            rows = []
            for none, conv, at, out, role, text in zip(*(part.column(c).to_pylist() for c in ("none", "conv", "at", "out", "role", "text")), strict=True):
                if out is not None:
                    outs = iter(out.split(" "))
                    continue
                for k, made in enumerate(next(outs)):
                    if made != "-":
                        new, own = _MADE.get(made, (role, True))
                        rows.append((none, conv, at, k, new, text if own else ""))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TURN.values(), strict=True)], list(_TURN))


def turns(ordered: DataFrame, solved: DataFrame, whole: bool) -> DataFrame:
    """The repaired turns, in the order of (at, k); ``whole``: each conversation in order in one partition, else each chunk."""
    ways = solved.select("none", "conv", "chunk", F.lit(-1).cast("long").alias("at"), "out", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    rows = ordered.select("none", "conv", F.shiftright("at", CHUNK_BITS).alias("chunk"), "at", F.lit(None).cast("string").alias("out"), "role", "text")
    key = ["none", "conv"] if whole else ["none", "conv", "chunk"]
    dealt = ways.unionByName(rows).repartition(*key).sortWithinPartitions("none", "conv", "chunk", "at")
    return dealt.mapInArrow(_turns, _TURNS)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(none, conv, sha): the SHA-256 of each conversation's turns, which come in order."""
    now, sha, done = None, None, []

    def batch() -> pa.RecordBatch:
        cols = list(zip(*done, strict=True)) or [(), (), ()]
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.bool_()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], ["none", "conv", "sha"])

    for b in batches:
        for part in parts(b):
            for none, conv, role, text in zip(*(part.column(c).to_pylist() for c in ("none", "conv", "role", "text")), strict=True):
                if (none, conv) == now:
                    sha.update(b"\n")
                else:
                    if now is not None:
                        done.append((*now, sha.hexdigest()))
                    now, sha = (none, conv), hashlib.sha256()
                sha.update(f"{role}:{text}".encode())
        if len(done) > 10_000:
            yield batch()
    if now is not None:
        done.append((*now, sha.hexdigest()))
    yield batch()


class Repair:
    """The repair of conversations: ``ordered`` (the rows in order, written), ``solved`` (a row a chunk)."""

    def __init__(self, rows: DataFrame):
        """``rows``: none, conv, turn, role, text, copy, without nulls but in turn."""
        self.ordered = in_order(rows)
        self.faults = stage(faults(self.ordered), "faults")
        self.solved = stage(solve(stage(chunks(self.faults), "chunks")), "solved")

    def turns(self) -> DataFrame:
        """The repaired turns: none, conv, at, k (their order is that of at, k), role, text."""
        return turns(self.ordered, self.solved, False)

    def summary(self) -> DataFrame:
        """A row a conversation that has rows: gaps, counts of faults, illegal neighbours, cost, audit, sha of the turns."""
        key, places = ["none", "conv"], F.col("hi") - F.col("lo") + 1 - F.col("different")
        gaps = self.faults.groupBy(*key).agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.countDistinct("turn").alias("different"))
        gaps = gaps.select(*key, F.coalesce(places, F.lit(0)).cast("long").alias("gaps"))
        sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "cost", "illegal")]
        whole = self.solved.groupBy(*key).agg(*sums, F.sort_array(F.collect_list(F.struct("chunk", "audit", "head", "tail"))).alias("c"))
        across = F.zip_with(F.slice("c.tail", 1, F.size("c") - 1), F.slice("c.head", 2, F.size("c")), lambda x, y: F.concat(x, y))
        illegal = F.col("illegal") + F.size(F.filter(across, lambda p: ~p.isin("su", "ua", "au")))
        whole = whole.select(*key, "blank", "duplicate", "truncated", "cost", illegal.alias("illegal"), F.array_join("c.audit", "").alias("audit"))
        digests = turns(self.ordered, self.solved, True).mapInArrow(_digests, "none boolean, conv string, sha string")
        return gaps.join(whole, key).join(digests, key, "left")


def repair_damaged(docs: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of ``docs``
    after ``damage``.

    Defined cases: a null role or text is one space, and so is a null id or turn in the damage's key; null ids are one
    conversation, null turns come first; rows of one turn are in the order of their roles and then texts, by code points,
    and equal rows are duplicates; a role other than system, user and assistant counts by its initial; a conversation
    without rows after damage, or whose turns are all deleted, has the digest of the empty string; texts and conversations
    of any length are taken whole; an empty table gives no rows. Other columns are not read, whatever their names.
    """
    filled = _filled(docs, id_col, turn_col, role_col, text_col)
    known = docs.select(F.col(id_col).isNull().alias("none"), F.coalesce(F.col(id_col).cast("string"), F.lit(" ")).alias("conv"), F.col(id_col).alias("id"))
    known = known.groupBy("none", "conv").agg(F.min("id").alias("id"))
    found = known.join(Repair(damage(filled)).summary(), ["none", "conv"], "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    sha = F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    return found.select(F.col("id").alias(id_col), *counts, F.coalesce("audit", F.lit("")).alias("audit"), sha)
