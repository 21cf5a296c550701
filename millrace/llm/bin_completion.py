"""Best-fit packing by bin completion branch and bound.

Only the number of pieces of each length matters for how few sequences are needed, and there are at most ``capacity``
lengths; so what is solved is that histogram, however many documents there are, and its solution is a list of patterns
(the lengths of one sequence) with how often each is used. The search is bin completion: the largest piece left opens a
sequence, all fillings of its room that leave no room for another piece are enumerated in order of their waste, each is a
branch, and branches are pruned when the waste so far leaves no chance of fewer sequences than the incumbent, which
best-fit decreasing provides at first. A filling is used as often as the histogram allows, and by later branches of its
node less often. Where that leaves more sequences than the sum of lengths asks for, the relaxed problem (patterns by
fractions, generated columns) gives a better bound, its patterns are used their whole number of times, and what is left is
searched; and dives that break ties by chance give better incumbents. The limits are NODES, those of PIVOTS and
those of RESTARTS: they bound the driver's work whatever the table, and where they end the search the incumbent stays.

The pieces get their sequences as Spark rows: within a length, salted by document, each piece has a rank (an exclusive
sum over the counts of the salts plus a row number within one salt), and ranges of ranks belong to slots of patterns. So
a length that a third of all pieces have is dealt over all salts, repeated rows or not, and pieces are moved once. A length
has as many salts as its number of pieces asks for, so what one task ranks does not grow with the corpus.
"""

from __future__ import annotations

import bisect
import heapq
import math
import random
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.support import columns, fresh, stage
from millrace.llm.tree_bpe import encode_documents

#: A length has SALTS salts, and more where they would have over SALT_ROWS pieces each.
CAPACITY, END_ID, SALTS, SALT_ROWS = 1024, 2, 64, 500_000
#: The search is cut off after so many nodes and keeps the incumbent; the first dive is always completed and has none of them.
NODES = 300
#: Pivots of the relaxed problem at most; a pivot counts for as many rows as there are lengths.
PIVOTS, PIVOT_ROWS = 1500, 300_000
#: Dives by chance at most; each looks at so many lengths for each of its fillings. The pieces at their ends that are searched.
RESTARTS, RESTART_LENGTHS, TAIL = 600, 4_000_000, 30

Pattern = tuple[tuple[tuple[int, int], ...], int]


def _best_fit(counts: list[int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over a histogram: like pieces and like rooms are handled together."""
    rooms: dict[int, dict[tuple[int, ...], int]] = {}
    for size in range(capacity, 0, -1):
        left = counts[size]
        for room in sorted(r for r in rooms if r >= size):
            if not left:
                break
            fits = room // size
            for lengths in list(rooms[room]):
                if not left:
                    break
                many = rooms[room].pop(lengths)
                full, part = divmod(left, fits)
                used = min(many, full)
                for n, k in ((used, fits), (1 if used < many and part and used == full else 0, part)):
                    if n:
                        rooms.setdefault(room - k * size, {}).setdefault(lengths + (size,) * k, 0)
                        rooms[room - k * size][lengths + (size,) * k] += n
                        left, many = left - n * k, many - n
                if many:
                    rooms[room][lengths] = rooms[room].get(lengths, 0) + many
            if not rooms[room]:
                del rooms[room]
        fits = capacity // size
        for n, k in ((left // fits, fits), (1 if left % fits else 0, left % fits)):
            if n:
                at = rooms.setdefault(capacity - k * size, {})
                at[(size,) * k] = at.get((size,) * k, 0) + n
    out = []
    for group in rooms.values():
        for lengths, n in group.items():
            out.append((tuple((s, lengths.count(s)) for s in dict.fromkeys(lengths)), n))
    return out


Filling = tuple[tuple[int, int], ...]


def _sums(counts: list[int], sizes: list[int], room: int) -> list[int]:
    """By k: a bit for each sum up to ``room`` that pieces of the first k of ``sizes`` can have."""
    full, sums = (1 << (room + 1)) - 1, [1]
    for size in sizes:
        own, left, many = sums[-1], min(counts[size], room // size), 1
        while left:
            many = min(many, left)
            own |= own << many * size & full
            left, many = left - many, many * 2
        sums.append(own)
    return sums


def _fillings(counts: list[int], sizes: list[int], room: int) -> Iterator[tuple[int, Filling]]:
    """(waste, filling) of every filling of ``room`` that leaves no room for a piece that is left, least waste first.

    ``sizes`` ascend. A filling that leaves room for another piece is dominated by the one that has it, so with a waste all
    pieces up to that length are in the filling. Each longer length is taken at every count from the most that fit down to
    none; of fillings with equal waste those with more of the larger pieces come first. They are made as they are asked
    for, and no step leads nowhere, as it is known which sums the lengths below can have.
    """
    sizes = sizes[: bisect.bisect_right(sizes, room)]
    small, sums = -1, [1]

    def exact(k: int, rest: int, taken: Filling) -> Iterator[Filling]:
        if not rest:
            yield taken
        while rest:
            size = sizes[small + k - 1]
            for n in range(min(counts[size], rest // size), 0, -1):
                if sums[k - 1] >> rest - n * size & 1:
                    yield from exact(k - 1, rest - n * size, (*taken, (size, n)))
            if not sums[k - 1] >> rest & 1:
                return
            k -= 1

    for waste in range(room + 1):
        if small != (small := bisect.bisect_right(sizes, waste)):
            sums = _sums(counts, sizes[small:], room)
            every = tuple((s, counts[s]) for s in reversed(sizes[:small]))
        rest = room - waste - sum(s * n for s, n in every)
        if rest < 0:
            return
        if sums[-1] >> rest & 1:
            for filling in exact(len(sums) - 1, rest, ()):
                yield waste, filling + every


def _branches(counts: list[int], large: int, capacity: int, slack: Callable[[], int], barred: frozenset[Filling]) -> Iterator[tuple[int, Filling, frozenset[Filling]]]:
    """(times, filling, barred) for every filling of the sequence that ``large`` opens: as often as the counts and the
    waste allow, and in later turns at every smaller number of times. Sequences with the same opener come in the order of
    their fillings, so after a branch its filling and those before it are barred until the opener changes."""
    others = counts.copy()
    others[large] -= 1
    fillings = _fillings(others, [s for s in range(1, large + 1) if others[s]], capacity - large)
    seen: list[list] = []
    more = True
    while more or seen:
        for at in seen:
            at[0] = min(at[0] - 1, slack() // at[1] if at[1] else at[0])
            if at[0] > 0:
                yield at[0], *at[2:]
        seen = [at for at in seen if at[0] > 1]
        waste, filling = next(fillings, (capacity + 1, ())) if more else (0, ())
        more = more and waste <= min(capacity, slack())
        if more and filling not in barred:
            barred |= {filling}
            need = Counter({large: 1}) + Counter(dict(filling))
            times = min(counts[s] // n for s, n in need.items())
            seen.append([min(times, slack() // waste) if waste else times, waste, filling, barred])
            yield seen[-1][0], *seen[-1][2:]


def _relaxed(counts: list[int], capacity: int, known: list[Pattern]) -> tuple[list[Pattern], float]:
    """The whole parts of a solution that may use patterns by fractions, by generated columns, never more than ``counts``;
    and a bound that no solution goes below.

    The patterns of ``known`` enter first. The counts are raised by tiny different amounts, without which thousands of
    pivots would not move at all.
    """
    sizes = np.flatnonzero(counts)
    fits = capacity // sizes
    columns = [((int(s), int(n)),) for s, n in zip(sizes, fits, strict=True)]
    need = np.array(counts, float)[sizes]
    inverse, x, at = np.diag(1 / fits), (need + np.linspace(1, 2, len(sizes)) * 1e-5) / fits, {int(s): k for k, s in enumerate(sizes)}
    first, bound = [Counter(dict(lengths)) for lengths, _ in known], 0.0
    for _ in range(min(PIVOTS, PIVOT_ROWS // len(sizes))):
        price = inverse.sum(0)
        entering = next((c for c in iter(lambda: first.pop() if first else None, None) if sum(n * price[at[s]] for s, n in c.items()) > 1 + 1e-9), None)
        if entering is None:
            worth, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
            for room in range(int(sizes[0]), capacity + 1):
                some = bisect.bisect_right(sizes, room)
                each = worth[room - sizes[:some]] + price[:some]
                taken[room] = each.argmax()
                worth[room] = each[taken[room]]
                if worth[room] <= worth[room - 1]:
                    worth[room], taken[room] = worth[room - 1], -1
            # Prices divided by the most that a sequence is worth are feasible in the dual problem.
            bound = max(bound, float(price @ need) / max(1.0, worth[capacity]))
            if worth[capacity] <= 1 + 1e-9:
                break
            room, entering = capacity, Counter()
            while room:
                size = int(sizes[taken[room]]) if taken[room] >= 0 else 0
                entering.update([size] if size else [])
                room -= size or 1
        step = sum(n * inverse[:, at[s]] for s, n in entering.items())
        k = int(np.argmin(np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)))
        by = x[k] / step[k]
        x = np.maximum(x - by * step, 0)
        x[k], columns[k] = by, tuple(sorted(entering.items(), reverse=True))
        row = inverse[k] / step[k]
        inverse -= np.outer(step, row)
        inverse[k] = row
    left, out = list(counts), []
    for lengths, times in zip(columns, np.floor(x + 1e-6).astype(int).tolist(), strict=True):
        times = min(times, *(left[s] // n for s, n in lengths))
        if times > 0:
            out.append((lengths, times))
            for s, n in lengths:
                left[s] -= n * times
    return out, bound


def _fullest(counts: list[int], sizes: list[int], room: int, rng: random.Random) -> Filling:
    """A filling of the most of ``room`` that can be filled, of sizes with many pieces left, where chance breaks near ties:
    what is left then stays as varied as it was, so that the last sequences can be filled as well as the first."""
    sizes = sizes[: bisect.bisect_right(sizes, room)]
    sums = _sums(counts, sizes, room)
    rest, k, taken = sums[-1].bit_length() - 1, len(sizes), []
    while rest:
        best, choice = -1.0, (0, 0)
        for i in range(bisect.bisect_right(sizes, rest, 0, k)):
            size, below = sizes[i], sums[i]
            value = counts[size] * (1 + 0.5 * rng.random())
            if value > best and (n := next((n for n in range(1, min(counts[size], rest // size) + 1) if below >> rest - n * size & 1), 0)):
                best, choice = value, (i, n)
        k, n = choice
        taken.append((sizes[k], n))
        rest -= n * sizes[k]
    return tuple(taken)


def _restarts(histogram: dict[int, int], capacity: int, fewest: int, bound: int, nodes: int) -> list[Pattern] | None:
    """Dives of the search that take, for the largest piece left, one of the fullest fillings by chance, down to the last
    TAIL pieces, which are searched. A dive ends as soon as its waste rules out fewer than ``fewest`` sequences."""
    total, best = sum(s * n for s, n in histogram.items()), None
    looked = 0
    for seed in range(RESTARTS):
        if looked > RESTART_LENGTHS:
            break
        rng, counts, path, used, waste = random.Random(seed), [0] * (capacity + 1), [], 0, 0
        for size, n in histogram.items():
            counts[size] = n
        sizes, left = sorted(histogram), sum(histogram.values())
        while left > TAIL and (fewest - 1) * capacity >= total + waste:
            large, looked = sizes[-1], looked + len(sizes)
            counts[large] -= 1
            filling = _fullest(counts, [s for s in sizes if counts[s]], capacity - large, rng)
            counts[large] += 1
            need = Counter({large: 1}) + Counter(dict(filling))
            # Of a filling that the counts allow often, half of them: as varied is what is left then.
            times = max(1, min(counts[s] // n for s, n in need.items()) // 2)
            counts, used, waste, path = _use(counts, used, waste, path, large, filling, times, capacity)
            left, sizes = left - times * need.total(), [s for s in sizes if counts[s]]
        if (fewest - 1) * capacity >= total + waste:
            found = [*path, *_search({s: counts[s] for s in sizes}, capacity, nodes)]
            if (many := sum(n for _, n in found)) < fewest:
                fewest, best = many, found
                if fewest <= bound:
                    break
    return best


def bin_completion(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[Pattern]:
    """Patterns ((length, times), ...) with how often each is used; they use up ``histogram`` exactly.

    While there are more sequences than the bounds (the sum of lengths, then the relaxed problem) ask for, in turn: the
    search of the whole, the search and the restarts of what the relaxed problem leaves, and the restarts of the whole.
    """
    bound = -(-sum(s * n for s, n in histogram.items()) // capacity)
    many = lambda patterns: sum(n for _, n in patterns)
    best = _search(histogram, capacity, nodes)
    if many(best) > bound:
        counts = [0] * (capacity + 1)
        for size, n in histogram.items():
            counts[size] = n
        whole, least = _relaxed(counts, capacity, best)
        bound = max(bound, math.ceil(least - 1e-6))
        for lengths, times in whole:
            for s, n in lengths:
                counts[s] -= n * times
        rest, base = {s: n for s, n in enumerate(counts) if n}, many(whole)
        for attempt in (
            lambda: [*whole, *_search(rest, capacity, nodes)],
            lambda: (found := _restarts(rest, capacity, many(best) - base, bound - base, nodes)) and [*whole, *found],
            lambda: whole and _restarts(histogram, capacity, many(best), bound, nodes),
        ):
            if many(best) > bound and (found := attempt()) and many(found) < many(best):
                best = found
    return best


def _search(histogram: dict[int, int], capacity: int, nodes: int) -> list[Pattern]:
    counts = [0] * (capacity + 1)
    for size, n in histogram.items():
        counts[size] = n
    total = sum(s * n for s, n in enumerate(counts))
    bound = -(-total // capacity)
    incumbent = _best_fit(counts, capacity)
    fewest, left, number = sum(n for _, n in incumbent), nodes, 0
    # Nodes with branches still to take: (branches that were passed over on the way, latest first, the node, its branches).
    waiting: list[tuple] = []

    def slack(waste: int) -> int:
        """With one sequence less than the incumbent's there is so much waste in all; the bound is on the sizes left."""
        return (fewest - 1) * capacity - total - waste

    def dive(passed: int, counts: list[int], used: int, waste: int, path: list[Pattern], last: int, barred: frozenset[Filling]) -> None:
        """Down by the first branch of each node, to the end or until there is too much waste. The first dive (no branch
        passed over) goes to the end and counts no nodes."""
        nonlocal incumbent, fewest, left, number
        while fewest > bound:
            large = max((s for s in range(1, capacity + 1) if counts[s]), default=0)
            if not large:
                if used < fewest:
                    fewest, incumbent = used, path
                return
            if passed and (left <= 0 or slack(waste) < 0):
                return
            left, number = left - (passed > 0), number + 1
            allowed = lambda waste=waste: slack(waste)
            branches = _branches(counts, large, capacity, allowed, barred if large == last else frozenset())
            if passed:
                first = next(branches, None)
                if first is None:
                    return
                heapq.heappush(waiting, (passed + 1, number, counts, used, waste, path, large, branches))
            else:
                heapq.heappush(waiting, (1, number, counts, used, waste, path, large, branches))
                first = next(_branches(counts, large, capacity, lambda: total + len(counts) * sum(counts), frozenset()))
            times, filling, barred = first
            counts, used, waste, path = _use(counts, used, waste, path, large, filling, times, capacity)
            last = large

    # One dive that always takes the filling of least waste; then the branches that differ from it in few places.
    dive(0, counts, 0, 0, [], 0, frozenset())
    while waiting and fewest > bound and left > 0:
        passed, order, counts, used, waste, path, large, branches = heapq.heappop(waiting)
        if slack(waste) < 0:
            continue
        found = next(branches, None)
        if found is not None:
            left -= 1
            times, filling, barred = found
            heapq.heappush(waiting, (passed + 1, order, counts, used, waste, path, large, branches))
            dive(passed, *_use(counts, used, waste, path, large, filling, times, capacity), large, barred)
    return incumbent


def _use(counts: list[int], used: int, waste: int, path: list[Pattern], large: int, option: tuple, times: int, capacity: int) -> tuple:
    need: dict[int, int] = {large: 1}
    for size, n in option:
        need[size] = need.get(size, 0) + n
    counts = counts.copy()
    for s, n in need.items():
        counts[s] -= n * times
    waste += times * (capacity - sum(s * n for s, n in need.items()))
    return counts, used + times, waste, [*path, (tuple(sorted(need.items(), reverse=True)), times)]


def _slots(patterns: list[Pattern]) -> tuple[np.ndarray, ...]:
    """By length and first rank: the sequence of that rank (the next rank has the next sequence) and the offset there."""
    ranks: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, times in patterns:
        offset = 0
        for size, n in lengths:
            for _ in range(n):
                rows.append((size << 44 | ranks.get(size, 0), sequence, offset))
                ranks[size] = ranks.get(size, 0) + times
                offset += size
        sequence += times
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3


def pack(pieces: DataFrame, capacity: int = CAPACITY, salts: int = SALTS, salt_rows: int = SALT_ROWS) -> DataFrame:
    """``pieces`` (any columns, with ``length`` from 1 to ``capacity``) with sequence_id and offset.

    Each row is a piece of its own, also where rows are repeated: it gets a number when ``pieces`` are written, which decides
    its salt. Columns of those two names (in whatever case) are replaced, all others pass through unchanged.
    """
    names = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    number, salt_at, rank_at, slot_at = fresh(pieces.columns, "number", "salt", "rank", "slot")
    pieces = stage(pieces.select(*columns(names), F.monotonically_increasing_id().alias(number)), "pieces")
    # At most capacity rows, whatever the number of documents.
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    keys, sequences, offsets = _slots(bin_completion(histogram, capacity))
    # The salts of each length, as one literal: any number of lengths may be busy.
    numbers = ",".join(str(max(salts, -(-histogram.get(k, 0) // salt_rows))) for k in range(1, capacity + 1))
    many = F.get(F.split(F.lit(numbers), ","), F.col("length").cast("int") - 1).cast("int")
    salted = pieces.withColumn(salt_at, F.pmod(F.xxhash64(number), many).cast("int"))
    # At most capacity * salts rows, and one for each salt_rows pieces.
    table = salted.groupBy("length", F.col(salt_at).alias("salt")).count().orderBy("length", "salt").collect()
    own = np.array([r["length"] << 32 | r["salt"] for r in table], np.int64)
    starts, last, sum_of = np.zeros(len(table), np.int64), None, 0
    for k, r in enumerate(table):
        sum_of = sum_of if r["length"] == last else 0
        starts[k], last, sum_of = sum_of, r["length"], sum_of + r["count"]

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def slot(length: pd.Series, salt: pd.Series, number: pd.Series) -> pd.DataFrame:
        size = length.to_numpy(np.int64)
        rank = starts[np.searchsorted(own, size << 32 | salt.to_numpy(np.int64))] + number.to_numpy(np.int64) - 1
        key = size << 44 | rank
        at = np.searchsorted(keys, key, "right") - 1
        return pd.DataFrame({"sequence_id": sequences[at] + key - keys[at], "offset": offsets[at]})

    # The order within a salt is any; equal pieces are interchangeable.
    window = Window.partitionBy("length", salt_at).orderBy(number)
    ranked = salted.withColumn(rank_at, F.row_number().over(window))
    out = ranked.withColumn(slot_at, slot("length", salt_at, rank_at))
    return out.select(*columns(names), f"{slot_at}.sequence_id", f"{slot_at}.offset")


def _cut(capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            docs, numbers, starts, lengths, parts = [], [], [], [], []
            for doc, ids in zip(b.column("id").to_pylist(), b.column("ids").to_pylist(), strict=True):
                ids += end
                n = len(ids) // 4
                first = n % capacity or capacity
                for k, at in enumerate([0, *range(first, n, capacity)]):
                    to = first if k == 0 else at + capacity
                    docs.append(doc)
                    numbers.append(k)
                    starts.append(at)
                    lengths.append(to - at)
                    parts.append(ids[4 * at : 4 * to])
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs, pa.int64()), pa.array(numbers, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(parts, pa.binary())],
                ["id", "piece", "start", "length", "ids"],
            )

    return run


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids) of every document: its ids and the end id, in pieces of ``capacity``.

    The first piece is the shorter one. A null or empty text is the end id alone. ``ids``: unsigned 32 bits each.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pieces = encode_documents(rows, path, _cut(capacity, end_id), "id long, piece int, start long, length long, ids binary")
    return pieces.withColumnRenamed("id", id_col)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of ``docs``, in few sequences.

    Defined cases: a null or empty text is the end id alone; a text of any length is packed whole, in pieces; ids may be
    null or repeated, each row is packed as a document of its own; an empty table gives no rows. Other columns are not
    read, whatever their names. For the ids themselves, pack the table of cut_pieces.
    """
    pieces = cut_pieces(docs, path, capacity, end_id, id_col, text_col)
    return pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), capacity)


__all__ = ["bin_completion", "cut_pieces", "pack", "pack_documents"]
