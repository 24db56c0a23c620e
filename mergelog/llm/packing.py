"""Best-fit packing of token sequences by linear grouping.

Lengths are bounded by the capacity, so the whole problem is its histogram. On the
driver, from at most `capacity` counts:

1. Lengths above a quarter of the capacity are sorted and cut into groups of equal
   cardinality; each group's lengths are rounded up to its largest.
2. A linear programme over the few rounded sizes chooses configurations (column
   generation: a knapsack finds each new configuration); counts are rounded down.
3. Actual lengths take the places of their groups' rounded ones, which gives room back.
4. All that is left goes in by best-fit decreasing, in runs of equal lengths.

The plan is a list of segments: the pieces of one length with ranks lo to lo + n get
consecutive sequences and one offset. Spark gives each piece its rank and its place.

Defined results: a null or empty text is one end id. Only a document longer than the
capacity is cut; its first piece has the remainder. Repeated rows are packed each on
their own. An empty table gives no pieces. Columns besides the id and the text aren't read.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import column
from .staging import Staging
from .tokens import default_tokenizer_path, document_slices

CAPACITY = 2048
GROUPS = 128
RANK_ROWS = 4_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """[(how many of each size, in how many bins)]: a basic solution of the configuration programme, rounded down. Sizes descend."""
    m = len(sizes)
    if not m:
        return []
    need, rising = np.array(counts, float), np.array(sizes[::-1])
    fits = np.searchsorted(rising, np.arange(capacity + 1), side="right")
    columns = np.zeros((m, m))
    np.fill_diagonal(columns, [capacity // s for s in sizes])
    for _ in range(60 * m):
        inverse = np.linalg.inv(columns)
        use = inverse @ need
        worth = inverse.sum(axis=0)  # the duals of bins that all cost one
        best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        each = worth[::-1].copy()
        for room in range(int(rising[0]), capacity + 1):
            gain = best[room - rising[: fits[room]]] + each[: fits[room]]
            k = int(gain.argmax())
            if gain[k] > best[room - 1] + 1e-12:
                best[room], pick[room] = gain[k], m - 1 - k
            else:
                best[room] = best[room - 1]
        if best[capacity] <= 1 + 1e-7:
            break
        new, room = np.zeros(m), capacity
        while room > 0:
            if pick[room] < 0:
                room -= 1
            else:
                new[pick[room]] += 1
                room -= sizes[pick[room]]
        step = inverse @ new
        ratio = np.where(step > 1e-9, np.maximum(use, 0) / np.where(step > 1e-9, step, 1), np.inf)
        columns[:, int(np.argmin(ratio))] = new
    use = np.floor(np.maximum(np.linalg.solve(columns, need), 0) + 1e-9).astype(int)
    return [(columns[:, k].astype(int).tolist(), int(use[k])) for k in range(m) if use[k] > 0]


class Plan:
    """Segments (length, lo, n, sequence, offset) and the number of sequences."""

    def __init__(self, capacity: int):
        self.capacity, self.bins = capacity, 0
        self.segments: list[tuple[int, int, int, int, int]] = []
        self.taken: dict[int, int] = {}
        self.room: dict[int, list[tuple[int, int]]] = {}  # free room: runs of (first bin, bins)

    def open(self, n: int) -> int:
        first, self.bins = self.bins, self.bins + n
        return first

    def put(self, length: int, n: int, first_bin: int, room: int) -> None:
        lo = self.taken.get(length, 0)
        self.taken[length] = lo + n
        self.segments.append((length, lo, n, first_bin, self.capacity - room))

    def leave(self, room: int, first_bin: int, n: int) -> None:
        if room > 0:
            self.room.setdefault(room, []).append((first_bin, n))


def packing_plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> Plan:
    plan = Plan(capacity)
    left = dict(histogram)
    if n := left.pop(capacity, 0):
        plan.put(capacity, n, plan.open(n), capacity)
    large = sorted((x for x in left if 4 * x > capacity), reverse=True)
    total = sum(left[x] for x in large)
    queues: list[deque] = []
    sizes: list[int] = []
    counts: list[int] = []
    each = -(-total // groups) if total else 0
    have = each
    for x in large:
        n = left[x]
        while n:
            if have >= each:
                queues.append(deque())
                sizes.append(x)
                counts.append(0)
                have = 0
            k = min(n, each - have)
            queues[-1].append([x, k])
            counts[-1] += k
            have += k
            n -= k
    for s in sorted({s for s in sizes if sizes.count(s) > 1}):  # groups of one size are one group
        own = [k for k, v in enumerate(sizes) if v == s]
        for k in own[1:]:
            queues[own[0]].extend(queues[k])
            counts[own[0]] += counts[k]
        for k in reversed(own[1:]):
            del queues[k], sizes[k], counts[k]
    for config, n in configurations(sizes, counts, capacity):
        slots = [k for k, times in enumerate(config) for _ in range(times)]
        while n and slots:
            runs = [queues[k][0] if queues[k] else None for k in slots]
            if any(r is None for r in runs):
                break
            uses = [sum(q is r for q in runs) for r in runs]
            k = min([n, *(r[1] // u for r, u in zip(runs, uses, strict=True))])
            if k == 0:  # one run ends within a bin: it goes to best fit
                short = next(q for q, r, u in zip(slots, runs, uses, strict=True) if r[1] < u)
                queues[short].popleft()
                continue
            first, room = plan.open(k), capacity
            for run in runs:
                plan.put(run[0], k, first, room)
                left[run[0]] -= k
                run[1] -= k
                room -= run[0]
            plan.leave(room, first, k)
            for q in set(slots):
                if queues[q] and queues[q][0][1] == 0:
                    queues[q].popleft()
            n -= k
    _best_fit(plan, left)
    return plan


def _best_fit(plan: Plan, left: dict[int, int]) -> None:
    capacity = plan.capacity
    for x in sorted((x for x, n in left.items() if n > 0), reverse=True):
        n, room = left[x], x
        while n:
            while room <= capacity and not plan.room.get(room):
                room += 1
            if room > capacity:
                break
            first, bins = plan.room[room].pop()
            k, fit = min(n, bins), room // x
            if k < bins:
                plan.room[room].append((first + k, bins - k))
            if fit > 1 and n < k * fit:  # fill each bin before the next, as one after another would
                k = max(1, min(bins, n // fit))
                plan.room[room].pop() if bins > min(n, bins) else None
                if k < bins:
                    plan.room[room].append((first + k, bins - k))
                fit = min(fit, n)
            times = min(fit, n // k)
            for t in range(times):
                plan.put(x, k, first, room - t * x)
            plan.leave(room - times * x, first, k)
            n -= times * k
        if n:
            fit = capacity // x
            for bins, times in ((n // fit, fit), (1 if n % fit else 0, n % fit)):
                if bins:
                    first = plan.open(bins)
                    for t in range(times):
                        plan.put(x, bins, first, capacity - t * x)
                    plan.leave(capacity - times * x, first, bins)


def _pieces(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            docs = column(batch, "_id").to_pylist()
            for first, ids, at in document_slices(column(batch, "_text"), path):
                raw = memoryview(ids.astype("<u4").tobytes())
                for k, (start, end) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    n = end - start
                    cut = list(range(n % capacity or capacity, n + 1, capacity)) if n > capacity else [n]
                    for piece, (a, b) in enumerate(zip([0, *cut], cut)):
                        for out, v in zip(rows, (docs[first + k], piece, a, b - a, zlib.crc32(raw[4 * (start + a) : 4 * (start + b)])), strict=True):
                            out.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(df: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for every document."""
    return df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).mapInArrow(_pieces(tokenizer or default_tokenizer_path(), capacity), PIECES)


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, rank_rows: int = RANK_ROWS) -> DataFrame:
    """pieces with sequence_id and offset. `pieces` is read twice, so it should be a written table.

    A length can hold a third of all rows, so ranks are counted within salts of a length and
    shifted by the counts of the salts before. The histogram has `capacity` rows at most, and
    the plan a few thousand segments that depend on the histogram's lengths, not on the rows:
    both are small whatever the input, which is why the plan is broadcast.
    """
    spark = pieces.sparkSession
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    plan = packing_plan(histogram, capacity, groups)
    segments = spark.createDataFrame(plan.segments or [(0, 0, 0, 0, 0)], "seg_length long, lo long, n long, first_bin long, seg_offset long")
    salts = max(1, -(-sum(histogram.values()) // rank_rows))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(salts)))
    counts = salted.groupBy("length", "_salt").count()
    before = counts.select("length", "_salt", (F.sum("count").over(Window.partitionBy("length").orderBy("_salt")) - F.col("count")).alias("_before"))
    own = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")
    ranked = salted.withColumn("_rank", F.row_number().over(own) - 1).join(before, ["length", "_salt"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    placed = ranked.join(F.broadcast(segments), (F.col("length") == F.col("seg_length")) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("lo") + F.col("n")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first_bin") + F.col("_rank") - F.col("lo")).alias("sequence_id"), F.col("seg_offset").alias("offset"))


def pack_documents(df: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    staging = Staging(df.sparkSession, "packing")
    return pack_pieces(staging.table(token_pieces(df, capacity, tokenizer, id_col, text_col), "pieces"), capacity)
