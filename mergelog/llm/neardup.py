"""Near-duplicates by HyperMinHash.

A document's set is its distinct 5-word shingles, lower-cased in A-Z; a document of fewer
words has its whole sequence as the one shingle. One hash of each shingle picks one of
128 buckets; a bucket's register keeps the leading zeros of its least hash and ten
mantissa bits, 16 bits in all. Empty registers are filled from others in an order that
depends only on which are empty, so equal registers stay as likely as sets are alike.

Candidates share a band: four compressed registers that are all equal (32 bands). A
pair's registers then estimate its similarity, corrected for chance collisions of
compressed registers; only pairs far below the threshold (five standard deviations, as
measured at SMALL shingles) are dropped. The rest are confirmed on full sets of 64-bit
shingle hashes.

Sets of fewer than SMALL shingles fill too few registers for that. Their candidates, of
any size, share one of the least shingle hashes of both: of n hashes in order all but
the last ceil(0.75 n) - 1. Every pair at 0.75 does, so none is missed, and no estimate
is made of them.

Documents of equal sets are one class; only its least row is compared. In a band, members
are linked to the least first. Bands whose members then still lie in several components
are gone through again. Their members are cut into blocks, each of one component or of
several small ones, and pairs of blocks with different components are units of bounded
size. A unit first sees sketches alone, and tells which members have a likely partner in
another component; texts travel only to units where they do, which confirm the pairs in
place and give back only links that join components. No partner is capped.

Keys with many rows (a hot band, hub, class or component) are salted in all joins.

Defined results: a null, empty or blank text has an empty set and is linked with nothing.
Rows that share an id are compared on their own, each with its own text, and each gets the
least id of its component; rows without an id link others and get the least id of their
component, if any. An empty table gives an empty result. Columns besides the id and the
text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import ODD, column, mix, word_batches
from .components import components
from .skew import needed, row_numbers, salted_join
from .staging import Staging

WORDS = 5
NUMERATOR, DENOMINATOR = 75, 100
BUCKET_BITS = 7
BUCKETS = 1 << BUCKET_BITS
MANTISSA = 10
ROWS = 4
BANDS = BUCKETS // ROWS
SIGMAS = 5
#: Sets of fewer shingles are compared by exact hashes; a set alike has at most SMALL_PARTNER.
SMALL = 32
SMALL_PARTNER = (SMALL - 1) * DENOMINATOR // NUMERATOR
#: The measured deviation of equal registers is at most this, in binomial ones, from SMALL shingles on.
SPREAD = 1.15
BLOCK_ROWS = 512
#: Fixed odd multipliers of a shingle's words.
PLACE = (ODD * (2 * np.arange(1, WORDS + 1, dtype=np.uint64) + np.uint64(1))) | np.uint64(1)
EDGES = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS)
PROBES = (mix(np.arange(BUCKETS * 64, dtype=np.uint64) * ODD) % np.uint64(BUCKETS)).astype(np.int64).reshape(BUCKETS, 64)
TURN = (np.arange(BUCKETS)[:, None] + np.arange(BUCKETS)[None, :]) % BUCKETS


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text."""
    for first, _, _, _, heads, h in word_batches(texts, lower=True):
        n = len(h)
        sh = np.zeros(n, np.uint64)
        for k in range(min(words, n)):
            sh[: n - k] += h[k:] * PLACE[k]
        sh = mix(sh)
        for row in range(len(heads) - 1):
            a, b = int(heads[row]), int(heads[row + 1])
            if b - a >= words:
                yield first + row, np.unique(sh[a : b - words + 1])
            elif b > a:
                yield first + row, mix((h[a:b] * PLACE[: b - a]).sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a))
            else:
                yield first + row, sh[:0]


def registers(hashes: np.ndarray) -> np.ndarray:
    """128 compressed registers of a sorted set, the empty ones filled from others."""
    at = np.searchsorted(hashes, EDGES)
    end = np.append(at[1:], len(hashes))
    full = end > at
    least = hashes[np.minimum(at, len(hashes) - 1)] << np.uint64(BUCKET_BITS)
    m, e = np.frexp((least >> np.uint64(12)).astype(np.float64))  # 52 bits are exact in a double
    zeros = np.where(m > 0, 52 - e, 52).astype(np.uint16)
    low = np.where(m > 0, (2 * m - 1) * (1 << MANTISSA), 0).astype(np.uint16)
    reg = (zeros << np.uint16(MANTISSA)) | low
    empty = np.flatnonzero(~full)
    if len(empty):
        probe = PROBES[empty]
        hit = full[probe]
        first = hit.argmax(axis=1)
        source = probe[np.arange(len(empty)), first]
        missed = np.flatnonzero(~hit[np.arange(len(empty)), first])
        if len(missed):
            turn = TURN[empty[missed]]
            source[missed] = turn[np.arange(len(missed)), full[turn].argmax(axis=1)]
        reg[empty] = reg[source]
    return reg


def exact_keys(n: int) -> int:
    """Of a small set's n hashes in order, how many the first ones are of which each set alike has one among its own; equal sets need none."""
    if DENOMINATOR * n < NUMERATOR * (n + 1):
        return 0  # one or two shingles: alike is equal
    return n + NUMERATOR * n // -DENOMINATOR + 1


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mask = (1 << 63) - 1
    for batch in batches:
        ids, texts = column(batch, "_id"), column(batch, "_text")
        n = len(ids)
        sizes, one, two, regs, small = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), [None] * n, [None] * n
        for row, s in shingle_sets(texts):
            sizes[row] = len(s)
            if len(s):
                one[row] = int(s.sum(dtype=np.uint64)) & mask
                two[row] = int(mix(s ^ ODD).sum(dtype=np.uint64)) & mask
                regs[row] = registers(s).tobytes()
                if len(s) <= SMALL_PARTNER:
                    small[row] = s.view(np.int64)
        columns = [ids, pa.array(sizes), pa.array(one), pa.array(two), pa.array(regs, pa.binary()), pa.array(small, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "n_shingles", "sum_1", "sum_2", "regs", "small"])


def sketches(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, n_shingles, two sums that tell equal sets, regs, the hashes of small sets)."""
    return df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).mapInArrow(_sketch, "row long, n_shingles long, sum_1 long, sum_2 long, regs binary, small array<long>")


@lru_cache(4096)
def chance(log_n: int, log_m: int) -> float:
    """The probability that registers of two disjoint sets of about 2**log sizes are equal."""
    n, m = (max(1.0, 2.0**x / BUCKETS) for x in (log_n, log_m))
    total = 0.0
    step = 1 << MANTISSA
    for zeros in range(0, 40):
        lo = (np.arange(step) + step) / (step * 2.0 ** (zeros + 1))
        hi = lo + 1 / (step * 2.0 ** (zeros + 1))
        total += float((((1 - lo) ** n - np.maximum(0, 1 - hi) ** n) * ((1 - lo) ** m - np.maximum(0, 1 - hi) ** m)).sum())
    return total


def least_equal(threshold: float = NUMERATOR / DENOMINATOR, sigmas: float = SIGMAS * SPREAD) -> int:
    """The least number of equal registers that a pair at the threshold has but for that many binomial deviations.

    A pair's corrected estimate is (equal / 128 - c) / (1 - c), c the chance of equal
    registers of disjoint sets. c is largest for small sets; taking the least c makes
    the bound valid for sets of all sizes.
    """
    c = min(chance(a, b) for a in range(0, 24, 4) for b in range(0, 24, 4))
    floor = threshold - sigmas * math.sqrt(threshold * (1 - threshold) / BUCKETS)
    return math.floor(BUCKETS * (floor * (1 - c) + c))


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, text_a, text_b) whose full sets have 100 * shared >= 75 * union."""
    for batch in batches:
        a, b = (column(batch, c).to_numpy() for c in ("a", "b"))
        keep = np.zeros(len(a), bool)
        head = np.append(True, a[1:] != a[:-1]) if len(a) else keep  # a run of one a has its set made once
        lefts = shingle_sets(column(batch, "text_a").take(pa.array(np.flatnonzero(head))))
        left = np.zeros(0, np.uint64)
        for row, right in shingle_sets(column(batch, "text_b")):
            if head[row]:
                left = next(lefts)[1]
            both = np.concatenate([left, right])
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            keep[row] = shared > 0 and DENOMINATOR * shared >= NUMERATOR * (len(both) - shared)
        yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])


def _equal(x: str, y: str) -> F.Column:
    """How many of two documents' registers are equal, as a native expression over their bytes."""
    same = lambda i: F.when(F.substring(F.col(x), 2 * i + 1, F.lit(2)) == F.substring(F.col(y), 2 * i + 1, F.lit(2)), 1).otherwise(0)
    return F.aggregate(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), F.lit(0), lambda s, i: s + same(i))


def _verified(pairs: DataFrame, texts: DataFrame, staging: Staging) -> DataFrame:
    """pairs (a, b) confirmed on full sets: b's text travels to a's, a hub's to as many tasks as its partners need."""
    ids = staging.table(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "wanted")
    t = staging.table(needed(texts, "row", ids, "row").select(F.col("row").alias("_d"), F.col("text").alias("_t")), "wanted-texts")
    with_a = salted_join(pairs, t.withColumnRenamed("_d", "a"), ["a"]).withColumnRenamed("_t", "text_a")
    both = with_a.join(t, with_a.b == t._d).select("a", "b", "text_a", F.col("_t").alias("text_b"))
    return both.mapInArrow(_confirm, "a long, b long")


class Members:
    """The members of a unit: two sides (or one, with itself), and the pairs of different components that are likely."""

    def __init__(self, side: np.ndarray, comps: np.ndarray, sizes: np.ndarray, regs: np.ndarray, sets: list):
        self.sizes, self.regs, self.sets, self.n = sizes, regs, sets, len(sizes)
        names, self.own = np.unique(comps, return_inverse=True)
        self.root = np.arange(len(names))
        self.within = not side.any()
        self.left, self.right = np.flatnonzero(side == 0), np.arange(self.n) if self.within else np.flatnonzero(side == 1)
        self.least = least_equal()
        # an index from hashes to the right side's small sets
        held = self.right[sizes[self.right] <= SMALL_PARTNER]
        hashes, holder = np.concatenate([sets[y] for y in held] or [np.zeros(0, np.uint64)]), np.repeat(held, sizes[held])
        order = np.argsort(hashes)
        self.hashes, self.holder = hashes[order], holder[order]

    def apart(self, x: int, y: int) -> bool:
        return self.root[self.own[x]] != self.root[self.own[y]]

    def join(self, x: int, y: int) -> None:
        self.root[self.root == self.root[self.own[y]]] = self.root[self.own[x]]

    def partners(self, x: int) -> tuple[np.ndarray, np.ndarray]:
        """(partners that are alike, both sets being small; likely ones of larger sets), all of other components."""
        sizes, alike, likely = self.sizes, self.right[:0], self.right[:0]
        if sizes[x] <= SMALL_PARTNER:
            at, end = np.searchsorted(self.hashes, self.sets[x]), np.searchsorted(self.hashes, self.sets[x], "right")
            shared = np.bincount(np.concatenate([self.holder[a:b] for a, b in zip(at, end)]), minlength=self.n)
            fits = (shared > 0) & (DENOMINATOR * shared >= NUMERATOR * (sizes + sizes[x] - shared))
            if self.within:
                fits[: x + 1] = False
            alike = np.flatnonzero(fits)
            alike = alike[self.root[self.own[alike]] != self.root[self.own[x]]]
        if sizes[x] >= SMALL:
            other = self.right[self.right > x] if self.within else self.right
            other = other[sizes[other] >= SMALL]
            other = other[self.root[self.own[other]] != self.root[self.own[x]]]
            other = other[DENOMINATOR * np.minimum(sizes[other], sizes[x]) >= NUMERATOR * np.maximum(sizes[other], sizes[x])]
            if len(other):
                equal = self.regs[other] == self.regs[x]
                likely = other[(equal.sum(axis=1) >= self.least) & equal.reshape(len(other), BANDS, ROWS).all(axis=2).any(axis=1)]
        return alike, likely


def _active(table: pa.Table) -> pa.Table:
    """Of a unit's sketches, the members that have a likely partner in another component."""
    if not table.num_rows:
        return pa.table({"unit": pa.array([], pa.int64()), "side": pa.array([], pa.int32()), "rep": pa.array([], pa.int64()), "component": pa.array([], pa.int64())})
    sizes = table.column("n_shingles").to_numpy()
    regs = np.stack([np.frombuffer(r, np.uint16) for r in table.column("regs").to_pylist()])
    sets = [None if s is None else np.array(s, np.int64).view(np.uint64) for s in table.column("small").to_pylist()]
    unit = Members(table.column("side").to_numpy(), table.column("component").to_numpy(), sizes, regs, sets)
    active = np.zeros(unit.n, bool)
    for x in unit.left.tolist():
        for found in unit.partners(x):
            if len(found):
                active[x] = True
                active[found] = True
    return table.select(["unit", "side", "rep", "component"]).filter(pa.array(active))


def _unit(table: pa.Table) -> pa.Table:
    """Links that join components among a unit's members, confirmed on their texts."""
    reps = table.column("rep").to_numpy()
    sets = [s for _, s in shingle_sets(table.column("text").combine_chunks())] if table.num_rows else []
    found: list[tuple[int, int]] = []
    if sets:
        unit = Members(table.column("side").to_numpy(), table.column("component").to_numpy(), np.array([len(s) for s in sets]), np.stack([registers(s) for s in sets]), sets)
        for x in unit.left.tolist():
            alike, likely = unit.partners(x)
            for y in alike.tolist():
                if unit.apart(x, y):
                    found.append((int(reps[x]), int(reps[y])))
                    unit.join(x, y)
            for y in likely.tolist():
                if unit.apart(x, y):
                    both = np.concatenate([sets[x], sets[y]])
                    both.sort()
                    shared = int((both[1:] == both[:-1]).sum())
                    if DENOMINATOR * shared >= NUMERATOR * (len(both) - shared):
                        found.append((int(reps[x]), int(reps[y])))
                        unit.join(x, y)
    return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})


def _crossed(rest: DataFrame, classes: DataFrame, texts: DataFrame, staging: Staging, block_rows: int) -> DataFrame:
    """Links between components among the members of shared bands.

    Members that bands connect make a cluster. A component with block_rows members or
    more in a cluster has blocks of its own, the others share pool blocks. A unit is a
    pair of blocks that hold different components, so members that are joined already
    never meet, and a hot cluster is many units.
    """
    cluster = staging.table(components(rest.select(F.col("hub").alias("a"), F.col("rep").alias("b")), staging, "cc-bands"), "clusters")
    nodes = rest.select("rep", "component").distinct().join(cluster.select(F.col("node").alias("rep"), F.col("component").alias("cluster")), "rep")
    nodes = staging.table(nodes.join(classes.select("rep", "n_shingles", "regs", "small"), "rep"), "nodes")
    sized = nodes.groupBy("cluster", "component").agg(F.count("*").alias("n")).withColumn("pool", F.col("n") < block_rows)
    groups = sized.groupBy("cluster", "pool", F.when(~F.col("pool"), F.col("component")).alias("own")).agg(F.ceil(F.sum("n") / block_rows).alias("blocks"))
    groups = staging.table(groups.withColumn("own", F.coalesce("own", F.lit(0).cast("long"))), "groups")  # a pool block may hold more rows than asked for, by chance
    one, two = (groups.select("cluster", *(F.col(c).alias(c + k) for c in ("pool", "own", "blocks"))) for k in "12")
    pairs = one.join(two, "cluster").where((F.col("pool1") & F.col("pool2")) | (F.col("pool1") & ~F.col("pool2")) | (~F.col("pool1") & ~F.col("pool2") & (F.col("own1") < F.col("own2"))))
    spread = pairs.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks1") - 1))).withColumn("j", F.explode(F.sequence(F.when(F.col("pool2"), F.col("i")).otherwise(F.lit(0).cast("long")), F.col("blocks2") - 1)))
    units = staging.table(spread.withColumn("unit", F.monotonically_increasing_id()), "units")
    same = F.col("pool1") & F.col("pool2") & (F.col("i") == F.col("j"))
    first = units.select("unit", F.lit(0).alias("side"), "cluster", F.col("pool1").alias("pool"), F.col("own1").alias("own"), F.col("i").alias("block"))
    second = units.where(~same).select("unit", F.lit(1).alias("side"), "cluster", F.col("pool2").alias("pool"), F.col("own2").alias("own"), F.col("j").alias("block"))
    place = salted_join(nodes.select("cluster", "component", "rep"), sized.select("cluster", "component", "pool"), ["cluster", "component"])
    place = staging.table(place.withColumn("own", F.when(F.col("pool"), F.lit(0).cast("long")).otherwise(F.col("component"))), "place")
    blocked = salted_join(place, groups, ["cluster", "pool", "own"]).select("rep", "cluster", "component", "pool", "own", F.pmod(F.xxhash64("rep"), F.col("blocks")).alias("block"))
    dealt = staging.table(blocked.join(first.unionByName(second), ["cluster", "pool", "own", "block"]).select("unit", "side", "rep", "component"), "dealt")
    seen = salted_join(dealt, nodes.select("rep", "n_shingles", "regs", "small"), ["rep"])
    active = staging.table(seen.groupBy("unit").applyInArrow(_active, "unit long, side int, rep long, component long"), "active")
    ids = staging.table(active.select("rep").distinct(), "active-rows")
    told = salted_join(active, needed(texts.withColumnRenamed("row", "rep"), "rep", ids, "rep"), ["rep"])
    return told.groupBy("unit").applyInArrow(_unit, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of df; kept: the row's id is the least of its component."""
    spark = df.sparkSession
    staging = Staging(spark, "neardup")
    keyed, number, numbered = row_numbers(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), staging)
    texts = keyed.select(F.col(number).alias("row"), "text")
    sk = staging.table(sketches(texts, "row"), "sketch")
    equal = ["sum_1", "sum_2", "n_shingles"]
    classes = staging.table(sk.where("n_shingles > 0").groupBy(*equal).agg(F.min_by("regs", "row").alias("regs"), F.min_by("small", "row").alias("small"), F.min("row").alias("rep")), "classes")
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("regs"), i * (2 * ROWS) + 1, F.lit(2 * ROWS))))
    none = F.array().cast("array<long>")
    firsts = F.element_at(F.array(*(F.lit(exact_keys(n)) for n in range(1, SMALL_PARTNER + 1))), F.col("n_shingles").cast("int"))
    exact = F.when(F.col("n_shingles") <= SMALL_PARTNER, F.transform(F.slice("small", F.lit(1), firsts), lambda h: F.xxhash64(F.lit(BANDS), h)))
    every = F.concat(F.when(F.col("n_shingles") >= SMALL, bands).otherwise(none), F.coalesce(exact, none))
    rows = staging.table(classes.select(F.explode(every).alias("key"), "rep"), "bands")
    shared = staging.table(rows.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", "hub"), "shared")
    members = staging.table(salted_join(rows, shared, ["key"]), "members")  # only bands of two or more
    staging.drop("bands", "shared")
    pairs = staging.table(members.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), "pairs")
    ids = staging.table(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "paired")
    reg = staging.table(needed(classes.select("rep", "n_shingles", "regs"), "rep", ids, "rep"), "paired-sketches")
    near = DENOMINATOR * F.least("_n", "_m") >= NUMERATOR * F.greatest("_n", "_m")
    some = near & ((F.least("_n", "_m") < SMALL) | (_equal("_p", "_q") >= least_equal()))
    with_a = salted_join(pairs, reg.select(F.col("rep").alias("a"), F.col("n_shingles").alias("_n"), F.col("regs").alias("_p")), ["a"])
    both = with_a.join(reg.select(F.col("rep").alias("b"), F.col("n_shingles").alias("_m"), F.col("regs").alias("_q")), "b")
    stars = staging.table(both.where(some).select("a", "b"), "stars")
    staging.drop("pairs", "paired", "paired-sketches")
    links = staging.table(_verified(stars, texts, staging), "links-1")
    staging.drop("wanted", "wanted-texts", "stars")
    comp = staging.table(components(links, staging, "cc1"), "comp-1")
    # what the stars left: bands whose members lie in several components
    placed = members.select("key", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    placed = staging.table(placed, "placed")
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("rep").alias("hub")).where("lo < hi").select("key", "hub")
    rest = staging.table(salted_join(placed, mixed, ["key"]).select("hub", "rep", "component").distinct(), "rest")
    final = comp
    if not rest.isEmpty():
        more = _crossed(rest, classes, texts, staging, block_rows)
        # of the stars' links their components are enough: each node keeps one
        edges = comp.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
        final = staging.table(components(edges, staging, "cc2"), "comp-2")
    staging.drop("members", "placed", "rest")
    by_class = classes.select(*equal, "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left").select(*equal, F.coalesce("component", "rep").alias("component"))
    found = salted_join(sk.select("row", *equal), by_class, equal, "left").select("row", "n_shingles", F.coalesce("component", "row").alias("component"))
    if not numbered:
        return found.select(F.col("row").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), (F.col("row") == F.col("component")).alias("kept"))
    ids = keyed.select(F.col(number).alias("row"), "doc_id")
    least = ids.select(F.col("row").alias("component"), F.col("doc_id").alias("component_id"))
    told = salted_join(staging.table(found, "found"), least, ["component"]).join(ids, "row")
    return told.select("doc_id", "n_shingles", "component_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"))
