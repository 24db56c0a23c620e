"""Benchmark decontamination with DataFrame functions alone.

Texts are lower-cased and cut into words (x20 and x09-x0D part them); a shingle is five
words. A window has as many words as an item. Every window that shares a shingle with
any item of its size and starts at one (or is the last that fits) gets a 63-bit SimHash
weighted by shingle counts; a best window of the item's size always starts so, since
sliding one to its first shared shingle loses none. Which item a window may match is
found by its fingerprint alone.

Fingerprints are compared by a multi-index: nine blocks of seven bits. Two fingerprints
at most 26 bits apart have a block at most two bits apart, so an index of each item's
blocks with all their neighbours to two bits finds every item within that radius. At a
similarity of 0.75 fingerprints are 11 bits apart on average, with a deviation of 3.
Candidates are verified by exact weighted-shingle similarity: shared counts to all
counts, 0.75 or more.

Item data up to BROADCAST_BYTES are broadcast. Beyond, shingles (document, place, hash) are
joined alone, and only documents with a hit, once each, meet their windows' places again.

Defined results: null, empty or blank texts, and texts that share no shingle, are clean.
Items without words match nothing. Repeated ids get their rows' findings
together; rows without an id are reported clean. With an empty benchmark all documents are clean. Only the named
columns are read. Items under five words have their whole sequence as one shingle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import Staging

WORDS = 5
BLOCKS, BLOCK_BITS, SLACK = 9, 7, 2
RADIUS = BLOCKS * (SLACK + 1) - 1
BITS = BLOCKS * BLOCK_BITS
LANES, LANE_BITS = 3, 21
LANE_ONES = sum(1 << (LANE_BITS * k) for k in range(LANES))
LANE_TOPS = LANE_ONES << (LANE_BITS - 1)
NUMERATOR, DENOMINATOR = 75, 100
BROADCAST_BYTES = 64 << 20
#: XOR masks of a block's neighbours.
NEIGHBOURS = [m for m in range(1 << BLOCK_BITS) if bin(m).count("1") <= SLACK]
INDEX_ROW_BYTES, KEY_ROW_BYTES = 48, 24


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), "")


def _shingles(words: Column) -> Column:
    """Hashes of all runs of five words, in order; of fewer words, of the whole sequence."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(0), F.greatest(n - WORDS, F.lit(0))), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WORDS))))
    return F.when(n >= WORDS, runs).when(n > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))


def simhash(shingles: Column, n: Column) -> Column:
    """Bit b is set when more than half of the n shingle hashes have it: counts of three bits side by side in one long."""
    out = F.lit(0).cast("long")
    over = F.shiftright(n, 1).cast("long") + 1
    for j in range(LANE_BITS):
        counts = F.aggregate(shingles, F.lit(0).cast("long"), lambda s, h: s + F.shiftrightunsigned(h, j).bitwiseAND(F.lit(LANE_ONES)))
        set_bits = F.shiftrightunsigned((counts.bitwiseOR(F.lit(LANE_TOPS)) - over * F.lit(LANE_ONES)).bitwiseAND(F.lit(LANE_TOPS)), LANE_BITS - 1)
        out = out.bitwiseOR(F.shiftleft(set_bits, j))
    return out


def _block(fingerprint: Column, k: int | Column) -> Column:
    mask = F.lit((1 << BLOCK_BITS) - 1).cast("long")
    if isinstance(k, int):
        return F.shiftrightunsigned(fingerprint, k * BLOCK_BITS).bitwiseAND(mask)
    return F.expr(f"shiftrightunsigned(fp, _b * {BLOCK_BITS})").bitwiseAND(mask)


def _shared(x: Column, y: Column) -> Column:
    """The sum over shingles of the lesser count; sets, the usual case, take one hash pass."""
    slow = F.aggregate(F.array_distinct(y), F.lit(0), lambda s, h: s + F.least(F.size(F.filter(x, lambda v: v == h)), F.size(F.filter(y, lambda v: v == h))))
    sets = (F.size(F.array_distinct(x)) == F.size(x)) & (F.size(F.array_distinct(y)) == F.size(y))
    return F.when(sets, F.size(F.array_intersect(x, y))).otherwise(slow)


def _fits(rows: int, row_bytes: int) -> bool:
    return rows * row_bytes <= BROADCAST_BYTES


def _sized(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Broadcast only below a checked size; a shuffle join otherwise."""
    return F.broadcast(df) if _fits(rows, row_bytes) else df


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity): the best window of each document for each item at 0.75 or more."""
    items = benchmark.select(F.col(item_col).alias("item_id"), words_of(F.col(item_text_col)).alias("_w")).where(F.size("_w") > 0)
    items = items.select("item_id", F.size("_w").alias("n"), _shingles(F.col("_w")).alias("item_shingles")).withColumn("k", F.size("item_shingles"))
    items = items.withColumn("item_fp", simhash(F.col("item_shingles"), F.col("k")))
    items = Staging(docs.sparkSession, "benchmark").table(items, "items")  # read three times; as an expression it would be copied into each
    n_items, n_shingles, short = items.agg(F.count("*"), F.sum("k"), F.collect_set(F.when(F.col("n") < WORDS, F.col("n")))).first()
    n_items, n_shingles = n_items or 0, n_shingles or 0
    keys = items.select("n", "k", F.explode("item_shingles").alias("h")).distinct()
    texts = docs.select(F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("_w"))
    long_keys = keys.where(F.col("n") >= WORDS)
    start = F.least(F.col("pos"), F.greatest(F.col("_m") - F.col("k"), F.lit(0)))
    if _fits(n_shingles, KEY_ROW_BYTES):
        keys, long_keys = F.broadcast(keys), F.broadcast(long_keys)
        # outer, so that no size filter makes the shingles a second time
        runs = texts.select("doc_id", F.size("_w").alias("_n"), _shingles(F.col("_w")).alias("hs")).select("doc_id", "hs", F.size("hs").alias("_m"), F.posexplode_outer("hs").alias("pos", "h"))
        windows = runs.join(long_keys, "h").select("doc_id", "n", F.slice("hs", start + 1, F.col("k")).alias("w"))
    else:
        sets = Staging(docs.sparkSession, "shingles").table(texts.select(F.monotonically_increasing_id().alias("_row"), "doc_id", _shingles(F.col("_w")).alias("hs")), "sets")
        runs = sets.select("_row", F.size("hs").alias("_m"), F.posexplode("hs").alias("pos", "h"))
        places = runs.join(long_keys, "h").select("_row", "n", "k", start.alias("at")).distinct()
        places = places.groupBy("_row").agg(F.collect_list(F.struct("n", "k", "at")).alias("_p"))  # at most a document's shingles times the items' sizes
        each = sets.join(places, "_row").select("doc_id", "hs", F.explode("_p").alias("_p"))
        windows = each.select("doc_id", F.col("_p.n").alias("n"), F.slice("hs", F.col("_p.at") + 1, F.col("_p.k")).alias("w"))
    for size in sorted(short or []):  # one to four words, each its own window
        grams = F.transform(F.sequence(F.lit(0), F.greatest(F.size("_w") - size, F.lit(0))), lambda i: F.xxhash64(F.slice("_w", i + 1, size)))
        one = texts.where(F.size("_w") >= size).select("doc_id", F.explode(F.array_distinct(grams)).alias("h")).join(keys.where(F.col("n") == size), "h")
        windows = windows.unionByName(one.select("doc_id", "n", F.array("h").alias("w")))
    # not null, so that no null test computes it once more below a join
    windows = windows.withColumn("fp", F.coalesce(simhash(F.col("w"), F.size("w")), F.lit(0).cast("long"))).withColumn("_b", F.explode(F.array(*map(F.lit, range(BLOCKS))))).withColumn("_v", _block(F.col("fp"), F.col("_b")))
    index = items.select("item_id", "n", "item_fp", "item_shingles", F.explode(F.array(*(F.struct(F.lit(b).alias("_b"), _block(F.col("item_fp"), b).alias("_own")) for b in range(BLOCKS)))).alias("_e"))
    index = index.select("item_id", "n", "item_fp", F.col("_e._b").alias("_b"), F.explode(F.array(*(F.col("_e._own").bitwiseXOR(F.lit(m).cast("long")) for m in NEIGHBOURS))).alias("_v"))
    index = _sized(index, n_items * BLOCKS * len(NEIGHBOURS), INDEX_ROW_BYTES)
    found = windows.join(index, ["n", "_b", "_v"])
    apart = F.col("fp").bitwiseXOR(F.col("item_fp"))
    earlier = F.lit(False)  # each pair once: in its first near block
    for b in range(BLOCKS - 1):
        earlier = earlier | ((F.col("_b") > b) & (F.bit_count(_block(apart, b)) <= SLACK))
    found = found.where((F.bit_count(apart) <= RADIUS) & ~earlier)
    full = _sized(items.select("item_id", "item_shingles"), n_shingles, 8)
    found = found.join(full, "item_id").withColumn("shared", _shared(F.col("w"), F.col("item_shingles")))
    union = F.size("w") + F.size("item_shingles") - F.col("shared")
    exact = found.where(DENOMINATOR * F.col("shared") >= NUMERATOR * union)
    return exact.groupBy("doc_id", "item_id").agg(F.max(F.col("shared") / union).alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids, similarity) for every row of docs."""
    pairs = contaminated_pairs(docs, benchmark, id_col, text_col, item_col, item_text_col)
    by_doc = pairs.groupBy(F.col("doc_id").alias("_d")).agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("similarity").alias("similarity"))
    out = docs.select(F.col(id_col).alias("doc_id")).join(by_doc, F.col("doc_id") == F.col("_d"), "left")
    return out.select(
        "doc_id",
        F.col("_d").isNotNull().alias("contaminated"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"),
        F.coalesce("similarity", F.lit(0.0)).alias("similarity"),
    )
