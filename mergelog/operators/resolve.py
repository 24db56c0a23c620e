"""Last-writer-wins state over an ordered log of puts and deletes.

A mutation is (seq, tag, key, value): tag 0 puts, tag 1 deletes. Recency is `seq`, or for
segments their place (0 = newest).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PUT, TOMBSTONE = 0, 1
NODE_OVERHEAD = 48


def admissible(mutations: DataFrame) -> DataFrame:
    """Mutations with a key that isn't empty; the write path's only test."""
    return mutations.where(F.octet_length("key") > 0)


def latest(mutations: DataFrame, *by: str, recency: str = "seq", newest_first: bool = False) -> DataFrame:
    """One row for each key (and `by`), tombstones included: the latest.

    row_number() = 1 is planned with a map-side group limit, so all but one row of a hot key
    in each task stay there, and wide values aren't aggregated.
    """
    order = F.col(recency).asc() if newest_first else F.col(recency).desc()
    w = Window.partitionBy(*by, "key").orderBy(order)
    return mutations.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def live(mutations: DataFrame, **options) -> DataFrame:
    return latest(mutations, **options).where(F.col("tag") == PUT)


def snapshot(mutations: DataFrame, seq: int | Column) -> DataFrame:
    """The live state as of a sequence number, itself included."""
    return live(mutations.where(F.col("seq") <= seq))


def get_status(probes: DataFrame, mutations: DataFrame) -> DataFrame:
    """(key, status, value) for each distinct probe: found, deleted or not_present.

    The probes cut the log down by a semi join before anything is ranked.
    """
    keys = probes.select("key").distinct()
    hits = latest(mutations.join(keys, "key", "left_semi")).select("key", "tag", "value")
    status = F.when(F.col("tag").isNull(), "not_present").when(F.col("tag") == TOMBSTONE, "deleted").otherwise("found")
    return keys.join(hits, "key", "left").select("key", status.alias("status"), F.when(F.col("tag") == PUT, F.col("value")).alias("value"))


def multi_get(probes: DataFrame, mutations: DataFrame) -> DataFrame:
    """(key, value) of the probes that are found."""
    return get_status(probes, mutations).where("status = 'found'").select("key", "value")


def history(mutations: DataFrame) -> DataFrame:
    """(key, puts, deletes, overwrites, replaced_bytes): replaced_bytes adds up the values that later mutations shadow."""
    before = F.lag(F.octet_length("value")).over(Window.partitionBy("key").orderBy("seq"))
    rows = mutations.select("key", "tag", before.alias("_b"))
    return rows.groupBy("key").agg(
        F.sum(F.when(F.col("tag") == PUT, 1).otherwise(0)).alias("puts"),
        F.sum(F.when(F.col("tag") == TOMBSTONE, 1).otherwise(0)).alias("deletes"),
        F.count("_b").alias("overwrites"),
        F.coalesce(F.sum("_b"), F.lit(0)).cast("long").alias("replaced_bytes"),
    )


def image(mutations: DataFrame, by: str = "seg") -> DataFrame:
    """The memtable's image of each segment's share of the log: latest rows with tombstones, and each key's rank."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy("key")).cast("long")
    return latest(mutations, by).withColumn("key_rank", rank)


def memory(images: DataFrame, by: str = "seg") -> DataFrame:
    """(seg, entries, bytes): key and latest value lengths and a fixed charge for each entry."""
    charge = F.octet_length("key") + F.octet_length("value") + NODE_OVERHEAD
    return images.groupBy(by).agg(F.count("*").alias("entries"), F.sum(charge).cast("long").alias("bytes"))


def scan(state: DataFrame, low=None, high=None, limit: int | None = None) -> DataFrame:
    """Live rows with low <= key < high in key order; with a limit, a seek (top-k, no full sort)."""
    if low is not None:
        state = state.where(F.col("key") >= F.lit(low))
    if high is not None:
        state = state.where(F.col("key") < F.lit(high))
    state = state.orderBy("key")
    return state.limit(limit) if limit is not None else state


def as_of(probes: DataFrame, marks: DataFrame, by: str, at: str, mark: str, carry: str) -> DataFrame:
    """probes with `carry` of the last mark at or before them in their group, null before the first: one sort, no range join."""
    names = probes.columns
    kinds = dict(probes.dtypes)
    value = dict(marks.dtypes)[carry]
    left = probes.select(*names, F.col(at).alias("_x"), F.lit(1).alias("_o"), F.lit(None).cast(value).alias("_c"))
    right = marks.select(*(F.col(n) if n == by else F.lit(None).cast(kinds[n]).alias(n) for n in names), F.col(mark).alias("_x"), F.lit(0).alias("_o"), F.col(carry).alias("_c"))
    last = Window.partitionBy(by).orderBy("_x", "_o").rowsBetween(Window.unboundedPreceding, 0)
    return left.unionByName(right).withColumn(carry, F.last("_c", ignorenulls=True).over(last)).where("_o = 1").select(*names, carry)
