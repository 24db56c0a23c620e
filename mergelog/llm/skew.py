"""Joins and row keys that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import Staging

HOT_ROWS = 1000
#: At most this many keys can be hot, whatever the input: what is broadcast is bounded by it.
HOT_KEYS = 1_000_000
#: Ids that may be broadcast: 64 MB of longs.
BROADCAST_ROWS = 4_000_000


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", hot_rows: int = HOT_ROWS) -> DataFrame:
    """left joined with right (one row a key) on keys; a key with many rows of left is cut into parts of about hot_rows.

    `left` is read three times, so it should be a written table. A key is hot above
    max(hot_rows, rows / HOT_KEYS) rows, so by counting there are at most HOT_KEYS hot
    keys; they are broadcast with their counts, and right's row is copied once for each
    part: in all at most rows / hot_rows copies.
    """
    bar = max(hot_rows, -(-left.count() // HOT_KEYS))
    hot = left.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > bar).select(*keys, F.ceil(F.col("_n") / bar).alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1).cast("long"))
    dealt = left.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*(F.col(c) for c in left.columns)), parts)).drop("_parts")
    copied = right.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
    return dealt.join(copied, [*keys, "_salt"], how).drop("_salt")


def near_least(key: str, most: int, n: Column) -> Column:
    """Whether key's hash lies below a bound that the `most` least hashes of about n keys stay under, but for odds below 1e-9.

    Few others do (a fifth more, and some), so that what is sorted to find the least is
    bounded by `most`, where a limit in each map task leaves `most` for every task.
    """
    return F.xxhash64(key).cast("double") / 2.0**64 + 0.5 < F.lit(1.2 * (most + 8 * most**0.5 + 64)) / n


def needed(df: DataFrame, key: str, ids: DataFrame, id_col: str) -> DataFrame:
    """df's rows whose key is among ids, where these are few enough to be broadcast; else df, whose join then drops them."""
    ids = ids.select(F.col(id_col).alias(key))
    return df.join(F.broadcast(ids), key, "left_semi") if ids.count() <= BROADCAST_ROWS else df


def row_numbers(df: DataFrame, staging: Staging, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str, bool]:
    """(df with a number of its own for each row, its name, whether it isn't the id); numbers go up with (id, text), rows without an id last.

    Where all ids are different and none is null the id is the number. Otherwise the
    whole table is sorted once and written with its numbers.
    """
    name = "_row"
    while name in df.columns:
        name += "_"
    ids = df.select(F.col(id_col).cast("long").alias("_id"))
    again = ids.groupBy("_id").agg(F.count("*").alias("_n")).where(F.col("_id").isNull() | (F.col("_n") > 1))
    if again.isEmpty():
        return df.withColumn(name, F.col(id_col).cast("long")), name, False
    ordered = df.orderBy(F.asc_nulls_last(F.col(id_col).cast("long")), F.col(text_col)).withColumn(name, F.monotonically_increasing_id())
    return staging.table(ordered, "numbered"), name, True
