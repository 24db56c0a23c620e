"""Size-tiered compaction: tiers, runs, the pick, the merge, and its installation.

`segments` is (pos, number, size_bytes), pos 0 the newest.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mergelog.operators.resolve import TOMBSTONE, latest


def size_tier(size: Column, ratio: int) -> Column:
    """ln/ln, cut to an integer: 1000 by 10 is tier 2, since the quotient falls just short of 3."""
    q = F.ln(F.greatest(size, F.lit(1)).cast("double")) / F.lit(math.log(max(ratio, 2)))
    return F.greatest(F.lit(0), q.cast("int"))


def runs(segments: DataFrame, ratio: int) -> DataFrame:
    """(start, end, tier, length) of contiguous segments of one tier, newest first: gaps and islands."""
    tiered = segments.withColumn("tier", size_tier(F.col("size_bytes"), ratio))
    island = F.row_number().over(Window.orderBy("pos")) - F.row_number().over(Window.partitionBy("tier").orderBy("pos"))
    return tiered.withColumn("_i", island).groupBy("tier", "_i").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.count("*").alias("length")).drop("_i")


def pick(segments: DataFrame, ratio: int, min_merge: int) -> DataFrame:
    """At most one row (start, end, tier, length, drop_tombstones): the newest run that is long enough, whole."""
    oldest = segments.agg(F.max("pos").alias("oldest"))
    fit = runs(segments, ratio).where(F.col("length") >= max(min_merge, 2)).orderBy("start").limit(1)
    return fit.crossJoin(F.broadcast(oldest)).select("start", "end", "tier", "length", (F.col("end") == F.col("oldest")).alias("drop_tombstones"))


def merge(rows: DataFrame, drop_tombstones: bool) -> DataFrame:
    """Rows of several segments (pos, tag, key, value): each key's newest version; tombstones go only from the oldest end."""
    merged = latest(rows, recency="pos", newest_first=True)
    return merged.where(F.col("tag") != TOMBSTONE) if drop_tombstones else merged


@dataclass(frozen=True)
class Meta:
    number: int
    size_bytes: int


def tier_of(size: int, ratio: int) -> int:
    return max(0, int(math.log(max(size, 1)) / math.log(max(ratio, 2))))


def pick_run(segments: list[Meta], ratio: int, min_merge: int) -> tuple[int, int, bool] | None:
    """(first, last exclusive, drop_tombstones) over a manifest's list: the planner of the store; its list has one item a segment."""
    first = 0
    while first < len(segments):
        last = first + 1
        while last < len(segments) and tier_of(segments[last].size_bytes, ratio) == tier_of(segments[first].size_bytes, ratio):
            last += 1
        if last - first >= max(min_merge, 2):
            return first, last, last == len(segments)
        first = last
    return None
