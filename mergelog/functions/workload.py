"""Workload keys, Zipf draws and latency summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bench_key(i: Column, width: int = 16) -> Column:
    """Zero-padded, never cut."""
    text = i.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def zipf_cdf(ranks: DataFrame, skew: float, rank: str = "i") -> DataFrame:
    """(i, cdf) over 0-based ranks: running sum of 1 / (i + 1)^skew over its total."""
    w = 1 / F.pow(F.col(rank) + 1, F.lit(skew))
    running = F.sum(w).over(Window.orderBy(rank).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(w).over(Window.partitionBy())
    return ranks.select(F.col(rank), (running / total).alias("cdf"))


def zipf_draw(draws: DataFrame, cdf: DataFrame, u: str = "u", spans: int = 4096) -> DataFrame:
    """draws with the first rank whose cdf reaches u.

    Draws and marks are dealt to equal spans of [0, 1] and sorted within each; a draw after
    its span's last mark takes the first mark of the next span that has one, from a table
    of at most `spans` rows. No range join, and no task sorts all draws.
    """
    names = draws.columns

    def span(x: Column) -> Column:
        return F.least(F.floor(x * spans), F.lit(spans)).cast("long")

    marks = cdf.select(F.col("cdf").alias("_x"), F.lit(1).alias("_o"), F.col("i").alias("_i"), *(F.lit(None).cast(t).alias(n) for n, t in draws.dtypes))
    asked = draws.select(F.col(u).alias("_x"), F.lit(0).alias("_o"), F.lit(None).cast("long").alias("_i"), *names)
    both = asked.unionByName(marks).withColumn("_s", span(F.col("_x")))
    after = Window.partitionBy("_s").orderBy("_x", "_o", "_i").rowsBetween(0, Window.unboundedFollowing)
    found = both.withColumn("_d", F.first("_i", ignorenulls=True).over(after)).where("_o = 0")
    firsts = cdf.groupBy(span(F.col("cdf")).alias("_s")).agg(F.min("i").alias("_f"))
    every = draws.sparkSession.range(spans + 1).select(F.col("id").alias("_s")).join(firsts, "_s", "left")
    later = every.select("_s", F.first("_f", ignorenulls=True).over(Window.orderBy("_s").rowsBetween(1, Window.unboundedFollowing)).alias("_f"))
    return found.join(F.broadcast(later), "_s", "left").select(*names, F.coalesce("_d", "_f").alias("drawn"))


def floor_rank(n: Column, f: float) -> Column:
    """The 1-based place of a percentile: no interpolation, rounded down."""
    return F.floor(F.lit(f) * (n - 1)).cast("long") + 1


PERCENTILES = (("p50", 0.50), ("p95", 0.95), ("p99", 0.99), ("p999", 0.999))


def latency_percentiles(df: DataFrame, by: str, x: str) -> DataFrame:
    """(by, n, p50, p95, p99, p999, most)."""
    own = Window.partitionBy(by)
    ranked = df.select(by, F.col(x).alias("_x"), F.row_number().over(own.orderBy(x)).alias("_r"), F.count("*").over(own).alias("_n"))
    picks = [F.max(F.when(F.col("_r") == floor_rank(F.col("_n"), f), F.col("_x"))).alias(name) for name, f in PERCENTILES]
    return ranked.groupBy(by).agg(F.count("*").alias("n"), *picks, F.max("_x").alias("most"))


def median_of_trials(trials: DataFrame, by: str, ops: str = "ops") -> DataFrame:
    """The trial of upper-median throughput of each workload, with the least and the most."""
    own = Window.partitionBy(by)
    ranked = trials.withColumn("_r", F.row_number().over(own.orderBy(ops, "trial"))).withColumn("_n", F.count("*").over(own)).withColumn("ops_min", F.min(ops).over(own)).withColumn("ops_max", F.max(ops).over(own))
    return ranked.where(F.col("_r") == F.floor(F.col("_n") / 2) + 1).drop("_r", "_n")
