"""Bloom filters as relations: parameters, set bits, membership."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hashing import fnv_halves

LN2 = math.log(2.0)
MOST_PROBES = 30


def bits_per_key(fpr: Column) -> Column:
    return F.greatest(F.lit(1.0), -F.log(fpr) / F.lit(LN2 * LN2))


def num_bits(n: Column, fpr: Column) -> Column:
    """At least a byte, whole bytes."""
    raw = F.greatest(F.lit(8), F.floor(F.greatest(n, F.lit(1)) * bits_per_key(fpr)).cast("long"))
    return (F.floor((raw + 7) / 8) * 8).cast("long")


def num_probes(fpr: Column) -> Column:
    """Half rounds away from zero, as for every positive double here."""
    return F.greatest(F.lit(1), F.least(F.lit(MOST_PROBES), F.floor(bits_per_key(fpr) * F.lit(LN2) + 0.5).cast("int"))).cast("int")


def bit_at(h1: Column, h2: Column, i: Column, bits: Column) -> Column:
    """(h1 + i * h2) mod bits, a zero h2 counting as one; below 2**38, so no overflow."""
    return F.pmod(h1 + i * F.when(h2 == 0, F.lit(1).cast("long")).otherwise(h2), bits)


def parameters(images: DataFrame, fpr: float, by: str = "seg") -> DataFrame:
    """(seg, n, bits, probes)."""
    p = F.lit(fpr)
    return images.groupBy(by).agg(F.count("*").alias("n")).select(by, "n", num_bits(F.col("n"), p).alias("bits"), num_probes(p).alias("probes"))


def with_hashes(df: DataFrame, key: str = "key") -> DataFrame:
    return df.withColumn("_h", fnv_halves(key)).select("*", F.col("_h.h1").alias("h1"), F.col("_h.h2").alias("h2")).drop("_h")


def positions(hashed: DataFrame) -> DataFrame:
    """A row for each probe of each row of (h1, h2, bits, probes)."""
    return hashed.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("probes").cast("long") - 1))).withColumn("bit", bit_at(F.col("h1"), F.col("h2"), F.col("_i"), F.col("bits"))).drop("_i")


def set_bits(images: DataFrame, fpr: float, by: str = "seg") -> DataFrame:
    """Distinct (seg, bit). The parameters are one row a segment and join by their own key.

    Keys go to their segment's task first: bits are several times as many, and are distinct there.
    """
    members = with_hashes(images.select(by, "key").repartition(by))
    return positions(members.join(parameters(images, fpr, by), by)).select(by, "bit").distinct()


def packed(bits: DataFrame, by: str = "seg") -> DataFrame:
    """(seg, words): each filter as an array of longs, 64 bits each; words behind the last set bit are left out."""
    lane = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("bit", F.lit(64)).cast("int"))
    words = bits.groupBy(by, F.shiftright("bit", 6).cast("int").alias("_w")).agg(F.bit_or(lane).alias("_v"))
    gap = F.col("_w") - F.coalesce(F.lag("_w").over(Window.partitionBy(by).orderBy("_w")), F.lit(-1)) - 1
    pieces = words.select(by, "_w", F.concat(F.array_repeat(F.lit(0).cast("long"), gap), F.array("_v")).alias("_p"))
    return pieces.groupBy(by).agg(F.flatten(F.sort_array(F.collect_list(F.struct("_w", "_p")))["_p"]).alias("words"))


def probe_count(fpr: float) -> int:
    """num_probes for a known rate."""
    return max(1, min(MOST_PROBES, math.floor(max(1.0, -math.log(fpr) / (LN2 * LN2)) * LN2 + 0.5)))


def every_pair(probes: DataFrame, params: DataFrame) -> DataFrame:
    """Each distinct probe key, hashed once, with each segment's parameters (one small row a segment)."""
    return with_hashes(probes.select("key").distinct()).crossJoin(F.broadcast(params))


def accepts(fpr: float) -> Column:
    """Whether a row's filter (words, bits) lets its key (h1, h2) through: all its bits are set, or it has no filter. The first clear bit ends the test."""
    out = F.lit(True)
    for i in range(probe_count(fpr)):
        bit = bit_at(F.col("h1"), F.col("h2"), F.lit(i).cast("long"), F.col("bits"))
        word = F.coalesce(F.get("words", F.shiftright(bit, 6).cast("int")), F.lit(0).cast("long"))
        out = out & (F.call_function("shiftright", word, F.pmod(bit, F.lit(64)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1)
    return F.col("words").isNull() | out


def passing(pairs: DataFrame, bits: DataFrame, fpr: float, by: str = "seg") -> DataFrame:
    """The (seg, key) of given pairs (with h1, h2, bits) that a filter lets through, and all of segments that have no bits: no filter rejects nothing."""
    return pairs.join(packed(bits, by), by, "left").where(accepts(fpr)).select(by, "key")


def spread(keys: DataFrame) -> DataFrame:
    """Keys over all tasks: few bytes that much is done with, which would else be gathered in a few."""
    return keys.repartition(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")


def matching(probes: DataFrame, params: DataFrame, bits: DataFrame, fpr: float, by: str = "seg") -> DataFrame:
    """passing(every_pair(probes, params), bits) of all pairs: filters travel with the parameters, and a pair is judged where it is made, so none is sent."""
    keys = with_hashes(spread(probes.select("key")).distinct())
    return keys.join(params.join(packed(bits, by), by, "left"), accepts(fpr)).select(by, "key")
