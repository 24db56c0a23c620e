"""FNV-1a over 64 bits with the offset basis that the filters use."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

# This basis lacks the standard one's last digit, on purpose.
BASIS, PRIME, WORD = 1469598103934665603, 1099511628211, 1 << 64


def fnv1a64(key: Column) -> Column:
    """The hash as decimal(20,0), by built-in functions alone: exact under ANSI arithmetic, for checks and short keys."""
    wide = "decimal(38,0)"
    b = key.cast("binary")
    codes = F.when(F.octet_length(b) > 0, F.transform(F.sequence(F.lit(1), F.octet_length(b)), lambda i: F.conv(F.hex(F.substring(b, i, F.lit(1))), 16, 10).cast("int"))).otherwise(F.array().cast("array<int>"))

    def step(a: Column, x: Column) -> Column:
        low = (a % 256).cast("int")
        return (((a - low.cast(wide)) + low.bitwiseXOR(x).cast(wide)).cast(wide) * F.lit(str(PRIME)).cast(wide) % F.lit(str(WORD)).cast(wide)).cast(wide)

    return F.aggregate(codes, F.lit(str(BASIS)).cast(wide), step).cast("decimal(20,0)")


HALVES = StructType([StructField("h1", LongType()), StructField("h2", LongType())])


@F.pandas_udf(HALVES)
def fnv_halves(keys: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Low and high halves of the hash, a numpy step for each byte place of a batch."""
    for batch in keys:
        raw = [k if isinstance(k, (bytes, bytearray)) else (k or "").encode() for k in batch]
        sizes = np.array([len(k) for k in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else sizes
        h = np.full(len(raw), BASIS, np.uint64)
        for k in range(int(sizes.max()) if len(sizes) else 0):
            live = np.flatnonzero(sizes > k)
            h[live] = (h[live] ^ flat[first[live] + k]) * np.uint64(PRIME)
        yield pd.DataFrame({"h1": (h & np.uint64(0xFFFFFFFF)).astype(np.int64), "h2": (h >> np.uint64(32)).astype(np.int64)})
