"""Byte formats as column expressions: little-endian integers, log frames, segment entries, checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FRAME_HEADER = 8  # length and checksum
PAYLOAD_FIXED = 9  # tag and two lengths
ENTRY_FIXED = 9


def _swapped(n: Column) -> Column:
    """The low 32 bits of a long with their bytes reversed."""
    low, second = F.lit(0xFF).cast("long"), F.lit(0xFF00).cast("long")
    outer = F.shiftleft(n.bitwiseAND(low), 24).bitwiseOR(F.shiftright(n, 24).bitwiseAND(low))
    return outer.bitwiseOR(F.shiftleft(n.bitwiseAND(second), 8)).bitwiseOR(F.shiftright(n, 8).bitwiseAND(second))


def le32(n: Column) -> Column:
    """An unsigned 32-bit integer, held in a long, as four bytes."""
    return F.unhex(F.lpad(F.hex(_swapped(n.cast("long"))), 8, "0"))


def le64(n: Column) -> Column:
    n = n.cast("long")
    return F.concat(le32(n), le32(F.shiftrightunsigned(n, 32)))


def read_le32(b: Column, start: Column | int = 1) -> Column:
    """The integer at a 1-based place of a binary column; null where fewer than four bytes are left."""
    four = F.substring(b, F.lit(start) if isinstance(start, int) else start, F.lit(4))
    return F.when(F.octet_length(four) == 4, _swapped(F.conv(F.hex(four), 16, 10).cast("long")))


def read_le64(b: Column, start: Column | int = 1) -> Column:
    """As a decimal, since unsigned 64-bit integers exceed a long."""
    wide = "decimal(20,0)"
    return (read_le32(b, start + 4).cast(wide) * F.lit(str(1 << 32)).cast(wide) + read_le32(b, start).cast(wide)).cast(wide)


def as_binary(c: Column) -> Column:
    return c.cast("binary")


def payload(tag: Column, key: Column, value: Column) -> Column:
    """tag, key length, key, value length, value."""
    return F.concat(F.unhex(F.lpad(F.hex(tag.cast("long")), 2, "0")), le32(F.octet_length(key)), as_binary(key), le32(F.octet_length(value)), as_binary(value))


def payload_length(key: Column, value: Column) -> Column:
    return (F.octet_length(key) + F.octet_length(value) + PAYLOAD_FIXED).cast("long")


def frame(tag: Column, key: Column, value: Column) -> Column:
    body = payload(tag, key, value)
    return F.concat(le32(payload_length(key, value)), le32(F.crc32(body)), body)


def frame_length(key: Column, value: Column) -> Column:
    return payload_length(key, value) + FRAME_HEADER


def entry(tag: Column, key: Column, value: Column) -> Column:
    """key length, key, tag, value length, value: not the payload's order."""
    return F.concat(le32(F.octet_length(key)), as_binary(key), F.unhex(F.lpad(F.hex(tag.cast("long")), 2, "0")), le32(F.octet_length(value)), as_binary(value))


def entry_length(key: Column, value: Column) -> Column:
    return (F.octet_length(key) + F.octet_length(value) + ENTRY_FIXED).cast("long")


def _decoded(b: Column, klen: Column, vlen: Column) -> Column:
    sound = (F.octet_length(b) >= PAYLOAD_FIXED) & (klen + PAYLOAD_FIXED <= F.octet_length(b)) & (klen + vlen + PAYLOAD_FIXED == F.octet_length(b))
    tag = F.conv(F.hex(F.substring(b, 1, 1)), 16, 10).cast("tinyint")
    made = F.struct(tag.alias("tag"), F.substring(b, F.lit(6), klen.cast("int")).alias("key"), F.substring(b, (klen + 10).cast("int"), vlen.cast("int")).alias("value"))
    return F.when(F.octet_length(b) >= PAYLOAD_FIXED, F.when(sound & tag.isin(0, 1), made))


def decode_payload(b: Column) -> Column:
    """struct(tag, key, value), or null where the bytes are too short, too long or have an unknown tag.

    One expression, in which the lengths are read again wherever they're used; of many rows decode_payloads reads each once.
    """
    klen = read_le32(b, 2)
    return _decoded(b, klen, read_le32(b, (klen + 6).cast("int")))


def decode_payloads(df: DataFrame, body: str, name: str) -> DataFrame:
    """df with decode_payload of a column in place of it; lengths are columns of their own, so each is read once a row."""
    b, klen = F.col(body), F.col("_klen")
    lengths = df.withColumn("_klen", read_le32(b, 2))
    lengths = lengths.withColumn("_vlen", F.when(klen + PAYLOAD_FIXED <= F.octet_length(b), read_le32(b, (klen + 6).cast("int"))))
    return lengths.withColumn(name, _decoded(b, klen, F.col("_vlen"))).drop("_klen", "_vlen", *({body} - {name}))
