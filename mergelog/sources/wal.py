"""The log's byte format: frames of length, checksum and payload.

As relations (offsets, the good prefix) and as a Python data source `kvwal` that reads
files frame by frame and stops at the first bad one. Paths may name any file system that
pyarrow reaches (file, hdfs, s3, gs); a path without a scheme is local.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from mergelog.functions.codec import frame_length, payload, payload_length

SCHEMA = "seq long, tag tinyint, key binary, value binary, start long, end long"
U32 = struct.Struct("<I")
MOST = (1 << 32) - 1
BUFFER = 1 << 20


def frames(mutations: DataFrame) -> DataFrame:
    """(seq, payload_len, frame_len, crc); a payload over 32-bit lengths is an error."""
    key, value = F.col("key"), F.col("value")
    size = payload_length(key, value)
    fits = F.when(size <= MOST, size).otherwise(F.raise_error(F.lit("a payload exceeds 32-bit lengths")).cast("long"))
    return mutations.select("seq", fits.alias("payload_len"), frame_length(key, value).alias("frame_len"), F.crc32(payload(F.col("tag"), key, value)).alias("crc"))


def offsets(framed: DataFrame, spans: int = 64) -> DataFrame:
    """framed with (start, end): a running sum in two levels, so that no task sorts the whole log.

    Sequence numbers are cut at quantiles; spans' totals give their first offsets.
    """
    marks = framed.stat.approxQuantile("seq", [k / spans for k in range(1, spans)], 0.001) if spans > 1 else []
    cuts = sorted({int(m) for m in marks})
    span = F.lit(0)
    if cuts:
        span = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("seq")))
    cut = framed.withColumn("_s", span)
    totals = cut.groupBy("_s").agg(F.sum("frame_len").alias("_t"))  # one row a span
    before = totals.select("_s", (F.sum("_t").over(Window.orderBy("_s")) - F.col("_t")).alias("_b"))
    within = F.sum("frame_len").over(Window.partitionBy("_s").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    placed = cut.withColumn("_w", within).join(F.broadcast(before), "_s").withColumn("end", (F.col("_b") + F.col("_w")).cast("long"))
    return placed.withColumn("start", F.col("end") - F.col("frame_len")).drop("_s", "_b", "_w")


def good_prefix(placed: DataFrame, bad: Column) -> DataFrame:
    """The frames before the first bad one; all that follow are dropped, sound or not."""
    first = placed.where(bad).agg(F.min("seq").alias("_bad"))
    return placed.crossJoin(F.broadcast(first)).where(F.col("_bad").isNull() | (F.col("seq") < F.col("_bad"))).drop("_bad")


def truncate_offset(placed: DataFrame, bad: Column) -> DataFrame:
    """(good_frames, keep_bytes, dropped_bytes)."""
    kept = good_prefix(placed, bad).agg(F.count("*").alias("good_frames"), F.coalesce(F.max("end"), F.lit(0)).cast("long").alias("keep_bytes"))
    whole = placed.agg(F.coalesce(F.max("end"), F.lit(0)).cast("long").alias("_all"))
    return kept.crossJoin(whole).select("good_frames", "keep_bytes", (F.col("_all") - F.col("keep_bytes")).alias("dropped_bytes"))


def encode_mutation(tag: int, key: bytes, value: bytes) -> bytes:
    body = bytes([tag]) + U32.pack(len(key)) + key + U32.pack(len(value)) + value
    if len(body) > MOST:
        raise ValueError("a payload exceeds 32-bit lengths")
    return U32.pack(len(body)) + U32.pack(zlib.crc32(body)) + body


def decode_body(body: bytes) -> tuple[int, bytes, bytes] | None:
    """(tag, key, value), or None where lengths don't fit or the tag is unknown; lengths are Python integers, so no sum wraps."""
    if len(body) < 9 or body[0] > 1:
        return None
    (k,) = U32.unpack_from(body, 1)
    if k + 9 > len(body):
        return None
    (v,) = U32.unpack_from(body, 5 + k)
    return (body[0], body[5 : 5 + k], body[9 + k :]) if k + v + 9 == len(body) else None


def read_frames(raw: bytes) -> Iterator[tuple[int, int, bytes, bytes, int, int]]:
    """(seq, tag, key, value, start, end) until the first short, damaged or malformed frame."""
    return stream_frames(io.BytesIO(raw), len(raw))


def stream_frames(f, total: int) -> Iterator[tuple[int, int, bytes, bytes, int, int]]:
    """read_frames of an open file of `total` bytes: holds one frame at a time."""
    at, seq = 0, 0
    while at + 8 <= total:
        head = f.read(8)
        if len(head) < 8:
            return
        size, crc = U32.unpack_from(head, 0)[0], U32.unpack_from(head, 4)[0]
        if size > total - at - 8:
            return
        body = f.read(size)
        found = decode_body(body) if len(body) == size and zlib.crc32(body) == crc else None
        if found is None:
            return
        yield (seq, *found, at, at + 8 + size)
        at, seq = at + 8 + size, seq + 1


def file_at(path: str):
    """(file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def file_frames(path: str) -> Iterator[tuple[int, int, bytes, bytes, int, int]]:
    """The frames of a file as it is read; a missing log is empty."""
    where, name = file_at(path)
    try:
        f = where.open_input_file(name)
    except FileNotFoundError:
        return
    with f:
        yield from stream_frames(io.BufferedReader(f, BUFFER), f.size())


def file_pieces(path: str, most: int | None = None) -> Iterator[bytes]:
    """A file's bytes (at most the first `most`) in pieces of BUFFER; none of a missing one."""
    where, name = file_at(path)
    try:
        f = where.open_input_file(name)
    except FileNotFoundError:
        return
    with f:
        left = f.size() if most is None else most
        while left > 0 and (piece := f.read(min(BUFFER, left))):
            left -= len(piece)
            yield piece


def write_file(path: str, raw: bytes | Iterable[bytes]) -> None:
    """All or nothing: a temporary file that is moved to the name. Pieces are written as they come."""
    where, name = file_at(path)
    folder = name.rpartition("/")[0]
    if folder:
        where.create_dir(folder, recursive=True)
    with where.open_output_stream(name + ".tmp", buffer_size=BUFFER) as f:
        for piece in (raw,) if isinstance(raw, bytes) else raw:
            f.write(piece)
    where.move(name + ".tmp", name)


def recover_file(path: str) -> tuple[int, int]:
    """Cuts a log behind its last good frame, so that what is appended can be read: (good frames, bytes cut). A missing log is empty."""
    good = keep = 0
    for frame in file_frames(path):
        good, keep = good + 1, frame[5]
    where, name = file_at(path)
    size = where.get_file_info(name).size or 0  # none of a missing file
    if keep < size:
        write_file(path, file_pieces(path, keep))
    return good, size - keep


def append_bytes(path: str, raw: Iterable[bytes]) -> None:
    write_file(path, chain(file_pieces(path), raw))


def append_file(path: str, mutations: list[tuple[int, bytes, bytes]]) -> None:
    """Frames behind what a log holds."""
    append_bytes(path, (encode_mutation(*x) for x in mutations))


class KvWal(DataSource):
    """Reads log files (option path: a file or a comma-separated list), one partition each; writes one file a task."""

    @classmethod
    def name(cls) -> str:
        return "kvwal"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"].split(","))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], schema.fieldNames())


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from file_frames(partition.value)


class _Writer(DataSourceWriter):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names

    def write(self, iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        place = {n: self.names.index(n) for n in ("tag", "key", "value")}
        raw = (encode_mutation(row[place["tag"]], bytes(row[place["key"]]), bytes(row[place["value"]])) for row in iterator)
        write_file(f"{self.path.rstrip('/')}/wal-{TaskContext.get().partitionId():05d}.log", raw)
        return WriterCommitMessage()


def files_as_mutations(spark, path: str) -> DataFrame:
    """The same frames through Spark's own binary reader, which reaches any file system."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = [(p, *f) for p, raw in zip(batch["path"], batch["content"], strict=True) for f in read_frames(bytes(raw))]
            yield pd.DataFrame(rows, columns=["path", "seq", "tag", "key", "value", "start", "end"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, " + SCHEMA)
