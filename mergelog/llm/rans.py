"""Token files by a static range asymmetric numeral system (rANS).

One frequency table, counted over all ids, is shared by all blocks. A block holds whole
documents and is coded on its own by interleaved lanes: lane j codes every LANES-th id.
All lanes of many blocks advance together as numpy vectors. States are 64-bit, words
32-bit. A block's header has its counts and checksums; at every CHECKPOINT steps it
stores the lanes' states and the place in the words, so that decoders can start there.

    block: header | end states | checkpoints (word index, states) | words
    header: magic, ids, lanes, table bits, checkpoint steps, words, crc32 of the ids, crc32 of what follows

Blocks lie in a table ordered by first document (doc_ids, lens, start, block); the
frequency table lies beside it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrow import column
from .staging import Staging
from .tokens import default_tokenizer_path, document_slices

BITS = 20
LANES = 256
BLOCK_IDS = 131_072
CHECKPOINT = 256
TOGETHER = 32
PART_ROWS = 8192
PART_BYTES = 32 << 20  # of text: a partition of long texts has fewer rows
BROADCAST_BYTES = 64 << 20
MAGIC = b"rANS"
HEADER = struct.Struct("<4sQIIIQII")
LOW = np.uint64(1 << 31)
U32, UBITS = np.uint64(32), np.uint64(BITS)


def scaled(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Frequencies that sum to 2**bits, 1 at least for each id that occurs."""
    total, size = int(counts.sum()), 1 << bits
    if not total:
        counts, total = np.eye(1, len(counts), dtype=np.int64)[0], 1
    freq = np.where(counts > 0, np.maximum(1, counts.astype(np.float64) * size / total).astype(np.int64), 0)
    excess = int(freq.sum()) - size
    order = np.argsort(-freq, kind="stable")
    for k in order:
        if excess == 0:
            break
        take = min(excess, int(freq[k]) - 1) if excess > 0 else excess
        freq[k] -= take
        excess -= take
    return freq.astype(np.uint64)


class Coder:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.limit = self.freq << np.uint64(63 - BITS)
        self._symbols: np.ndarray | None = None

    @property
    def symbols(self) -> np.ndarray:
        if self._symbols is None:
            self._symbols = np.repeat(np.arange(len(self.freq), dtype=np.uint16), self.freq.astype(np.int64))
        return self._symbols

    def encode(self, blocks: list[np.ndarray]) -> list[bytes]:
        """Blocks of ids, coded together."""
        order = sorted(range(len(blocks)), key=lambda k: -len(blocks[k]))
        steps = [-(-len(blocks[k]) // LANES) for k in order]
        fill = int(np.argmax(self.freq))
        most, n = max(steps, default=0), len(blocks)
        ids = np.full((n, most * LANES), fill, dtype=np.uint16)
        for row, k in enumerate(order):
            ids[row, : len(blocks[k])] = blocks[k]
        ids = ids.reshape(n, most, LANES)
        state = np.full(n * LANES, LOW, dtype=np.uint64)
        words: list[list[np.ndarray]] = [[] for _ in range(n)]
        sent = np.zeros(n, dtype=np.int64)
        marks: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(n)]
        live = 0
        for s in range(most - 1, -1, -1):
            while live < n and steps[live] > s:
                live += 1
            t = ids[:live, s].ravel()
            x = state[: live * LANES]
            full = x >= self.limit[t]
            if full.any():
                low = (x[full] & np.uint64(0xFFFFFFFF)).astype("<u4")
                per = full.reshape(live, LANES).sum(axis=1)
                at = np.concatenate([[0], np.cumsum(per)])
                for k in np.flatnonzero(per):
                    words[k].append(low[at[k] : at[k + 1]])
                sent[:live] += per
                x = np.where(full, x >> U32, x)
            f = self.freq[t]
            q = x // f
            state[: live * LANES] = (q << UBITS) + (x - q * f) + self.cum[t]
            if s and s % CHECKPOINT == 0:
                for k in range(live):
                    marks[k].append((int(sent[k]), state[k * LANES : (k + 1) * LANES].copy()))
        out: list[bytes] = [b""] * n
        for row, k in enumerate(order):
            stream = b"".join(w.tobytes() for w in reversed(words[row]))
            points = b"".join(struct.pack("<Q", sent[row] - c) + x.astype("<u8").tobytes() for c, x in reversed(marks[row]))
            body = state[row * LANES : (row + 1) * LANES].astype("<u8").tobytes() + points + stream
            plain = zlib.crc32(np.asarray(blocks[k], "<u4").tobytes())
            out[k] = HEADER.pack(MAGIC, len(blocks[k]), LANES, BITS, CHECKPOINT, int(sent[row]), plain, zlib.crc32(body)) + body
        return out

    def decode(self, blocks: list[bytes]) -> list[np.ndarray]:
        """The ids of blocks; every checkpoint starts its own run of lanes, so a block's parts are decoded side by side."""
        runs = []  # (steps, block, first step, state, words, word index)
        heads = []
        for b, raw in enumerate(blocks):
            magic, n, lanes, bits, every, n_words, plain, coded = HEADER.unpack_from(raw)
            body = memoryview(raw)[HEADER.size :]
            if magic != MAGIC or lanes != LANES or bits != BITS or zlib.crc32(body) != coded:
                raise ValueError("a damaged block")
            steps = -(-n // LANES)
            points = max(0, (steps - 1) // every)
            at = 8 * LANES
            state = np.frombuffer(body, "<u8", LANES)
            words = np.frombuffer(body, "<u4", n_words, at + points * (8 + 8 * LANES))
            begin, index = 0, 0
            for p in range(points + 1):
                end = min(steps, (p + 1) * every)
                if end > begin:
                    runs.append((end - begin, b, begin, state, words, index))
                if p < points:
                    index = struct.unpack_from("<Q", body, at)[0]
                    state = np.frombuffer(body, "<u8", LANES, at + 8)
                    at += 8 + 8 * LANES
                    begin = end
            heads.append((n, steps, plain))
        runs.sort(key=lambda r: -r[0])
        out = [np.zeros((steps, LANES), np.uint16) for _, steps, _ in heads]
        if runs:
            state = np.concatenate([r[3] for r in runs]).astype(np.uint64)
            base, bases = 0, {}
            pool = []
            for r in runs:
                if r[1] not in bases:
                    bases[r[1]] = base
                    pool.append(r[4])
                    base += len(r[4])
            pool = np.concatenate([*pool, np.zeros(1, "<u4")])
            at = np.array([bases[r[1]] + r[5] for r in runs], dtype=np.int64)
            made = np.zeros((len(runs), runs[0][0], LANES), np.uint16)
            low, live = np.uint64((1 << BITS) - 1), len(runs)
            for s in range(runs[0][0]):
                while runs[live - 1][0] <= s:
                    live -= 1
                x = state[: live * LANES]
                slot = x & low
                t = self.symbols[slot]
                x = self.freq[t] * (x >> UBITS) + slot - self.cum[t]
                need = x < LOW
                grid = need.reshape(live, LANES)
                rank = np.cumsum(grid, axis=1)
                index = (at[:live, None] + rank - 1).ravel()[need]
                x[need] = (x[need] << U32) | pool[index].astype(np.uint64)
                at[:live] += rank[:, -1]
                state[: live * LANES] = x
                made[:live, s] = t.reshape(live, LANES)
            for k, (steps, b, begin, *_rest) in enumerate(runs):
                out[b][begin : begin + steps] = made[k, :steps]
        ids = [o.ravel()[:n] for o, (n, _, _) in zip(out, heads, strict=True)]
        for x, (_, _, plain) in zip(ids, heads, strict=True):
            if zlib.crc32(x.astype("<u4").tobytes()) != plain:
                raise ValueError("a damaged block")
        return ids


BLOCKS = "part int, block int, before long, doc_ids array<long>, lens array<long>, ids binary, counts binary"
CODED = "doc_ids array<long>, lens array<long>, start long, block binary"
LIST = pa.list_(pa.int64())


def _ordered(path: str, vocabulary: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, before = TaskContext.get().partitionId(), 0, 0
        docs, lens, raws, size = [], [], [], 0
        counts = np.zeros(vocabulary, np.int64)

        def out(last: bytes | None = None):
            row = (part, -1 if last else block, before, docs, lens, b"".join(raws), last)
            kinds = (pa.int32(), pa.int32(), pa.int64(), LIST, LIST, pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["part", "block", "before", "doc_ids", "lens", "ids", "counts"])

        for batch in batches:
            own = column(batch, "_id").to_pylist()
            for first, ids, at in document_slices(column(batch, "_text"), path):
                counts += np.bincount(ids, minlength=vocabulary)
                raw = ids.astype("<u2").tobytes()
                for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    docs.append(own[first + k])
                    raws.append(raw[2 * a : 2 * b])
                    lens.append(b - a)
                    size += b - a
                    if size >= BLOCK_IDS:
                        yield out()
                        block, before = block + 1, before + size
                        docs, lens, raws, size = [], [], [], 0
        if docs:
            yield out()
            docs, lens, raws = [], [], []
        if counts.any():
            yield out(zlib.compress(counts.astype("<i8").tobytes(), 1))

    return run


def _sum(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for raw in column(batch, "counts"):
                counts += np.frombuffer(zlib.decompress(raw.as_py()), "<i8")
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(counts[seen])], names=["id", "n"])

    return run


def _encode(freq: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq)
        for batch in batches:
            for k in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(k, TOGETHER)
                coded = coder.encode([np.frombuffer(v.as_buffer(), "<u2") for v in column(some, "ids")])
                yield pa.RecordBatch.from_arrays([column(some, "doc_ids").cast(LIST), column(some, "lens").cast(LIST), column(some, "start"), pa.array(coded, pa.binary())], names=["doc_ids", "lens", "start", "block"])

    return run


def _decode(freq: np.ndarray, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq)
        for batch in batches:
            for k in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(k, TOGETHER)
                every = coder.decode([v.as_py() for v in column(some, "block")])
                rows: tuple[list, ...] = ([], [], [], [], [])
                for docs, lens, start, ids in zip(*(column(some, c).to_pylist() for c in ("doc_ids", "lens", "start")), every, strict=True):
                    raw, at = ids.astype("<u4").tobytes(), 0
                    for doc, n in zip(docs, lens, strict=True):
                        own = raw[4 * at : 4 * (at + n)]
                        for out, v in zip(rows, (doc, start + at, n, zlib.crc32(own), own if with_ids else None), strict=True):
                            out.append(v)
                        at += n
                names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 5 if with_ids else 4]
                yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, (*[pa.int64()] * 4, pa.binary())[: len(names)], strict=False)], names=names)

    return run


def write_tokens(df: DataFrame, folder: str, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", vocabulary: int = 65536) -> None:
    """Encodes whole texts in ascending id order, an end id after each, and writes blocks and the frequency table to `folder`.

    Null and empty texts are the end id alone; equal ids keep all their rows, ordered by
    text; an empty table gives empty files. The range exchange moves texts once; what
    comes to the driver is the ids' counts.
    """
    spark = df.sparkSession
    staging = Staging(spark, "rans")
    texts = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    rows, size = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()
    parts = max(1, -(-rows // PART_ROWS), -(-size // PART_BYTES))
    ordered = texts.repartitionByRange(parts, "_id").sortWithinPartitions("_id", "_text").mapInArrow(_ordered(tokenizer or default_tokenizer_path(), vocabulary), BLOCKS)
    blocks = staging.table(ordered, "blocks")
    counts = np.zeros(vocabulary, np.int64)
    for i, n in blocks.where("counts is not null").select("counts").mapInArrow(_sum(vocabulary), "id long, n long").groupBy("id").agg(F.sum("n")).collect():
        counts[i] = n
    freq = scaled(counts)
    blocks = blocks.where("block >= 0")
    totals = blocks.select("part", F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    starts = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))  # one row a partition
    if parts * 16 <= BROADCAST_BYTES:  # else the join shuffles the blocks too
        starts = F.broadcast(starts)
    placed = blocks.join(starts, "part").withColumn("start", F.col("first") + F.col("before"))
    coded = placed.select("doc_ids", "lens", "start", "ids").mapInArrow(_encode(freq), CODED)
    coded.write.option("compression", "none").parquet(f"{folder}/blocks")
    table = [(int(k), int(freq[k])) for k in np.flatnonzero(freq)]
    spark.createDataFrame(table, "id int, freq long").coalesce(1).write.parquet(f"{folder}/table")
    staging.drop("blocks")


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = False, vocabulary: int = 65536) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) decoded from the files; a damaged block fails."""
    freq = np.zeros(vocabulary, np.int64)
    for i, f in spark.read.parquet(f"{folder}/table").collect():
        freq[i] = f
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return spark.read.schema(CODED).parquet(f"{folder}/blocks").mapInArrow(_decode(freq, with_ids), schema)


def token_files(df: DataFrame, **options) -> DataFrame:
    staging = Staging(df.sparkSession, "tokens")
    write_tokens(df, staging.root, **options)
    return read_tokens(df.sparkSession, staging.root)
