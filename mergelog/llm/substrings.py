"""Removal of repeated passages by recompression.

Words are named by 64-bit hashes. Two rounds rename all texts: runs of one symbol become
one symbol, then adjacent pairs (a, b) with a in the left half of all symbols and b in
the right half become one. Names are hashes of what they stand for and halves are bits
of names, so all tasks of the Spark job name alike without exchanging a dictionary. Each
symbol knows the stretch of words that settles it: where that stretch lies within a
passage, every copy of the passage has the same symbol.

A window (13 words) is anchored at the least of the highest-level symbols that it
settles; a window that settles none (in a long run) is its own anchor. So equal windows
have equal anchors, and one anchor serves many windows. A first exchange tells which
anchors occur in several documents; a second takes only the windows of those, by their
own hashes, and gives the least document of each, which verifies the repeat. There a
window is told by 96 bits of two hashes of its words: of the 2.7e13 windows of 100 TB
0.005 pairs of unlike ones are expected to agree.

Texts stay in chunks of a bucketed table and are never shuffled: exchanges carry packed
sorted hashes, and answers are one bit each. The rounds run once, when chunks are made;
a chunk keeps its anchors. Within a chunk an anchor or window counts once with its least
document, so copies do not pile up at one key.

An exchange deals entries to n buckets of equal size. Up to DIRECT buckets a chunk writes
a row for each. Beyond, it goes by two levels: a chunk writes a row for each of sqrt(n)
ranges, and groups of about sqrt(n) chunks cut each range into sqrt(n) buckets; answers
go back the same way. Bytes are in proportion to the input, rows a chunk to sqrt(n):
2,050 at 100 TB, where rows of chunk and bucket would be four million.

Defined results: null, empty and short texts keep all their words. Documents of one id
don't remove from each other; a null id is greater than all others. Windows are judged
on the input. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import ODD, column, mix, text_buffers, word_bounds, word_hashes
from .staging import Staging

WINDOW = 13
ROUNDS = 2
CHUNK_BYTES = 4 << 20
CHUNK_ROWS = 4096
BUCKET_BYTES = 24 << 20  # of text for each exchange bucket
DIRECT = 256  # most buckets of an exchange of one level
TABLE_BYTES = 48 << 20  # of text for each bucket of the chunk table
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
PLACE = (ODD * (2 * np.arange(1, WINDOW + 1, dtype=np.uint64) + np.uint64(1))) | np.uint64(1)
CHECK_PLACE = mix(PLACE) | np.uint64(1)
NO_ID = np.iinfo(np.int64).max


class Symbols:
    """Symbols of many texts: name, document, first and last word, first and last word of what settles it."""

    def __init__(self, names: np.ndarray, docs: np.ndarray):
        at = np.arange(len(names))
        self.name, self.doc, self.first, self.last, self.low, self.high = names, docs, at, at, at, at

    def _neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether each symbol has one before and one after it in its document."""
        before = np.zeros(len(self.name), bool)
        before[1:] = self.doc[1:] == self.doc[:-1]
        return before, np.append(before[1:], False)

    def _shifted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What settles the symbols before and after; at a document's edge something outside it."""
        before, after = self._neighbours()
        low_b, high_b, low_a, high_a = self.low.copy(), self.high.copy(), self.low.copy(), self.high.copy()
        low_b[1:], high_b[1:] = self.low[:-1], self.high[:-1]
        low_a[:-1], high_a[:-1] = self.low[1:], self.high[1:]
        low_b, high_a = np.where(before, low_b, self.first - WINDOW), np.where(after, high_a, self.last + WINDOW)
        return low_b, np.where(before, high_b, self.high), np.where(after, low_a, self.low), high_a

    def runs(self) -> None:
        n = len(self.name)
        if not n:
            return
        edge = np.ones(n, bool)
        edge[1:] = (self.name[1:] != self.name[:-1]) | (self.doc[1:] != self.doc[:-1])
        head = np.flatnonzero(edge)
        tail = np.append(head[1:], n) - 1
        low_b, _, _, high_a = self._shifted()
        times = (tail - head + 1).astype(np.uint64)
        name = self.name[head]
        self.name = np.where(times > 1, mix(name * ODD + times), name)
        low, high = np.minimum(self.low[head], low_b[head]), np.maximum(self.high[tail], high_a[tail])
        self.doc, self.first, self.last, self.low, self.high = self.doc[head], self.first[head], self.last[tail], low, high

    def pairs(self, salt: int) -> None:
        n = len(self.name)
        if not n:
            return
        left = (mix(self.name + np.uint64(salt)) & np.uint64(1)) == 0
        _, after = self._neighbours()
        joins = np.zeros(n, bool)
        joins[:-1] = left[:-1] & ~left[1:] & after[:-1]
        gone = np.append(False, joins[:-1])
        low_b, high_b, low_a, high_a = self._shifted()
        # a left symbol is settled with the next one, a right symbol with the one before
        low, high = np.where(left, np.minimum(self.low, low_a), np.minimum(self.low, low_b)), np.where(left, np.maximum(self.high, high_a), np.maximum(self.high, high_b))
        head = np.flatnonzero(joins)
        name, last = self.name.copy(), self.last.copy()
        name[head] = mix(self.name[head] * PLACE[0] + self.name[head + 1] * PLACE[1] + np.uint64(salt))
        last[head] = self.last[head + 1]
        low[head], high[head] = np.minimum(self.low[head], self.low[head + 1]), np.maximum(self.high[head], self.high[head + 1])
        keep = ~gone
        self.name, self.doc, self.first, self.last, self.low, self.high = (x[keep] for x in (name, self.doc, self.first, last, low, high))


def window_hashes(h: np.ndarray, place: np.ndarray = PLACE) -> np.ndarray:
    """The hash of the window that starts at each word; meaningless for the last few of a text."""
    out = np.zeros(len(h), np.uint64)
    for k in range(min(WINDOW, len(h))):
        out[: len(h) - k] += h[k:] * place[k]
    return mix(out)


def anchors(h: np.ndarray, docs: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """The anchor of the window that starts at each word."""
    n = len(h)
    symbols, levels = Symbols(h, docs), []
    for r in range(ROUNDS):
        symbols.runs()
        symbols.pairs(r + 1)
        levels.append((symbols.name, symbols.low, symbols.high))
    best = np.full(n, NONE)
    for name, low, high in reversed(levels):
        here = np.full(n, NONE)
        first = np.maximum(high - WINDOW + 1, 0)
        inside = (first <= low) & (low >= 0) & (high < n)
        name, first, span = name[inside], first[inside], (low - first)[inside]
        for t in range(WINDOW):
            more = span >= t
            if not more.all():
                name, first, span = name[more], first[more], span[more]
            if not len(name):
                break
            np.minimum.at(here, first + t, name)
        best = np.where(best == NONE, here, best)
    return np.where(best == NONE, windows, best)


class Chunk:
    """The words and windows of a chunk's texts, always made the same way."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, raw: bytes):
        self.ids, self.offsets, self.raw = ids, offsets, raw
        buffer = np.frombuffer(raw, np.uint8)
        starts, ends, self.heads = word_bounds(buffer, offsets)
        self.words = word_hashes(buffer, starts, ends)
        self.docs = np.repeat(np.arange(len(ids)), np.diff(self.heads))
        n = len(self.words) - WINDOW + 1
        self.at = np.flatnonzero(self.docs[:n] == self.docs[WINDOW - 1 :]) if n > 0 else np.zeros(0, np.int64)  # where windows start
        self.windows = window_hashes(self.words)

    def anchor_entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(sorted distinct anchors, the least id of each, whether several ids have it, lengths of runs of windows of one anchor, each run's anchor by place)."""
        a, d = anchors(self.words, self.docs, self.windows)[self.at], self.docs[self.at]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
        head = np.flatnonzero(new)
        keys, _, least, several = _least(a[head], np.zeros(len(head), np.uint32), self.ids[d[head]])
        return keys, least, several, np.diff(np.append(head, len(a))), np.searchsorted(keys, a[head])

    def window_entries(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(positions of windows whose anchor is shared, the entry of each, sorted distinct window hashes, their checks, the least id of each)."""
        at = self.at[shared]
        checks = (window_hashes(self.words, CHECK_PLACE)[at] >> np.uint64(32)).astype(np.uint32)
        order, group, head = _groups(self.windows[at], checks)
        entry = np.empty(len(at), np.int64)
        entry[order] = group
        least = np.minimum.reduceat(self.ids[self.docs[at]][order], head) if len(at) else np.zeros(0, np.int64)
        first = order[head]
        return at, entry, self.windows[at][first], checks[first], least


def _groups(keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(an order that brings equal (key, check) together by key, the group of each in that order, where groups start)."""
    order = np.argsort(keys, kind="stable")
    k, c = keys[order], checks[order]
    same = k[1:] == k[:-1]
    if (same & (c[1:] != c[:-1])).any():  # unlike windows of one hash
        order = np.lexsort((checks, keys))
        k, c = keys[order], checks[order]
        same = (k[1:] == k[:-1]) & (c[1:] == c[:-1])
    new = np.append(True, ~same)[: len(k)]
    return order, np.cumsum(new, dtype=np.int32) - 1, np.flatnonzero(new)


def _least(keys: np.ndarray, checks: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each distinct (key, check), sorted: key, check, least id, whether several ids have it."""
    order, _, head = _groups(keys, checks)
    if not len(order):
        return keys, checks, ids, np.zeros(0, bool)
    least, most = (f.reduceat(ids[order], head) for f in (np.minimum, np.maximum))
    first = order[head]
    return keys[first], checks[first], least, least != most


def _pack(x: np.ndarray) -> bytes:
    """Sorted or clustered numbers: differences by byte planes, compressed."""
    x = x.view(np.uint64)
    d = np.diff(x, prepend=np.uint64(0))
    return zstandard.compress(d.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 3)


def _unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _small(x: np.ndarray) -> bytes:
    return zstandard.compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def _unsmall(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


CHUNK = "chunk long, ids binary, offsets binary, data binary, keys binary, least binary, several binary, runs binary, anchor binary"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, count = TaskContext.get().partitionId(), 0
    names = [c.split()[0] for c in CHUNK.split(", ")]
    for batch in batches:
        ids = column(batch, "_id").fill_null(NO_ID).to_numpy()
        data, offsets = text_buffers(column(batch, "_text"))
        a, n = 0, len(ids)
        while a < n:
            b = int(np.searchsorted(offsets, offsets[a] + CHUNK_BYTES, side="right")) - 1
            b = min(max(b, a + 1), n, a + CHUNK_ROWS)
            own = (offsets[a : b + 1] - offsets[a]).astype("<i8")
            raw = data[offsets[a] : offsets[b]].tobytes()
            keys, least, several, runs, anchor = Chunk(ids[a:b], own, raw).anchor_entries()
            row = (ids[a:b].astype("<i8").tobytes(), own.tobytes(), zstandard.compress(raw, 3), _pack(keys), _pack(least), np.packbits(several).tobytes(), _small(runs), _small(anchor))
            yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + count], pa.int64()), *(pa.array([x], pa.binary()) for x in row)], names=names)
            a, count = b, count + 1


def _buckets(keys: np.ndarray, n: int, fan: int = 1) -> list[tuple[int, int, int]]:
    """(bucket, first, last) of sorted keys by equal ranges of their values; fan buckets of n in one."""
    if not len(keys):
        return []
    width = ((1 << 64) // n + 1) * fan
    of = (keys // np.uint64(width)).astype(np.int64) if n > fan else np.zeros(len(keys), np.int64)
    head = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    return list(zip(of[head].tolist(), head.tolist(), [*head[1:].tolist(), len(keys)], strict=True))


# entries of some chunks for one bucket: each chunk's are in order of key and follow the last chunk's
ENTRIES = "bucket long, range long, team long, chunks binary, sizes binary, keys binary, ids binary, extra binary"
ANSWERS = "bucket long, range long, team long, chunks binary, sizes binary, bits binary"


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    columns = list(zip(*rows, strict=True)) or [()] * len(schema.split(", "))
    return pa.table({c.split()[0]: pa.array(list(x), kinds[c.split()[1]]) for c, x in zip(schema.split(", "), columns, strict=True)})


def _rows(chunk: int, keys: np.ndarray, ids: np.ndarray, extra: np.ndarray, n: int, fan: int) -> pa.RecordBatch:
    """A chunk's entries, a row for each bucket; extra is flags (several ids) or checks."""
    rows = []
    for bucket, a, b in _buckets(keys, n, fan):
        rows.append((bucket, bucket, chunk, np.int64(chunk).tobytes(), np.uint32(b - a).tobytes(), _pack(keys[a:b]), _pack(ids[a:b]), extra[a:b].tobytes()))
    return _table(ENTRIES, rows).combine_chunks().to_batches()[0] if rows else pa.RecordBatch.from_pylist([], schema=_table(ENTRIES, []).schema)


def _parts(table: pa.Table, name: str, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]


def _dealt(table: pa.Table, n: int, kind: str) -> pa.Table:
    """The second level: the rows of a range and a team of chunks, as a row for each of the range's buckets."""
    place, chunk = table.column("range")[0].as_py(), [int(x[0]) for x in _parts(table, "chunks", "<i8")]
    team = table.column("team")[0].as_py()
    into: dict[int, list[tuple]] = {}
    columns = (map(_unpack, table.column("keys").to_pylist()), map(_unpack, table.column("ids").to_pylist()), _parts(table, "extra", kind))
    for c, keys, ids, extra in zip(chunk, *columns, strict=True):
        for bucket, a, b in _buckets(keys, n):
            into.setdefault(bucket, []).append((c, keys[a:b], ids[a:b], extra[a:b]))
    rows = []
    for bucket, parts in into.items():
        chunks, keys, ids, extra = zip(*parts, strict=True)
        sizes = np.array([len(k) for k in keys], "<u4")
        rows.append((bucket, place, team, np.array(chunks, "<i8").tobytes(), sizes.tobytes(), _pack(np.concatenate(keys)), _pack(np.concatenate(ids)), np.concatenate(extra).tobytes()))
    return _table(ENTRIES, rows)


def _gathered(table: pa.Table) -> pa.Table:
    """The way back: the answers of a range's buckets for a team of chunks, as one row for each chunk."""
    table = table.sort_by("bucket")
    bits: dict[int, list[np.ndarray]] = {}
    for chunks, sizes, raw in zip(_parts(table, "chunks", "<i8"), _parts(table, "sizes", "<u4"), table.column("bits").to_pylist(), strict=True):
        cut = np.cumsum(sizes.astype(np.int64))
        for c, part in zip(chunks.tolist(), np.split(_bits(raw, int(cut[-1])), cut[:-1]), strict=True):
            bits.setdefault(c, []).append(part)
    place = table.column("range")[0].as_py()
    rows = [(place, place, c, np.int64(c).tobytes(), np.uint32(sum(map(len, x))).tobytes(), np.packbits(np.concatenate(x)).tobytes()) for c, x in bits.items()]
    return _table(ANSWERS, rows)


def _bits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


def _each(batches: Iterator[pa.RecordBatch], n: int, fan: int, *more: str) -> Iterator[tuple]:
    """(chunk, its texts, which windows have a shared anchor, more columns)."""
    for batch in batches:
        for row in range(batch.num_rows):
            chunk, ids, offsets, data, keys, runs, anchor, shared, *rest = (column(batch, c)[row].as_py() for c in ("chunk", "ids", "offsets", "data", "keys", "runs", "anchor", "shared", *more))
            own = Chunk(np.frombuffer(ids, "<i8"), np.frombuffer(offsets, "<i8"), zstandard.decompress(data) if data else b"")
            yield chunk, own, np.repeat(_chosen(_unpack(keys), shared or [], n, fan)[_unsmall(anchor)], _unsmall(runs)), *(x or [] for x in rest)


def _anchor_rows(n: int, fan: int):
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                chunk, keys, least, several = (column(batch, c)[k].as_py() for c in ("chunk", "keys", "least", "several"))
                keys = _unpack(keys)
                yield _rows(chunk, keys, _unpack(least).view(np.int64), _bits(several, len(keys)), n, fan)

    return run


def _answers(table: pa.Table, anchors_only: bool) -> pa.Table:
    """For each row of a bucket, a bit for each entry: the anchor occurs in several documents, or the window in a lesser one."""
    keys = [_unpack(x) for x in table.column("keys").to_pylist()]
    cut = np.cumsum([len(k) for k in keys])[:-1]
    flat = np.concatenate(keys)
    del keys
    who = np.concatenate([_unpack(x).view(np.int64) for x in table.column("ids").to_pylist()])
    extra = np.concatenate(_parts(table, "extra", "?" if anchors_only else "<u4"))
    order, group, first = _groups(flat, np.zeros(len(flat), np.uint32) if anchors_only else extra)
    del flat
    sorted_ids = who[order]
    del who
    least = np.minimum.reduceat(sorted_ids, first)
    yes = np.empty(len(order), bool)
    if anchors_only:
        yes[order] = ((np.maximum.reduceat(sorted_ids, first) > least) | np.maximum.reduceat(extra[order], first))[group]
    else:
        yes[order] = least[group] < sorted_ids
    bits = pa.array([np.packbits(x).tobytes() for x in np.split(yes, cut)], pa.binary())
    return table.select(["bucket", "range", "team", "chunks", "sizes"]).append_column("bits", bits)


def _chosen(keys: np.ndarray, answers: list[dict], n: int, fan: int) -> np.ndarray:
    """The answers' bits in the order of the sorted keys."""
    by = {a["range"]: a["bits"] for a in answers}
    return np.concatenate([_bits(by[b], last - first) for b, first, last in _buckets(keys, n, fan)] or [np.zeros(0, bool)])


def _window_rows(n: int, fan: int):
    def run(batches):
        for chunk, own, shared in _each(batches, n, fan):
            _, _, windows, checks, least = own.window_entries(shared)
            yield _rows(chunk, windows, least, checks, n, fan)

    return run


def _kept_rows(n: int, fan: int):
    def run(batches):
        for _, own, shared, repeated in _each(batches, n, fan, "repeated"):
            at, entry, windows, _, least = own.window_entries(shared)
            gone = np.zeros(len(own.docs) + 1, np.int64)
            if len(at):
                hit = at[_chosen(windows, repeated, n, fan)[entry] | (own.ids[own.docs[at]] > least[entry])]
                np.add.at(gone, hit, 1)
                np.add.at(gone, np.minimum(hit + WINDOW, len(gone) - 1), -1)
            removed = np.cumsum(gone[:-1]) > 0
            count = np.add.reduceat(np.append(removed, False).astype(np.int64), own.heads[:-1]) if len(own.ids) else own.ids
            count = np.where(np.diff(own.heads) > 0, count, 0)
            texts = []
            for k, (a, b) in enumerate(zip(own.heads[:-1], own.heads[1:], strict=True)):
                words = own.raw[own.offsets[k] : own.offsets[k + 1]].split()
                if count[k]:
                    words = [w for w, r in zip(words, removed[a:b].tolist(), strict=True) if not r]
                texts.append(b" ".join(words))
            ids = pa.array(own.ids, mask=own.ids == NO_ID)
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(own.heads)), pa.array(count), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array(texts, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept text]) for every row of df."""
    spark = df.sparkSession
    staging = Staging(spark, "substrings")
    texts = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    total = texts.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    n, buckets = max(1, -(-total // bucket_bytes)), max(1, -(-total // TABLE_BYTES))
    fan = 1 if n <= DIRECT else math.isqrt(n - 1) + 1
    n, teams = (n if fan == 1 else fan * fan), max(1, -(-total // (CHUNK_BYTES * fan)))
    name = f"chunks_{uuid.uuid4().hex}"
    texts.mapInArrow(_chunks, CHUNK).write.bucketBy(buckets, "chunk").option("compression", "none").option("path", staging.path("chunks")).saveAsTable(name)
    chunks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name alone: the files stay, and the plan knows them and their buckets

    def exchanged(entries: DataFrame, anchors_only: bool, label: str) -> DataFrame:
        if fan > 1:
            kind = "?" if anchors_only else "<u4"
            teamed = entries.withColumn("team", F.pmod(F.xxhash64("team"), F.lit(teams)))
            entries = teamed.groupBy("range", "team").applyInArrow(lambda t: _dealt(t, n, kind), ENTRIES)
        answers = entries.groupBy("bucket").applyInArrow(lambda t: _answers(t, anchors_only), ANSWERS)
        if fan > 1:
            answers = answers.groupBy("range", "team").applyInArrow(_gathered, ANSWERS)
        # now a row is of one chunk, which team names
        return staging.table(answers.groupBy(F.col("team").alias("chunk")).agg(F.collect_list(F.struct("range", "bits")).alias(label)), label)

    shared = exchanged(chunks.select("chunk", "keys", "least", "several").mapInArrow(_anchor_rows(n, fan), ENTRIES), True, "shared")
    some = ["chunk", "ids", "offsets", "data", "keys", "runs", "anchor", "shared"]
    with_shared = chunks.join(shared, "chunk", "left").select(some)
    repeated = exchanged(with_shared.mapInArrow(_window_rows(n, fan), ENTRIES), False, "repeated")
    with_both = chunks.join(shared, "chunk", "left").join(repeated, "chunk", "left").select(*some, "repeated")
    kept = with_both.mapInArrow(_kept_rows(n, fan), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary")
    return kept.select("doc_id", "n_words", "n_removed", "kept_sha256", *([F.col("kept").cast("string").alias("kept")] if with_text else []))
