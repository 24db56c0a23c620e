"""A versioned key-value table: batched puts and deletes, merge-on-read lookups, flush, compaction, vacuum.

Data lie in Parquet: `log/batch-<n>-<writer>` as written, `seg-<n>-<writer>` sorted by key
with a Bloom filter on the key; no two writers share a folder. The manifest names what is live; a commit adds its next version as a
whole, so a reader has one snapshot and a crash leaves only orphans, which vacuum()
removes. Recency is (batch, ord): the batch's number and the caller's order column within
it. One writer at a time: a commit over another's is refused.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from mergelog.errors import Closed, Corruption, InvalidArgument, NotFound
from mergelog.operators.compaction import Meta, pick_run
from mergelog.operators.resolve import NODE_OVERHEAD, PUT, TOMBSTONE, scan
from mergelog.options import Options
from mergelog.sources import manifest as m

ROWS = "batch long, ord long, tag tinyint, key binary, value binary"
TARGET_BYTES = 128 << 20
#: A store of at most so many bytes, as its manifest knows, goes to the readers' tasks instead of being shuffled.
BROADCAST_BYTES = 64 << 20


@dataclass(frozen=True)
class Snapshot:
    """A pinned set of files; compaction never changes what it reads."""

    spark: SparkSession
    files: m.Files
    manifest: m.Manifest

    def rows(self) -> DataFrame:
        """All versions, with pos: 0 the log, then segments from the newest. Order is (pos, batch, ord)."""
        parts = []
        if self.manifest.log_batches:
            paths = [self.files.url(f"log/{b}") for b in self.manifest.log_batches]
            parts.append(self.spark.read.schema(ROWS).parquet(*paths).withColumn("pos", F.lit(0)))
        for pos, table in enumerate(self.manifest.tables, 1):
            parts.append(self.spark.read.schema(ROWS).parquet(self.files.url(table.folder)).withColumn("pos", F.lit(pos)))
        out = parts[0] if parts else self.spark.createDataFrame([], ROWS).withColumn("pos", F.lit(0))
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def size_bytes(self) -> int:
        """At least the bytes of all versions' keys and values."""
        return self.manifest.log_charge + sum(t.size_bytes for t in self.manifest.tables)

    def latest(self) -> DataFrame:
        """One row a key; a lone segment has that already."""
        alone = len(self.manifest.tables) == 1 and not self.manifest.log_batches
        return self.rows() if alone else newest(self.rows())

    def live(self) -> DataFrame:
        return self.latest().where(F.col("tag") == PUT).select("key", "value")

    def scan(self, low=None, high=None, limit: int | None = None) -> DataFrame:
        rows = self.rows()
        if low is not None:  # before ranking, so that it reaches the files
            rows = rows.where(F.col("key") >= F.lit(low))
        if high is not None:
            rows = rows.where(F.col("key") < F.lit(high))
        return scan(newest(rows).where(F.col("tag") == PUT).select("key", "value"), limit=limit)

    def get(self, key: bytes) -> bytes:
        """A literal comparison, which row-group statistics, page indexes and Bloom filters prune."""
        found = self.rows().where(F.col("key") == F.lit(bytearray(key))).orderBy("pos", F.desc("batch"), F.desc("ord")).select("tag", "value").take(1)
        if not found or found[0]["tag"] == TOMBSTONE:
            raise NotFound(repr(key))
        return bytes(found[0]["value"])

    def read(self, keys: DataFrame) -> DataFrame:
        """(key, status, value) for each row of keys, repeated ones too; found, deleted or not_present.

        A small store is resolved once and broadcast, so that the keys aren't shuffled; of
        a large one the keys choose the rows that are resolved.
        """
        asked = keys.select(F.col("key").cast("binary").alias("key"))
        if self.size_bytes() <= BROADCAST_BYTES:
            hits = F.broadcast(self.latest().select("key", "tag", "value"))
        else:
            hits = newest(self.rows().join(asked.distinct(), "key", "left_semi")).select("key", "tag", "value")
        status = F.when(F.col("tag").isNull(), "not_present").when(F.col("tag") == TOMBSTONE, "deleted").otherwise("found")
        return asked.join(hits, "key", "left").select("key", status.alias("status"), F.when(F.col("tag") == PUT, F.col("value")).alias("value"))

    def multi_get(self, keys: DataFrame) -> DataFrame:
        """read(), once for each distinct key."""
        return self.read(keys.select("key").distinct())


def newest(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("key").orderBy("pos", F.desc("batch"), F.desc("ord"))
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


class Store:
    def __init__(self, spark: SparkSession, files: m.Files, options: Options, manifest: m.Manifest):
        self.spark, self.files, self.options, self.manifest, self.closed = spark, files, options, manifest, False
        self.writer = uuid.uuid4().hex[:12]

    @staticmethod
    def open(spark: SparkSession, path: str, options: Options = Options()) -> Store:
        if not path:
            raise InvalidArgument("a path is needed")
        files = m.Files(spark, path)
        if files.exists() and not files.is_folder():
            raise InvalidArgument(f"{path} is not a folder")
        if not files.exists():
            if not options.create_if_missing:
                raise InvalidArgument(f"{path} does not exist")
            files.make()
        manifest = m.load(files)
        there = {*files.names(), *(f"log/{n}" for n in files.names("log"))}
        gone = [n for n in (*(t.folder for t in manifest.tables), *(f"log/{b}" for b in manifest.log_batches)) if n not in there]
        if gone:
            raise Corruption(f"the manifest names what isn't there: {', '.join(gone)}")
        return Store(spark, files, options, manifest)

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """May be called again. What isn't flushed stays in the log, as after a crash."""
        self.closed = True

    def _writable(self) -> None:
        if self.closed:
            raise Closed("the store is closed")

    # writes

    def put(self, df: DataFrame, order_col: str | None = None) -> None:
        """Rows (key, value); several rows of a key need an order column."""
        self.apply(df.select("key", "value", F.lit(PUT).alias("tag"), *([F.col(order_col).alias("ord")] if order_col else [])), "ord" if order_col else None)

    def delete(self, keys: DataFrame) -> None:
        """Tombstones, also for keys that aren't there."""
        self.apply(keys.select("key", F.lit(b"").alias("value"), F.lit(TOMBSTONE).alias("tag")).distinct(), None)

    def apply(self, df: DataFrame, order_col: str | None, stream_batch: int | None = None) -> None:
        """Mutations (key, value, tag) as one batch, visible at once or not at all."""
        self._writable()
        batch = self.manifest.next_batch
        tag = F.col("tag").cast("tinyint")
        value = F.when(tag == TOMBSTONE, F.lit(b"")).otherwise(F.coalesce(F.col("value").cast("binary"), F.lit(b"")))
        rows = df.select(F.lit(batch).cast("long").alias("batch"), (F.col(order_col).cast("long") if order_col else F.lit(0).cast("long")).alias("ord"), tag.alias("tag"), F.col("key").cast("binary").alias("key"), value.alias("value"))
        name = f"log/batch-{batch}-{self.writer}"
        self.files.delete(name)  # left by a write that never committed
        rows.write.parquet(self.files.url(name))
        written = self.spark.read.schema(ROWS).parquet(self.files.url(name))
        wrong = F.count(F.when(~F.col("tag").isin(PUT, TOMBSTONE), 1))
        same = written.groupBy("key", "ord").agg(F.count("*").alias("c"), wrong.alias("w"), F.sum(F.octet_length("value")).alias("v"))
        empty = F.max(F.col("key").isNull() | (F.octet_length("key") == 0))
        seen = same.agg(F.sum("c").alias("n"), F.max("c").alias("times"), empty.alias("empty"), F.sum("w").alias("tags"), F.sum(F.octet_length("key") + F.col("v") + NODE_OVERHEAD).alias("charge")).first()
        if seen["empty"] or seen["tags"] or (seen["times"] or 0) > 1:
            self.files.delete(name)
            raise InvalidArgument("an empty key" if seen["empty"] else "an unknown tag" if seen["tags"] else "a key occurs twice without an order")
        new = replace(self.manifest, next_batch=batch + 1)
        if seen["n"]:
            new = replace(new, log_batches=(*new.log_batches, name.removeprefix("log/")), log_charge=new.log_charge + seen["charge"])
        if stream_batch is not None:
            new = replace(new, stream_batch=stream_batch)
        self.manifest = m.commit(self.files, self.manifest, new)
        if self.manifest.log_charge >= self.options.flush_threshold_bytes:  # the charge counts overwritten rows, too; only then is it worth a look
            exact = self.memtable_bytes()
            if exact >= self.options.flush_threshold_bytes:
                self.flush()
            else:
                self.manifest = replace(self.manifest, log_charge=exact)  # kept with the next commit

    def _log(self) -> DataFrame:
        return Snapshot(self.spark, self.files, replace(self.manifest, tables=())).rows()

    def memtable_bytes(self) -> int:
        if not self.manifest.log_batches:
            return 0
        charge = F.octet_length("key") + F.octet_length("value") + NODE_OVERHEAD
        return newest(self._log()).agg(F.sum(charge)).first()[0] or 0

    def _write_segment(self, rows: DataFrame, number: int, most_bytes: int, most_rows: int) -> m.Table:
        """One pass over rows; partitions and filters are sized by bounds that the manifest knows."""
        name = f"seg-{number}-{self.writer}"
        self.files.delete(name)
        parts, sums = max(1, -(-most_bytes // TARGET_BYTES)), Observation()
        rows = rows.select("batch", "ord", "tag", "key", "value")
        rows = rows.repartitionByRange(parts, "key") if parts > 1 else rows.repartition(1)
        # above the exchange, so that sampling for its ranges isn't counted
        counted = rows.observe(sums, F.count("*").alias("n"), F.sum(F.octet_length("key") + F.octet_length("value") + 9).alias("bytes"))
        writer = counted.sortWithinPartitions("key").write.option("parquet.page.write-checksum.enabled", "true")
        if self.options.bloom_filters:
            writer = writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.expected.ndv#key", str(max(1, most_rows // parts))).option("parquet.bloom.filter.fpp#key", str(self.options.bloom_fpr))
        writer.parquet(self.files.url(name))
        return m.Table(number, int(sums.get["bytes"] or 0), int(sums.get["n"]), name)

    def flush(self) -> None:
        """The log's latest rows, tombstones too, as the newest segment; its batches leave the log in the same commit."""
        self._writable()
        if not self.manifest.log_batches:
            return
        number = self.manifest.next_file_number
        charge = self.manifest.log_charge
        table = self._write_segment(newest(self._log()), number, charge, charge // (NODE_OVERHEAD + 1))
        self.manifest = m.commit(self.files, self.manifest, replace(self.manifest, next_file_number=number + 1, tables=(table, *self.manifest.tables), log_batches=(), log_charge=0))

    def compact(self, most: int | None = None) -> int:
        """Merges runs until none is eligible; the number of merges. Inputs stay on disk until vacuum()."""
        self._writable()
        done = 0
        while most is None or done < most:
            tables = self.manifest.tables
            chosen = pick_run([Meta(t.number, t.size_bytes) for t in tables], self.options.tier_ratio, self.options.compaction_min_merge)
            if chosen is None:
                break
            first, last, drop = chosen
            rows = newest(Snapshot(self.spark, self.files, replace(self.manifest, tables=tables[first:last], log_batches=())).rows())
            number = self.manifest.next_file_number
            run = tables[first:last]
            table = self._write_segment(rows.where(F.col("tag") != TOMBSTONE) if drop else rows, number, sum(t.size_bytes for t in run), sum(t.n_entries for t in run))
            self.manifest = m.commit(self.files, self.manifest, replace(self.manifest, next_file_number=number + 1, tables=(*tables[:first], table, *tables[last:])))
            done += 1
        return done

    def orphans(self) -> list[str]:
        live, logs = {t.folder for t in self.manifest.tables}, set(self.manifest.log_batches)
        return [n for n in self.files.names() if n.startswith("seg-") and n not in live] + [f"log/{n}" for n in self.files.names("log") if n.startswith("batch-") and n not in logs]

    def vacuum(self) -> list[str]:
        """Deletes what the manifest doesn't name. Call it when no older snapshot is in use."""
        self._writable()
        gone = self.orphans()
        for name in gone:
            self.files.delete(name)
        return gone

    # reads

    def snapshot(self) -> Snapshot:
        return Snapshot(self.spark, self.files, self.manifest)

    def get(self, key: bytes) -> bytes:
        return self.snapshot().get(key)

    def multi_get(self, keys: DataFrame) -> DataFrame:
        return self.snapshot().multi_get(keys)

    def read(self, keys: DataFrame) -> DataFrame:
        return self.snapshot().read(keys)

    def scan(self, low=None, high=None, limit: int | None = None) -> DataFrame:
        return self.snapshot().scan(low, high, limit)

    def segments(self) -> DataFrame:
        rows = [(pos, t.number, t.size_bytes, t.n_entries) for pos, t in enumerate(self.manifest.tables)]
        return self.spark.createDataFrame(rows, "pos int, number long, size_bytes long, n_entries long")
