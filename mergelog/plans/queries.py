"""Driver queries: the engine's functions applied to the driver's tables. The same names are in oracle.py as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mergelog import workloads
from mergelog.errors import LABELS, status_text
from mergelog.functions import bloom, codec, hashing, workload
from mergelog.operators import compaction, resolve, segment
from mergelog.options import Options
from mergelog.sources import manifest, segment_file, wal
from mergelog.sources.shared import fresh_folder
from mergelog.store import Store

FPR = 0.01
BLOCK = 512
RATIO = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mut_events(spark: SparkSession, d: str) -> DataFrame:
    """seq, tag, key, value: an error deletes its user's key, any other event puts its properties."""
    gone = F.col("event_type") == "error"
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), F.when(gone, 1).otherwise(0).alias("tag"), F.col("user_id").cast("string").alias("key"), F.when(gone, "").otherwise(F.col("props")).alias("value"))


def mut_orders(spark: SparkSession, d: str) -> DataFrame:
    gone = F.col("o_orderstatus") == "F"
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.when(gone, 1).otherwise(0).alias("tag"), F.col("o_custkey").cast("string").alias("key"), F.when(gone, "").otherwise(F.col("o_orderpriority")).alias("value"))


def probes(spark: SparkSession, d: str) -> DataFrame:
    """All customers' keys, and as many that no one wrote."""
    key = F.col("c_custkey").cast("string")
    return table(spark, d, "customer").select(F.explode(F.array(key, F.concat(F.lit("absent"), key))).alias("key"))


def seg_fixed() -> Column:
    return (F.floor(F.col("seq") / 1000) + 1).cast("long")


def seg_doubling() -> Column:
    return F.length(F.bin(F.col("seq") + 1)).cast("long")


def event_images(spark: SparkSession, d: str, seg: Column | None = None) -> DataFrame:
    return resolve.image(mut_events(spark, d).withColumn("seg", seg_fixed() if seg is None else seg))


def doubling_segments(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(rows with pos, segments): sizes double with age's place, so tiers differ."""
    rows = resolve.latest(mut_events(spark, d).withColumn("seg", seg_doubling()), "seg")
    size = (F.octet_length("key") + F.octet_length("value") + 9).cast("long")
    sums = rows.groupBy("seg").agg(F.sum(size).alias("size_bytes"), F.count("*").alias("n_entries"))
    place = (F.row_number().over(Window.orderBy(F.desc("seg"))) - 1).cast("long")
    segments = sums.select(place.alias("pos"), F.col("seg").alias("number"), "size_bytes", "n_entries")
    return rows.join(F.broadcast(segments.select(F.col("number").alias("seg"), "pos")), "seg"), segments


def kv_mutation_log(spark, d):
    return resolve.admissible(mut_events(spark, d)).select("seq", "tag", "key", "value")


def kv_live_state(spark, d):
    return resolve.live(mut_events(spark, d)).select("key", "value", "seq")


def kv_get_status(spark, d):
    return resolve.get_status(probes(spark, d), mut_orders(spark, d))


def kv_multi_get(spark, d):
    return resolve.multi_get(probes(spark, d), mut_orders(spark, d))


def kv_key_history(spark, d):
    return resolve.history(mut_events(spark, d))


def kv_reject_empty_key(spark, d):
    """Every seventh key is emptied; the write path keeps the rest."""
    dirty = mut_events(spark, d).withColumn("key", F.when(F.col("seq") % 7 == 0, "").otherwise(F.col("key")))
    return resolve.admissible(dirty).agg(F.count("*").alias("accepted"), F.count_distinct("key").alias("keys"))


def memtable_image(spark, d):
    return event_images(spark, d).select("seg", "key_rank", "key", "tag", "value", "seq")


def memtable_bytes(spark, d):
    return resolve.memory(event_images(spark, d))


def flush_plan(spark, d):
    """The cuts for a threshold of 4096 bytes: (seg, first_seq, last_seq, n)."""
    plan = segment.flush_plan(mut_events(spark, d), 4096)
    return plan.groupBy("seg").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("n"))


def blocks(spark, d):
    return segment.entry_blocks(event_images(spark, d), BLOCK)


def sst_entry_blocks(spark, d):
    return blocks(spark, d).select("seg", "key", "size", "block")


def sst_document_blocks(spark, d):
    """Large values: documents by tens of thousands of ids a segment, blocks of 4096 bytes."""
    docs = table(spark, d, "documents").select((F.floor(F.col("doc_id") / 500) + 1).cast("long").alias("seg"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("key"), F.col("text").alias("value"))
    return segment.sparse_index(segment.entry_blocks(docs, 4096))


def sst_sparse_index(spark, d):
    return segment.sparse_index(blocks(spark, d))


def sst_index_lookup(spark, d):
    return segment.index_lookup(probes(spark, d), sst_sparse_index(spark, d)).select("seg", "key", F.col("block").cast("long").alias("block"))


def bloom_hash(spark, d):
    """The hash by built-in functions beside the batch function's halves."""
    keys = bloom.with_hashes(mut_events(spark, d).select("key").distinct())
    both = F.col("h2").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(20,0)") + F.col("h1")
    return keys.select("key", hashing.fnv1a64(F.col("key")).cast("string").alias("hash"), both.cast("decimal(20,0)").cast("string").alias("batch_hash"))


def bloom_params(spark, d):
    n = table(spark, d, "part").select((F.col("p_partkey") * F.col("p_size")).cast("long").alias("n")).distinct()
    grid = n.select("n", F.explode(F.array(*map(F.lit, (0.5, 0.1, 0.01, 0.001)))).alias("fpr"))
    return grid.select("n", "fpr", bloom.num_bits(F.col("n"), F.col("fpr")).alias("bits"), bloom.num_probes(F.col("fpr")).cast("long").alias("probes"))


def bloom_set_bits(spark, d):
    return bloom.set_bits(event_images(spark, d), FPR)


def bloom_false_positives(spark, d):
    """(seg, probes, false_positives) over keys that no one wrote."""
    images = event_images(spark, d)
    params = bloom.parameters(images, FPR)
    absent = probes(spark, d).where(F.col("key").startswith("absent"))
    wrong = bloom.matching(absent, params, bloom.set_bits(images, FPR), FPR).groupBy("seg").agg(F.count("*").alias("w"))
    total = absent.agg(F.count_distinct("key").alias("probes"))
    return params.select("seg").crossJoin(F.broadcast(total)).join(wrong, "seg", "left").select("seg", "probes", F.coalesce("w", F.lit(0).cast("long")).alias("false_positives"))


def bloom_no_false_negatives(spark, d):
    """Each segment's own keys against its filter: (members, rejected)."""
    images = event_images(spark, d)
    own = bloom.with_hashes(images.select("seg", "key")).join(bloom.parameters(images, FPR), "seg")
    passed = bloom.passing(own, bloom.set_bits(images, FPR), FPR).agg(F.count("*").alias("p"))
    return own.agg(F.count("*").alias("members")).crossJoin(F.broadcast(passed)).select("members", (F.col("members") - F.col("p")).alias("rejected"))


def read_amplification(spark, d):
    return segment.read_amplification(probes(spark, d), event_images(spark, d), FPR)


def segment_tiers(spark, d):
    _, segments = doubling_segments(spark, d)
    return segments.select("pos", "number", "size_bytes", "n_entries", compaction.size_tier(F.col("size_bytes"), RATIO).cast("long").alias("tier"))


def _pick(spark, d, min_merge):
    return compaction.pick(doubling_segments(spark, d)[1], RATIO, min_merge)


def compaction_pick(spark, d):
    """For several lengths of run: (min_merge, start, end, tier, length, drop_tombstones)."""
    out = None
    for n in (2, 4):
        one = _pick(spark, d, n).select(F.lit(n).cast("long").alias("min_merge"), "start", "end", F.col("tier").cast("long").alias("tier"), "length", "drop_tombstones")
        out = one if out is None else out.unionByName(one)
    return out


def compaction_runs(spark, d):
    return compaction.runs(doubling_segments(spark, d)[1], RATIO).select("start", "end", F.col("tier").cast("long").alias("tier"), "length")


def _merged(spark, d, drop):
    rows, _ = doubling_segments(spark, d)
    chosen = F.broadcast(_pick(spark, d, 4).select("start", "end"))
    run = rows.join(chosen, (F.col("pos") >= F.col("start")) & (F.col("pos") <= F.col("end")))
    return compaction.merge(run, drop).select("key", "tag", "value", "pos")


def compaction_merge_keep(spark, d):
    return _merged(spark, d, False)


def compaction_merge_drop(spark, d):
    return _merged(spark, d, True)


def compaction_fixpoint(spark, d):
    """The planner's whole course over the fixed segments' sizes, from a list that has one item a segment."""
    rows = event_images(spark, d).withColumn("size", (F.octet_length("key") + F.octet_length("value") + 9).cast("long")).groupBy("seg").agg(F.sum("size").alias("s")).orderBy(F.desc("seg")).collect()
    held = [compaction.Meta(r["seg"], r["s"]) for r in rows]
    step, out, number = 0, [], max((t.number for t in held), default=0)
    while (run := compaction.pick_run(held, RATIO, 4)) is not None:
        first, last, drop = run
        number, step = number + 1, step + 1
        out.append((step, first, last - 1, drop, number))
        held[first:last] = [compaction.Meta(number, sum(t.size_bytes for t in held[first:last]))]
    return spark.createDataFrame(out, "step long, start long, end long, drop_tombstones boolean, number long")


def wal_frames(spark, d):
    return wal.frames(mut_events(spark, d))


def wal_offsets(spark, d):
    return wal.offsets(wal.frames(mut_events(spark, d))).select("seq", "frame_len", "start", "end")


def _bad() -> Column:
    """A planted checksum error, past the first half of a thousand frames."""
    return (F.col("seq") % 997 == 600) & (F.col("crc") % 2 == 0)


def wal_recover(spark, d):
    return wal.good_prefix(wal.offsets(wal.frames(mut_events(spark, d))), _bad()).select("seq", "start", "end")


def wal_truncate_offset(spark, d):
    return wal.truncate_offset(wal.offsets(wal.frames(mut_events(spark, d))), _bad())


def manifest_state(spark, d):
    return manifest.state(event_images(spark, d).select(F.col("seg").alias("number")).distinct())


def live_and_orphan_segments(spark, d):
    """Every third file isn't in the manifest."""
    files = event_images(spark, d).select(F.col("seg").alias("number")).distinct()
    return manifest.live_files(files, files.where("number % 3 <> 0"))


def snapshot_read(spark, d):
    log = mut_events(spark, d)
    half = log.agg(F.floor(F.max("seq") / 2).alias("_s"))
    return resolve.live(log.join(F.broadcast(half), F.col("seq") <= F.col("_s"))).select("key", "value", "seq")


def range_scan(spark, d):
    return resolve.scan(resolve.live(mut_orders(spark, d)).select("key", "value"), "1", "3")


def seek(spark, d):
    """The first live keys at or after a place."""
    return resolve.scan(resolve.live(mut_orders(spark, d)).select("key", "value"), "2", limit=10)


def bench_key(spark, d):
    return table(spark, d, "orders").select("o_orderkey", workload.bench_key(F.col("o_orderkey"), 4).alias("narrow"), workload.bench_key(F.col("o_orderkey"), 16).alias("wide"))


def zipf_cdf(spark, d):
    ranks = table(spark, d, "customer").select((F.col("c_custkey") - F.lit(0)).alias("c")).select((F.row_number().over(Window.orderBy("c")) - 1).cast("long").alias("i"))
    return workload.zipf_cdf(ranks, 0.99).select("i", F.round("cdf", 9).alias("cdf"))


def zipf_draw(spark, d):
    ranks = table(spark, d, "customer").select((F.row_number().over(Window.orderBy("c_custkey")) - 1).cast("long").alias("i"))
    draws = table(spark, d, "supplier").select("s_suppkey", ((F.col("s_suppkey") % 97 + 0.5) / 97).alias("u"))
    return workload.zipf_draw(draws, workload.zipf_cdf(ranks, 0.99)).select("s_suppkey", F.col("drawn").cast("long").alias("drawn"))


def latency_percentiles(spark, d):
    return workload.latency_percentiles(table(spark, d, "events"), "event_type", "value")


def median_of_trials(spark, d):
    trials = table(spark, d, "events").groupBy(F.col("event_type").alias("workload"), (F.col("event_id") % 5).alias("trial")).agg(F.count("*").alias("ops"))
    return workload.median_of_trials(trials, "workload").select("workload", "trial", "ops", "ops_min", "ops_max")


def status_line(spark, d):
    codes = list(LABELS)
    code = F.element_at(F.array(*map(F.lit, codes)), (F.col("n_nationkey") % len(codes) + 1).cast("int"))
    message = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise("")
    return table(spark, d, "nation").select("n_nationkey", status_text(code, message).alias("status"))


def throughput_summary(spark, d):
    """Operations a second over the span of each type's events."""
    span = F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))
    rows = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("ops"), span.alias("span_us"))
    return rows.select("event_type", "ops", "span_us", F.round(F.col("ops") * 1e6 / F.col("span_us"), 6).alias("ops_per_sec"))


def fixed_integers(spark, d):
    """Integers as little-endian bytes, and read back."""
    n = F.pmod(F.col("event_id") * 2654435761, F.lit(1 << 32))
    wide = F.col("event_id") * 1_000_003 + n
    rows = table(spark, d, "events").select("event_id", n.alias("n"), wide.alias("w"))
    return rows.select("event_id", F.hex(codec.le32(F.col("n"))).alias("low"), F.hex(codec.le64(F.col("w"))).alias("wide"), codec.read_le32(codec.le32(F.col("n"))).alias("low_back"), codec.read_le64(codec.le64(F.col("w"))).cast("string").alias("wide_back"))


def wal_decode(spark, d):
    """Payloads and what is read from them: every fifth is cut by a byte, every seventh has an unknown tag."""
    body = codec.payload(F.when(F.col("seq") % 7 == 3, 2).otherwise(F.col("tag")), F.col("key"), F.col("value"))
    rows = mut_events(spark, d).select("seq", body.alias("body"))
    cut = F.when(F.col("seq") % 5 == 2, F.substring("body", F.lit(1), F.octet_length("body") - 1)).otherwise(F.col("body"))
    back = codec.decode_payloads(rows.select("seq", cut.alias("cut")), "cut", "p")
    return back.select("seq", F.col("p.tag").cast("int").alias("tag"), F.col("p.key").cast("string").alias("key"), F.col("p.value").cast("string").alias("value"))


def wal_file_round_trip(spark, d):
    """The log as one file (its order is the file's), with a damaged tail that recovery cuts, read back frame by frame."""
    spark.dataSource.register(wal.KvWal)
    folder = fresh_folder(spark, "wal")
    rows = mut_events(spark, d).repartition(1).sortWithinPartitions("seq").select("tag", F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"))
    rows.write.format("kvwal").mode("append").option("path", folder).save()
    path = f"{folder}/wal-00000.log"
    wal.append_bytes(path, [b"\5\0\0"])
    wal.recover_file(path)
    back = spark.read.format("kvwal").option("path", path).load()
    return back.select("seq", F.col("tag").cast("int").alias("tag"), F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "start", "end")


def _segment_path(spark, d) -> str:
    """The log's latest rows as one segment file."""
    spark.dataSource.register(segment_file.KvSegment)
    folder = fresh_folder(spark, "segment")
    rows = resolve.latest(mut_events(spark, d)).select("tag", F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"))
    rows.repartition(1).sortWithinPartitions("key").write.format("kvsegment").mode("append").option("path", folder).option("block_size", BLOCK).save()
    return f"{folder}/00000.sst"


def segment_file_round_trip(spark, d):
    back = spark.read.format("kvsegment").option("path", _segment_path(spark, d)).load()
    return back.select(F.col("tag").cast("int").alias("tag"), F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def segment_file_get(spark, d):
    """Each probe looked up in the file: filter, binary search of the index, one block."""
    path = _segment_path(spark, d)

    def run(batches):
        own = segment_file.SegmentFile.open(path)
        for batch in batches:
            found = [own.get(k.encode()) for k in batch["key"]]
            yield batch.assign(status=[f[0] for f in found], value=[f[1].decode() if f[1] is not None else None for f in found])

    return probes(spark, d).distinct().mapInPandas(run, "key string, status string, value string")


def manifest_bytes(spark, d):
    """The byte form of the manifest of the fixed segments, and what is read from it; a manifest has one number a segment."""
    numbers = [r[0] for r in event_images(spark, d).select("seg").distinct().orderBy(F.desc("seg")).collect()]
    raw = manifest.to_bytes(max(numbers, default=0) + 1, numbers)
    following, back = manifest.from_bytes(raw)
    return spark.createDataFrame([(raw.hex(), following, ",".join(map(str, back)))], "bytes string, next_file_number long, table_numbers string")


def _stored(spark, d, parts: int, options: Options) -> tuple[str, Store]:
    """A store that took the events in `parts` batches of equal spans."""
    path = fresh_folder(spark, "store")
    log = mut_events(spark, d).select("seq", "tag", F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"))
    n = log.count()
    store = Store.open(spark, path, options)
    for k in range(parts):
        store.apply(log.where((F.col("seq") >= k * n // parts) & (F.col("seq") < (k + 1) * n // parts)), "seq")
    return path, store


def _texts(df: DataFrame) -> DataFrame:
    return df.withColumn("key", F.col("key").cast("string")).withColumn("value", F.col("value").cast("string"))


def store_reopened(spark, d):
    """Puts and deletes in three batches, closed without a flush, opened again: the live state comes from the log."""
    path, store = _stored(spark, d, 3, Options(flush_threshold_bytes=1 << 40))
    store.close()
    return _texts(Store.open(spark, path, Options(create_if_missing=False)).snapshot().live())


def store_flushed(spark, d):
    """A flush behind each of four batches: (pos, number, size_bytes, n_entries), the newest first."""
    return _stored(spark, d, 4, Options(flush_threshold_bytes=1))[1].segments()


def store_compacted(spark, d):
    """Four flushed batches, merged until nothing is eligible, vacuumed and opened again."""
    path, store = _stored(spark, d, 4, Options(flush_threshold_bytes=1, compaction_min_merge=2))
    store.compact()
    store.vacuum()
    return _texts(Store.open(spark, path).snapshot().live())


def store_read(spark, d):
    """Repeated keys through segments and the log: (key, status, value) for each row asked."""
    _, store = _stored(spark, d, 3, Options(flush_threshold_bytes=20_000))
    asked = probes(spark, d)
    return _texts(store.read(asked.unionByName(asked.where(F.col("key").startswith("absent")))))


def bloom_missing_filter(spark, d):
    """(seg, passed) of absent keys where segments of even numbers have no filter."""
    images = event_images(spark, d)
    absent = probes(spark, d).where(F.col("key").startswith("absent"))
    params = bloom.parameters(images, FPR)
    passed = bloom.matching(absent, params, bloom.set_bits(images.where("seg % 2 = 1"), FPR), FPR).groupBy("seg").agg(F.count("*").alias("p"))
    return params.select("seg").join(passed, "seg", "left").select("seg", F.coalesce("p", F.lit(0).cast("long")).alias("passed"))


def _runner(spark) -> workloads.Runner:
    return workloads.Runner(spark, workloads.parse("--num_ops 2000 --num_keys 1000 --trials 1 --batches 2 --flush_threshold 100000".split()))


def workload_fill_random(spark, d):
    """The keys of a random fill of as many operations as there are orders: each once."""
    n = table(spark, d, "orders").count()
    return spark.range(n).select(F.col("id").alias("op"), workloads.shuffled(F.col("id"), n, 42).alias("i")).groupBy(workload.bench_key(F.col("i")).alias("key")).agg(F.count("*").alias("times"))


def workload_reads(spark, d):
    """Uniform and Zipf reads and the mix over a filled store: operations, and how many of the reads found their key."""
    rows = _runner(spark).suite(("read-random-uniform", "read-random-zipfian", "mixed-50-50"))
    return spark.createDataFrame([(r.workload, r.ops, r.found if r.workload.startswith("read") else r.ops) for r in rows], "workload string, ops long, found long")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        kv_mutation_log, kv_live_state, kv_get_status, kv_multi_get, kv_key_history, kv_reject_empty_key, memtable_image, memtable_bytes, flush_plan,
        sst_entry_blocks, sst_document_blocks, sst_sparse_index, sst_index_lookup, bloom_hash, bloom_params, bloom_set_bits, bloom_false_positives,
        bloom_no_false_negatives, read_amplification, segment_tiers, compaction_pick, compaction_runs, compaction_merge_keep, compaction_merge_drop,
        compaction_fixpoint, wal_frames, wal_offsets, wal_recover, wal_truncate_offset, manifest_state, live_and_orphan_segments, snapshot_read,
        range_scan, seek, bench_key, zipf_cdf, zipf_draw, latency_percentiles, median_of_trials, throughput_summary,
        fixed_integers, wal_decode, wal_file_round_trip, segment_file_round_trip, segment_file_get, manifest_bytes, store_reopened, store_flushed,
        store_compacted, store_read, bloom_missing_filter, workload_fill_random, workload_reads,
    )
}
QUERIES["status_text"] = status_line
