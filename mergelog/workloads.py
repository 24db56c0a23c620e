"""Workloads over a store, from the command line: batched fills, reads and mixes, trials and their median.

    python -m mergelog.workloads --workload all --num_ops 50000 --num_keys 100000 --out results.json

An unknown flag prints the usage and ends with status 1. Rates are operations a second;
latencies are of whole batches, since a Spark job's fixed cost hides a single operation's.
"""

from __future__ import annotations

import argparse
import json
import math
import os
import platform
import random
import shutil
import sys
import tempfile
import time
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergelog.functions.workload import bench_key, zipf_cdf, zipf_draw
from mergelog.options import Options
from mergelog.store import Store

SKEW = 0.99
NAMES = ("fill-sequential", "fill-random", "read-random-uniform", "read-random-zipfian", "mixed-50-50")


@dataclass
class Summary:
    workload: str
    trial: int
    ops: int
    ops_per_sec: float
    p50_us: float
    p95_us: float
    p99_us: float
    p999_us: float
    max_us: float
    found: int = 0
    ops_per_sec_min: float = 0.0
    ops_per_sec_max: float = 0.0


def percentile(ordered: list[float], f: float) -> float:
    """Rank rounded down, no interpolation; 0 of nothing."""
    return ordered[math.floor(f * (len(ordered) - 1))] if ordered else 0.0


def summarize(workload: str, trial: int, ops: int, batches: list[float], found: int = 0) -> Summary:
    ordered = sorted(b * 1e6 for b in batches)
    total = sum(batches)
    return Summary(workload, trial, ops, ops / total if total else 0.0, *(percentile(ordered, f) for f in (0.5, 0.95, 0.99, 0.999)), ordered[-1] if ordered else 0.0, found)


def median_of_trials(trials: list[Summary]) -> Summary:
    """The upper median by throughput, with the least and the greatest."""
    ordered = sorted(trials, key=lambda s: s.ops_per_sec)
    out = ordered[len(ordered) // 2]
    out.ops_per_sec_min, out.ops_per_sec_max = ordered[0].ops_per_sec, ordered[-1].ops_per_sec
    return out


def shuffled(i: Column, n: int, seed: int) -> Column:
    """A permutation of 0 .. n - 1 (n below 2**32): each index comes once, at a place that the seed chooses; a step without a common factor with n."""
    rng = random.Random(seed)
    step = next(a for a in iter(lambda: rng.randrange(1, min(n, 1 << 31) + 1), 0) if math.gcd(a, n) == 1)
    return F.pmod(i.cast("long") * F.lit(step).cast("long") + F.lit(rng.randrange(n)).cast("long"), F.lit(n).cast("long"))


class Runner:
    def __init__(self, spark: SparkSession, args: argparse.Namespace):
        self.spark, self.args = spark, args

    def _rows(self, index: DataFrame, letter: str) -> DataFrame:
        key = bench_key(F.col("i"), self.args.key_size).cast("binary")
        return index.select(key.alias("key"), F.lit(letter * self.args.value_size).cast("binary").alias("value"), "ord")

    def _fresh(self) -> tuple[str, Store]:
        root = tempfile.mkdtemp(prefix="mergelog-", dir=self.args.db_root)
        return root, Store.open(self.spark, f"file://{root}/store", Options(flush_threshold_bytes=self.args.flush_threshold))

    def _timed(self, batches: list, run) -> tuple[list[float], int]:
        took, found = [], 0
        for b in batches:
            began = time.perf_counter()
            found += run(b) or 0
            took.append(time.perf_counter() - began)
        return took, found

    def _cut(self, n: int) -> list[tuple[int, int]]:
        size = -(-n // self.args.batches)
        return [(a, min(n, a + size)) for a in range(0, n, size)]

    def _index(self, a: int, b: int) -> DataFrame:
        return self.spark.range(a, b).select(F.col("id").alias("i"), F.col("id").alias("ord"))

    def _asked(self, a: int, b: int, zipf: bool) -> DataFrame:
        """Drawn indices of operations a to b, the same for a seed."""
        u = (F.pmod(F.xxhash64("ord", F.lit(self.args.seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        drawn = self.spark.range(a, b).select(F.col("id").alias("ord")).withColumn("u", u)
        if zipf:
            ranks = self.spark.range(self.args.num_keys).select(F.col("id").alias("i"))
            return zipf_draw(drawn, zipf_cdf(ranks, SKEW)).select(F.col("drawn").alias("i"), "ord")
        return drawn.select(F.floor(F.col("u") * self.args.num_keys).cast("long").alias("i"), "ord")

    def _drawn(self, root: str, frames: list[DataFrame]) -> list[DataFrame]:
        """Frames as written tables, so that drawing isn't timed."""
        out = []
        for k, df in enumerate(frames):
            path = f"file://{root}/drawn-{time.monotonic_ns()}-{k}"
            df.write.parquet(path)
            out.append(self.spark.read.parquet(path))
        return out

    def fill(self, trial: int, sequential: bool) -> Summary:
        root, store = self._fresh()

        def run(cut: tuple[int, int]) -> None:
            index = self._index(*cut)
            if not sequential:
                index = index.withColumn("i", shuffled(F.col("i"), self.args.num_ops, self.args.seed))
            store.put(self._rows(index, "v"), "ord")

        took, _ = self._timed(self._cut(self.args.num_ops), run)
        shutil.rmtree(root, ignore_errors=True)
        return summarize("fill-sequential" if sequential else "fill-random", trial, self.args.num_ops, took)

    def _populated(self) -> tuple[str, Store]:
        root, store = self._fresh()
        for cut in self._cut(self.args.num_keys):
            store.put(self._rows(self._index(*cut), "v"), "ord")
        return root, store

    def reads(self, trial: int, zipf: bool, store: Store, root: str) -> Summary:
        key = bench_key(F.col("i"), self.args.key_size).cast("binary").alias("key")
        asked = self._drawn(root, [self._asked(*cut, zipf).select(key) for cut in self._cut(self.args.num_ops)])
        took, found = self._timed(asked, lambda df: store.read(df).where("status = 'found'").agg(F.count("value")).first()[0])
        if found != self.args.num_ops:
            raise RuntimeError(f"{self.args.num_ops - found} reads found nothing")
        return summarize("read-random-zipfian" if zipf else "read-random-uniform", trial, self.args.num_ops, took, found)

    def mixed(self, trial: int, store: Store, root: str) -> Summary:
        key = bench_key(F.col("i"), self.args.key_size).cast("binary").alias("key")
        coin = F.xxhash64("ord", F.lit(self.args.seed + 1)) % 2 == 0
        frames = self._drawn(root, [self._asked(*cut, False) for cut in self._cut(self.args.num_ops)])

        def run(index: DataFrame) -> int:
            asked = index.where(coin).select(key)
            found = store.read(asked).where("status = 'found'").agg(F.count("value")).first()[0]
            store.put(self._rows(index.where(~coin), "w"), "ord")
            return found

        took, found = self._timed(frames, run)
        return summarize("mixed-50-50", trial, self.args.num_ops, took, found)

    def suite(self, names: tuple[str, ...]) -> list[Summary]:
        out: dict[str, list[Summary]] = {n: [] for n in names}
        for trial in range(self.args.trials):
            for n in names:
                if n.startswith("fill"):
                    out[n].append(self.fill(trial, n == "fill-sequential"))
            if any(not n.startswith("fill") for n in names):
                root, store = self._populated()
                self.reads(-1, False, store, root)  # an untimed pass to warm up
                for n in names:
                    if n.startswith("read"):
                        out[n].append(self.reads(trial, n == "read-random-zipfian", store, root))
                    elif n == "mixed-50-50":
                        out[n].append(self.mixed(trial, store, root))
                shutil.rmtree(root, ignore_errors=True)
        return [median_of_trials(t) for t in out.values()]


def machine() -> dict:
    return {"processor": platform.processor() or platform.machine(), "cpus": os.cpu_count(), "system": platform.platform()}


def parse(argv: list[str] | None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="mergelog.workloads", description="Batched key-value workloads.")
    p.add_argument("--workload", default="all", choices=("all", *NAMES))
    for name, default in (("num_ops", 50_000), ("num_keys", 100_000), ("value_size", 100), ("key_size", 16), ("seed", 42), ("trials", 3), ("flush_threshold", 4 << 20), ("batches", 5)):
        p.add_argument(f"--{name}", type=int, default=default)
    p.add_argument("--db_root", default=None)
    p.add_argument("--out", default=None)
    p.error = lambda message: (p.print_usage(sys.stderr), sys.exit(1))  # type: ignore[method-assign,assignment]
    return p.parse_args(argv)


def table(rows: list[Summary]) -> str:
    lines = ["| workload | ops/s | least | greatest | p50 us | p99 us |", "|-|-|-|-|-|-|"]
    return "\n".join(lines + [f"| {r.workload} | {r.ops_per_sec:,.0f} | {r.ops_per_sec_min:,.0f} | {r.ops_per_sec_max:,.0f} | {r.p50_us:,.0f} | {r.p99_us:,.0f} |" for r in rows])


def main(argv: list[str] | None = None) -> int:
    args = parse(argv)
    spark = SparkSession.builder.master("local[*]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    rows = Runner(spark, args).suite(NAMES if args.workload == "all" else (args.workload,))
    print(table(rows))
    if args.out:
        with open(args.out, "w") as f:
            json.dump({"machine": machine(), "config": vars(args), "results": [asdict(r) for r in rows]}, f, indent=1)
    return 0


if __name__ == "__main__":
    sys.exit(main())
