"""Synthetic workloads, their summary, and the sweep grid."""
from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.scalar import workload_key

#: The sweep: one option at a time, all else at its default.
WORKLOADS = ("write_heavy", "read_heavy", "mixed")
SWEEP = {"memtable": ("64K", "256K", "1M", "4M"), "bloom": ("4", "8", "10", "14"), "compaction": ("2", "4", "8")}


def draw(column: Column, salt: int, n: int) -> Column:
    """A number in [0, n) by three steps of a multiplicative generator mod 2^31 - 1: the same whatever the partitioning, and on any engine."""
    x = (column * 48271 + salt * 69621) % 2147483647
    return F.floor(x * 16807 % 2147483647 * 48271 % 2147483647 / 7).cast("long") % n


def operations(spark: SparkSession, ops: int, write_ratio: float, key_space: int, value_size: int, seed: int) -> DataFrame:
    """sequence, op (read or write), key, value."""
    ids = spark.range(1, ops + 1).withColumnRenamed("id", "sequence")
    write = draw(F.col("sequence"), seed, 1_000_000) < int(write_ratio * 1_000_000)
    rows = ids.withColumn("op", F.when(write, "write").otherwise("read")).withColumn("key", workload_key(draw(F.col("sequence"), seed + 1, key_space)))
    return rows.withColumn("value", F.when(F.col("op") == "write", F.repeat(F.lit("x"), value_size)))


def mix(ops: DataFrame, by: str = "op") -> DataFrame:
    return ops.groupBy(by).agg(F.count("*").alias("ops"))


def latency(samples: DataFrame, by: str, value: str) -> DataFrame:
    """by, samples, p50, p95, p99 by nearest rank."""
    cuts = [stats.nearest_rank(value, p).alias(f"p{p}") for p in (50, 95, 99)]
    return samples.groupBy(by).agg(F.count("*").alias("samples"), *cuts)


def throughput(phases: DataFrame) -> DataFrame:
    """Per phase and in all: ops, seconds, ops a second; reads and writes are each divided by the seconds of all phases."""
    total = phases.agg(F.sum("ops").alias("ops"), F.sum("seconds").alias("seconds"))
    all_ = total.select(F.lit("total").alias("phase"), "ops", stats.rate(F.col("ops"), F.col("seconds")).alias("per_second"))
    seconds = F.broadcast(total.select(F.col("seconds").alias("_all")))  # one row
    return phases.join(seconds).select("phase", "ops", stats.rate(F.col("ops"), F.col("_all")).alias("per_second")).unionByName(all_)


def sweep_grid(spark: SparkSession) -> DataFrame:
    """workload, dimension, raw of the 33 runs."""
    options = [(d, v) for d, values in SWEEP.items() for v in values]
    grid = spark.createDataFrame(options, "dimension string, raw string")
    return grid.select(F.explode(F.array(*map(F.lit, WORKLOADS))).alias("workload"), "dimension", "raw")


def report_text(report: dict) -> str:
    return json.dumps(report, indent=2, ensure_ascii=False)


SAMPLES = 20  # operations timed one by one for the latencies of a report


def _timed(calls) -> dict[str, float]:
    """p50, p95 and p99 by nearest rank, in microseconds, of calls made one after the other."""
    import math
    import time

    took = []
    for call in calls:
        began = time.perf_counter()
        call()
        took.append((time.perf_counter() - began) * 1e6)
    took.sort()
    return {f"p{p}": took[max(0, math.ceil(p / 100 * len(took)) - 1)] if took else 0.0 for p in (50, 95, 99)}


def run(store, ops: int, write_ratio: float, key_space: int, value_size: int = 100, seed: int = 20260728, samples: int = SAMPLES) -> dict:
    """Apply a workload to a store as batches and measure it: one report of the shape the report queries read.

    Throughput is that of the batches; latencies are those of `samples` single
    commits and reads, which are beyond the counted operations.
    """
    import time

    spark = store.spark
    rows = operations(spark, ops, write_ratio, key_space, value_size, seed).persist()
    began = time.perf_counter()
    store.apply(rows.where("op = 'write'").select("key", "value", F.lit(False).alias("tombstone"), "sequence"), "sequence")
    wrote = time.perf_counter()
    reads = store.multi_get(rows.where("op = 'read'").select("key")).agg(F.count("*").alias("reads"), stats.hit_rate(F.col("found")).alias("hit_rate")).head()
    ended = time.perf_counter()
    store.read_counted(rows.where("op = 'read'").select("key"))
    keys = [r["key"] for r in rows.select("key").limit(samples).collect()]
    rows.unpersist()
    read_latency = _timed([lambda k=k: store.get(k) for k in keys])
    write_latency = _timed([lambda k=k: store.put(k, "x" * value_size) for k in keys[: max(1, samples // 4)]])
    writes, seconds = ops - reads["reads"], ended - began
    state = store.stats().head().asDict()
    files = sum(v["files"] for v in store.state["folders"].values())
    return {
        "workload": "mixed",
        "config": {"ops": ops, "write_ratio": write_ratio, "key_space": key_space, "value_size": value_size, "preload": 0, "seed": seed},
        "options": {"memtable_bytes": store.options.memtable_bytes, "bloom_bits_per_key": store.options.bloom_bits_per_key,
                    "compaction_trigger": store.options.compaction_trigger, "sync_writes": store.options.sync_writes},
        "results": {"elapsed_seconds": seconds, "total_ops_per_second": ops / seconds, "writes": writes, "write_ops_per_second": writes / seconds, "reads": reads["reads"],
                    "read_ops_per_second": reads["reads"] / seconds, "read_hit_rate": reads["hit_rate"], "write_latency_us": write_latency, "read_latency_us": read_latency,
                    "write_seconds": wrote - began, "sstable_count": state["sstable_count"], "bloom_checks": state["bloom_checks"], "bloom_negative_hits": state["bloom_negative_hits"],
                    "sstable_reads": state["sstable_reads"], "sstable_bytes_read": state["sstable_bytes_read"], "table_metadata_bytes": state["table_metadata_bytes"],
                    "database_size_bytes": state["disk_bytes"], "file_count": files},
    }


def reader_scaling(store, keys: list[str], reads: int, readers=(1, 2, 4, 8, 16)) -> DataFrame:
    """readers, reads, seconds, ops_per_second, p50_us, p95_us, p99_us: threads that each read the same keys, all results compared with the first reader's."""
    import time
    from concurrent.futures import ThreadPoolExecutor

    expected = {k: store.get(k) for k in keys}
    rows = []
    for n in readers:
        share = max(1, reads // n)

        def one(thread: int) -> list[float]:
            took = []
            for k in range(share):
                key = keys[(thread * share + k) % len(keys)]
                began = time.perf_counter()
                if store.get(key) != expected[key]:
                    raise AssertionError(f"readers disagree on {key!r}")
                took.append((time.perf_counter() - began) * 1e6)
            return took

        began = time.perf_counter()
        with ThreadPoolExecutor(n) as pool:
            took = sorted(x for part in pool.map(one, range(n)) for x in part)
        seconds = time.perf_counter() - began
        cut = lambda p: took[max(0, -(-p * len(took) // 100) - 1)]
        rows.append((n, len(took), seconds, len(took) / seconds, cut(50), cut(95), cut(99)))
    return store.spark.createDataFrame(rows, "readers int, reads long, seconds double, ops_per_second double, p50_us double, p95_us double, p99_us double")
