"""Time the headline queries: one JSON line.

The reference's figures are single operations a second on one node; here the same
work is done in batches, so each query's rows a second are given beside its time.
"""
from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

#: What stands for the reference's phases: writes with a flush, point reads, scans, compaction; then reconciliation and measurements.
HEADLINE = ["put_latest", "multi_get", "get_hit", "scan_full", "scan_range", "newest_generation_wins", "compact_merge", "wal_replay", "flush_layout", "table_integrity",
            "find_block", "bloom_hash", "bloom_stats", "percentile_nearest_rank", "report_summary"]
REPEAT = 2


def store_phases(spark, root: str, n: int) -> dict[str, float]:
    """n puts into a store with a flush, n seeded reads of which all hit, a full scan, a compaction."""
    from pyspark.sql import functions as F

    from tidemark import Options
    from tidemark.plans.store import Store

    store = Store(spark, f"file://{root}/store", Options(256 * 1024, 10, 4))
    rows = spark.range(n).select(F.concat(F.lit("key-"), F.col("id").cast("string")).alias("key"), F.concat(F.lit("value-"), F.col("id").cast("string")).alias("value"), "id")
    out = {}

    def timed(name, f):
        began = time.perf_counter()
        got = f()
        out[name] = time.perf_counter() - began
        return got

    timed("store_put", lambda: (store.put_many(rows, "id"), store.flush()))
    asked = spark.range(n).select(F.concat(F.lit("key-"), F.pmod(F.xxhash64("id"), F.lit(n)).cast("string")).alias("key"))
    found = timed("store_multi_get", lambda: store.multi_get(asked).where("found").count())
    assert found == n, found
    assert timed("store_scan", lambda: store.view().count()) == n
    store.put_many(rows.where("id % 10 = 0"), "id")
    store.flush()
    timed("store_compact", store.compact)
    assert store.view().count() == n
    return out


def main() -> None:
    import shutil
    import tempfile

    from pyspark.sql import SparkSession

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    root = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", f"file://{root}/shared").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tidemark import queries as engine

    times: dict[str, float] = {}
    for name in HEADLINE:
        for _ in range(REPEAT):  # the first run compiles
            began = time.perf_counter()
            engine.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - began
            times[name] = min(times.get(name, took), took)
    n = int(os.environ.get("BENCH_KEYS", "1000000"))
    phases = store_phases(spark, root, n)
    rates = {f"{k}_per_second": round(n / v) for k, v in phases.items()}
    spark.stop()
    shutil.rmtree(root, ignore_errors=True)
    times |= phases
    print(json.dumps({"metric": "headline queries and store phases, total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": {k: round(v, 3) for k, v in times.items()}, "rates": rates, "keys": n, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
