"""Operators and formats against plain loops."""
import random

from pyspark.sql import functions as F

from tidemark.functions import bloom, scalar
from tidemark.operators import checks, layout, mutate
from tidemark.plans import workload
from tidemark.sources import codec, files
from tidemark.streaming import ingest

COLUMNS = "key string, sequence long, tombstone boolean, value string, generation int"


def test_block_packing_is_the_loop(spark):
    rng = random.Random(3)
    rows = [(f"k{n:05d}", n + 1, False, "x" * rng.choice([0, 10, 700, 4076, 5000]), 1 + n % 3) for n in range(300)]
    got = layout.pack_blocks(spark.createDataFrame(rows, COLUMNS)).collect()
    for g in (1, 2, 3):
        own = sorted((r for r in rows if r[4] == g), key=lambda r: r[0])
        firsts = codec.pack([20 + len(r[0]) + len(r[3]) for r in own])
        want = {r[0]: sum(f <= n for f in firsts) - 1 for n, r in enumerate(own)}
        assert {r["key"]: r["block"] for r in got if r["generation"] == g} == want


def test_closed_form_size_is_the_encoded_size(spark):
    rows = [(f"k{n:03d}", n + 1, n % 5 == 0, "" if n % 5 == 0 else "v" * 90, 1) for n in range(120)]
    packed = layout.pack_blocks(spark.createDataFrame(rows, COLUMNS))
    size = layout.sizes(packed, 10).head()
    versions = [codec.Version(k.encode(), s, d, v.encode()) for k, s, d, v, _ in rows]
    assert size["file_bytes"] == len(codec.encode_table(versions, 10)) and size["entries"] == 120


def test_generation_schedule():
    events = layout.flush_schedule([10] * 7, 1, 4)
    assert [(k, g) for _, k, g in events] == [("flush", 1), ("flush", 2), ("flush", 3), ("flush", 4), ("compact", 5), ("flush", 6), ("flush", 7), ("flush", 8), ("compact", 9)]


def test_distributed_filters_are_the_built_ones(spark):
    rows = [(f"k{n}", n + 1, False, "", n % 2) for n in range(200)]
    got = {r["generation"]: bytes(r["body"]) for r in bloom.filters(spark.createDataFrame(rows, COLUMNS), 10).collect()}
    assert got == {g: bloom.build([r[0].encode() for r in rows if r[4] == g], 10)[2] for g in (0, 1)}


def test_sequences_follow_the_order(spark):
    rows = [(n * 7919 % 1000,) for n in range(1000)]
    got = mutate.numbered(spark.createDataFrame(rows, "n int").repartition(7), 50, "n").collect()
    assert {r["n"]: r["sequence"] for r in got} == {n: n + 51 for n in range(1000)}


def test_floor_percentile_of_one_to_twenty(spark):
    from tidemark.functions import stats

    got = stats.floor_index(spark.createDataFrame([("a", n) for n in range(1, 21)], "g string, x int"), "g", "x", [0.95]).head()
    assert got["p95"] == 19


def test_log_sources_agree(spark, tmp_path):
    log = [codec.Version(b"a", 1, False, b"x"), codec.Version(b"\xff", 2, True, b""), codec.Version(b"c", 3, False, b"")]
    (tmp_path / "active.wal").write_bytes(b"".join(map(codec.log_record, log)) + b"WAL1broken-tail")
    want = [(bytes(v.key), v.sequence, v.tombstone, bytes(v.value)) for v in log]
    spark.dataSource.register(files.LogSource)
    one = files.read_logs(spark, str(tmp_path / "active.wal"))
    two = spark.read.format("tidemark_log").option("path", str(tmp_path / "active.wal")).load()
    for df in (one, two):
        assert [(bytes(r["key"]), r["sequence"], r["tombstone"], bytes(r["value"])) for r in df.orderBy("position").collect()] == want


def test_tables_and_discovery(spark, tmp_path):
    for g in (1, 3):
        (tmp_path / f"sst-{g}.dat").write_bytes(codec.encode_table([codec.Version(b"k", g, False, b"v%d" % g)], 10))
    (tmp_path / "sst-9.dat.tmp").write_bytes(b"half")
    assert [r["generation"] for r in files.discover(spark, str(tmp_path)).collect()] == [3, 1]
    assert sorted((r["generation"], bytes(r["value"])) for r in files.read_tables(spark, str(tmp_path)).collect()) == [(1, b"v1"), (3, b"v3")]
    size = files.folder_size(spark, str(tmp_path)).head()
    assert size["files"] == 3


def test_acknowledged_writes(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("k1\tv1\nk2\ta\tb\nk3\tv3\ntorn\tli")
    assert [tuple(r) for r in files.read_acknowledged(spark, str(tmp_path / "a.tsv")).orderBy("key").collect()] == [("k1", "v1"), ("k2", "a\tb"), ("k3", "v3")]
    (tmp_path / "b.tsv").write_text("k1\tv1\nbad\nk3\tv3\n")
    assert files.read_acknowledged(spark, str(tmp_path / "b.tsv")).count() == 1


def test_workload_configuration(spark, tmp_path):
    (tmp_path / "w.conf").write_text("# c\nops = 12\nwrite_ratio = 7\nkey_space=0\nother = 3\n")
    got = files.workload(spark, str(tmp_path / "w.conf"))
    assert (got["ops"], got["write_ratio"], got["key_space"], got["seed"]) == (12, 1.0, 1, 20260728) and "other" not in got


def test_operation_mix(spark):
    ops = workload.operations(spark, 20000, 0.9, 100, 5, 1)
    n = {r["op"]: r["ops"] for r in workload.mix(ops).collect()}
    assert sum(n.values()) == 20000 and 17700 < n["write"] < 18300
    assert ops.where("length(key) <> 20 or (op = 'write' and value <> 'xxxxx')").isEmpty()
    assert workload.sweep_grid(spark).count() == 33


def test_labels(spark):
    got = spark.createDataFrame([(0,), (1023,), (1024,), (1536,), (1 << 20,), (5 << 20,)], "n long").select(scalar.size_label(F.col("n")).alias("l"))
    assert [r["l"] for r in got.collect()] == ["0", "1023", "1K", "1K", "1M", "5M"]


def test_differences_see_deletions(spark):
    a = spark.createDataFrame([("k", "1"), ("d", "")], "key string, value string")
    b = spark.createDataFrame([("k", "2")], "key string, value string")
    assert sorted(map(tuple, checks.differences(a, b).collect())) == [("d", "", None), ("k", "1", "2")]


def test_stream_state_is_the_batch_view(spark, tmp_path):
    rows = [("a", 1, False, "x"), ("b", 2, False, "y"), ("a", 5, True, ""), ("a", 3, False, "late"), ("b", 4, False, "z")]
    for n, r in enumerate(rows):
        spark.createDataFrame([r], "key string, sequence long, tombstone boolean, value string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ingest.changes(spark, str(tmp_path / "in"), 2)
    q = ingest.keyed_state(stream).writeStream.outputMode("update").format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination()
    newest = {r["key"]: (r["sequence"], r["tombstone"]) for r in spark.sql("select * from kept order by sequence").collect()}
    q = ingest.latest_state(ingest.changes(spark, str(tmp_path / "in"), 2)).writeStream.outputMode("complete").format("memory").queryName("whole").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert newest == {"a": (5, True), "b": (4, False)} == {r["key"]: (r["sequence"], r["tombstone"]) for r in spark.sql("select * from whole").collect()}


def sliced(monkeypatch):
    """Frames of any size in many slices."""
    from tidemark.operators import ranges

    monkeypatch.setattr(ranges, "SLICE_BYTES", 400)
    monkeypatch.setattr(layout, "SLICE_BLOCKS", 3)
    monkeypatch.setattr(checks, "SLICE_ROWS", 17)
    return ranges


def test_slices_do_not_change_ranks_or_packing(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(f"k{n:05d}", n + 1, False, "x" * rng.choice([0, 10, 700, 1500, 4076, 5000]), 1 + n % 3) for n in range(400)]
    df = spark.createDataFrame(rows, COLUMNS)
    want = {name: sorted(map(tuple, f(df).select("generation", "key", "block").collect())) for name, f in (("fold", layout.pack_blocks), ("fixed", lambda d: layout.fixed_blocks(d, 7)))}
    ranges = sliced(monkeypatch)
    assert len(ranges.bounds(df, "key")) > 5
    assert sorted(map(tuple, layout.pack_blocks(df).select("generation", "key", "block").collect())) == want["fold"]
    assert sorted(map(tuple, layout.fixed_blocks(df, 7).select("generation", "key", "block").collect())) == want["fixed"]
    for g in (1, 2, 3):
        own = sorted((r for r in rows if r[4] == g), key=lambda r: r[0])
        firsts = codec.pack([20 + len(r[0]) + len(r[3]) for r in own])
        assert [b for x, _, b in want["fold"] if x == g] == [sum(f <= n for f in firsts) - 1 for n in range(len(own))]


def test_slices_do_not_change_lookups(spark, monkeypatch):
    rows = [(f"k{n:04d}", n + 1, False, "v" * (n % 9), 1 + n % 2) for n in range(0, 600, 2)]
    df = spark.createDataFrame(rows, COLUMNS)
    keys = spark.createDataFrame([(f"k{n:04d}",) for n in range(0, 620, 7)] + [("a",), ("z",)], "key string")

    def all_of():
        index = layout.sparse_index(layout.fixed_blocks(df, 5)).persist()
        try:
            return [sorted(map(tuple, x.collect())) for x in (layout.find_block(index, keys), layout.extents(index, 40).select("generation", "block", "offset", "end"),
                    layout.overlapping(index, "k0100", "k0200").select("generation", "block"),
                    checks.table_integrity(df.withColumn("position", F.pmod(F.col("sequence") * 7, F.lit(1009)))))]
        finally:
            index.unpersist()

    want = all_of()
    sliced(monkeypatch)
    assert all_of() == want


def test_slices_do_not_change_percentiles(spark, monkeypatch):
    from tidemark.functions import stats

    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(50)) for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, x int")
    want = sorted(map(str, stats.floor_index(df, "g", "x", [0.5, 0.99]).collect()))
    sliced(monkeypatch)
    assert sorted(map(str, stats.floor_index(df, "g", "x", [0.5, 0.99]).collect())) == want


def test_metric_lines_and_tables(spark, tmp_path):
    df = spark.createDataFrame([(10, 80, 2)], "acknowledged long, sequence long, sstables long")
    files.write_metrics(df, str(tmp_path / "m"))
    line = spark.read.text(str(tmp_path / "m"))
    assert line.head()["value"] == "acknowledged=10 sequence=80 sstables=2"
    assert line.select(files.metrics(F.col("value")).alias("m")).head()["m"] == {"acknowledged": 10, "sequence": 80, "sstables": 2}
    files.write_csv(df, str(tmp_path / "c"))
    assert [tuple(r) for r in spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "c")).collect()] == [(10, 80, 2)]
    rows = spark.createDataFrame([("mixed", 12.345, 7), ("a name that is long", None, 100000)], "run string, rate double, n int")
    got = [r["value"] for r in files.fixed_width(rows, {"run": 8, "rate": 7, "n": 4}).orderBy("n").collect()]
    assert got == ["run         rate    n", "mixed       12.3    7", "a name that is long       - 100000"]


def test_workload_report_and_reader_scaling(spark, tmp_path):
    from tidemark import Options
    from tidemark.plans import reports
    from tidemark.plans.store import Store

    s = Store(spark, f"file://{tmp_path}/s", Options(1000, 10, 4))
    report = workload.run(s, 200, 0.5, 50, 20, samples=4)
    (tmp_path / "r").mkdir()
    (tmp_path / "r/mixed__bloom_10.json").write_text(workload.report_text(report))
    row = reports.summary(files.read_reports(spark, str(tmp_path / "r"))).head()
    assert row["run"] == "mixed" and row["value"] == 10 and row["sstable_count"] == 1
    assert all(row[c] > 0 for c in ("total_ops_per_second", "read_latency_us_p99", "write_latency_us_p99", "bloom_checks", "database_size_bytes"))
    table = workload.reader_scaling(s, ["00000000000000000001", "absent"], 4, (1, 2))
    assert [(r["readers"], r["reads"]) for r in table.collect()] == [(1, 4), (2, 4)] and table.where("p99_us < p50_us").isEmpty()


def test_lookup_in_all_generations_moves_no_product(spark, monkeypatch):
    """Against a loop, in one slice and many; in the plan the rows of keys times generations come last, behind the sort."""
    rng = random.Random(9)
    rows = [(g, b, k) for g in (1, 2, 5) for b, k in enumerate(sorted(rng.sample([f"k{n:03d}" for n in range(300)], 20)))] + [(None, 0, "k000"), (7, 0, None)]
    index = spark.createDataFrame(rows, "generation long, block long, first_key string")
    asked = [f"k{n:03d}" for n in range(0, 320, 3)] + ["a", "z", "k1", None]
    keys = spark.createDataFrame([(k,) for k in asked], "key string").repartition(5)
    want = {(g, k): max([b for x, b, f in rows if x == g and g is not None and k is not None and f is not None and f <= k], default=-1) for g in (1, 2, 5, 7, None) for k in asked}
    assert {(r["generation"], r["key"]): r["block"] for r in layout.find_block(index, keys).collect()} == want
    sliced(monkeypatch)
    found = layout.find_block(index, keys)
    got = found.collect()
    assert len(got) == len(want) and {(r["generation"], r["key"]): r["block"] for r in got} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert "MapInArrow" in plan[0] and "Sort" in plan[1]


def filtered():
    """Entries of generations of unlike and of like sizes, a null among keys and generations; and what each filter says of each key."""
    rows = [(g, f"k{k}") for g in range(1, 12) for k in range(0, 300, g)] + [(g, f"k{k}") for g in range(20, 40) for k in range(g, 300, 10)] + [(3, None), (None, "k1"), (5, "k5")]
    want = {}
    keys = {k for _, k in rows}
    for g in {g for g, _ in rows}:
        own = {k for x, k in rows if x == g}
        bits, real = bloom.bits_for(len(own), 10), [k for k in own if k is not None and g is not None]
        on = set(bloom.positions([k.encode() for k in real], bits, 6).ravel().tolist())
        for k in keys:
            want[g, k] = k is not None and on.issuperset(bloom.positions([k.encode()], bits, 6).ravel().tolist()), k in real
    return rows, want


def test_filters_in_pieces_and_passes_are_the_same(spark, monkeypatch):
    rows, want = filtered()
    entries = spark.createDataFrame(rows, "generation long, key string").repartition(3)
    counts = {g: (len({k for _, k in want}), sum(m for (x, _), (m, _) in want.items() if x == g)) for g, _ in want}
    for sent in (1 << 20, 400, 200):  # one pass, several, and filters that are too large to be sent
        monkeypatch.setattr(bloom, "BROADCAST_BYTES", sent)
        parts = bloom.filter_bytes(entries, 10)
        got = bloom.membership_held(entries, parts).collect()
        assert len(got) == len(want) and {(r["generation"], r["key"]): (r["maybe"], r["held"]) for r in got} == want
        assert {r["generation"]: (r["checks"], r["maybe"]) for r in bloom.passed(entries.select("key").distinct(), parts).collect()} == counts
        for name, value in (("PIECE_BITS", 512), ("KEYS_AT_ONCE", 7), ("PAIRS_AT_ONCE", 50), ("OUT_ROWS", 16)):
            monkeypatch.setattr(bloom, name, value)


def test_keys_times_generations_are_not_moved(spark, tmp_path):
    """Nothing comes after the rows of bloom_membership are made; bloom_stats counts the same."""
    from tidemark import queries

    events = [(n, n % 40, "error" if n % 5 == 0 else "view", "{}") for n in range(0, 50_000, 50)]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, props string").write.parquet(str(tmp_path / "events.parquet"))
    plan = queries.bloom_membership(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert "MapInArrow" in plan[0]
    stats = queries.bloom_stats(spark, str(tmp_path))
    member = queries.bloom_membership(spark, str(tmp_path)).groupBy("generation").agg(F.count("*"), F.count_if(~F.col("maybe")), F.count_if(F.col("maybe") & ~F.col("held")))
    assert sorted(map(tuple, stats.collect())) == sorted(map(tuple, member.collect()))
