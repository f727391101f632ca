"""The store against a dict: reads, flush, compaction, reopening, interrupted commits."""
import random

import pytest
from pyspark.errors import PySparkException

from tidemark import CorruptStore, InvalidArgument, Options
from tidemark.operators import reads
from tidemark.plans.store import Store


def apply(spark, store, ops):
    rows = [(k, v or "", v is None, n) for n, (k, v) in enumerate(ops)]
    store.apply(spark.createDataFrame(rows, "key string, value string, tombstone boolean, n int"), "n")


def seen(store):
    return [(r["key"], r["value"]) for r in store.scan().collect()]


def test_options():
    for bad in ((0, 1, 2), (1, 0, 2), (1, 1, 1)):
        with pytest.raises(InvalidArgument):
            Options(*bad)


def test_versions_flush_compact_reopen(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    s = Store(spark, path, Options(1 << 20, 10, 10))
    for value in ("old", "new", None):
        apply(spark, s, [("shared", value)])
        s.flush()
    assert s.get("shared") is None and s.state["generations"] == [1, 2, 3]
    s = Store(spark, path, Options(1 << 20, 10, 10))
    assert s.get("shared") is None
    s.compact()
    assert s.state["generations"] == [4] and s.get("shared") is None
    assert s.generation(4).collect()[0]["tombstone"]  # tombstones outlive compaction
    s.put("shared", "")
    assert s.get("shared") == "" and s.state["sequence"] == 4
    s.flush()
    s.flush()
    assert s.state["generations"] == [4, 5]


def test_golden_scans(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s", Options(1 << 20, 10, 10))
    apply(spark, s, [(k, f"old-{k}") for k in "abcd"])
    s.flush()
    apply(spark, s, [("b", "new-b"), ("c", None), ("e", "new-e")])
    for _ in range(3):
        assert [tuple(r) for r in s.scan("b", "e").collect()] == [("b", "new-b"), ("d", "old-d")]
        assert [k for k, _ in seen(s)] == list("abde")
        s.flush()
        s.compact()
    assert s.scan("x", "x").collect() == []
    for begin, end in (("b", "a"), ("b", "")):
        with pytest.raises(InvalidArgument):
            s.scan(begin, end)
    assert [r["key"] for r in s.scan_from("b").collect()] == ["b", "d", "e"]


def test_limits(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    for key, value in (("", "v"), ("k" * (2**20 + 1), "v")):
        with pytest.raises(InvalidArgument):
            s.put(key, value)
    with pytest.raises(PySparkException):
        apply(spark, s, [("ok", "1"), ("", "2")])
    assert s.state["sequence"] == 0 and s.get("ok") is None and s.get("") is None
    s.erase("never put")
    assert s.state["sequence"] == 1 and s.memtable().head()["entries"] == 1


def test_generation_schedule(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s", Options(1, 10, 4))
    for k in range(7):
        apply(spark, s, [(f"k{k}", "v")])
    assert s.state["generations"] == [9] and s.state["next_generation"] == 10


def test_differential(spark, tmp_path):
    rng, model, path = random.Random(20260728), {}, f"file://{tmp_path}/s"
    for phase in range(4):
        s = Store(spark, path, Options(700, 10, 3))
        assert seen(s) == sorted((k, v) for k, v in model.items() if v is not None)
        ops = [(f"key-{rng.randrange(40)}", None if rng.random() < 0.2 else f"value-{rng.randrange(999)}") for _ in range(60)]
        model.update(ops)
        apply(spark, s, ops)
        if phase % 2:
            s.compact()
    s = Store(spark, path)
    assert seen(s) == sorted((k, v) for k, v in model.items() if v is not None)
    asked = spark.createDataFrame([(f"key-{k}",) for k in range(50)], "key string")
    for r in s.multi_get(asked).collect():
        assert r["value"] == model.get(r["key"]) and r["found"] == (model.get(r["key"]) is not None)


class Crash(Exception):
    pass


@pytest.mark.parametrize("step", ["log", "table", "manifest", "delete"])
def test_interrupted_commit(spark, tmp_path, step):
    path = f"file://{tmp_path}/s"
    s = Store(spark, path, Options(1 << 20, 10, 10))
    apply(spark, s, [("a", "1"), ("b", "2")])
    s.flush()
    apply(spark, s, [("a", None)])
    s.flush()
    before = seen(s)

    def stop(at):
        if at == step:
            raise Crash

    s.fault = stop
    with pytest.raises(Crash):
        if step == "log":
            apply(spark, s, [("c", "3")])
        s.compact()
    again = Store(spark, path, Options(1 << 20, 10, 10))
    assert seen(again) == before
    apply(spark, again, [("d", "4")])
    again.flush()
    assert seen(again) == before + [("d", "4")]


def test_missing_generation_is_refused(spark, tmp_path):
    import shutil

    s = Store(spark, f"file://{tmp_path}/s")
    apply(spark, s, [("a", "1")])
    s.flush()
    shutil.rmtree(folder_of(tmp_path, 1))
    with pytest.raises(CorruptStore):
        Store(spark, f"file://{tmp_path}/s")


def test_key_predicates_reach_the_scan(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s")
    apply(spark, s, [("a", "1"), ("b", "2")])
    s.flush()
    plan = reads.scan(s.log(), "a", "b")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key,a)" in plan and "LessThan(key,b)" in plan


def folder_of(tmp_path, generation):
    folder, = (tmp_path / "s/gen").glob(f"{generation}-*")
    return folder


def part_files(folder):
    return sorted(p for p in folder.iterdir() if p.name.startswith("part-"))


@pytest.mark.parametrize("harm", ["delete", "cut", "add", "flip"])
def test_damaged_part_files_are_refused(spark, tmp_path, monkeypatch, harm):
    from tidemark.plans import store

    monkeypatch.setattr(store, "KEY_BUCKET_BYTES", 2_000)  # many part files
    s = Store(spark, f"file://{tmp_path}/s", Options(1 << 30, 10, 10))
    apply(spark, s, [(f"key-{k:05d}", "x" * 50) for k in range(2000)])
    s.flush()
    files = part_files(folder_of(tmp_path, 1))
    assert len(files) > 1
    if harm == "delete":
        files[0].unlink()
    elif harm == "cut":
        files[0].write_bytes(files[0].read_bytes()[:-9])
    elif harm == "add":
        (files[0].parent / "part-x.parquet").write_bytes(files[0].read_bytes())
    else:  # a byte of a data page: found when it is read
        raw = bytearray(files[0].read_bytes())
        raw[200] ^= 0x5A
        files[0].write_bytes(raw)
        (files[0].parent / f".{files[0].name}.crc").unlink()
        with pytest.raises((CorruptStore, PySparkException)):
            Store(spark, f"file://{tmp_path}/s").check()
        return
    with pytest.raises(CorruptStore):
        Store(spark, f"file://{tmp_path}/s")


def test_check_of_a_sound_store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s", Options(1 << 20, 10, 10))
    apply(spark, s, [("a", "1"), ("b", None)])
    s.flush()
    apply(spark, s, [("c", "3")])
    Store(spark, f"file://{tmp_path}/s").check()


def test_readers_go_on_across_a_compaction(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    s = Store(spark, path, Options(1 << 20, 10, 10))
    for k in range(3):
        apply(spark, s, [(f"k{k}", "v")])
        s.flush()
    reader = Store(spark, path)
    view = reader.view()
    s.compact()
    apply(spark, s, [("new", "v")])
    assert {r["key"] for r in view.collect()} == {r["key"] for r in reader.view().collect()} == {"k0", "k1", "k2"}
    s.retain = 0
    apply(spark, s, [("newer", "v")])
    assert [p.name.partition("-")[0] for p in (tmp_path / "s/gen").iterdir()] == ["4"]


def test_of_two_writers_one_is_refused(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    one, two = Store(spark, path), Store(spark, path)
    apply(spark, one, [("a", "1")])
    with pytest.raises(CorruptStore):
        apply(spark, two, [("a", "2")])
    assert Store(spark, path).get("a") == "1"


def test_a_torn_manifest_was_never_acknowledged(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    s = Store(spark, path)
    apply(spark, s, [("a", "1")])
    (tmp_path / "s/manifest/00000000000000000009.json").write_text('{"version": 9, "gen')
    assert Store(spark, path).get("a") == "1"


def test_buffered_writer(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s", Options(1 << 20, 10, 10))
    with s.writer() as w:
        for k in range(500):
            w.put(f"k{k}", "v")
        w.erase("k7")
        w.put("k8", "w")
        with pytest.raises(InvalidArgument):
            w.put("", "v")
    assert s.state["sequence"] == 502 and s.state["batches"] == [1]
    assert s.get("k7") is None and s.get("k8") == "w" and s.get("k499") == "v"


def test_read_counters(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/s", Options(1 << 20, 10, 10))
    for half in range(2):
        apply(spark, s, [(f"present-{k}", "value") for k in range(100 * half, 100 * half + 100)])
        s.flush()
    apply(spark, s, [("staged", "v")])
    asked = spark.createDataFrame([(f"{w}-{k}",) for w in ("present", "absent") for k in range(100)] + [("staged",)], "key string")
    assert s.read_counted(asked).where("found").count() == 101
    got = s.stats().head()
    # absent keys ask both filters, those of the older half both, staged ones none
    assert got["bloom_checks"] == 400 and 100 <= got["sstable_reads"] < 120
    assert got["bloom_negative_hits"] == got["bloom_checks"] - got["sstable_reads"] and got["sstable_bytes_read"] > 0
    assert got["table_metadata_bytes"] == 2 * (40 + 125) + sum(12 + len(k) for k in first_keys()) and got["sstable_count"] == 2 and got["memtable_entries"] == 1


def first_keys():
    """First keys of the blocks of the two generations above, by greedy packing."""
    out = []
    for half in range(2):
        used = 1 << 30
        for key in sorted(f"present-{k}" for k in range(100 * half, 100 * half + 100)):
            size = 20 + len(key) + 5
            if used + size > 4096:
                out.append(key)
                used = 0
            used += size
    return out


def test_filters_joined_by_byte_are_the_same(spark, monkeypatch):
    from tidemark.functions import bloom

    entries = spark.createDataFrame([(g, f"k{k}") for g in (1, 2) for k in range(0, 300, g)], "generation long, key string")
    keys = spark.createDataFrame([(f"k{k}",) for k in range(600)], "key string")
    parts = bloom.filter_bytes(entries, 10)
    few = sorted(map(tuple, bloom.membership(keys, parts).collect()))
    monkeypatch.setattr(bloom, "BROADCAST_BYTES", 0)
    assert sorted(tuple(r[c] for c in ("generation", "key", "maybe")) for r in bloom.membership(keys, parts).collect()) == few


def test_many_requests_are_the_same_as_few(spark, monkeypatch):
    log = spark.createDataFrame([("a", 1, False, "x"), ("a", 2, False, "y"), ("b", 3, False, "z"), ("b", 4, True, ""), ("c", 5, False, ""), ("d", 6, False, "unasked")],
                                "key string, sequence long, tombstone boolean, value string")
    keys = spark.createDataFrame([(k,) for k in ["a", "a", "a", "b", "c", "none", "none"] + ["c"] * 10], "key string")
    want = sorted(map(str, reads.multi_get(log, keys).collect()))
    monkeypatch.setattr(reads, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(reads, "REPEATS", 4)
    assert sorted(map(str, reads.multi_get(log, keys).collect())) == want and len(want) == 17


def test_a_stream_fills_a_store(spark, tmp_path):
    from tidemark.streaming import ingest

    path, rows = f"file://{tmp_path}/s", [("a", 1, False, "x" * 30), ("b", 2, False, "y"), ("a", 5, True, ""), ("c", 6, False, "z" * 40)]
    for r in rows[:3]:
        spark.createDataFrame([r], "key string, sequence long, tombstone boolean, value string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = Store(spark, path, Options(30, 10, 4))
    ingest.to_store(ingest.changes(spark, str(tmp_path / "in"), 1), s, str(tmp_path / "c")).awaitTermination()
    assert s.state["streams"] == {"stream": 2} and s.state["generations"] and s.get("b") == "y"
    spark.createDataFrame(rows[3:], "key string, sequence long, tombstone boolean, value string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    again = Store(spark, path, Options(30, 10, 4))  # restarted from the checkpoint: only the new file comes
    ingest.to_store(ingest.changes(spark, str(tmp_path / "in"), 1), again, str(tmp_path / "c")).awaitTermination()
    assert again.state["streams"] == {"stream": 3} and again.state["sequence"] == 4 and again.get("c") == "z" * 40
    # a batch whose acknowledgement the checkpoint lost comes again and changes nothing
    import shutil

    shutil.rmtree(tmp_path / "c")
    ingest.to_store(ingest.changes(spark, str(tmp_path / "in"), 1), again, str(tmp_path / "c")).awaitTermination()
    assert again.state["sequence"] == 4


def test_a_killed_writer_loses_nothing_acknowledged(spark, tmp_path):
    """Rounds of a process that is killed while it writes; what it printed as acknowledged is there."""
    import os
    import signal
    import subprocess
    import sys
    import time

    code = f"""
import sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
from tidemark import Options
from tidemark.plans.store import Store
s = Store(spark, "file://{tmp_path}/s", Options(60, 10, 3))
while True:
    n = s.state["sequence"] + 1
    s.put(f"crash-key-{{n}}", f"crash-value-{{n}}")
    print(f"ACK {{n}}", flush=True)
"""
    acked: set[int] = set()
    for wait in (3, 5):
        with open(tmp_path / "out", "w") as out:
            p = subprocess.Popen([sys.executable, "-c", code], stdout=out, stderr=subprocess.DEVNULL, start_new_session=True)
        began = time.time()
        while time.time() - began < 90 and (tmp_path / "out").read_text().count("ACK") < wait:
            time.sleep(0.3)
        os.killpg(p.pid, signal.SIGKILL)
        p.wait()
        acked |= {int(line.split()[1]) for line in (tmp_path / "out").read_text().splitlines() if line.startswith("ACK")}
        s = Store(spark, f"file://{tmp_path}/s", Options(60, 10, 3))
        s.check()
        held = {r["key"]: r["value"] for r in s.scan().collect()}
        assert {n for n in acked if held.get(f"crash-key-{n}") != f"crash-value-{n}"} == set() and s.state["sequence"] >= max(acked)
    assert len(acked) >= 8
