"""A store: staged log batches, generations as sorted Parquet, a manifest as the commit point.

Layout below the store's path, on any Hadoop file system:
  log/<n>-<token>    a committed batch of mutations with sequences
  gen/<g>-<token>    a generation: one version a key, range-dealt and sorted by key
  manifest/<n>.json  what is live; the highest complete number counts

New data is written first, then a manifest that names it, with the number of its
files, their bytes, rows and a digest of names and lengths.  Opening refuses a
folder whose listing differs; Parquet pages carry checksums that reads verify, and
check() reads everything and compares rows, key order and sequences.  What a commit
replaces is kept for `retain_seconds`, so readers that hold an older manifest go on;
later commits delete it.  A crash leaves folders no manifest names; they are ignored
and removed by the next commit.  A manifest is created under its own name and never
over another one, and folders have a token of their writer's commit, so of two
writers one is refused and harms nothing.
"""
from __future__ import annotations

import hashlib
import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bloom
from ..model import BLOCK_BYTES, MUTATION, CorruptStore, InvalidArgument, Options, check_key, check_value
from ..operators import layout, mutate, reads, reconcile

KEY_BUCKET_BYTES = 128 << 20  # of a generation's part files, about
RETAIN_SECONDS = 3600.0
COUNTERS = ("bloom_checks", "bloom_negative_hits", "sstable_reads", "sstable_bytes_read")


class Files:
    """The few file operations the manifest needs."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf, self.root = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), root.rstrip("/")

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def fs(self):
        return self.path("x").getFileSystem(self.conf)

    def names(self, folder: str) -> list[str]:
        p = self.path(folder)
        return sorted(s.getPath().getName() for s in self.fs().listStatus(p)) if self.fs().exists(p) else []

    def read(self, name: str) -> str:
        stream = self.fs().open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Create a file of this name, or refuse if there is one: the file system's own exclusive create.

        A crash while writing leaves a file that is no JSON; readers pass over it.
        """
        try:
            out = self.fs().create(self.path(name), False)
        except Py4JJavaError as e:
            raise CorruptStore(f"another writer committed {name}") from e
        out.write(bytearray(text.encode()))
        out.close()

    def listing(self, folder: str) -> dict:
        """files, bytes and a digest of the names and lengths of a folder's data files."""
        p = self.path(folder)
        found = self.fs().listStatus(p) if self.fs().exists(p) else []
        rows = sorted((s.getPath().getName(), s.getLen()) for s in found)
        rows = [r for r in rows if not r[0].startswith(("_", "."))]
        return {"files": len(rows), "bytes": sum(n for _, n in rows), "digest": hashlib.sha256(json.dumps(rows).encode()).hexdigest()}

    def delete(self, name: str) -> None:
        self.fs().delete(self.path(name), True)


class Store:
    """One writer; any number of readers."""

    def __init__(self, spark: SparkSession, path: str, options: Options | None = None, retain_seconds: float = RETAIN_SECONDS):
        self.spark, self.options, self.files, self.retain = spark, options or Options(), Files(spark, path), retain_seconds
        self.path = path.rstrip("/")
        #: Called with a step's name between the steps of a commit; tests stop there.
        self.fault = lambda step: None
        self.counters = dict.fromkeys(COUNTERS, 0)
        self.state = {"version": 0, "sequence": 0, "next_generation": 1, "next_batch": 1, "generations": [], "batches": [], "folders": {}, "staged_bytes": 0, "retired": []}
        found = [n for n in self.files.names("manifest") if n.endswith(".json")]
        for name in reversed(found):
            try:
                self.state = json.loads(self.files.read(f"manifest/{name}"))
                break
            except ValueError as e:  # a torn one was never acknowledged
                if name == found[0]:
                    raise CorruptStore(f"no manifest of {found} can be read") from e
        if found:
            self._verify()

    def live(self) -> list[str]:
        return [f"gen/{g}" for g in self.state["generations"]] + [f"log/{b}" for b in self.state["batches"]]

    def _verify(self) -> None:
        """Refuse folders that lack files, have others, or files of other lengths."""
        for folder in self.live():
            noted = self.state["folders"].get(folder)
            found = self.files.listing(noted["name"]) if noted else {}
            if noted is None or any(noted[k] != found[k] for k in found):
                raise CorruptStore(f"{folder} should be {noted}, but is {found}")

    def check(self) -> None:
        """Read all live folders; refuse rows that are missing, out of order or newer than the manifest."""
        self._verify()
        for folder in self.live():
            rows = self._table([folder])
            try:  # all columns are read, so that every page is verified
                n, top, _ = rows.agg(F.count("*"), F.max("sequence"), F.max(F.xxhash64(*MUTATION.names))).head()
            except (PySparkException, Py4JJavaError) as e:
                raise CorruptStore(f"{folder} cannot be read") from e
            if n != self.state["folders"][folder]["rows"] or (top or 0) > self.state["sequence"]:
                raise CorruptStore(f"{folder} has {n} rows up to sequence {top}")
            if folder.startswith("gen/") and rows.groupBy("key").count().where("count > 1").limit(1).count():
                raise CorruptStore(f"{folder} holds a key twice")

    # --- commits

    def _noted(self, folder: str, name: str, rows: int) -> dict:
        return self.state["folders"] | {folder: self.files.listing(name) | {"rows": rows, "name": name}}

    def _commit(self, **change) -> None:
        state = self.state | change | {"version": self.state["version"] + 1}
        now, keep = time.time(), {f"gen/{g}" for g in state["generations"]} | {f"log/{b}" for b in state["batches"]}
        gone = [[v["name"], now] for f, v in state["folders"].items() if f not in keep]
        state["folders"] = {f: v for f, v in state["folders"].items() if f in keep}
        state["retired"] = [r for r in state["retired"] if now - r[1] < self.retain] + (gone if self.retain > 0 else [])
        keep = {v["name"] for v in state["folders"].values()} | {r[0] for r in state["retired"]}
        self.fault("manifest")
        self.files.write(f"manifest/{state['version']:020d}.json", json.dumps(state))
        self.state = state
        self.fault("delete")
        for kind in ("gen", "log"):
            for name in self.files.names(kind):
                if f"{kind}/{name}" not in keep:
                    self.files.delete(f"{kind}/{name}")
        for name in self.files.names("manifest")[:-2]:
            self.files.delete(f"manifest/{name}")

    # --- mutations

    def put(self, key, value) -> None:
        check_key(key)
        check_value(value)
        self.apply(self.spark.createDataFrame([(key, value, False)], "key string, value string, tombstone boolean"))

    def erase(self, key) -> None:
        check_key(key)
        self.apply(self.spark.createDataFrame([(key, "", True)], "key string, value string, tombstone boolean"))

    def put_many(self, rows: DataFrame, *order) -> None:
        self.apply(mutate.puts(rows), *order)

    def erase_many(self, keys: DataFrame, *order) -> None:
        self.apply(mutate.erases(keys), *order)

    def apply(self, mutations: DataFrame, *order, **also) -> None:
        """Append key, value, tombstone rows in a stated order (by key if none is), then flush if the log is full.

        A batch that breaks a limit changes nothing.  The manifest is the
        acknowledgement; `also` is noted in it, such as the position of a stream.
        """
        held: list[DataFrame] = []
        numbered = mutate.numbered(mutate.checked(mutations), self.state["sequence"], *(order or ("key",)), held=held).select(*MUTATION.names)
        batch = self.state["next_batch"]
        name = f"log/{batch}-{uuid.uuid4().hex[:12]}"
        self.fault("log")
        try:
            numbered.write.option("parquet.page.write-checksum.enabled", "true").parquet(f"{self.path}/{name}")
        finally:
            for df in held:
                df.unpersist()
        rows, top, size = self._read([name]).agg(F.count("*"), F.max("sequence"), F.sum(mutate.payload())).head()
        if top is None:
            self.files.delete(name)
            if also:
                self._commit(**also)
            return
        # the bytes of all staged versions bound those of the current ones: these are only counted once the bound is passed
        self._commit(sequence=top, next_batch=batch + 1, batches=[*self.state["batches"], batch], folders=self._noted(f"log/{batch}", name, rows), staged_bytes=self.state["staged_bytes"] + size, **also)
        if self.state["staged_bytes"] >= self.options.memtable_bytes:
            current = self.memtable().head()["bytes"]
            if current >= self.options.memtable_bytes:
                self.flush()
            else:
                self.state["staged_bytes"] = current

    # --- physical state

    def _read(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], MUTATION)
        return self.spark.read.schema(MUTATION).option("parquet.page.verify-checksum.enabled", "true").parquet(*[f"{self.path}/{f}" for f in names])

    def _table(self, folders: list[str]) -> DataFrame:
        return self._read([self.state["folders"][f]["name"] for f in folders])

    def staged(self) -> DataFrame:
        return self._table([f"log/{b}" for b in self.state["batches"]])

    def memtable(self) -> DataFrame:
        """entries, bytes of the staged versions."""
        return mutate.memtable_bytes(self.staged())

    def generation(self, g: int) -> DataFrame:
        return self._table([f"gen/{g}"])

    def log(self) -> DataFrame:
        """All versions: every generation and the staged batches.  Never filtered by tombstone here."""
        return self._table(self.live())

    def _write(self, versions: DataFrame, g: int, bytes_in: int) -> dict:
        """Write a generation; the folders to note in the manifest."""
        parts, name = max(1, bytes_in // KEY_BUCKET_BYTES), f"gen/{g}-{uuid.uuid4().hex[:12]}"
        self.fault("table")
        (versions.repartitionByRange(int(parts), "key").sortWithinPartitions("key").write.option("parquet.bloom.filter.enabled#key", "true")
         .option("parquet.block.size", 8 << 20).option("parquet.page.write-checksum.enabled", "true").parquet(f"{self.path}/{name}"))
        return self._noted(f"gen/{g}", name, self._read([name]).count())

    def flush(self) -> None:
        """Staged batches become a generation; nothing staged, nothing done.  Only a flush looks at the trigger."""
        if not self.state["batches"]:
            return
        g, size = self.state["next_generation"], sum(self.state["folders"][f"log/{b}"]["bytes"] for b in self.state["batches"])
        folders = self._write(reconcile.latest_wins(self.staged()), g, size)
        self._commit(next_generation=g + 1, generations=[*self.state["generations"], g], batches=[], folders=folders, staged_bytes=0)
        if len(self.state["generations"]) >= self.options.compaction_trigger:
            self.compact()

    def compact(self) -> None:
        """All generations become one of the next number, tombstones kept; the log stays.  Fewer than two: nothing done."""
        old = self.state["generations"]
        if len(old) < 2:
            return
        g = self.state["next_generation"]
        merged = reconcile.latest_wins(self._table([f"gen/{x}" for x in old]))
        folders = self._write(merged, g, sum(self.state["folders"][f"gen/{x}"]["bytes"] for x in old))
        self._commit(next_generation=g + 1, generations=[g], folders=folders)

    # --- reads

    def view(self) -> DataFrame:
        return reconcile.view(self.log())

    def get(self, key) -> str | None:
        row = reads.get(self.log(), key).head()
        return None if row is None else row["value"]

    def multi_get(self, keys: DataFrame) -> DataFrame:
        return reads.multi_get(self.log(), keys)

    def scan(self, begin="", end="") -> DataFrame:
        return reads.scan(self.log(), begin, end)

    def scan_from(self, begin) -> DataFrame:
        return reads.scan_from(self.log(), begin)

    def scan_prefix(self, prefix: str) -> DataFrame:
        return reads.scan_prefix(self.log(), prefix)

    def read_counted(self, keys: DataFrame) -> DataFrame:
        """multi_get() that counts as it goes: adds to the counters what the filters of the generations say of the keys."""
        asked = keys.select("key").distinct()
        generations = [(g, self.state["folders"][f"gen/{g}"]["bytes"]) for g in self.state["generations"]]
        if generations:
            entries = None
            for g, _ in generations:
                part = self.generation(g).select(F.lit(g).cast("long").alias("generation"), "key")
                entries = part if entries is None else entries.unionByName(part)
            staged = self.staged().select("key").distinct()
            found = bloom.membership(asked.join(staged, "key", "left_anti"), bloom.filter_bytes(entries, self.options.bloom_bits_per_key))
            # the newest generation is asked first; a key held there goes no further
            held = entries.groupBy("key").agg(F.max("generation").alias("_at"))
            seen = found.join(held, "key", "left").where(F.col("_at").isNull() | (F.col("generation") >= F.col("_at")))
            checks, passed = seen.agg(F.count("*"), F.count_if("maybe")).head()
            records, = self._table([f"gen/{g}" for g, _ in generations]).agg(F.sum(mutate.payload())).head()
            rows = sum(self.state["folders"][f"gen/{g}"]["rows"] for g, _ in generations)
            self.counters["bloom_checks"] += checks
            self.counters["bloom_negative_hits"] += checks - passed
            self.counters["sstable_reads"] += passed
            self.counters["sstable_bytes_read"] += passed * min(BLOCK_BYTES, (records or 0) // max(1, rows) + 20)
        return self.multi_get(keys)

    def metadata_bytes(self) -> int:
        """Header, filter and sparse index of the generations, as the interchange format would hold them."""
        total = 0
        for g in self.state["generations"]:
            row = layout.sizes(layout.pack_blocks(self.generation(g).withColumn("generation", F.lit(g).cast("long"))), self.options.bloom_bits_per_key).head()
            total += row["metadata_bytes"] if row else 0
        return total

    def stats(self) -> DataFrame:
        """memtable_entries, memtable_bytes, sstable_count, sequence, disk_bytes, table_metadata_bytes, and the counters of read_counted()."""
        disk = sum(self.state["folders"][f"gen/{g}"]["bytes"] for g in self.state["generations"])
        known = {"sstable_count": len(self.state["generations"]), "sequence": self.state["sequence"], "disk_bytes": disk, "table_metadata_bytes": self.metadata_bytes()} | self.counters
        return self.memtable().select(
            F.col("entries").alias("memtable_entries"), F.col("bytes").alias("memtable_bytes"), *[F.lit(v).cast("long").alias(k) for k, v in known.items()])

    def writer(self, batch_bytes: int | None = None) -> Writer:
        """A buffer for single puts and erases, committed as one batch when it is full, on flush() and on leaving `with`."""
        return Writer(self, batch_bytes or self.options.memtable_bytes)


class Writer:
    """Single mutations, acknowledged by flush(): until then they are in this process only."""

    def __init__(self, store: Store, batch_bytes: int):
        self.store, self.limit, self.rows, self.size = store, batch_bytes, [], 0

    def put(self, key: str, value: str) -> None:
        check_key(key)
        check_value(value)
        self._add(key, value, False)

    def erase(self, key: str) -> None:
        check_key(key)
        self._add(key, "", True)

    def _add(self, key: str, value: str, dead: bool) -> None:
        self.rows.append((key, value, dead, len(self.rows)))
        self.size += len(key.encode()) + len(value.encode())
        if self.size >= self.limit:
            self.flush()

    def flush(self) -> None:
        if self.rows:
            rows, self.rows, self.size = self.rows, [], 0
            self.store.apply(self.store.spark.createDataFrame(rows, "key string, value string, tombstone boolean, _n long"), "_n")

    def __enter__(self) -> Writer:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.flush()


def open_store(spark: SparkSession, path: str, options: Options | None = None) -> Store:
    if not path:
        raise InvalidArgument("a store needs a path")
    return Store(spark, path, options)
