"""Shared helpers: table access, the shared scratch folder, worker state, Arrow row mapping."""
from __future__ import annotations

import contextlib
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SLICE_BYTES = 4 << 20  # of an Arrow batch that a function gets at a time, but for a larger row
MARK_WORDS = 1 << 18  # 64-bit words that stand for ids, at most
_scopes: list[list[str]] = []  # the driver's open scopes, each with the scratch paths made in it
_held: dict = {}  # a worker's state: one entry


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a local one only where that is unset and the master is local."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tidemark-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path for a written table below the shared folder."""
    path = f"{shared_root(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    for paths in _scopes:
        paths.append(path)
    return path


def saved(df: DataFrame, what: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop_saved(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables that saved() wrote."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            remove(spark, folder)


def free(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now, not when the driver next happens to collect its garbage."""
    import gc

    for _ in range(2):  # what the first pass releases names more in the second
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.1)


@contextlib.contextmanager
def scope(spark: SparkSession, keep: tuple[str, ...] = ()):
    """Deletes the scratch tables made inside when it ends, but for those whose name begins with one of `keep`.

    Results are evaluated late, so what is to outlive a scope is saved in it under a kept name.
    """
    paths: list[str] = []
    _scopes.append(paths)
    try:
        yield
    finally:
        _scopes.remove(paths)
        for path in paths:
            if not path.rpartition("/")[2].startswith(keep or ("\0",)):
                remove(spark, path)


def trim() -> None:
    """Give freed memory of a worker back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def resident(name, make):
    """What make() gives, kept by this worker process until another name is asked for: a reused worker holds one state only."""
    if name not in _held:
        _held.clear()
        trim()
        _held[name] = make()
    return _held[name]


class Shared:
    """A value that workers get by broadcast, and what they make of it."""

    def __init__(self, spark: SparkSession, value):
        self.name, self.broadcast = uuid.uuid4().hex, spark.sparkContext.broadcast(value)

    def get(self, make=lambda value: value):
        return resident(self.name, lambda: make(self.broadcast.value))


def slices(batch, size: int = SLICE_BYTES):
    """A batch in slices of so many bytes about."""
    rows = max(1, batch.num_rows * size // max(size, batch.nbytes))
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def text_docs(docs: DataFrame) -> DataFrame:
    """doc_id and text alone; a null text counts as empty."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def unused(df: DataFrame, name: str) -> str:
    """A column name like this one that df has not, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def marked(df: DataFrame, column: str, ids: DataFrame, mark: str) -> DataFrame:
    """df with a boolean column: true where the number in a column is one of the ids (a saved table's only column), and for few others.

    So rows that surely have no partner need not be moved to be joined.  What is sent
    is a bit for each id's hash, of 32 an id about but 64 * MARK_WORDS at most; with
    more than some million ids more others are marked, in the end all.
    """
    words = max(1, min(MARK_WORDS, ids.count() // 2))
    word, bits = unused(df, "_word"), unused(df, "_bits")

    def place(value):
        return F.pmod(F.xxhash64(value.cast("long"), F.lit("mark")), F.lit(64 * words))

    def bit(value):  # shiftleft takes no column of shifts
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place(value), F.lit(64)).cast("int"))

    own, value = F.col(ids.columns[0]), df[column]
    table = ids.select(F.shiftright(place(own), 6).alias(word), bit(own).alias(bits)).groupBy(word).agg(F.bit_or(bits).alias(bits))
    both = df.join(F.broadcast(table), F.shiftright(place(value), 6) == F.col(word), "left")
    return both.withColumn(mark, F.coalesce(F.col(bits).bitwiseAND(bit(value)) != 0, F.lit(False))).drop(word, bits)


def map_rows(df: DataFrame, fn, schema: str, size: int = SLICE_BYTES) -> DataFrame:
    """fn(list of column lists) -> dict of lists, for each slice of `size` bytes about of each Arrow batch."""
    from pyspark.sql.types import _parse_datatype_string

    kinds = _parse_datatype_string(schema)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(kinds)
        for whole in batches:
            for b in slices(whole, size):
                got = fn([c.to_pylist() for c in b.columns])
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in out], schema=out)
        trim()

    return df.mapInArrow(run, schema)


def extend(df: DataFrame, column: str, fn, schema: str) -> DataFrame:
    """All columns of df and those of schema, made from one column's values; a clashing name is replaced."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    added = _parse_datatype_string(schema)
    kept = [f for f in df.schema if f.name not in added.names]
    whole = StructType(kept + list(added))
    names = [f.name for f in kept]

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(whole)
        for large in batches:
            for b in slices(large):
                got = fn(b.column(b.schema.get_field_index(column)).to_pylist())
                arrays = [b.column(b.schema.get_field_index(n)).cast(out.field(n).type) for n in names]
                arrays += [pa.array(got[n], out.field(n).type) for n in added.names]
                yield pa.RecordBatch.from_arrays(arrays, schema=out)
        trim()

    return df.mapInArrow(run, whole)
