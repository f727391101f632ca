"""Streaming ingest: a changelog stream kept as generations, or as keyed state.

Versions carry their sequence, so applying them is idempotent and order does not
matter: no watermark is needed, and a late version never replaces a newer one.
"""
from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import MUTATION
from ..operators.reconcile import latest_wins


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a local one only where none is named and the master is local."""
    import tempfile

    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tidemark-")
    return root.rstrip("/")


def changes(spark: SparkSession, path: str, files_a_batch: int | None = None) -> DataFrame:
    """New Parquet files of mutations below a path."""
    reader = spark.readStream.schema(MUTATION)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    return reader.parquet(path)


def to_generations(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch becomes the generation of its batch id.

    A batch run again after a failure overwrites its own generation, so the
    result is exactly-once; the batch's entry in the checkpoint acknowledges it.
    """

    def flush(batch: DataFrame, batch_id: int) -> None:
        newest = latest_wins(batch.select(*MUTATION.names))
        newest.sortWithinPartitions("key").write.mode("overwrite").parquet(f"{target}/generation={batch_id}")

    return stream.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_store(stream: DataFrame, store, checkpoint: str, name: str = "stream") -> StreamingQuery:
    """Each micro-batch is appended to a store's log, in order of `sequence`; the store flushes by size and compacts by its trigger.

    The store takes sequences of its own.  A batch run again after a failure is
    passed over: the manifest that acknowledged it names it as the stream's last.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        if store.state.get("streams", {}).get(name, -1) < batch_id:
            store.apply(batch.select("key", "value", "tombstone", "sequence"), "sequence", streams=store.state.get("streams", {}) | {name: batch_id})

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def generations(spark: SparkSession, target: str) -> DataFrame:
    """All versions of a folder that to_generations() keeps."""
    return spark.read.schema(MUTATION).option("recursiveFileLookup", "true").parquet(target)


def latest_state(stream: DataFrame) -> DataFrame:
    """The newest version of each key as a streaming aggregate (complete or update mode)."""
    newest = F.max_by(F.struct("sequence", "tombstone", "value"), "sequence")
    return stream.groupBy("key").agg(newest.alias("_v")).select("key", "_v.*")


def keyed_state(stream: DataFrame) -> DataFrame:
    """The same with explicit state for each key: emits a key whenever its newest version changes (update mode).

    State is one version a key; an equal sequence replaces, a lower one never does.
    """

    def step(key, batches: Iterator, state):
        import pandas as pd

        held = state.get if state.exists else (0, False, "")
        best = held
        for pdf in batches:
            at = pdf["sequence"].to_numpy().argmax()
            if pdf["sequence"].iloc[at] >= best[0]:
                best = (int(pdf["sequence"].iloc[at]), bool(pdf["tombstone"].iloc[at]), str(pdf["value"].iloc[at]))
        if best != held:
            state.update(best)
            yield pd.DataFrame({"key": [key[0]], "sequence": [best[0]], "tombstone": [best[1]], "value": [best[2]]})

    return stream.groupBy("key").applyInPandasWithState(
        step, "key string, sequence long, tombstone boolean, value string", "sequence long, tombstone boolean, value string", "update", "NoTimeout")
