"""Reconciling versions: the newest of each key wins, tombstones included.

Tombstones are hidden after reconciliation only; key predicates may stand on
either side, since the key is the grouping key and Catalyst pushes them to the scan.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_wins(log: DataFrame) -> DataFrame:
    """One row for each key: its version of the highest sequence.

    Partial aggregation keeps one version a key and task before the shuffle, so
    a hot key costs no more than any other.
    """
    others = [c for c in log.columns if c not in ("key", "sequence")]
    newest = F.max_by(F.struct("sequence", *others), "sequence")
    return log.groupBy("key").agg(newest.alias("_v")).select("key", "_v.sequence", *[F.col(f"_v.`{c}`") for c in others])


def newest_generation_wins(log: DataFrame) -> DataFrame:
    """The first version from the newest generation down, as a layered lookup finds it; exact on ties of sequence."""
    order = Window.partitionBy("key").orderBy(F.desc("generation"), F.desc("sequence"))
    return log.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def live(versions: DataFrame) -> DataFrame:
    """Drop tombstones and show keys and values; for reconciled versions only."""
    return versions.where(~F.col("tombstone")).select("key", "value")


def view(log: DataFrame) -> DataFrame:
    return live(latest_wins(log))


def merge(*generations: DataFrame) -> DataFrame:
    """Compaction: the newest version of each key of all generations.  Tombstones stay."""
    whole = generations[0]
    for g in generations[1:]:
        whole = whole.unionByName(g)
    return latest_wins(whole)


def census(versions: DataFrame) -> DataFrame:
    """Live keys and tombstones of reconciled versions."""
    return versions.agg(F.count_if(~F.col("tombstone")).alias("live"), F.count_if("tombstone").alias("dead"), F.count("*").alias("entries"))


def as_of(log: DataFrame, sequence: int) -> DataFrame:
    """The view as it stood after a sequence (an extension)."""
    return view(log.where(F.col("sequence") <= sequence))
