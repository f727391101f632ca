"""Integrity and comparison: valid prefixes, table order, acknowledged writes."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLICE_ROWS = 1 << 20  # positions of a slice


def valid_prefix(records: DataFrame, source: str, position: str, valid: str) -> DataFrame:
    """The records of each source before its first invalid one.

    The first bad position of a source is a partial aggregate, joined back: no
    source has to fit a task.
    """
    bad = records.where(~F.col(valid)).groupBy(source).agg(F.min(position).alias("_stop"))
    return records.join(bad, source, "left").where(F.col("_stop").isNull() | (F.col(position) < F.col("_stop"))).drop("_stop")


def table_integrity(entries: DataFrame) -> DataFrame:
    """For each generation: entries, highest sequence, and whether keys rise strictly by position.

    Neighbours are compared within slices of SLICE_ROWS positions, and the last key
    of a slice with the first of the next.
    """
    cut = entries.withColumn("_slice", F.floor(F.col("position") / SLICE_ROWS))
    before = F.lag("key").over(Window.partitionBy("generation", "_slice").orderBy("position"))
    marked = cut.withColumn("_rises", F.coalesce(before < F.col("key"), F.lit(True)))
    parts = marked.groupBy("generation", "_slice").agg(
        F.count("*").alias("entries"), F.max("sequence").alias("max_sequence"), F.count_if(~F.col("_rises")).alias("_falls"),
        F.min_by("key", "position").alias("_first"), F.max_by("key", "position").alias("_last"))
    last = F.lag("_last").over(Window.partitionBy("generation").orderBy("_slice"))  # a row for each slice
    falls = F.col("_falls") + F.coalesce((last >= F.col("_first")).cast("int"), F.lit(0))
    whole = parts.withColumn("_all", falls).groupBy("generation").agg(F.sum("entries").alias("entries"), F.max("max_sequence").alias("max_sequence"), F.sum("_all").alias("out_of_order"))
    return whole.withColumn("ordered", F.col("out_of_order") == 0)


def lost_writes(oracle: DataFrame, view: DataFrame) -> DataFrame:
    """Acknowledged rows (key, value) that the view lacks or holds otherwise: key, expected, actual."""
    held = view.select("key", F.col("value").alias("actual"))
    return oracle.select("key", F.col("value").alias("expected")).join(held, "key", "left").where(~F.col("expected").eqNullSafe(F.col("actual")))


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Keys whose value differs between two views, deletions included: key, left_value, right_value."""
    a = left.select("key", F.col("value").alias("left_value"), F.lit(True).alias("_l"))
    b = right.select("key", F.col("value").alias("right_value"), F.lit(True).alias("_r"))
    both = a.join(b, "key", "full")
    return both.where(~(F.col("left_value").eqNullSafe(F.col("right_value")) & F.col("_l").eqNullSafe(F.col("_r")))).drop("_l", "_r")
