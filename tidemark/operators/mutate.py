"""Mutations: limits, sequences, memtable accounting."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import MAX_KEY_BYTES, MAX_VALUE_BYTES
from .reconcile import latest_wins


def verdict(key: Column, value: Column) -> Column:
    """ok, empty_key, long_key or long_value, in the order in which a mutation is refused."""
    return (
        F.when(key.isNull() | (F.octet_length(key) == 0), "empty_key").when(F.octet_length(key) > MAX_KEY_BYTES, "long_key")
        .when(F.octet_length(value) > MAX_VALUE_BYTES, "long_value").otherwise("ok")
    )


def checked(mutations: DataFrame) -> DataFrame:
    """Fail the job at the first row that breaks a limit."""
    v = verdict(F.col("key"), F.col("value"))
    refuse = F.raise_error(F.concat(F.lit("invalid mutation: "), v))
    return mutations.withColumn("key", F.when(v == "ok", F.col("key")).otherwise(refuse))


def puts(rows: DataFrame) -> DataFrame:
    """key, value as puts; other columns stay to order by."""
    return rows.withColumn("tombstone", F.lit(False)).withColumn("value", F.coalesce("value", F.lit("")))


def erases(keys: DataFrame) -> DataFrame:
    """Blind deletes: no look at what is there."""
    return keys.withColumn("tombstone", F.lit(True)).withColumn("value", F.lit(""))


def numbered(arrivals: DataFrame, base: int, *order, held: list | None = None) -> DataFrame:
    """Give sequences base + 1, base + 2, ... in the stated order.

    Rows are sorted by range, numbered within their partition, and shifted by the
    sizes of the partitions before, so no task sees all rows.  The driver holds
    one count for each partition.  The sorted rows are persisted; `held` gets the
    frame to unpersist once the result is written.
    """
    spark = arrivals.sparkSession
    placed = arrivals.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    placed = placed.persist()  # the numbering and the counts must see the same partitions
    if held is not None:
        held.append(placed)
    shift, before = [], base
    for r in placed.groupBy("_part").count().orderBy("_part").collect():
        shift.append((r["_part"], before))
        before += r["count"]
    offsets = spark.createDataFrame(shift, "_part int, _before long")
    # one row for each partition
    return placed.join(F.broadcast(offsets), "_part").withColumn("sequence", F.col("_before") + F.col("_row") + 1).drop("_part", "_row", "_before")


def payload() -> Column:
    return (F.octet_length("key") + F.octet_length("value")).cast("long")


def memtable_bytes(log: DataFrame, *by: str) -> DataFrame:
    """Bytes of the current versions (an overwrite counts once), for each group of `by`."""
    if by:
        order = Window.partitionBy(*by, "key").orderBy(F.desc("sequence"))
        newest = log.withColumn("_n", F.row_number().over(order)).where("_n = 1")
        return newest.groupBy(*by).agg(F.count("*").alias("entries"), F.sum(payload()).alias("bytes"))
    return latest_wins(log).agg(F.count("*").alias("entries"), F.coalesce(F.sum(payload()), F.lit(0)).alias("bytes"))
