"""Ranks and carries along a sort order without one task for a whole group.

An order is cut at bounds taken from a sample by hash, so a row's slice depends on
its value alone, whatever the partitioning, and plans may be evaluated again.
Windows run within a slice; what crosses slices are sums and maxima of small tables
with a row for each group and slice.  Frames that Spark estimates at SLICE_BYTES or
less are one slice.
"""
from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_BYTES = 64 << 20
SLICES = 10_000  # at most: the bounds are driver data
SAMPLE = 20  # values a slice that bounds are chosen from, about


def estimated_bytes(df: DataFrame) -> int:
    """Spark's own estimate from the plan; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def bounds(df: DataFrame, column: str) -> list:
    """Values at which a column's order is cut into slices of SLICE_BYTES about; none for a small frame."""
    size = estimated_bytes(df)
    if size <= SLICE_BYTES:
        return []
    return cuts_at(df, column, min(SLICES, size // SLICE_BYTES + 1), df.count())


def cuts_at(df: DataFrame, column: str, slices: int, n: int) -> list:
    """Values at which a column's order is cut into so many slices about, for a frame of n rows."""
    if slices < 2:
        return []
    share = min(1.0, SAMPLE * slices / max(1, n))
    picked = df.where(F.col(column).isNotNull() & (F.pmod(F.xxhash64(column), F.lit(1_000_000)) <= int(share * 1_000_000)))
    rows = picked.groupBy(column).count().orderBy(column).collect()
    total, out, at = sum(r["count"] for r in rows), [], 0
    for r in rows:
        if at >= (len(out) + 1) * total / slices:
            out.append(r[column])
        at += r["count"]
    return out


def slice_of(df: DataFrame, column: str, cuts: list) -> Column:
    """The number of cuts that are not above the value, by binary search in one literal."""
    if not cuts:
        return F.lit(0)
    kind = df.schema[column].dataType.simpleString()
    table = F.from_json(F.lit(json.dumps(cuts)), f"array<{kind}>")
    steps = [1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)]

    def take(lo: Column, step: Column) -> Column:
        return F.when((lo + step <= len(cuts)) & (F.element_at(table, F.least(lo + step, F.lit(len(cuts)))) <= F.col(column)), lo + step).otherwise(lo)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), take)


def before(parts: DataFrame, group: str, value: str, slice_: str = "_slice") -> DataFrame:
    """Add _before: the sum of `value` over a group's earlier slices.  parts has a row for each group and slice."""
    earlier = Window.partitionBy(group).orderBy(slice_).rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("_before", F.coalesce(F.sum(value).over(earlier), F.lit(0)))


def ranked(df: DataFrame, group: str, column: str, to: str) -> DataFrame:
    """Add the rank from 0 of each row in its group, by a column's order."""
    cuts = bounds(df.select(group, column), column)
    cut = df.withColumn("_slice", slice_of(df, column, cuts))
    at = F.row_number().over(Window.partitionBy(group, "_slice").orderBy(column)) - 1
    if not cuts:
        return cut.withColumn(to, at.cast("long")).drop("_slice")
    sizes = before(cut.groupBy(group, "_slice").agg(F.count("*").alias("_n")), group, "_n").select(F.col(group).alias("_g"), F.col("_slice").alias("_s"), "_before")
    tied = cut.withColumn("_at", at).join(sizes, (F.col(group).eqNullSafe(F.col("_g"))) & (F.col("_slice") == F.col("_s")))
    return tied.withColumn(to, (F.col("_before") + F.col("_at")).cast("long")).drop("_slice", "_at", "_g", "_s", "_before")
