"""Latency percentiles and rates."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nearest_rank(value: str, percent: float) -> Column:
    """sorted[ceil(p/100 * n) - 1]; 0 of no samples."""
    if not 0 <= percent <= 100:
        raise ValueError("percent is 0 to 100")
    return F.expr(f"coalesce(percentile_disc({percent / 100.0!r}) within group (order by `{value}`), 0)")


def floor_index(samples: DataFrame, by: str, value: str, shares: list[float]) -> DataFrame:
    """sorted[floor(p * (n - 1))] for each group: columns p<100p>.

    Ranks come slice by slice of the values and are compared with the group's size,
    so no group is gathered into an array or into one task.
    """
    from ..operators.ranges import ranked

    sizes = samples.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("_n"))
    placed = ranked(samples.select(by, value), by, value, "_k").join(sizes, F.col(by).eqNullSafe(F.col("_by")))
    picks = [F.max(F.when(F.col("_k") == F.floor(F.lit(p) * (F.col("_n") - 1)), F.col(value))).alias(f"p{round(p * 100)}") for p in shares]
    return placed.groupBy(by).agg(F.max("_n").alias("samples"), *picks)


def rate(count: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, count / seconds).otherwise(F.lit(0.0))


def hit_rate(found: Column) -> Column:
    """Share of reads that found something; 0 without reads."""
    return F.coalesce(F.avg(found.cast("int")), F.lit(0.0))
