"""Report summaries, series and comparison."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import percent_change, report_name, size_label

#: The metrics that two runs are compared by, as paths in a report.
COMPARED = (
    "total_ops_per_second", "write_ops_per_second", "read_ops_per_second", "read_latency_us.p50", "read_latency_us.p95", "read_latency_us.p99",
    "sstable_bytes_read", "table_metadata_bytes", "database_size_bytes", "file_count",
)
SUMMARY = ("total_ops_per_second", "write_latency_us.p99", "read_latency_us.p99", "read_hit_rate", "sstable_count", "bloom_checks", "bloom_negative_hits",
           "sstable_reads", "sstable_bytes_read", "database_size_bytes")


def metric(path: str) -> Column:
    """A nested result as double; a missing one is 0."""
    return F.coalesce(F.col(f"results.{path}").cast("double"), F.lit(0.0))


def alias(path: str) -> str:
    return path.replace(".", "_")


def named(reports: DataFrame) -> DataFrame:
    """Reports whose file name states a run, with its parts; others are left out."""
    workload, dimension, raw, value = report_name(F.col("file_name"))
    parts = reports.select("*", workload.alias("run"), dimension.alias("dimension"), raw.alias("raw"), value.alias("value"))
    return parts.where(F.col("run").isNotNull())


def summary(reports: DataFrame, workload: str | None = None) -> DataFrame:
    """run, dimension, value, label and the summary metrics, in order of run, dimension and value."""
    rows = named(reports)
    if workload is not None:
        rows = rows.where(F.col("run") == workload)
    metrics = [metric(p).alias(alias(p)) for p in SUMMARY]
    return rows.select("run", "dimension", "value", size_label(F.col("value")).alias("label"), *metrics).orderBy("run", "dimension", "value")


def series(reports: DataFrame, path: str) -> DataFrame:
    """One metric along each swept option."""
    return named(reports).select("run", "dimension", "value", metric(path).alias("metric")).orderBy("run", "dimension", "value")


def long_form(reports: DataFrame, value: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(p).alias("metric"), metric(p).alias(value)) for p in COMPARED])
    return reports.select("file_name", F.explode(pairs).alias("_m")).select("file_name", "_m.metric", f"_m.{value}")


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """file_name, metric, old, new, change for the reports that both sides have."""
    both = long_form(old, "old").join(long_form(new, "new"), ["file_name", "metric"])
    return both.withColumn("change", percent_change(F.col("old"), F.col("new")))


def high_water(rounds: DataFrame, metrics: list[str]) -> DataFrame:
    """The highest value of each metric over all rounds."""
    return rounds.agg(*[F.max(m).alias(m) for m in metrics])
