"""Point, batched and range reads over a changelog."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import check_range
from .reconcile import latest_wins, live, view

BROADCAST_KEYS = 200_000  # requested keys up to which they are sent to the scan
REPEATS = 1 << 16


def get(log: DataFrame, key) -> DataFrame:
    """No row for a miss: a key never written, or deleted last.  Any key may be asked for, the empty one too."""
    return live(latest_wins(log.where(F.col("key") == F.lit(key))))


def lookup(log: DataFrame, key) -> DataFrame:
    """One row, key, found, value, for a hit or a miss."""
    asked = log.sparkSession.range(1).select(F.lit(key).alias("key"))
    return multi_get(log, asked)


def multi_get(log: DataFrame, keys: DataFrame) -> DataFrame:
    """key, found, value for each requested key.

    Keys are broadcast only if counting shows few of them; the log is then reduced
    to them before it is reconciled, since Catalyst leaves a semi-join above the
    aggregate.  Otherwise requests and log are one stream that is dealt by key once:
    a partial aggregate counts the requests of a key and keeps its newest version.
    """
    asked = keys.select("key")
    if asked.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        hits = live(latest_wins(log.join(F.broadcast(asked.distinct()), "key", "left_semi"))).withColumn("found", F.lit(True))
        return asked.join(hits, "key", "left").select("key", F.coalesce("found", F.lit(False)).alias("found"), "value")
    requests = asked.select("key", F.lit(1).cast("long").alias("_asked"), *[F.lit(None).cast(log.schema[c].dataType).alias(c) for c in ("sequence", "tombstone", "value")])
    both = requests.unionByName(log.select("key", F.lit(0).cast("long").alias("_asked"), "sequence", "tombstone", "value"))
    newest = both.groupBy("key").agg(F.sum("_asked").alias("_asked"), F.max_by(F.struct("tombstone", "value"), "sequence").alias("_v")).where("_asked > 0")
    held = newest.select("key", F.coalesce(~F.col("_v.tombstone"), F.lit(False)).alias("found"), F.when(~F.col("_v.tombstone"), F.col("_v.value")).alias("value"), "_asked")
    # a key is given out as often as it was asked for, in two steps, so no array is long
    chunks = held.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_asked") - 1) / REPEATS))).alias("_c"))
    each = chunks.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(REPEATS).cast("long"), F.col("_asked") - F.col("_c") * REPEATS))))
    return each.select("key", "found", "value")


def in_range(df: DataFrame, begin, end) -> DataFrame:
    """The half-open range [begin, end) in byte order; an empty end is open."""
    df = df.where(F.col("key") >= F.lit(begin)) if begin else df
    return df.where(F.col("key") < F.lit(end)) if end else df


def scan(log: DataFrame, begin="", end="") -> DataFrame:
    """key, value of the live keys of a range, in key order."""
    check_range(begin, end)
    return view(in_range(log, begin, end)).orderBy("key")


def scan_from(log: DataFrame, begin) -> DataFrame:
    """From a key to the end (an extension: scan() refuses a begin without an end)."""
    return view(in_range(log, begin, "")).orderBy("key")


def scan_prefix(log: DataFrame, prefix: str) -> DataFrame:
    return view(log.where(F.col("key").startswith(prefix))).orderBy("key")


def scan_limit(log: DataFrame, n: int, begin="", end="") -> DataFrame:
    """The first n rows of a scan (an extension)."""
    check_range(begin, end)
    return view(in_range(log, begin, end)).orderBy("key").limit(n)
