"""Key formats, sizes, report names, deltas: built-in expressions only."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def padded(number: Column, width: int) -> Column:
    """Zero-padded decimal; longer numbers are not cut."""
    text = number.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def workload_key(number: Column) -> Column:
    return padded(number, 20)


def reader_key(number: Column) -> Column:
    return padded(number, 12)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def parse_size(raw: Column, lower: bool = True) -> Column:
    """256K, 1M, 512: leading digits and a unit; anything else counts as 0."""
    digits = F.regexp_extract(raw, r"^\s*(\d+)", 1)
    unit = F.substring(raw, -1, 1)
    k, m = (("K", "k"), ("M", "m")) if lower else (("K",), ("M",))
    scale = F.when(unit.isin(*k), 1024).when(unit.isin(*m), 1024 * 1024).otherwise(1)
    return F.when(digits == "", F.lit(0)).otherwise(digits.cast("long") * scale).cast("long")


def size_label(value: Column) -> Column:
    mega, kilo = 1024 * 1024, 1024
    return (
        F.when(value >= mega, F.concat(F.floor(value / mega).cast("string"), F.lit("M")))
        .when(value >= kilo, F.concat(F.floor(value / kilo).cast("string"), F.lit("K"))).otherwise(value.cast("string"))
    )


#: Fixed pattern of report names: workload, swept option, value.
REPORT_NAME = r"^(write_heavy|read_heavy|mixed)__(memtable|bloom|compaction)_(\d+[KM]?)(\.json)?$"


def report_name(name: Column) -> list[Column]:
    """workload, dimension, raw value, value; null where the name is no report's."""
    ok = name.rlike(REPORT_NAME)
    parts = [F.when(ok, F.regexp_extract(name, REPORT_NAME, k)) for k in (1, 2, 3)]
    return [*parts, F.when(ok, parse_size(parts[2], lower=False))]


def table_generation(name: Column) -> Column:
    """The generation in a table's file name, 0 if it is no table's."""
    digits = F.regexp_extract(name, r"^sst-(\d+)\.dat$", 1)
    return F.when(digits == "", F.lit(0)).otherwise(digits.cast("long")).cast("long")


def percent_change(old: Column, new: Column) -> Column:
    """Signed text of one decimal; `new` from nothing, `0` between nothings."""
    return (
        F.when((old == 0) & (new == 0), "0").when(old == 0, "new")
        .otherwise(F.format_string("%+.1f%%", (new - old) / old * 100.0))
    )
