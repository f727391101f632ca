"""Readers and writers: logs, tables, acknowledged writes, configurations, metrics, reports."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.scalar import table_generation, trimmed
from . import codec

VERSIONS = "source string, position long, key binary, sequence long, tombstone boolean, value binary"


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """The valid prefix of every log file below a path.  Files are read by Spark, so any store will do."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for source, content in zip(pdf["path"], pdf["content"]):
                rows = [(source, at, *v) for at, v in codec.log_records(bytes(content))]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in VERSIONS.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, VERSIONS)


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """All versions of the tables of a folder, with their generation.  A corrupt table fails the read."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for generation, source, content in zip(pdf["generation"], pdf["path"], pdf["content"]):
                rows = [(source, k, *v, generation) for k, v in enumerate(codec.decode_table(bytes(content)).versions)]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in VERSIONS.split(", ")] + ["generation"])

    files = spark.read.format("binaryFile").load(path).withColumn("generation", table_generation(F.element_at(F.split("path", "/"), -1)))
    return files.where("generation > 0").select("path", "content", "generation").mapInPandas(run, VERSIONS + ", generation long")


def discover(spark: SparkSession, path: str) -> DataFrame:
    """name, generation, bytes of a folder's tables, newest first; other files and unfinished ones are ignored."""
    name = F.element_at(F.split("path", "/"), -1)
    files = spark.read.format("binaryFile").load(path).select(name.alias("name"), F.col("length").alias("bytes"))
    return files.withColumn("generation", table_generation(F.col("name"))).where("generation > 0").orderBy(F.desc("generation"))


def folder_size(spark: SparkSession, path: str) -> DataFrame:
    """bytes and files; contents are not read."""
    return spark.read.format("binaryFile").load(path).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count("*").alias("files"))


class LogSource(DataSource):
    """Spark data source `tidemark_log`: the valid prefix of local or mounted log files, one partition a file."""

    @classmethod
    def name(cls):
        return "tidemark_log"

    def schema(self):
        return VERSIONS

    def reader(self, schema):
        return LogReader(self.options)


class LogReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("path", "").split(",") if p]

    def partitions(self):
        return [InputPartition(p) for p in self.paths]

    def read(self, partition):
        with open(partition.value, "rb") as f:
            data = f.read()
        for at, v in codec.log_records(data):
            yield partition.value, at, v.key, v.sequence, v.tombstone, v.value


def read_acknowledged(spark: SparkSession, path: str) -> DataFrame:
    """key, value of a file of acknowledged writes: split at the first tab.

    Reading ends at the first line without one; a last line without its line feed
    is torn and left out.  The file is one writer's, read whole as one row.
    """
    whole = spark.read.text(path, wholetext=True)
    lines = F.slice(F.split("value", "\n"), 1, F.size(F.split("value", "\n")) - 1)
    rows = whole.select(F.posexplode(lines).alias("n", "line"))
    tab = F.instr("line", "\t")
    first_bad = rows.where(tab == 0).agg(F.min("n").alias("stop"))
    good = rows.join(F.broadcast(first_bad)).where(F.col("stop").isNull() | (F.col("n") < F.col("stop")))  # one row
    return good.select(F.substring_index("line", "\t", 1).alias("key"), F.expr("substring(line, instr(line, '\t') + 1)").alias("value"))


def write_acknowledged(rows: DataFrame, path: str) -> None:
    rows.select(F.concat_ws("\t", "key", "value").alias("value")).write.mode("append").text(path)


#: Defaults of a workload configuration.
WORKLOAD = {"workload": "mixed", "ops": 20000, "write_ratio": 0.5, "key_space": 100000, "value_size": 100, "preload": 0, "seed": 20260728}


def parse_workload(lines: DataFrame) -> DataFrame:
    """name, value of `name = value` lines; text after # and lines without = are comments, the last of a name wins."""
    body = F.regexp_replace("value", "#.*$", "")
    cut = F.instr(body, "=")
    pairs = lines.where(cut > 0).select(
        trimmed(F.substring_index(body, "=", 1)).alias("name"), trimmed(F.regexp_replace(body, "^[^=]*=", "")).alias("text"), F.monotonically_increasing_id().alias("_at"))
    return pairs.groupBy("name").agg(F.max_by("text", "_at").alias("text"))


def workload(spark: SparkSession, path: str) -> dict:
    """A configuration with defaults: unknown names are ignored, write_ratio is kept in 0 to 1, key_space at 1 or more."""
    out = dict(WORKLOAD)
    for r in parse_workload(spark.read.text(path)).collect():  # a file of a few lines
        if r["name"] in out:
            out[r["name"]] = type(out[r["name"]])(r["text"])
    out["write_ratio"] = min(1.0, max(0.0, out["write_ratio"]))
    out["key_space"] = max(1, out["key_space"])
    return out


def metrics(text):
    """`name=value` tokens of a line as a map of longs; tokens without = are left out."""
    tokens = F.filter(F.split(trimmed(text), r"\s+"), lambda t: F.instr(t, "=") > 0)
    return F.map_from_entries(F.transform(tokens, lambda t: F.struct(F.substring_index(t, "=", 1), F.regexp_replace(t, "^[^=]*=", "").cast("long"))))


def write_metrics(rows: DataFrame, path: str) -> None:
    """One line of `name=value` tokens for each row, in order of its columns; what metrics() reads."""
    tokens = [F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in rows.columns]
    rows.select(F.concat_ws(" ", *tokens).alias("value")).write.mode("append").text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """A table with a header line in each file, such as the reader-scaling results."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def fixed_width(rows: DataFrame, widths: dict[str, int], digits: int = 1) -> DataFrame:
    """value: lines of columns padded to their widths, text to the left, numbers to the right and rounded; longer texts are not cut.

    The header is a line of its own, with line number 0 in the column `n`; rows keep no order but by `n`.
    """
    kinds = dict(rows.dtypes)

    def cell(c: str):
        text = F.format_string(f"%.{digits}f", F.col(c).cast("double")) if kinds[c] in ("double", "float") else F.col(c).cast("string")
        text = F.when(F.col(c).isNull(), "-").otherwise(text)
        padded = F.rpad(text, widths[c], " ") if kinds[c] == "string" else F.lpad(text, widths[c], " ")
        return F.when(F.char_length(text) > widths[c], text).otherwise(padded)

    names = list(widths)
    head = " ".join(c.ljust(widths[c]) if kinds[c] == "string" else c.rjust(widths[c]) for c in names)
    header = rows.sparkSession.createDataFrame([(0, head.rstrip())], "n long, value string")
    body = rows.select((F.monotonically_increasing_id() + 1).alias("n"), F.rtrim(F.concat_ws(" ", *map(cell, names))).alias("value"))
    return header.unionByName(body)


REPORT = (
    "workload string, config struct<ops:bigint,write_ratio:double,key_space:bigint,value_size:bigint,preload:bigint,seed:bigint>, "
    "options struct<memtable_bytes:bigint,bloom_bits_per_key:bigint,compaction_trigger:bigint,sync_writes:boolean>, "
    "results struct<elapsed_seconds:double,total_ops_per_second:double,writes:bigint,write_ops_per_second:double,reads:bigint,read_ops_per_second:double,"
    "read_hit_rate:double,write_latency_us:struct<p50:double,p95:double,p99:double>,read_latency_us:struct<p50:double,p95:double,p99:double>,"
    "sstable_count:bigint,bloom_checks:bigint,bloom_negative_hits:bigint,sstable_reads:bigint,sstable_bytes_read:bigint,table_metadata_bytes:bigint,"
    "database_size_bytes:bigint,file_count:bigint>"
)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Report files with their name."""
    return spark.read.schema(REPORT).option("multiLine", True).option("pathGlobFilter", "*.json").json(path).withColumn("file_name", F.col("_metadata.file_name"))
