"""WARC archives: writing captures, reading records, and assembling transactions.

Each page becomes a transaction of three records: request, response (or revisit)
and metadata; request and metadata name the response in WARC-Concurrent-To.
Records are built by DataFrame expressions and written by Spark's text sink, so
files are committed by Spark to any Hadoop file system: a row is a transaction
without its last line feed, which the sink adds.  Files are gzip.

assemble() joins the records of a transaction through WARC-Concurrent-To and
gives one nested row for each capture.

A null html is an empty payload, a null url becomes urn:page:<page_id> (urn:page:
without a page_id), line breaks in a url are taken out.  Rows with a null page_id
get a record of their own number; they revisit a page that has their payload and a
page_id, else they are responses.  Repeated page_ids are captures of their own,
numbered in order of url and payload; among equal payloads of the largest page_id
the first is the response.  Columns besides page_id, url and html are ignored,
whatever their names.  A payload may be as long as a string; an empty table gives
no archive and an empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import common

LEAST_REVISIT = 1000  # bytes of payload from which equal ones are revisits
ROWS_A_FILE = 50_000
NAMELESS = 0x10  # added to the kind in record ids of rows without a page_id
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = (
    "record_id string, warc_type string, concurrent_to string, target_uri string, date string, refers_to string, "
    "payload_bytes long, payload_digest string, block binary"
)


def record_id(kind: int, page_id: Column, nth: Column) -> Column:
    """A UUID URN of kind, occurrence and page_id."""
    low = F.lpad(F.hex(page_id), 16, "0")
    return F.lower(F.concat(F.lit(f"<urn:uuid:{kind:08x}-"), F.lpad(F.hex(nth.bitwiseAND(0xFFFF)), 4, "0"), F.lit("-"), F.lpad(F.hex(F.shiftright(nth, 16)), 4, "0"),
                            F.lit("-"), F.substring(low, 1, 4), F.lit("-"), F.substring(low, 5, 12), F.lit(">")))


def page_of(record: Column) -> Column:
    """The page_id in a record id that record_id() made; null for those of rows without one."""
    digits = F.regexp_extract(record, r"-([0-9a-f]{4})-([0-9a-f]{12})>$", 1), F.regexp_extract(record, r"-([0-9a-f]{4})-([0-9a-f]{12})>$", 2)
    number = F.conv(F.concat(*digits), 16, 10).cast("decimal(20,0)")
    wrapped = F.when(number >= F.lit(str(2**63)).cast("decimal(20,0)"), number - F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(number)
    return F.when(record.isNotNull() & ~record.startswith(f"<urn:uuid:{NAMELESS + 1:08x}-"), wrapped.cast("long"))


def marked(pages: DataFrame) -> DataFrame:
    """page_id, url, html, size, digest, nth, refers_page (null for responses), number (of rows without a page_id)."""
    every = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = every.where("page_id is not null")
    bare = rows.select("page_id", F.sha1(F.encode("html", "UTF-8")).alias("digest"), F.octet_length("html").cast("long").alias("size"))
    # the response of each payload that comes more than once, by partial aggregation
    shared = bare.where(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).where("n > 1").drop("n")
    known = bare.select("page_id", "digest").distinct().join(shared, "digest")
    known = known.groupBy(F.col("page_id").alias("shared_page")).agg(F.map_from_entries(F.collect_list(F.struct("digest", "holder"))).alias("holders"))
    whole = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8"))).withColumn("size", F.octet_length("html").cast("long"))
    # html is dealt once, by page_id: the join and the windows below share that partitioning
    both = whole.join(known, F.col("page_id") == F.col("shared_page"), "left").withColumn("holder", F.col("holders")[F.col("digest")])
    # a response that others refer to is its page's occurrence 0
    by_page = Window.partitionBy("page_id").orderBy(F.coalesce(F.col("holder") == F.col("page_id"), F.lit(False)).desc(), "digest", "url")
    both = both.withColumn("nth", F.row_number().over(by_page) - 1).withColumn("rank", F.row_number().over(Window.partitionBy("page_id", "digest").orderBy("nth")))
    revisits = F.col("holder").isNotNull() & ((F.col("holder") != F.col("page_id")) | (F.col("rank") > 1))
    named = both.withColumn("refers_page", F.when(revisits, F.col("holder"))).drop("rank", "shared_page", "holders", "holder")
    # rows without a page_id are numbered by partition and refer to the largest page_id of their payload
    holders = bare.where(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(F.max("page_id").alias("refers_page"))
    nameless = every.where("page_id is null").withColumn("digest", F.sha1(F.encode("html", "UTF-8"))).withColumn("size", F.octet_length("html").cast("long"))
    nameless = nameless.withColumn("number", F.monotonically_increasing_id()).join(holders, "digest", "left")
    return named.withColumn("number", F.lit(None).cast("long")).unionByName(nameless.withColumn("nth", F.lit(0)))


def record(kind: str, rid: Column, fields: list[tuple[str, Column]], block: Column, end: str = "\r\n\r\n") -> Column:
    """The record's text; fields with a null value are left out."""
    head = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Date: {DATE}\r\nWARC-Record-ID: "), rid, F.lit("\r\n")]
    for name, value in fields:
        head.append(F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit("")))
    return F.concat(*head, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block, F.lit(end))


def write(pages: DataFrame, path: str) -> None:
    """Write the archives of a pages table (page_id, url, html)."""
    rows = marked(pages).withColumn("url", F.coalesce(F.regexp_replace("url", r"[\r\n]+", ""), F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))))
    ids = lambda kind: F.when(F.col("page_id").isNull(), record_id(NAMELESS + kind, F.col("number"), F.lit(0))).otherwise(record_id(kind, F.col("page_id"), F.col("nth")))
    rid, uri = ids(1), ("WARC-Target-URI", F.col("url"))
    is_revisit = F.col("refers_page").isNotNull()
    # the response of a shared payload is its page's first occurrence with that digest; ids of the rest need none
    refers = F.when(is_revisit, record_id(1, F.col("refers_page"), F.lit(0)))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    typed = ("Content-Type", F.lit("application/http; msgtype=response"))
    get = F.concat(F.lit("GET "), F.col("url"), F.lit(" HTTP/1.1\r\n\r\n"))
    facts = F.concat(F.lit("pageId: "), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit("\r\n"))
    concurrent = ("WARC-Concurrent-To", rid)
    transaction = F.concat(
        record("request", ids(2), [uri, concurrent, ("Content-Type", F.lit("application/http; msgtype=request"))], get),
        F.when(is_revisit, record("revisit", rid, [uri, digest, ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", refers), typed], http))
        .otherwise(record("response", rid, [uri, digest, typed], F.concat(http, F.col("html")))),
        record("metadata", ids(3), [uri, concurrent, ("Content-Type", F.lit("application/warc-fields"))], facts, "\r\n\r"),  # the sink ends the line
    )
    lines = rows.select(transaction.alias("value"))
    lines.write.option("compression", "gzip").option("maxRecordsPerFile", ROWS_A_FILE).text(path)


def parse(stream):
    """Yield (headers, block) of the records of one file; bad framing raises ValueError."""
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"no WARC record at {line[:40]!r}")
        head = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b":")
            head[name.strip().lower().decode()] = value.strip().decode("utf-8", "replace")
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record is cut short")
        yield head, block


def read(spark: SparkSession, path: str, keep_blocks: bool = True) -> DataFrame:
    """The records below a folder.  Size and digest are those of the full payload: a revisit's come from its headers."""

    def run(batches):
        import gzip
        import hashlib
        import io

        import pyarrow as pa

        names = [c.split()[0] for c in RECORDS.split(", ")]
        kinds = [pa.int64() if n == "payload_bytes" else pa.binary() if n == "block" else pa.string() for n in names]

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for content in batch.column("content"):
                raw = content.as_buffer()
                stream = io.BytesIO(raw)
                if memoryview(raw)[:2].tobytes() == b"\x1f\x8b":
                    stream = gzip.GzipFile(fileobj=stream)
                rows, held = [], 0
                for head, block in parse(io.BufferedReader(stream, 1 << 20)):
                    size = digest = None
                    if head["warc-type"] in ("response", "revisit"):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        if head["warc-type"] == "response":
                            size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                        else:
                            digest = head["warc-payload-digest"].rpartition(":")[2]
                            size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    rows.append((head["warc-record-id"], head["warc-type"], head.get("warc-concurrent-to"), head.get("warc-target-uri"), head.get("warc-date"),
                                 head.get("warc-refers-to"), size, digest, block if keep_blocks else None))
                    held += len(block)
                    if len(rows) >= 5000 or held > 8 << 20:
                        yield table(rows)
                        rows, held = [], 0
                if rows:
                    yield table(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(run, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each response or revisit, with its request and its metadata records."""
    captures = records.where("warc_type in ('response', 'revisit')").drop("concurrent_to")
    others = records.where("concurrent_to is not null and warc_type in ('request', 'metadata')")
    part = F.struct("warc_type", "record_id", "target_uri", "date", "block")
    tied = others.groupBy(F.col("concurrent_to").alias("record_id")).agg(F.sort_array(F.collect_list(part)).alias("parts"))
    whole = captures.join(tied, "record_id", "left")
    pick = lambda kind: F.filter(F.coalesce("parts", F.array().cast(tied.schema["parts"].dataType)), lambda p: p["warc_type"] == kind)
    return whole.withColumn("request", F.get(pick("request"), F.lit(0))).withColumn("metadata", pick("metadata")).drop("parts")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the table's archives to the shared folder, read them back, and report each capture."""
    spark = pages.sparkSession
    path = common.scratch(spark, "warc")
    write(pages, path)
    got = assemble(read(spark, path, keep_blocks=False))
    return got.select(
        page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"),
        page_of(F.col("refers_to")).alias("refers_to"), F.col("request").isNotNull().alias("has_request"), F.size("metadata").alias("n_metadata"),
    )
