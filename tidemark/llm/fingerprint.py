"""Canonical exact document fingerprints, with DataFrame operations only.

The canonical form is NFC, lower case, NFC again, every run of white space one
space, trimmed.  It is hashed by two independently seeded xxhash64 (128 bits).
Documents are grouped by that hash and the canonical bytes compared inside a
group: where two different forms share a hash, the later ones (in byte order)
get their rank appended.  So equal fingerprints mean equal canonical forms.

Null text counts as empty; texts are taken whole, whatever their length.  Equal
doc_ids keep all their rows; their order is by text; rows without a doc_id come
first.  An empty table gives an empty result; other columns are ignored, whatever
their names.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SLICE_ROWS = 2_000  # rows of one slice of the doc_id order, about


def composed(text: Column) -> Column:
    """NFC, by the ICU library that Spark ships; nondeterministic to Spark, so select it before use."""
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))


def canonical(df: DataFrame, source: str, to: str) -> DataFrame:
    """Add the canonical form of a non-null string column."""
    once = df.withColumn("_folded", composed(F.col(source)))
    twice = once.withColumn("_folded", composed(F.lower("_folded")))
    folded = F.regexp_replace("_folded", r"[\s\x0B\x1C-\x1F\x85\p{Z}]+", " ")
    return twice.withColumn(to, F.trim(folded)).drop("_folded")


def wide_hash(form: Column) -> Column:
    """128 bits in hex: two xxhash64 chains, the second begun with another word and the length."""
    second = F.xxhash64(F.lit("second"), F.octet_length(form), form)
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(form)), 16, "0"), F.lpad(F.hex(second), 16, "0")))


def collisions(forms: DataFrame) -> DataFrame | None:
    """(hash, form, rank) of hashes that different canonical forms share; None if there are none, as ever so far.

    distinct() compares bytes inside equal hashes and collapses copies before the shuffle.
    """
    # keyed by hash first: rows of a hash with unlike bytes stay apart
    apart = forms.select("hash", "form").distinct()
    shared = apart.groupBy("hash").count().where("count > 1").select("hash")
    shared = common.saved(shared, "fingerprint-shared")
    if shared.isEmpty():
        common.drop_saved(shared.sparkSession, shared)
        return None
    rank = F.row_number().over(Window.partitionBy("hash").orderBy("form"))
    return apart.join(shared, "hash", "left_semi").withColumn("rank", rank)


def fingerprints(df: DataFrame, source: str, to: str, known: DataFrame | None, keep: str | None = None) -> DataFrame:
    """Add the fingerprint of a column, apart where `known` lists its hash as shared; keep: a name for the canonical form."""
    hashed = canonical(df, source, "_form").withColumn(to, wide_hash(F.col("_form")))
    if known is not None:
        named = known.select(F.col("hash").alias(to), F.col("form").alias("_form"), "rank")
        hashed = hashed.join(named, [to, "_form"], "left")
        hashed = hashed.withColumn(to, F.when(F.col("rank") > 1, F.concat(to, F.lit("-"), "rank")).otherwise(F.col(to))).drop("rank")
    return hashed.withColumnRenamed("_form", keep) if keep else hashed.drop("_form")


def with_next(docs: DataFrame) -> DataFrame:
    """Add each document's successor text in ascending doc_id (after the last: the first).

    The order is cut into slices at existing doc_ids.  The first rows of a slice
    are also dealt to the one before it, so no task sees more than its slice.
    """
    docs = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_id"))
    n = docs.count()
    if n == 0:
        return docs.drop("_id").withColumn("next_text", F.lit(None).cast("string"))
    k = max(1, n // SLICE_ROWS)
    # at most one bound for SLICE_ROWS documents; bounded for the driver by the parts of an even scale
    steps = [i / k for i in range(1, k)] if k <= 10_000 else [i / 10_000 for i in range(1, 10_000)]
    bounds = sorted(set(docs.approxQuantile("_id", steps, 0.2 / k if k <= 10_000 else 2e-5))) if steps else []
    first = docs.agg(F.min("_id")).head()[0]
    bounds = [int(b) for b in bounds if b > first]
    order = _literal(bounds)
    # a bound's own row opens its slice and closes the one before
    slot = _slot(bounds) if bounds else F.lit(0)
    at = docs.withColumn("_slice", slot)
    opens = F.element_at(order, F.greatest(F.col("_slice"), F.lit(1))) == F.col("_id") if bounds else F.lit(False)
    last = len(bounds)
    both = at.withColumn("_copies", F.when(F.col("_id") == first, F.array(F.struct(F.col("_slice"), F.lit(0).alias("late")), F.struct(F.lit(last).alias("_slice"), F.lit(2).alias("late"))))
                         .when(opens, F.array(F.struct(F.col("_slice"), F.lit(0).alias("late")), F.struct((F.col("_slice") - 1).alias("_slice"), F.lit(1).alias("late"))))
                         .otherwise(F.array(F.struct(F.col("_slice"), F.lit(0).alias("late")))))
    dealt = both.select("doc_id", "text", "_id", F.explode("_copies").alias("_c")).select("doc_id", "text", "_id", "_c._slice", "_c.late")
    order_by = Window.partitionBy("_slice").orderBy("late", "_id", "text")
    return dealt.withColumn("next_text", F.lead("text").over(order_by)).where("late = 0").select("doc_id", "text", "next_text")


def _literal(numbers: list[int]) -> Column:
    """One array literal, whatever its length."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")


def _slot(bounds: list[int]) -> Column:
    """The number of bounds <= _id."""
    c = F.col("_id")
    # a binary search: each step of a power of two is taken if the bound there is not above
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    table = _literal(bounds)

    def take(lo: Column, step: Column) -> Column:
        return F.when((lo + step <= len(bounds)) & (F.element_at(table, F.least(lo + step, F.lit(len(bounds)))) <= c), lo + step).otherwise(lo)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), take)


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every document: the operator's general output."""
    docs = common.text_docs(docs)
    known = collisions(canonical(docs, "text", "form").withColumn("hash", wide_hash(F.col("form"))))
    return fingerprints(docs, "text", "fingerprint", known).select("doc_id", "fingerprint")


def edited(docs: DataFrame) -> DataFrame:
    """Add edited: the last floor(n/4) code points replaced by the first as many of the next document."""
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    return (
        with_next(docs).withColumn("n_chars", n.cast("long")).withColumn("_cut", cut)
        .withColumn("edited", F.concat(F.expr("substring(text, 1, char_length(text) - _cut)"), F.when(F.col("_cut") > 0, F.expr("substring(next_text, 1, _cut)")).otherwise(F.lit(""))))
        .drop("_cut")
    )


def near_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its edited text, and whether they agree (an exact digest: 1 or 0).

    Likeness compares canonical bytes where fingerprints are equal, so a hash that
    an edited text shares with another form is no likeness.
    """
    docs = common.text_docs(docs)
    known = collisions(canonical(docs, "text", "form").withColumn("hash", wide_hash(F.col("form"))))
    rows = edited(docs)
    for source, to in (("text", "fingerprint"), ("edited", "edited_fingerprint"), ("next_text", "_next")):
        rows = fingerprints(rows, source, to, known, keep=f"_form_{to}")
    alike = lambda to: ((F.col("fingerprint") == F.col(to)) & (F.col("_form_fingerprint") == F.col(f"_form_{to}"))).cast("double")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        alike("edited_fingerprint").alias("near_edited"), alike("_next").alias("near_next"),
    )
