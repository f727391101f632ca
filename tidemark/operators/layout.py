"""Physical layout: block packing, sparse index, block lookup, sizes."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import BLOCK_BYTES
from . import ranges

#: Fixed sizes of the interchange format: record header, table header, index entry, checksum.
RECORD_HEADER, TABLE_HEADER, INDEX_ENTRY, CHECKSUM = 20, 40, 12, 4
SLICE_BLOCKS = 1 << 20  # blocks of a slice
#: Lookups of keys in all generations: bytes of an index entry or key, of which a slice has SLICE_BYTES; rows from which a further slice is worth a task; rows given at once.
ROW_BYTES, SPREAD_ROWS, OUT_ROWS = 128, 1000, 1 << 15


def record_bytes() -> Column:
    return (F.lit(RECORD_HEADER) + F.octet_length("key") + F.octet_length("value")).cast("long")


def pack_blocks(entries: DataFrame, limit: int = BLOCK_BYTES) -> DataFrame:
    """key, sequence, ..., block, record_bytes: greedy packing of each generation in key order.

    A record opens a block if it would lift the current one above the limit; a
    larger record has a block to itself.  That depends on all records before it, so
    it is a fold, cut into slices of the key order: a slice first states for each
    fill it may begin with how many blocks it opens and the fill it ends with (only
    its first records tell these apart, so they are few); the statements are
    chained; then every slice folds its rows as a stream from its known beginning.
    """
    sized = entries.withColumn("record_bytes", record_bytes())
    cuts = ranges.bounds(sized.select("generation", "key"), "key")
    cut = sized.withColumn("_slice", ranges.slice_of(sized, "key", cuts))
    if cuts:
        cut = cut.join(_entries_of_slices(cut, limit), ["generation", "_slice"])
    else:
        cut = cut.withColumn("_used", F.lit(None).cast("long")).withColumn("_block", F.lit(-1).cast("long"))
    dealt = cut.repartition("generation", "_slice").sortWithinPartitions("generation", "_slice", "key")

    names = sized.columns

    def fold(batches):
        import pyarrow as pa

        at, used, block = None, 0, -1
        for b in batches:
            out = []
            for gen, part, size, begin, before in zip(*(b.column(c).to_pylist() for c in ("generation", "_slice", "record_bytes", "_used", "_block"))):
                if (gen, part) != at:
                    at, used, block = (gen, part), begin, before
                if used is None or used + size > limit:
                    used, block = size, block + 1
                else:
                    used += size
                out.append(block)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(out, pa.int64())], names=[*names, "block"])

    return dealt.mapInArrow(fold, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sized.schema) + ", block long")


def _entries_of_slices(cut: DataFrame, limit: int) -> DataFrame:
    """generation, _slice, _used (null: nothing before), _block: the fill and the block a slice begins with."""
    import pandas as pd

    kind = cut.schema["generation"].dataType.simpleString()

    def states(key, group):
        """For each number `first` of records that may join an open block: blocks opened after them, and the last one's fill."""
        import numpy as np

        total = np.concatenate([[0], np.cumsum(group.sort_values("key")["record_bytes"].to_numpy())])
        n, known = len(total) - 1, {}

        def walk(i: int) -> tuple[int, int]:
            path = []
            while i < n and i not in known:
                path.append(i)
                i = max(i + 1, int(np.searchsorted(total, total[i] + limit, side="right")) - 1)
            blocks, fill = known.get(i, (0, None))
            for k in reversed(path):
                blocks += 1
                fill = int(total[n] - total[k]) if fill is None else fill
                known[k] = (blocks, fill)
            return blocks, fill

        rows = []
        for first in range(n + 1):
            if total[first] > limit:
                break
            blocks, fill = walk(first) if first < n else (0, None)
            rows.append((key[0], key[1], first, int(total[first]), int(total[first + 1]) if first < n else None, blocks, fill))
        return pd.DataFrame(rows, columns=["generation", "_slice", "first", "joined", "over", "blocks", "fill"]).astype({"over": "Int64", "fill": "Int64"})

    stated = cut.select("generation", "_slice", "key", "record_bytes").groupBy("generation", "_slice").applyInPandas(
        states, f"generation {kind}, _slice int, first long, joined long, over long, blocks long, fill long")

    def chain(key, group):
        used, block, rows = None, -1, []
        for part, own in group.groupby("_slice", sort=True):
            rows.append((key[0], part, used, block))
            for r in own.sort_values("first").itertuples():
                if used is None or pd.isna(r.over) or used + r.over > limit:
                    if pd.isna(r.over):  # all its records join the open block
                        used = r.joined if used is None else used + r.joined
                    else:
                        used, block = int(r.fill), block + int(r.blocks)
                    break
        return pd.DataFrame(rows, columns=["generation", "_slice", "_used", "_block"]).astype({"_used": "Int64"})

    return stated.groupBy("generation").applyInPandas(chain, f"generation {kind}, _slice int, _used long, _block long")


def fixed_blocks(entries: DataFrame, size: int) -> DataFrame:
    """Blocks of a fixed number of entries in key order, for each generation."""
    placed = ranges.ranked(entries, "generation", "key", "_rank")
    return placed.withColumn("block", F.floor(F.col("_rank") / size).cast("long")).drop("_rank")


def sparse_index(blocks: DataFrame) -> DataFrame:
    """generation, block, first_key, entries, bytes."""
    return blocks.groupBy("generation", "block").agg(F.min("key").alias("first_key"), F.count("*").alias("entries"), F.sum(record_bytes()).alias("bytes"))


def extents(index: DataFrame, start: Column | int) -> DataFrame:
    """Add offset and end of each block: running sums from the start of a table's records, slice by slice of block numbers."""
    cut = index.withColumn("_slice", F.floor(F.col("block") / SLICE_BLOCKS))
    order = Window.partitionBy("generation", "_slice").orderBy("block")
    here = F.coalesce(F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    earlier = ranges.before(cut.groupBy("generation", "_slice").agg(F.sum("bytes").alias("_n")), "generation", "_n").drop("_n")
    base = F.lit(start) if isinstance(start, int) else start
    tied = cut.withColumn("_here", here).join(earlier, ["generation", "_slice"]).withColumn("offset", base + F.col("_before") + F.col("_here"))
    return tied.select(*index.columns, "offset", (F.col("offset") + F.col("bytes")).alias("end"))


def find_block(index: DataFrame, keys: DataFrame) -> DataFrame:
    """generation, key, block: the last block whose first key is not above the key, -1 before the first.

    Keys with a generation are looked up by one sort within slices of the key order:
    index entries and keys are merged, and the last entry's block is carried forward;
    into a slice comes the last block of the slices before.  Keys without one are asked
    of every generation, see `_find_in_all`.
    """
    if "generation" not in keys.columns:
        return _find_in_all(index, keys)
    entries = index.select("generation", F.col("first_key").alias("key"), "block", F.lit(0).alias("_probe"))
    both = entries.unionByName(keys.select("generation", "key", F.lit(None).cast("long").alias("block"), F.lit(1).alias("_probe")))
    cuts = ranges.bounds(both.select("key"), "key")
    both = both.withColumn("_slice", ranges.slice_of(both, "key", cuts))
    order = Window.partitionBy("generation", "_slice").orderBy("key", "_probe").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("block", F.last("block", ignorenulls=True).over(order))
    if cuts:
        tops = both.groupBy("generation", "_slice").agg(F.max("block").alias("_top"))
        earlier = Window.partitionBy("generation").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        carried = tops.withColumn("_carried", F.max("_top").over(earlier)).drop("_top")
        found = found.where("_probe = 1").join(carried, ["generation", "_slice"]).withColumn("block", F.coalesce("block", "_carried")).drop("_carried")
    return found.where("_probe = 1").select("generation", "key", F.coalesce("block", F.lit(-1)).cast("long").alias("block"))


def _find_in_all(index: DataFrame, keys: DataFrame) -> DataFrame:
    """Each key in each generation.

    That product is the result; it is neither sorted nor moved.  A slice of the key
    order gets the block each generation comes into it with, then its index entries,
    then its keys, each once; the rows are made from these as a stream.
    """
    entries = index.select("generation", F.col("first_key").alias("key"), "block")
    both = entries.select("key").unionByName(keys.select("key"))
    n = both.count()
    slice_rows = ranges.SLICE_BYTES // ROW_BYTES
    spread = min(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // SPREAD_ROWS + 1)
    slices = min(ranges.SLICES, max(spread, n // slice_rows + 1))
    cuts = ranges.cuts_at(both, "key", slices, n)
    last = len(cuts)

    placed = entries.withColumn("_slice", ranges.slice_of(entries, "key", cuts))
    known = F.col("generation").isNotNull() & F.col("key").isNotNull()
    by = Window.partitionBy("generation").orderBy("_slice")
    tops = placed.groupBy("generation", "_slice").agg(F.max(F.when(known, F.col("block"))).alias("block")).withColumns(
        {"_first": F.row_number().over(by) == 1, "_until": F.coalesce(F.lead("_slice").over(by), F.lit(last))})
    nothing = F.transform(F.when(F.col("_first"), F.sequence(F.lit(0), F.col("_slice"))).otherwise(F.array().cast("array<int>")), lambda s: F.struct(s.alias("s"), F.lit(None).cast("long").alias("b")))
    later = F.transform(F.when(F.col("_slice") < F.col("_until"), F.sequence(F.col("_slice") + 1, F.col("_until"))).otherwise(F.array().cast("array<int>")), lambda s: F.struct(s.alias("s"), F.col("block").cast("long").alias("b")))
    carried = tops.select("generation", F.explode(F.concat(nothing, later)).alias("_c")).select(
        F.col("_c.s").alias("_slice"), F.lit(0).alias("_kind"), "generation", F.lit(None).cast("string").alias("key"), F.col("_c.b").alias("block"))
    kind = index.schema["generation"].dataType.simpleString()
    rows = carried.unionByName(placed.where(known).select("_slice", F.lit(1).alias("_kind"), "generation", "key", F.col("block").cast("long").alias("block"))).unionByName(
        keys.select(ranges.slice_of(keys, "key", cuts).alias("_slice"), F.lit(2).alias("_kind"), F.lit(None).cast(kind).alias("generation"), "key", F.lit(None).cast("long").alias("block")))
    dealt = rows.repartition(last + 1, "_slice") if cuts else rows.coalesce(1)
    return dealt.sortWithinPartitions("_slice", "_kind", "key").mapInArrow(_in_all, f"generation {kind}, key string, block long")


def _in_all(batches):
    """Rows by slice: generations with the block carried in (kind 0), index entries (1) and keys (2) in key order."""
    from bisect import bisect_left

    import numpy as np
    import pyarrow as pa

    at = None
    for b in batches:
        parts, kinds = (b.column(c).to_numpy(zero_copy_only=False) for c in ("_slice", "_kind"))
        edges = [0, *(np.flatnonzero((np.diff(parts) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            if hi == lo:
                continue
            if parts[lo] != at:
                at, generations, now, entries, done = parts[lo], [], [], [], 0
            run = b.slice(lo, hi - lo)
            if kinds[lo] == 0:
                generations += run.column("generation").to_pylist()
                now += [-1 if x is None else x for x in run.column("block").to_pylist()]
                place = None
            elif kinds[lo] == 1:
                place = place or {g: k for k, g in enumerate(generations)}
                entries += zip(run.column("key").to_pylist(), map(place.get, run.column("generation").to_pylist()), run.column("block").to_pylist())
            elif generations:
                if isinstance(now, list):
                    now, gens = np.array(now, np.int64), pa.array(generations, run.column("generation").type)
                keys = run.column("key")
                texts, n = keys.to_pylist(), len(keys)
                nulls = keys.null_count  # first; no entry is at or below them
                own = []
                if texts[-1] is not None:
                    until = done
                    while until < len(entries) and entries[until][0] <= texts[-1]:
                        until += 1
                    own, done = entries[done:until], until
                which = np.array([g for _, g, _ in own], np.int64)
                first = np.array([bisect_left(texts, k, nulls) for k, _, _ in own], np.int64)
                block = np.array([x for _, _, x in own], np.int64)
                order = np.argsort(which, kind="stable")
                which, first, block = which[order], first[order], block[order]
                begin = np.where(nulls == n, -1, now) if nulls else now
                step = max(1, OUT_ROWS // n)
                index = np.tile(np.arange(n), min(step, len(generations)))
                tiled = keys.take(pa.array(index))
                for g in range(0, len(generations), step):
                    m = min(step, len(generations) - g)
                    a, z = np.searchsorted(which, [g, g + m])
                    starts = np.concatenate([np.arange(m) * n, (which[a:z] - g) * n + first[a:z]])
                    sort = np.argsort(starts, kind="stable")
                    blocks = np.concatenate([begin[g : g + m], block[a:z]])[sort].repeat(np.diff(starts[sort], append=m * n))
                    if nulls and nulls < n:
                        blocks.reshape(m, n)[:, :nulls] = -1
                    yield pa.RecordBatch.from_arrays([gens.slice(g, m).take(pa.array(np.arange(m).repeat(n))), tiled.slice(0, m * n), pa.array(blocks)], names=["generation", "key", "block"])
                now[which] = block  # in key order within a generation, so the last one stays


def overlapping(index: DataFrame, begin: str, end: str) -> DataFrame:
    """The blocks that may hold keys of [begin, end); an empty end is open.  Block numbers have no gaps, so the next one is joined by number."""
    after = index.select("generation", (F.col("block") - 1).alias("block"), F.col("first_key").alias("_next"))
    spans = index.join(after, ["generation", "block"], "left")
    kept = spans.where(F.col("_next").isNull() | (F.col("_next") > F.lit(begin)))
    return (kept.where(F.col("first_key") < F.lit(end)) if end else kept).select(index.columns)


def bloom_bytes(entries: Column, bits_per_key: int) -> Column:
    return F.ceil(F.greatest(F.lit(64), entries * bits_per_key) / 8).cast("long")


def sizes(blocks: DataFrame, bits_per_key: int) -> DataFrame:
    """generation, entries, blocks, metadata_bytes, file_bytes of tables in the interchange format, in closed form."""
    index = sparse_index(blocks)
    t = index.groupBy("generation").agg(
        F.sum("entries").alias("entries"), F.count("*").alias("blocks"), F.sum(INDEX_ENTRY + F.octet_length("first_key")).cast("long").alias("_index"), F.sum("bytes").alias("_records"))
    meta = F.lit(TABLE_HEADER) + bloom_bytes(F.col("entries"), bits_per_key) + F.col("_index")
    return t.select("generation", "entries", "blocks", meta.cast("long").alias("metadata_bytes"), (meta + F.col("_records") + CHECKSUM).cast("long").alias("file_bytes"))


def flush_schedule(sizes: list[int], memtable_bytes: int, trigger: int) -> list[tuple[int, str, int]]:
    """(event number, flush or compact, generation) of a run of mutations to distinct keys of these sizes."""
    events, used, generation, tables = [], 0, 0, 0
    for size in sizes:
        used += size
        if used >= memtable_bytes:
            generation, tables, used = generation + 1, tables + 1, 0
            events.append((len(events) + 1, "flush", generation))
            if tables >= trigger:
                generation, tables = generation + 1, 1
                events.append((len(events) + 1, "compact", generation))
    return events
