"""The engine's registered queries over the star-schema tables, each with its SQL where SQL can say it."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import bloom, scalar, stats
from .operators import checks, layout, mutate, reads, reconcile
from .plans import reports, workload
from .sources import files

QUERIES: dict = {}
SQL: dict = {}

GENERATION_ROWS, ORDER_ROWS, BLOCK_ROWS, BITS = 2500, 4000, 16, 10
BEGIN, END, PREFIX = "user:00000020", "user:00000040", "user:0000001"

MUT = """
mut as (select 'user:' || lpad(cast(user_id as varchar), 8, '0') as key, event_id + 1 as sequence, event_type = 'error' as tombstone,
  case when event_type = 'error' then '' else event_type || '|' || props end as value, event_id // 2500 + 1 as generation from events),
latest as (select key, max(sequence) as sequence, arg_max(tombstone, sequence) as tombstone, arg_max(value, sequence) as value from mut group by key),
live as (select key, value from latest where not tombstone)"""
GENERATIONS = """,
perg as (select generation, key, max(sequence) as sequence, arg_max(tombstone, sequence) as tombstone, arg_max(value, sequence) as value from mut group by 1, 2)"""
BLOCKS = GENERATIONS + """,
blocks as (select *, (row_number() over (partition by generation order by key) - 1) // 16 as block from perg),
idx as (select generation, block, min(key) as first_key, count(*) as entries, sum(20 + strlen(key) + strlen(value))::bigint as bytes from blocks group by 1, 2)"""


def query(sql: str | None = None, with_: str = MUT):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"with {with_}\n{sql}" if with_ else sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mut(spark, sf_dir) -> DataFrame:
    """Events as a changelog: errors are deletes."""
    dead = F.col("event_type") == "error"
    return read(spark, sf_dir, "events").select(
        F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 8, "0")).alias("key"), (F.col("event_id") + 1).alias("sequence"), dead.alias("tombstone"),
        F.when(dead, "").otherwise(F.concat("event_type", F.lit("|"), "props")).alias("value"), (F.floor(F.col("event_id") / GENERATION_ROWS) + 1).alias("generation"))


def omut(spark, sf_dir) -> DataFrame:
    """Orders by customer: finished ones are deletes."""
    dead = F.col("o_orderstatus") == "F"
    return read(spark, sf_dir, "orders").select(
        F.concat(F.lit("cust:"), F.lpad(F.col("o_custkey").cast("string"), 8, "0")).alias("key"), (F.col("o_orderkey") + 1).alias("sequence"), dead.alias("tombstone"),
        F.when(dead, "").otherwise(F.col("o_orderpriority")).alias("value"), (F.floor(F.col("o_orderkey") / ORDER_ROWS) + 1).alias("generation"))


def cmut(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "conversations").select(
        F.concat(F.lit("conv:"), F.lpad(F.col("conv_id").cast("string"), 8, "0")).alias("key"), (F.col("turn") + 1).alias("sequence"), F.lit(False).alias("tombstone"),
        F.col("role").alias("value"), F.lit(1).alias("generation"))


def per_generation(spark, sf_dir) -> DataFrame:
    """The newest version of each key within each generation."""
    order = Window.partitionBy("generation", "key").orderBy(F.desc("sequence"))
    return mut(spark, sf_dir).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def blocks(spark, sf_dir) -> DataFrame:
    return layout.fixed_blocks(per_generation(spark, sf_dir), BLOCK_ROWS)


# --- reconciliation


@query("select * from latest")
def put_latest(spark, sf_dir):
    return reconcile.latest_wins(mut(spark, sf_dir).drop("generation"))


@query("""select 'cust:' || lpad(cast(o_custkey as varchar), 8, '0') as key, max(o_orderkey + 1) as sequence, arg_max(o_orderstatus = 'F', o_orderkey) as tombstone,
  arg_max(case when o_orderstatus = 'F' then '' else o_orderpriority end, o_orderkey) as value from orders group by 1""", "")
def put_latest_orders(spark, sf_dir):
    return reconcile.latest_wins(omut(spark, sf_dir).drop("generation"))


@query("select 'conv:' || lpad(cast(conv_id as varchar), 8, '0') as key, arg_max(role, turn) as value from conversations group by 1", "")
def put_latest_turns(spark, sf_dir):
    return reconcile.view(cmut(spark, sf_dir))


@query("select key, value from (select *, row_number() over (partition by key order by generation desc, sequence desc) as n from mut) where n = 1 and not tombstone")
def newest_generation_wins(spark, sf_dir):
    return reconcile.live(reconcile.newest_generation_wins(mut(spark, sf_dir)))


@query("select * from latest")
def replay_idempotent(spark, sf_dir):
    log = mut(spark, sf_dir)
    return reconcile.latest_wins(log.unionByName(log.where("generation = 1")).unionByName(log.where("generation = 4")).drop("generation"))


@query("select key, sequence, tombstone, value from latest")
def compact_merge(spark, sf_dir):
    log = mut(spark, sf_dir)
    odd = log.where("generation % 2 = 1").drop("generation")
    return reconcile.merge(odd, log.where("generation % 2 = 0").drop("generation"))


@query("select count(*) filter (not tombstone) as live, count(*) filter (tombstone) as dead, count(*) as entries from latest")
def tombstone_census(spark, sf_dir):
    return reconcile.census(reconcile.latest_wins(mut(spark, sf_dir)))


@query("select key, value from (select key, arg_max(tombstone, sequence) as tombstone, arg_max(value, sequence) as value from mut where sequence <= 500 group by key) where not tombstone")
def as_of(spark, sf_dir):
    return reconcile.as_of(mut(spark, sf_dir), 500)


# --- reads


@query("select 'user:00000007' as key, count(value) > 0 as found, max(value) as value from live where key = 'user:00000007'")
def get_hit(spark, sf_dir):
    return reads.lookup(mut(spark, sf_dir), "user:00000007")


@query("select 'user:99999999' as key, false as found, null::varchar as value", "")
def get_miss(spark, sf_dir):
    return reads.lookup(mut(spark, sf_dir), "user:99999999")


@query("select key, false as found, null::varchar as value from latest where tombstone")
def get_tombstone(spark, sf_dir):
    log = mut(spark, sf_dir)
    return reads.multi_get(log, reconcile.latest_wins(log).where("tombstone").select("key"))


ASKED = """, asked as (select 'user:' || lpad(cast(c_custkey * 3 as varchar), 8, '0') as key from customer)"""


@query("select a.key, l.key is not null as found, l.value from asked a left join live l on a.key = l.key", MUT + ASKED)
def multi_get(spark, sf_dir):
    asked = read(spark, sf_dir, "customer").select(F.concat(F.lit("user:"), F.lpad((F.col("c_custkey") * 3).cast("string"), 8, "0")).alias("key"))
    return reads.multi_get(mut(spark, sf_dir), asked)


@query("select count(*) as asked, count(l.key) as found, coalesce(avg((l.key is not null)::int), 0)::double as hit_rate from asked a left join live l on a.key = l.key", MUT + ASKED)
def hit_rate(spark, sf_dir):
    return multi_get(spark, sf_dir).agg(F.count("*").alias("asked"), F.count_if("found").alias("found"), stats.hit_rate(F.col("found")).alias("hit_rate"))


@query("select * from live")
def scan_full(spark, sf_dir):
    return reads.scan(mut(spark, sf_dir))


@query(f"select * from live where key >= '{BEGIN}' and key < '{END}'")
def scan_range(spark, sf_dir):
    return reads.scan(mut(spark, sf_dir), BEGIN, END)


@query(f"select * from live where starts_with(key, '{PREFIX}')")
def scan_prefix(spark, sf_dir):
    return reads.scan_prefix(mut(spark, sf_dir), PREFIX)


@query(f"select * from live where key >= '{BEGIN}'")
def scan_from(spark, sf_dir):
    return reads.scan_from(mut(spark, sf_dir), BEGIN)


@query("select * from live order by key limit 10")
def scan_limit(spark, sf_dir):
    return reads.scan_limit(mut(spark, sf_dir), 10)


@query("select distinct m.key from mut m join latest l on m.key = l.key where l.tombstone and not m.tombstone")
def erase_hides_value(spark, sf_dir):
    log = mut(spark, sf_dir)
    versions = log.groupBy("key").agg(F.count_if(~F.col("tombstone")).alias("values"), F.max_by("tombstone", "sequence").alias("dead"))
    return versions.where("dead and values > 0").select("key")


@query("""select 'user:' || lpad(cast(s_suppkey + 5000000 as varchar), 8, '0') as key, (select max(sequence) from mut) + row_number() over (order by s_suppkey) as sequence,
  true as tombstone, '' as value from supplier""")
def erase_blind(spark, sf_dir):
    """Deletes of keys never put: they take sequences and stay as tombstones."""
    log = mut(spark, sf_dir)
    base = log.agg(F.max("sequence")).head()[0]
    keys = read(spark, sf_dir, "supplier").select(F.concat(F.lit("user:"), F.lpad((F.col("s_suppkey") + 5000000).cast("string"), 8, "0")).alias("key"))
    erased = mutate.numbered(mutate.erases(keys), base, "key").select("key", "sequence", "tombstone", "value")
    return reconcile.latest_wins(log.drop("generation").unionByName(erased)).where(F.col("sequence") > base)


# --- mutations


@query("""select event_id, case when length(k) = 0 then 'empty_key' when strlen(k) > 1048576 then 'long_key' when strlen(v) > 16777216 then 'long_value' else 'ok' end as verdict
  from (select event_id, case event_id % 4 when 0 then '' when 1 then case when event_id < 10 then repeat('k', 1048577) else 'k' end else 'k' || event_id end as k,
    case when event_id = 2 then repeat('v', 16777217) else '' end as v from events)""", "")
def validate_mutations(spark, sf_dir):
    e = F.col("event_id")
    key = F.when(e % 4 == 0, "").when((e % 4 == 1) & (e < 10), F.repeat(F.lit("k"), 1048577)).when(e % 4 == 1, "k").otherwise(F.concat(F.lit("k"), e.cast("string")))
    value = F.when(e == 2, F.repeat(F.lit("v"), 16777217)).otherwise("")
    return read(spark, sf_dir, "events").select("event_id", mutate.verdict(key, value).alias("verdict"))


@query("select o_orderkey, 1000 + row_number() over (order by o_orderdate, o_orderkey) as sequence from orders", "")
def sequence_assign(spark, sf_dir):
    return mutate.numbered(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), 1000, "o_orderdate", "o_orderkey").select("o_orderkey", "sequence")


@query("select max(sequence) as sequence from mut")
def sequence_highwater(spark, sf_dir):
    return mut(spark, sf_dir).agg(F.max("sequence").alias("sequence"))


@query("select generation, count(*) as entries, sum(strlen(key) + strlen(value))::bigint as bytes from perg group by 1", MUT + GENERATIONS)
def memtable_bytes(spark, sf_dir):
    return mutate.memtable_bytes(mut(spark, sf_dir), "generation")


@query("select generation, count(*) as entries, max(sequence) as max_sequence, min(key) as min_key, max(key) as max_key from perg group by 1", MUT + GENERATIONS)
def flush_layout(spark, sf_dir):
    return per_generation(spark, sf_dir).groupBy("generation").agg(
        F.count("*").alias("entries"), F.max("sequence").alias("max_sequence"), F.min("key").alias("min_key"), F.max("key").alias("max_key"))


@query("select generation, key, sequence, tombstone, value from perg", MUT + GENERATIONS)
def table_scan(spark, sf_dir):
    """All entries of every generation, tombstones included, in key order within each."""
    return per_generation(spark, sf_dir).select("generation", "key", "sequence", "tombstone", "value").repartitionByRange("generation", "key").sortWithinPartitions("generation", "key")


@query("""select (select count(*) from latest) as memtable_entries, (select sum(strlen(key) + strlen(value))::bigint from latest) as memtable_bytes,
  (select count(distinct generation) from mut) as sstable_count, (select max(sequence) from mut) as sequence""")
def store_stats(spark, sf_dir):
    log = mut(spark, sf_dir)
    newest = mutate.memtable_bytes(log).select(F.col("entries").alias("memtable_entries"), F.col("bytes").alias("memtable_bytes"))
    rest = log.agg(F.countDistinct("generation").alias("sstable_count"), F.max("sequence").alias("sequence"))
    return newest.join(F.broadcast(rest))  # two aggregates of one row


# --- logs and tables

RECORDS = """
rec as (select o_orderkey // 4000 as source, o_orderkey as position, not (o_orderkey % 4000 in (1500, 2500) or o_orderkey = 40) as valid,
  'cust:' || lpad(cast(o_custkey as varchar), 8, '0') as key, o_orderkey + 1 as sequence, o_orderstatus = 'F' as tombstone,
  case when o_orderstatus = 'F' then '' else o_orderpriority end as value from orders),
good as (select * from (select *, bool_and(valid) over (partition by source order by position rows unbounded preceding) as ok from rec) where ok)"""


def records(spark, sf_dir) -> DataFrame:
    """Orders as log records of several logs, some of them bad."""
    at = F.col("sequence") - 1
    bad = (at % ORDER_ROWS).isin(1500, 2500) | (at == 40)
    return omut(spark, sf_dir).withColumns({"source": F.floor(at / ORDER_ROWS), "position": at, "valid": ~bad}).drop("generation")


@query("select source, position, key, sequence from good", RECORDS)
def wal_valid_prefix(spark, sf_dir):
    return checks.valid_prefix(records(spark, sf_dir), "source", "position", "valid").select("source", "position", "key", "sequence")


@query("select key, max(sequence) as sequence, arg_max(tombstone, sequence) as tombstone, arg_max(value, sequence) as value from good group by key", RECORDS)
def wal_replay(spark, sf_dir):
    good = checks.valid_prefix(records(spark, sf_dir), "source", "position", "valid")
    return reconcile.latest_wins(good.select("key", "sequence", "tombstone", "value"))


@query("""select generation, count(*) as entries, max(sequence) as max_sequence, count(*) filter (before >= key) as out_of_order, bool_and(coalesce(before < key, true)) as ordered
  from (select *, lag(key) over (partition by generation order by sequence) as before from mut) group by 1""")
def table_integrity(spark, sf_dir):
    return checks.table_integrity(mut(spark, sf_dir).withColumn("position", F.col("sequence")))


NAMES = """names as (select case p_partkey % 5 when 0 then 'sst-' || p_partkey || '.dat' when 1 then 'sst-' || p_partkey || '.dat.tmp' when 2 then 'sst-x' || p_partkey || '.dat'
  when 3 then 'active.wal' else 'sst-' || lpad(cast(p_partkey as varchar), 9, '0') || '.dat' end as name from part)"""


@query(r"select name, cast(regexp_extract(name, '^sst-(\d+)\.dat$', 1) as bigint) as generation from names where regexp_matches(name, '^sst-(\d+)\.dat$') and cast(regexp_extract(name, '^sst-(\d+)\.dat$', 1) as bigint) > 0", NAMES)
def discover_generations(spark, sf_dir):
    p = F.col("p_partkey")
    text = p.cast("string")
    name = (F.when(p % 5 == 0, F.concat(F.lit("sst-"), text, F.lit(".dat"))).when(p % 5 == 1, F.concat(F.lit("sst-"), text, F.lit(".dat.tmp")))
            .when(p % 5 == 2, F.concat(F.lit("sst-x"), text, F.lit(".dat"))).when(p % 5 == 3, "active.wal").otherwise(F.concat(F.lit("sst-"), F.lpad(text, 9, "0"), F.lit(".dat"))))
    named = read(spark, sf_dir, "part").select(name.alias("name"))
    return named.withColumn("generation", scalar.table_generation(F.col("name"))).where("generation > 0").orderBy(F.desc("generation"))


# --- layout


@query("""select generation, block, min(key) as first_key, count(*) as entries, sum(size)::bigint as bytes from fold group by 1, 2""", """recursive """ + MUT + GENERATIONS + """,
sized as (select generation, key, 20 + strlen(key) + strlen(value) as size, row_number() over (partition by generation order by key) as n from perg),
fold(generation, key, size, n, used, block) as (select generation, key, size, n, size, 0::bigint from sized where n = 1 union all
  select s.generation, s.key, s.size, s.n, case when f.used + s.size > 4096 then s.size else f.used + s.size end, f.block + (f.used + s.size > 4096)::bigint
  from fold f join sized s on s.generation = f.generation and s.n = f.n + 1)""")
def block_packing(spark, sf_dir):
    """Greedy 4096-byte blocks."""
    packed = layout.pack_blocks(per_generation(spark, sf_dir))
    return packed.groupBy("generation", "block").agg(F.min("key").alias("first_key"), F.count("*").alias("entries"), F.sum("record_bytes").alias("bytes"))


@query("""select generation, block, first_key, entries, bytes, (40 + coalesce(sum(bytes) over w, 0))::bigint as "offset", (40 + coalesce(sum(bytes) over w, 0) + bytes)::bigint as "end"
  from idx window w as (partition by generation order by block rows between unbounded preceding and 1 preceding)""", MUT + BLOCKS)
def block_extents(spark, sf_dir):
    return layout.extents(layout.sparse_index(blocks(spark, sf_dir)), 40)


@query("select generation, block, first_key, entries, bytes from idx", MUT + BLOCKS)
def sparse_index(spark, sf_dir):
    return layout.sparse_index(blocks(spark, sf_dir))


@query("""select g.generation, a.key, coalesce(max(i.block), -1) as block from (select distinct generation from idx) g
  cross join (select 'user:' || lpad(cast(s_suppkey * 7 as varchar), 8, '0') as key from supplier) a
  left join idx i on i.generation = g.generation and i.first_key <= a.key group by 1, 2""", MUT + BLOCKS)
def find_block(spark, sf_dir):
    keys = read(spark, sf_dir, "supplier").select(F.concat(F.lit("user:"), F.lpad((F.col("s_suppkey") * 7).cast("string"), 8, "0")).alias("key"))
    return layout.find_block(layout.sparse_index(blocks(spark, sf_dir)), keys.distinct())


@query(f"""select generation, block, first_key, entries, bytes from (select *, lead(first_key) over (partition by generation order by block) as nxt from idx)
  where first_key < '{END}' and (nxt is null or nxt > '{BEGIN}')""", MUT + BLOCKS)
def block_overlap(spark, sf_dir):
    return layout.overlapping(layout.sparse_index(blocks(spark, sf_dir)), BEGIN, END)


TABLE_SIZES = """, t as (select generation, sum(entries)::bigint as entries, count(*) as blocks, sum(12 + strlen(first_key))::bigint as ix, sum(bytes)::bigint as rec from idx group by 1),
m as (select *, 40 + (greatest(64, entries * 10) + 7) // 8 + ix as meta from t)"""


@query("select generation, entries, blocks, meta as metadata_bytes, meta + rec + 4 as file_bytes from m", MUT + BLOCKS + TABLE_SIZES)
def sst_file_size(spark, sf_dir):
    return layout.sizes(blocks(spark, sf_dir), BITS)


@query("select sum(meta)::bigint as metadata_bytes from m", MUT + BLOCKS + TABLE_SIZES)
def table_metadata_bytes(spark, sf_dir):
    return layout.sizes(blocks(spark, sf_dir), BITS).agg(F.sum("metadata_bytes").alias("metadata_bytes"))


@query("""select (row_number() over (order by n, c))::int as event, kind, generation::int as generation from (
  select n, 0 as c, 'flush' as kind, generation - compacted::int as generation from run where flushed union all select n, 1, 'compact', generation from run where compacted)""", """recursive
run(n, used, generation, tables, flushed, compacted) as (select -1, 0, 0, 0, false, false union all
  select n + 1, case when full_ then 0 else size end, generation + full_::int + (full_ and tables + 1 >= 4)::int, case when full_ and tables + 1 >= 4 then 1 else tables + full_::int end, full_, full_ and tables + 1 >= 4
  from (select *, used + 90 + (n + 1) % 21 as size, used + 90 + (n + 1) % 21 >= 1024 as full_ from run where n < 199))""")
def generation_schedule(spark, sf_dir):
    """Flushes and compactions of a run of 200 distinct keys of 90 to 110 bytes."""
    events = layout.flush_schedule([90 + k % 21 for k in range(200)], 1024, 4)
    return spark.createDataFrame(events, "event int, kind string, generation int")


# --- filters


@query("select p_partkey, greatest(64, p_size * (p_partkey % 16 + 1))::bigint as bits, greatest(1, least(12, (p_partkey % 16 + 1) * 69 // 100))::bigint as probes from part", "")
def bloom_sizing(spark, sf_dir):
    per = F.col("p_partkey") % 16 + 1
    return read(spark, sf_dir, "part").select("p_partkey", bloom.bits_for(F.col("p_size"), per).alias("bits"), bloom.probes_for(per).alias("probes"))


@query("""select key, cast(list_reduce(list_transform(range(0, length(key) + 1), lambda i: case when i = 0 then 1469598103934665603::uhugeint else ord(key[i])::uhugeint end),
  lambda h, c: (xor(h, c) * 1099511628211::uhugeint) % 18446744073709551616::uhugeint) as varchar) as hash from latest""")
def bloom_hash(spark, sf_dir):
    keys = mut(spark, sf_dir).select("key").distinct()
    return keys.withColumn("hash", bloom.hash_text(F.col("key")))


HASHES = GENERATIONS + """,
word(m) as (select 18446744073709551616::uhugeint),
hashed as (select generation, key, list_reduce(list_transform(range(0, length(key) + 1), lambda i: case when i = 0 then 1469598103934665603::uhugeint else ord(key[i])::uhugeint end),
  lambda h, c: (xor(h, c) * 1099511628211::uhugeint) % 18446744073709551616::uhugeint) as h from perg),
one as (select *, (xor(h, h // 1073741824::uhugeint) * 13787848793156543929::uhugeint) % m as f1 from hashed, word),
two as (select *, (xor(f1, f1 // 134217728::uhugeint) * 10723151780598845931::uhugeint) % m as f2 from one),
three as (select generation, key, h, m, xor(f2, f2 // 2147483648::uhugeint) as f3 from two),
probe as (select generation, key, i, ((h + i::uhugeint * (f3 + 1 - f3 % 2)) % m) as pos from three, range(6) t(i)),
shape as (select generation, greatest(64, count(*) * 10)::uhugeint as bits from perg group by 1),
body as (select distinct p.generation, p.pos % s.bits as bit from probe p join shape s on p.generation = s.generation),
asked as (select distinct key, i, pos from probe),
found as (select s.generation, a.key, bool_and(b.bit is not null) as maybe from asked a cross join shape s left join body b on b.generation = s.generation and b.bit = a.pos % s.bits group by 1, 2),
member as (select f.*, p.key is not null as held from found f left join perg p on p.generation = f.generation and p.key = f.key)"""


@query("select generation, key, maybe, held from member", MUT + HASHES)
def bloom_membership(spark, sf_dir):
    """Every key against every generation's filter; a key a generation holds is never denied."""
    entries = mut(spark, sf_dir).select("generation", "key")
    return bloom.membership_held(entries, bloom.filter_bytes(entries, BITS))


@query("select generation, count(*) as checks, count(*) filter (not maybe) as negatives, count(*) filter (maybe and not held) as false_positives from member group by 1", MUT + HASHES)
def bloom_stats(spark, sf_dir):
    """Checks, negatives and false positives of each generation's filter over the keys of all."""
    entries = mut(spark, sf_dir).select("generation", "key").distinct()
    asked = bloom.passed(entries.select("key").distinct(), bloom.filter_bytes(entries, BITS))
    held = entries.where("key is not null").groupBy("generation").agg(F.count("*").alias("_held"))  # all of them pass
    return asked.join(held, "generation", "left").select("generation", "checks", (F.col("checks") - F.col("maybe")).alias("negatives"), (F.col("maybe") - F.coalesce("_held", F.lit(0))).alias("false_positives"))


@query("""select key, sequence, xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(range(1, length(key || '=' || value) + 1), lambda i: ord((key || '=' || value)[i])::ubigint)),
  lambda c, b: xor(c // 256, tb[(xor(c, b) % 256 + 1)::int])), 4294967295::ubigint)::bigint as crc from mut, (select list(t order by i) as tb from tab)""", MUT + """,
tab as (select i, list_reduce([i::ubigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c % 2 = 1 then xor(c // 2, 3988292384::ubigint) else c // 2 end) as t from range(256) r(i))""")
def crc32(spark, sf_dir):
    """Checksums of key=value; the tables' texts are ASCII."""
    return mut(spark, sf_dir).select("key", "sequence", F.crc32(F.encode(F.concat("key", F.lit("="), "value"), "UTF-8")).alias("crc"))


# --- comparison

ACK = """, ack as (select key, case when sequence % 7 = 0 then value || '?' else value end as value from latest where sequence % 3 = 0)"""


@query("select a.key, a.value as expected, l.value as actual from ack a left join live l on a.key = l.key where a.value is distinct from l.value", MUT + ACK)
def oracle_verify(spark, sf_dir):
    newest = reconcile.latest_wins(mut(spark, sf_dir))
    acked = newest.where("sequence % 3 = 0").select("key", F.when(F.col("sequence") % 7 == 0, F.concat("value", F.lit("?"))).otherwise(F.col("value")).alias("value"))
    return checks.lost_writes(acked, reconcile.live(newest))


@query("""select coalesce(a.key, l.key) as key, a.value as left_value, l.value as right_value from
  (select key, arg_max(value, sequence) as value from mut where generation = 1 group by key having not arg_max(tombstone, sequence)) a
  full join live l on a.key = l.key where a.value is distinct from l.value or (a.key is null) <> (l.key is null)""")
def differential_replay(spark, sf_dir):
    log = mut(spark, sf_dir)
    return checks.differences(reconcile.view(log.where("generation = 1")), reconcile.view(log))


# --- measurements


@query("""select event_type, count(*) as samples, quantile_disc(value, 0.5)::double as p50, quantile_disc(value, 0.95)::double as p95, quantile_disc(value, 0.99)::double as p99
  from events group by 1""", "")
def percentile_nearest_rank(spark, sf_dir):
    return workload.latency(read(spark, sf_dir, "events"), "event_type", "value")


@query("""select event_type, count(*) as samples, list_sort(list(value))[(1 + floor(0.5 * (count(*) - 1)))::int] as p50,
  list_sort(list(value))[(1 + floor(0.95 * (count(*) - 1)))::int] as p95, list_sort(list(value))[(1 + floor(0.99 * (count(*) - 1)))::int] as p99 from events group by 1""", "")
def percentile_floor(spark, sf_dir):
    return stats.floor_index(read(spark, sf_dir, "events"), "event_type", "value", [0.5, 0.95, 0.99])


PHASES = "p as (select event_type as phase, count(*) as ops, (max(event_id) - min(event_id) + 1)::double as seconds from events group by 1)"


@query("""select phase, ops, ops / (select sum(seconds) from p) as per_second from p
  union all select 'total', sum(ops)::bigint, sum(ops) / sum(seconds) from p""", PHASES)
def throughput(spark, sf_dir):
    phases = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("phase")).agg(
        F.count("*").alias("ops"), (F.max("event_id") - F.min("event_id") + 1).cast("double").alias("seconds"))
    return workload.throughput(phases)


@query("""select case when event_type in ('purchase', 'signup', 'error') then 'write' else 'read' end as op, count(*) as ops from events group by 1""", "")
def workload_mix(spark, sf_dir):
    ops = read(spark, sf_dir, "events").select(F.when(F.col("event_type").isin("purchase", "signup", "error"), "write").otherwise("read").alias("op"))
    return workload.mix(ops)


def _draw(salt: int, n: int) -> str:
    return f"(((sequence * 48271 + {salt}::bigint * 69621) % 2147483647 * 16807 % 2147483647 * 48271 % 2147483647) // 7 % {n})"


@query(f"""select sequence, op, lpad(cast(k as varchar), 20, '0') as key, case when op = 'write' then repeat('x', 16) end as value from (
  select sequence, case when {_draw(20260728, 1_000_000)} < 900000 then 'write' else 'read' end as op, {_draw(20260729, 1000)} as k from range(1, 5001) t(sequence))""", "")
def workload_operations(spark, sf_dir):
    """A generated operation stream by seeded draws."""
    return workload.operations(spark, 5000, 0.9, 1000, 16, 20260728)


# --- formats


@query("""select p_partkey, lpad(cast(p_partkey as varchar), 20, '0') as workload_key, lpad(cast(p_partkey * 1000 as varchar), 12, '0') as reader_key from part""", "")
def key_format(spark, sf_dir):
    return read(spark, sf_dir, "part").select(
        "p_partkey", scalar.workload_key(F.col("p_partkey")).alias("workload_key"), scalar.reader_key(F.col("p_partkey") * 1000).alias("reader_key"))


RAW = """r as (select p_partkey, case p_partkey % 6 when 0 then p_size || 'K' when 1 then p_size || 'm' when 2 then p_size || 'M' when 3 then cast(p_size as varchar)
  when 4 then 'x' || p_size else p_size || 'k' end as raw from part)"""


@query(r"""select p_partkey, raw, case when regexp_extract(raw, '^\s*(\d+)', 1) = '' then 0 else cast(regexp_extract(raw, '^\s*(\d+)', 1) as bigint) *
  case when right(raw, 1) in ('k', 'K') then 1024 when right(raw, 1) in ('m', 'M') then 1048576 else 1 end end::bigint as bytes from r""", RAW)
def parse_size(spark, sf_dir):
    p, n = F.col("p_partkey"), F.col("p_size").cast("string")
    raw = (F.when(p % 6 == 0, F.concat(n, F.lit("K"))).when(p % 6 == 1, F.concat(n, F.lit("m"))).when(p % 6 == 2, F.concat(n, F.lit("M"))).when(p % 6 == 3, n)
           .when(p % 6 == 4, F.concat(F.lit("x"), n)).otherwise(F.concat(n, F.lit("k"))))
    return read(spark, sf_dir, "part").select("p_partkey", raw.alias("raw")).withColumn("bytes", scalar.parse_size(F.col("raw")))


@query("""select p_partkey, case when v >= 1048576 then (v // 1048576) || 'M' when v >= 1024 then (v // 1024) || 'K' else cast(v as varchar) end as label
  from (select p_partkey, p_partkey * p_size * 37 as v from part)""", "")
def size_label(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", scalar.size_label(F.col("p_partkey") * F.col("p_size") * 37).alias("label"))


REPORT_NAMES = """n as (select p_partkey, case p_partkey % 4 when 0 then 'mixed__memtable_' || p_size || 'K.json' when 1 then 'read_heavy__bloom_' || p_size
  when 2 then 'write_heavy__compaction_' || p_size || '.json' else 'mixed__memtable_1__bloom_' || p_size || '.json' end as name from part)"""


@query(r"""select p_partkey, name, case when ok then regexp_extract(name, pat, 1) end as workload, case when ok then regexp_extract(name, pat, 2) end as dimension,
  case when ok then regexp_extract(name, pat, 3) end as raw,
  case when not ok then -1 else (cast(regexp_extract(name, '_(\d+)[KM]?(\.json)?$', 1) as bigint) * case when regexp_extract(name, pat, 3) like '%K' then 1024 when regexp_extract(name, pat, 3) like '%M' then 1048576 else 1 end)::bigint end as value
  from (select *, '^(write_heavy|read_heavy|mixed)__(memtable|bloom|compaction)_(\d+[KM]?)(\.json)?$' as pat,
    regexp_matches(name, '^(write_heavy|read_heavy|mixed)__(memtable|bloom|compaction)_(\d+[KM]?)(\.json)?$') as ok from n)""".replace("pat, 1)", "'^(write_heavy|read_heavy|mixed)__(memtable|bloom|compaction)_(\\d+[KM]?)(\\.json)?$', 1)")
       .replace("pat, 2)", "'^(write_heavy|read_heavy|mixed)__(memtable|bloom|compaction)_(\\d+[KM]?)(\\.json)?$', 2)")
       .replace("pat, 3)", "'^(write_heavy|read_heavy|mixed)__(memtable|bloom|compaction)_(\\d+[KM]?)(\\.json)?$', 3)"), REPORT_NAMES)
def parse_report_name(spark, sf_dir):
    p, n = F.col("p_partkey"), F.col("p_size").cast("string")
    name = (F.when(p % 4 == 0, F.concat(F.lit("mixed__memtable_"), n, F.lit("K.json"))).when(p % 4 == 1, F.concat(F.lit("read_heavy__bloom_"), n))
            .when(p % 4 == 2, F.concat(F.lit("write_heavy__compaction_"), n, F.lit(".json"))).otherwise(F.concat(F.lit("mixed__memtable_1__bloom_"), n, F.lit(".json"))))
    named = read(spark, sf_dir, "part").select("p_partkey", name.alias("name"))
    work, dimension, raw, value = scalar.report_name(F.col("name"))
    return named.select("p_partkey", "name", work.alias("workload"), dimension.alias("dimension"), raw.alias("raw"), F.coalesce(value, F.lit(-1)).alias("value"))


@query("select s_suppkey, s_suppkey * 2 as acknowledged, s_suppkey + 3 as sequence, s_suppkey % 4 as sstables from supplier", "")
def kv_metrics(spark, sf_dir):
    s = F.col("s_suppkey")
    line = F.concat(F.lit("  acknowledged="), (s * 2).cast("string"), F.lit(" note sequence="), (s + 3).cast("string"), F.lit("\tsstables="), (s % 4).cast("string"), F.lit("\n"))
    found = read(spark, sf_dir, "supplier").select("s_suppkey", files.metrics(line).alias("m"))
    return found.select("s_suppkey", *[F.col("m")[k].alias(k) for k in ("acknowledged", "sequence", "sstables")])


@query("""select * from (values ('ops', '20000'), ('write_ratio', '0.9'), ('seed', '7'), ('key_space', '10')) t(name, text)""", "")
def workload_config(spark, sf_dir):
    text = ["# a comment", "ops = 20000", "  write_ratio=0.9\t# most are writes", "", "seed = 6", "seed = 7", "no value here", "key_space =10\r"]
    return files.parse_workload(spark.createDataFrame([(x,) for x in text], "value string").coalesce(1))


@query(r"""select s_suppkey, '{"name":"a\"b\\' || s_suppkey || '\nc","n":' || s_suppkey || '}' as json from supplier""", "")
def report_json(spark, sf_dir):
    name = F.concat(F.lit('a"b\\'), F.col("s_suppkey").cast("string"), F.lit("\nc"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.to_json(F.struct(name.alias("name"), F.col("s_suppkey").alias("n"))).alias("json"))


@query("""select w as workload, d as dimension, v as raw from (values ('write_heavy'), ('read_heavy'), ('mixed')) a(w),
  (values ('memtable', '64K'), ('memtable', '256K'), ('memtable', '1M'), ('memtable', '4M'), ('bloom', '4'), ('bloom', '8'), ('bloom', '10'), ('bloom', '14'),
    ('compaction', '2'), ('compaction', '4'), ('compaction', '8')) b(d, v)""", "")
def sweep_grid(spark, sf_dir):
    return workload.sweep_grid(spark)


# --- reports, made from lineitem as if each ship mode, flag and status were a run

RUNS = """
runs as (select case l_returnflag when 'A' then 'read_heavy' when 'N' then 'mixed' else 'write_heavy' end as run, l_linenumber * 2 as bits, count(*) as writes,
  sum(l_linenumber)::bigint as reads, max(l_suppkey) as bytes_read, min(l_partkey) as meta, max(l_orderkey) as db, count(distinct l_linenumber) as files from lineitem group by 1, 2)"""


def runs(spark, sf_dir, step: int = 0) -> DataFrame:
    """Report rows with integral metrics."""
    flag = F.col("l_returnflag")
    run = F.when(flag == "A", "read_heavy").when(flag == "N", "mixed").otherwise("write_heavy")
    g = read(spark, sf_dir, "lineitem").groupBy(run.alias("run"), (F.col("l_linenumber") * 2).alias("bits")).agg(
        F.count("*").alias("writes"), F.sum("l_linenumber").alias("reads"), F.max("l_suppkey").alias("bytes_read"), F.min("l_partkey").alias("meta"),
        F.max("l_orderkey").alias("db"), F.countDistinct("l_linenumber").alias("files"))
    d = lambda c: c.cast("double")
    lat = lambda c: F.struct(d(c).alias("p50"), d(c * 2).alias("p95"), d(c * 3).alias("p99"))
    w = F.col("writes") + step * F.col("bits")
    results = F.struct(
        d(w + F.col("reads")).alias("total_ops_per_second"), d(w).alias("write_ops_per_second"), d(F.col("reads")).alias("read_ops_per_second"), d(F.col("bits")).alias("read_hit_rate"),
        lat(F.col("bits")).alias("write_latency_us"), lat(F.col("bits") + step).alias("read_latency_us"), F.col("files").alias("sstable_count"), F.col("writes").alias("bloom_checks"),
        F.col("reads").alias("bloom_negative_hits"), F.col("files").alias("sstable_reads"), F.col("bytes_read").alias("sstable_bytes_read"),
        F.when(F.lit(step == 0), F.lit(None)).otherwise(F.col("meta")).alias("table_metadata_bytes"), F.col("db").alias("database_size_bytes"), F.col("files").alias("file_count"))
    return g.select(F.concat(F.col("run"), F.lit("__bloom_"), F.col("bits").cast("string"), F.lit(".json")).alias("file_name"), F.col("run").alias("workload"), results.alias("results"))


@query("""select run, 'bloom' as dimension, bits::bigint as value, cast(bits as varchar) as label, (writes + reads)::double as total_ops_per_second, (bits * 3)::double as write_latency_us_p99,
  (bits * 3)::double as read_latency_us_p99, bits::double as read_hit_rate, files::double as sstable_count, writes::double as bloom_checks, reads::double as bloom_negative_hits,
  files::double as sstable_reads, bytes_read::double as sstable_bytes_read, db::double as database_size_bytes from runs""", RUNS)
def report_summary(spark, sf_dir):
    return reports.summary(runs(spark, sf_dir))


@query("select run, 'bloom' as dimension, bits::bigint as value, (bits * 3)::double as metric from runs", RUNS)
def sweep_series(spark, sf_dir):
    return reports.series(runs(spark, sf_dir), "read_latency_us.p99")


@query("""select file_name, metric, old, new, case when old = 0 and new = 0 then '0' when old = 0 then 'new' else printf('%+.1f%%', (new - old) / old * 100.0) end as change from (
  select run || '__bloom_' || bits || '.json' as file_name, unnest(['total_ops_per_second', 'write_ops_per_second', 'read_ops_per_second', 'read_latency_us.p50', 'read_latency_us.p95',
    'read_latency_us.p99', 'sstable_bytes_read', 'table_metadata_bytes', 'database_size_bytes', 'file_count']) as metric,
  unnest([writes + reads, writes, reads, bits, bits * 2, bits * 3, bytes_read, 0, db, files]::double[]) as old,
  unnest([writes + bits + reads, writes + bits, reads, bits + 1, bits * 2 + 2, bits * 3 + 3, bytes_read, meta, db, files]::double[]) as new from runs where bits > 4)""", RUNS)
def compare_reports(spark, sf_dir):
    old = runs(spark, sf_dir)
    return reports.compare(old, runs(spark, sf_dir, 1).where(~F.col("file_name").rlike("_[24].json$")))


@query("select max(writes) as writes, max(reads) as reads, max(db) as db from runs", RUNS)
def crash_highwater(spark, sf_dir):
    r = runs(spark, sf_dir).select(F.col("results.write_ops_per_second").cast("long").alias("writes"), F.col("results.read_ops_per_second").cast("long").alias("reads"),
                                   F.col("results.database_size_bytes").alias("db"))
    return reports.high_water(r, ["writes", "reads", "db"])


# --- streaming


@query("select key, sequence, tombstone, value from latest")
def stream_latest(spark, sf_dir):
    """The changelog taken in by a stream as generations, then reconciled."""
    import uuid

    from .model import MUTATION
    from .streaming import ingest

    root = f"{ingest.shared_root(spark)}/stream-{uuid.uuid4().hex}"
    mut(spark, sf_dir).select(*MUTATION.names).repartition(4, "sequence").write.mode("overwrite").parquet(f"{root}/in")
    ingest.to_generations(ingest.changes(spark, f"{root}/in", 1), f"{root}/out", f"{root}/check").awaitTermination()
    return reconcile.latest_wins(ingest.generations(spark, f"{root}/out"))
