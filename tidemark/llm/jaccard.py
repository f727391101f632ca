"""Exact n-gram Jaccard join: blocked sparse products of documents by shingles.

Documents of equal shingle sets form a class.  Two sets that reach the threshold
differ in at most k shingles, k by their sizes; so if shingles are dealt to more
than k parts by hash, all but k agree whole.  Size classes are a factor of two wide.
A class gives signatures of its k + 1 largest parts in its size class, and in the
next one if it can link there; if it has no more parts than k that are not empty, it
gives these and goes on with more parts.  flat_signatures says why candidate search
is exact.  Candidates are linked to the smallest class of their signature only.
What is connected so in one scheme (two size classes) grows with the table, so it
is parted first: every class has a bitmap of the parities of its shingles' hash
bits, and two bitmaps differ in no more bits than their sets in shingles.  Pairs
whose bitmaps differ in more than a link allows cannot link; what the others
connect is a group.  Members of a group are cut into blocks of BLOCK sets and
BLOCK_SHINGLES shingles, about, and a pair of blocks is a task that
multiplies its document-by-shingle matrices, sums overlaps chunk by chunk of
columns, and keeps the pairs that reach the size-derived bound.  Pairs of classes
that earlier tasks have connected are not compared.  A task gives out a spanning
forest of its links, so no link between components is lost and no group is written
as all its pairs.

Null or wordless texts have an empty set, link with nothing and are their own
component.  Texts are taken whole, whatever their length.  Repeated rows and ties
share a component; it is named by its smallest doc_id.  An empty table gives an
empty result; other columns are ignored.
"""
from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import components

WORDS = 3
PERCENT = 90
SPARE = 2  # parts beyond k + 1, at least
BLOCK = 1024  # classes of a block at most, about
BLOCK_SHINGLES = 500_000  # of a block, about, but for a larger set
SMALL_ROWS = 400  # classes of small groups that share a task, about
BITS_BLOCK = 4096  # classes of a block of bitmaps, about
BITS_BYTES = 8 << 20  # of a block of bitmaps, about
BITS_ROWS = 2000  # classes of small candidate groups that share a task, about
CHUNK = 250_000  # shingles that get their signatures at a time, but for a larger set
COLUMNS = 4096  # of a dense chunk of the product
CACHE_WORDS = 300_000
TAG = np.uint64(63)
_P1, _P2, _P3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHash(dict):
    """Word to 64-bit hash; forgets when full."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str, table: WordHash, words: int) -> np.ndarray:
    """The sorted distinct hashes of the runs of `words` words; of all words, where there are fewer."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()  # lower case of A-Z, ASCII white space: as for bytes
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(table.__getitem__, tokens), np.uint64, len(tokens))
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = mix(out * _P1 + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def size_classes(percent: int, most: int) -> np.ndarray:
    """Last size of each class, twice the first at least, so that sizes that can link are in one class or the next."""
    ends, low = [], 1
    while not ends or ends[-1] < most:
        ends.append(max(low * 100 // percent, 2 * low))
        low = ends[-1] + 1
    return np.array(ends)


_ENDS: dict[int, np.ndarray] = {}


def class_of(n: int, percent: int) -> tuple[int, np.ndarray]:
    """The size class of a set of n shingles, and the classes' last sizes."""
    ends = _ENDS.get(percent)
    if ends is None or ends[-2] < n:
        ends = _ENDS[percent] = size_classes(percent, 4 * n + 1000)
    return int(np.searchsorted(ends, n)), ends


def differ(n, partner, percent: int):
    """In how many shingles a set of n and a linked one of up to `partner` differ at most."""
    return (n + partner) * (100 - percent) // (100 + percent)


@functools.cache
def scheme_of(scheme: int, percent: int) -> tuple[int, int]:
    """In how many shingles linked sets of a scheme differ at most, and spare parts, so that few of its sets have too few full ones."""
    _, ends = class_of(1, percent)
    while len(ends) <= scheme:
        _, ends = class_of(int(ends[-1]) + 1, percent)
    end = int(ends[scheme])
    least = int(ends[scheme - 1] + 1) * percent // 100 if scheme else 1
    most = differ(end, end, percent)
    spare = SPARE + most // 8
    while most and spare < 2 * most + 16:  # mean and deviation of the full parts of its largest and smallest sets
        parts, enough = most + 1 + spare, True
        for n in (least, end):
            none = math.exp(-n / parts)
            full = parts * (1 - none) - 2 * math.sqrt(parts * none * max(0, 1 - (1 + n / parts) * none))
            enough &= full > differ(n, min(end, n * 100 // percent), percent)
        if enough:
            break
        spare += 1 + spare // 8
    return most, spare


def slots_of(set_id: np.ndarray, scheme: np.ndarray) -> np.ndarray:
    """What stands for a class in a scheme: a class has two at most, so groups never span more than two size classes."""
    return mix(set_id.view(np.uint64) + scheme.astype(np.uint64) * _P3).view(np.int64)


def sets_of(slot: np.ndarray, scheme: np.ndarray) -> np.ndarray:
    """The set ids of slots of known schemes: slots_of the other way round."""
    h = slot.view(np.uint64)
    for shift, factor in ((31, 0x94D049BB133111EB), (27, 0xBF58476D1CE4E5B9)):
        h = (h ^ (h >> np.uint64(shift)) ^ (h >> np.uint64(2 * shift))) * np.uint64(pow(factor, -1, 1 << 64))
    h = h ^ (h >> np.uint64(30)) ^ (h >> np.uint64(60))
    return (h - scheme.astype(np.uint64) * _P3).view(np.int64)


def signatures(s: np.ndarray, percent: int) -> list[tuple[int, np.ndarray]]:
    """Signatures of a set's parts in each of its schemes, but for those where only equal sets link: they are one class."""
    _, schemes, sig = flat_signatures(s, np.array([len(s)]), percent)
    return [(k, sig[schemes == k]) for k in np.unique(schemes).tolist() if scheme_of(k, percent)[0]]


def flat_signatures(s: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, scheme, signature of sets that stand in s one after the other.

    A set gives its largest parts in the scheme of its size class, and of the next
    if sizes of that can link with it: one part more than it can differ in from a
    linked set of the scheme, and all that are not empty if there are no more, and
    then again with twice the spare parts.  Parts are ordered by size and number, so
    parts that agree stand alike: of two sets, take that whose last part stands higher;
    one of its parts agrees, and the other gives that too.  Where only equal sets
    link, the whole set gives the signature.  A signature's low bits (TAG) are its scheme.
    """
    _, ends = class_of(int(sizes.max()), percent)
    own, begin, reach = np.searchsorted(ends, sizes), np.cumsum(sizes) - sizes, sizes * 100 // percent
    found = []
    for scheme in np.unique(np.concatenate([own, own[reach > ends[own]] + 1])).tolist():
        rows = np.flatnonzero((own == scheme) | (own + 1 == scheme) & (reach > ends[own]))
        need = differ(sizes, np.minimum(reach, ends[scheme]), percent) + 1
        most, spare = scheme_of(scheme, percent)
        while len(rows):
            n, parts = sizes[rows], most + 1 + spare if most else 1
            x = s[np.repeat(begin[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            salt = mix(np.array([scheme + 1 + (spare << 32)], np.uint64))
            part = ((mix(x * _P3 + salt) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            key = np.repeat(np.arange(len(rows)) * parts, n) + part
            size = np.bincount(key, minlength=len(rows) * parts).reshape(-1, parts)
            place = size * parts + np.arange(parts)
            last = np.sort(place, axis=1)[np.arange(len(rows)), parts - need[rows]]
            given = (size > 0) & (place >= last[:, None])
            at, number = np.nonzero(given)
            a, b = (np.bincount(key, half.astype(float), len(rows) * parts)[given.ravel()].astype(np.uint64) for half in (x & np.uint64(0xFFFFFFFF), x >> np.uint64(32)))
            sig = mix(mix(a * _P1 + number.astype(np.uint64)) + b * _P2 + salt)
            found.append((rows[at], np.full(len(at), scheme), sig & ~TAG | np.uint64(scheme)))
            rows = rows[given.sum(axis=1) < need[rows]]
            spare *= 2
    row, schemes, sig = map(np.concatenate, zip(*found))
    return row, schemes, sig


def set_ids(s: np.ndarray, seed: int) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_intdigest(s.tobytes(), seed)
    return (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)


def parities(s: np.ndarray) -> bytes:
    """For each value of the hashes' low bits, whether the set has an odd number of them; one to two bits a shingle, 64 at least."""
    width = 64 << max(0, (len(s) - 1) // 64).bit_length()
    return np.packbits(np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width).astype(np.uint8) & 1).tobytes()


def folded(bitmaps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of words, all brought to the width of the narrowest."""
    width = min(map(len, bitmaps))
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(b, np.uint64).reshape(-1, width // 8), axis=0) for b in bitmaps])


def classes(docs: DataFrame, words: int) -> tuple[DataFrame, int]:
    """doc_id, n_shingles, set_id, bits of every document, and the seed by which set ids are free of collisions."""
    seed = 0
    while True:

        def fn(cols, seed=seed):
            table = common.resident("words", WordHash)
            out = {"doc_id": cols[0], "n_shingles": [], "set_id": [], "proof": [], "bits": []}
            for text in cols[1]:
                s = shingles(text, table, words)
                i, proof = set_ids(s, seed)
                for name, value in (("n_shingles", len(s)), ("set_id", i), ("proof", proof), ("bits", parities(s))):
                    out[name].append(value)
            return out

        found = common.saved(common.map_rows(docs, fn, "doc_id long, n_shingles long, set_id long, proof long, bits binary"), "sets")
        if found.groupBy("set_id").agg(F.min("proof").alias("low"), F.max("proof").alias("high")).where("low <> high").isEmpty():
            return found.drop("proof"), seed
        seed += 1


def starred(sig: np.ndarray, own: np.ndarray, before: bool = False) -> dict:
    """sig, id: each signature of a batch once, with its smallest id, and links within the batch as signatures of two rows.

    Links are those to the smallest and, if asked for, to the predecessor.
    """
    order = np.lexsort((own, sig))
    sig, own = sig[order], own[order]
    first = np.ones(len(sig), bool)
    first[1:] = sig[1:] != sig[:-1]
    hub = own[np.flatnonzero(first)][np.cumsum(first) - 1]
    at = np.flatnonzero(~first)
    pairs = [np.stack([own[at], other, (sig[at] & TAG).view(np.int64)], axis=1) for other in ((hub[at], own[at - 1]) if before else (hub[at],))]
    pairs = np.concatenate(pairs)
    pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
    made = mix(mix(pairs[:, 0].astype(np.uint64) * _P1) + pairs[:, 1].astype(np.uint64) * _P2) & ~TAG | pairs[:, 2].astype(np.uint64)
    sig = np.concatenate([sig[first], made, made])
    own = np.concatenate([own[first], pairs[:, 0], pairs[:, 1]])
    return {"sig": sig.view(np.int64), "id": own}


def hub_edges(rows: DataFrame, before: int = -1) -> DataFrame:
    """a, b, scheme: the ids of rows (sig, id), joined to the smallest of each signature; in the scheme `before` also to the predecessor."""

    def run(batches):
        import pyarrow as pa

        last, hub, prior = None, 0, 0  # of the row before
        for batch in batches:
            sig, own = (c.to_numpy() for c in batch.columns)
            if not len(sig):
                continue
            first = np.ones(len(sig), bool)
            first[1:], first[0] = sig[1:] != sig[:-1], last is None or sig[0] != last
            hubs = np.concatenate([[hub], own[first]])[np.cumsum(first)]
            priors = np.concatenate([[prior], own[:-1]])
            last, hub, prior = sig[-1], hubs[-1], own[-1]
            at = np.flatnonzero(~first & (own != hubs))
            more = at[((sig[at] & 63) == before) & (priors[at] != hubs[at]) & (priors[at] != own[at])]
            both = np.concatenate([at, more])
            out = own[both], np.concatenate([hubs[at], priors[more]]), (sig[both] & 63)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b", "scheme"])

    return rows.repartition("sig").sortWithinPartitions("sig", "id").mapInArrow(run, "a long, b long, scheme long").distinct()


def candidate_edges(docs: DataFrame, words: int, percent: int, seed: int) -> DataFrame:
    """a, b: slots joined to the smallest slot of a signature they share.

    A batch gives each signature once, with its smallest class, so a signature that
    a third of all documents have makes as many rows as there are batches.
    """

    def fn(cols):
        table, known, sigs, own = common.resident("words", WordHash), set(), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        ids, sets, size = [], [], 0

        def flush():
            if ids:
                row, scheme, sig = flat_signatures(np.concatenate(sets), np.array([len(s) for s in sets]), percent)
                some = np.isin(scheme, [k for k in np.unique(scheme).tolist() if scheme_of(k, percent)[0]])  # else only equal sets link, and they are one class
                sigs.append(sig[some])
                own.append(slots_of(np.array(ids, np.int64)[row[some]], scheme[some]))
                ids.clear(), sets.clear()

        for text in cols[0]:
            s = shingles(text, table, words)
            i = set_ids(s, seed)[0]
            if len(s) and i not in known:
                known.add(i)
                ids.append(i)
                sets.append(s)
                size += len(s)
            if size >= CHUNK:
                flush()
                size = 0
        flush()
        return starred(np.concatenate(sigs), np.concatenate(own))

    rows = common.map_rows(docs.select("text"), fn, "sig long, id long", 16 << 20)
    return hub_edges(rows)


def linked(ids: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among some sets, by a sparse product taken in chunks of columns."""
    n = len(ids)
    sizes = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(n), sizes)
    columns, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = count[column] > 1  # a shingle of one document adds to no overlap
    row, column = row[keep], column[keep]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    names = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]])) if len(column) else column
    overlap = np.zeros((n, n), np.float32)
    for low in range(0, int(names[-1]) + 1 if len(names) else 0, COLUMNS):
        a, b = np.searchsorted(names, [low, low + COLUMNS])
        dense = np.zeros((n, COLUMNS), np.float32)
        dense[row[a:b], names[a:b] - low] = 1
        overlap += dense @ dense.T
    overlap = overlap.astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - overlap
    x, y = np.nonzero(np.triu(100 * overlap >= percent * union, 1))
    top = list(range(n))

    def find(v):
        while top[v] != v:
            top[v] = top[top[v]]
            v = top[v]
        return v

    out = []
    for a, b in zip(x.tolist(), y.tolist()):
        ra, rb = find(a), find(b)
        if ra != rb:
            top[max(ra, rb)] = min(ra, rb)
            out.append((ids[a], ids[b]))
    return out


def slots(sets: DataFrame, percent: int) -> DataFrame:
    """node, set_id, n, bits: the slots of every class, one or two."""

    def fn(cols):
        ids, sizes = np.array(cols[0], np.int64), np.array(cols[1], np.int64)
        _, ends = class_of(int(sizes.max(initial=1)), percent)
        own = np.searchsorted(ends, sizes)
        again = np.flatnonzero(sizes * 100 // percent > ends[own])
        rows = np.concatenate([np.arange(len(ids)), again]).tolist()
        return {"node": np.concatenate([slots_of(ids, own), slots_of(ids[again], own[again] + 1)]), **{name: [col[k] for k in rows] for name, col in zip(("set_id", "n", "bits"), cols)}}

    one = sets.select("set_id", "n_shingles", "bits").dropDuplicates(["set_id"])
    return common.map_rows(one, fn, "node long, set_id long, n long, bits binary")


def alike(sizes: np.ndarray, bits: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of left and right rows (rows of sizes and bits) whose bitmaps do not rule a link out."""
    right = right[np.argsort(sizes[right], kind="stable")]
    order, label, out = sizes[right], np.arange(len(sizes)), []
    maps = np.ascontiguousarray(bits[right])
    low = np.searchsorted(order, -(-sizes[left] * percent // 100))
    high = np.searchsorted(order, sizes[left] * 100 // percent, "right")
    for i, a, b in zip(left.tolist(), low.tolist(), high.tolist()):
        differ = np.bitwise_count(maps[a:b] ^ bits[i]).sum(axis=1, dtype=np.int64)
        near = right[a:b][differ * (100 + percent) <= (order[a:b] + sizes[i]) * (100 - percent)]
        near = near[label[near] != label[i]]
        if len(near):
            names, at = np.unique(label[near], return_index=True)
            out += [(i, int(j)) for j in near[at]]
            label[np.isin(label, names)] = label[i]
    return out


def parted(groups: DataFrame, slot: DataFrame, percent: int) -> DataFrame:
    """node, component of what bitmaps leave connected in candidate groups (node, component), block pair by block pair."""
    spark = groups.sparkSession
    blocks = F.greatest(F.ceil(F.count("*") / BITS_BLOCK), F.ceil(F.sum(F.length("bits")) / BITS_BYTES)).cast("int")
    placed = common.saved(groups.join(slot, "node").select("component", "node", "n", "bits"), "bitmaps")
    tasks = max(1, placed.count() // BITS_ROWS)
    cut = placed.join(placed.groupBy("component").agg(blocks.alias("blocks")), "component")
    cut = cut.withColumn("own", F.pmod(F.xxhash64("node", F.lit("bits")), F.col("blocks")).cast("int"))
    with_all = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda y: F.struct(F.least("own", y).alias("x"), F.greatest("own", y).alias("y")))
    task = F.when(F.col("blocks") > 1, F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(tasks)))
    dealt = cut.withColumn("task", task).withColumn("_p", F.explode(with_all)).select("component", "node", "n", "bits", "own", "task", "_p.x", "_p.y")

    def compare(group):
        import pandas as pd

        out = []
        for _, part in group.groupby("component", sort=True):
            own, nodes, sizes = part["own"].to_numpy(), part["node"].to_numpy(), part["n"].to_numpy()
            left, right = np.flatnonzero(own == part["x"].iloc[0]), np.flatnonzero(own == part["y"].iloc[0])
            if len(left) and len(right):
                out += [(nodes[i], nodes[j]) for i, j in alike(sizes, folded(part["bits"].tolist()), left, right, percent)]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    forest = common.saved(dealt.groupBy("task", "x", "y").applyInPandas(compare, "a long, b long"), "alike")
    common.drop_saved(spark, placed)
    common.free(spark)
    return components(forest)


def gathered(docs: DataFrame, sets: DataFrame, members: DataFrame, words: int, seed: int) -> DataFrame:
    """component, blocks, set_id, shingles of members (component, blocks, set_id), made from one document of each class."""
    least = sets.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"))
    by_set = members.groupBy("set_id").agg(F.collect_list(F.struct("component", "blocks")).alias("groups"))  # two at most
    stands = common.saved(least.join(by_set, "set_id").select("doc_id", "set_id", "groups"), "stands")
    # doc_id may repeat with other texts: the set id is checked again
    texts = common.marked(docs, "doc_id", stands.select("doc_id"), "_mark").where("_mark").join(stands, "doc_id")

    def gather(cols):
        table, out = common.resident("words", WordHash), {"set_id": [], "groups": [], "shingles": []}
        for text, *rest in zip(*cols):
            s = shingles(text, table, words)
            if set_ids(s, seed)[0] == rest[0]:
                for name, value in zip(out, (*rest, s.tobytes())):
                    out[name].append(value)
        return out

    arrays = common.map_rows(texts.select("text", "set_id", "groups"), gather, "set_id long, groups array<struct<component:long,blocks:int>>, shingles binary")
    return arrays.select("set_id", "shingles", F.explode("groups").alias("_g")).select("_g.component", "_g.blocks", "set_id", "shingles")


def products(dealt: DataFrame, percent: int) -> DataFrame:
    """a, b: spanning forests of the links among the sets of each task (task, x, y), component by component."""

    def product(group):
        import pandas as pd

        out = []
        for _, part in group.drop_duplicates(["component", "set_id"]).groupby("component", sort=True):
            part = part.sort_values("set_id")
            out += linked(part["set_id"].tolist(), [np.frombuffer(b, np.uint64) for b in part["shingles"]], percent)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return dealt.select("component", "set_id", "shingles", "task", "x", "y").groupBy("task", "x", "y").applyInPandas(product, "a long, b long")


def links(sets: DataFrame, groups: DataFrame, percent: int, gather) -> DataFrame:
    """a, b: links that connect all linked classes of each candidate group, block pair by block pair.

    gather(component, blocks, set_id of members) adds their sorted shingles.

    A group of one block is a task's.  In a larger one every block is first compared
    with block 0, which takes two copies of the group; classes that are connected so
    need no comparison among themselves, so then only those outside the group's main
    cluster are compared, with all.
    """
    spark = sets.sparkSession
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    slot = common.saved(slots(sets, percent).join(groups.select("node"), "node", "left_semi"), "slots")
    placed = common.saved(parted(groups, slot, percent).join(slot, "node").select("component", "set_id", "n"), "placed")
    common.drop_saved(spark, slot)
    members = common.saved(placed.join(placed.groupBy("component").agg(blocks.alias("blocks")), "component"), "members")
    rows, total = placed.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    tasks = max(1, rows // SMALL_ROWS, total // BLOCK_SHINGLES)
    arrays = common.saved(gather(members).withColumn("own", F.pmod(F.xxhash64("set_id", F.lit("block")), F.col("blocks")).cast("int")), "arrays")
    common.free(spark)
    small = arrays.where("blocks = 1")
    small = small.withColumns({"task": F.pmod(F.xxhash64("component"), F.lit(tasks)), "x": F.lit(-1), "y": F.lit(-1)})
    forest = common.saved(products(small, percent), "links")
    common.free(spark)
    many = members.where("blocks > 1")
    if many.isEmpty():
        return forest
    arrays = arrays.where("blocks > 1")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    others = F.when(F.col("own") == 0, F.when(F.col("blocks") > 1, F.sequence(F.lit(1), F.col("blocks") - 1)).otherwise(F.array(F.lit(0)))).otherwise(F.array("own"))
    first = arrays.withColumn("y", F.explode(others)).withColumn("x", F.lit(0)).withColumn("task", F.col("component"))
    found = common.saved(products(first, percent), "links")
    common.free(spark)
    clusters = components(found).withColumnRenamed("component", "cluster")
    placed = many.join(clusters, F.col("set_id") == F.col("node"), "left").select("component", "set_id", "n", F.coalesce("cluster", "set_id").alias("cluster"))
    main = placed.groupBy("component", "cluster").agg(F.count("*").alias("n")).groupBy("component").agg(F.max_by("cluster", F.struct("n", "cluster")).alias("main"))
    outside = placed.join(main, "component").select("component", "set_id", "n", (F.col("cluster") != F.col("main")).alias("outside"))
    rests = outside.where("outside").groupBy("component").agg(blocks.alias("rests"))
    tagged = arrays.join(outside.drop("n").join(rests, "component"), ["component", "set_id"])  # sets are dealt once
    at = F.pmod(F.xxhash64("set_id", F.lit("rest")), F.col("rests")).cast("int")
    as_any = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda x: F.struct(x.alias("x"), F.col("own").alias("y")))
    as_rest = F.when(F.col("outside"), F.transform(every, lambda y: F.struct(F.col("at").alias("x"), y.alias("y")))).otherwise(F.array().cast("array<struct<x:int,y:int>>"))
    both = tagged.withColumn("at", at).withColumn("_p", F.explode(F.array_union(as_any, as_rest))).select("component", "set_id", "shingles", "_p.x", "_p.y")
    last = common.saved(products(both.withColumn("task", F.col("component")), percent), "links")
    return forest.unionByName(found).unionByName(last)


def join_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    docs = common.text_docs(docs)
    sets, seed = classes(docs, words)
    common.free(docs.sparkSession)
    groups = components(candidate_edges(docs, words, percent, seed))
    common.free(docs.sparkSession)
    some = sets.where("n_shingles > 0")
    forest = links(some, groups, percent, lambda members: gathered(docs, some, members, words, seed))
    common.free(docs.sparkSession)
    joined = components(forest)
    named = sets.join(joined, F.col("set_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "set_id").alias("_key"))
    least = named.where("n_shingles > 0").groupBy("_key").agg(F.min("doc_id").alias("_least"))
    return named.join(least, "_key", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("_least")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that name their component, all columns kept whatever their names; of rows equal in doc_id and text one stays.

    Rows without a doc_id name nothing and all stay.  Only rows whose doc_id goes, or
    stands on several rows, are moved to be joined, and few others.
    """
    odd, mark = common.unused(docs, "_odd"), common.unused(docs, "_mark")
    found = join_components(docs.where("doc_id is not null"), words, percent)
    counts = found.groupBy("doc_id").agg(F.count("*").alias("rows"), F.max(F.col("doc_id") == F.col("component_id")).alias("stays"))
    names = common.saved(counts.where("rows > 1 or not stays").withColumnRenamed("doc_id", odd), "names")
    marked = common.marked(docs, "doc_id", names.select(odd), mark)
    to_join = F.col(mark) & F.col("doc_id").isNotNull()
    kept, moved = marked.where(~to_join).drop(mark), marked.where(to_join).drop(mark)
    moved = moved.join(names.where("not stays"), F.col("doc_id") == F.col(odd), "left_anti")
    if not names.where("rows > 1").isEmpty():
        moved = moved.dropDuplicates(["doc_id", "text"])
    return kept.union(moved)
