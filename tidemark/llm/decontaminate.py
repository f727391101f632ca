"""Benchmark decontamination by greedy string tiling.

Words are lower-cased runs without white space, stripped of signs at both ends.
Documents and benchmark items that share a seed (SEED words in a row; the whole
item if it is shorter) are joined.  A pair is dropped unless its seeds cover
THRESHOLD of the item, an upper bound of what tiles can cover.  On the rest
running Karp-Rabin matching finds the length of the longest match of unmarked
words, marks all matches of that length that do not overlap, in order of item and
text position, and goes on with what is left, to SEED words.  Tiles may lie in any
order, so reordered passages count.  A document is contaminated by an item whose
words its tiles cover to THRESHOLD or more.  Repeated words cost no more than
others: a seed or window is looked up once, however often it occurs.

The benchmark is taken in blocks of BLOCK_BYTES at most, each sent to all
executors, so any size of it works.  Items or documents without a word match
nothing; items of equal words are matched each.  Texts are taken whole, whatever
their length.  Repeated rows give repeated rows; clean() passes all columns,
whatever their names; an empty table on either side gives an empty result (clean()
then keeps all).
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SEED = 5
THRESHOLD = 0.8
BLOCK_BYTES = 8 << 20
CACHE_WORDS = 150_000
SCHEMA = "doc_id long, item_id long, coverage double, n_tiles long, longest long"
_SIGNS = " \t!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»„“”‘’–—…¿¡"
_P = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return [w for w in (x.strip(_SIGNS) for x in (text or "").lower().split()) if w]


def window_hash(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n words in a row."""
    m = len(ids) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(m, n, np.uint64)
    for k in range(n):
        h = (h ^ ids[k : k + m].astype(np.uint64)) * _P
        h ^= h >> np.uint64(31)
    return h


class Block:
    """A block of the benchmark: vocabulary, items as word ids, and seeds in sorted arrays."""

    def __init__(self, items: list[tuple[int, str | None]]):
        self.vocabulary: dict[str, int] = {}
        self.items, self.names = [], []
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            if ids:
                self.items.append(np.array(ids, np.int64))
                self.names.append(item_id)
        self.seeds = {}  # by length: hashes sorted, item, position
        for n in sorted({min(SEED, len(i)) for i in self.items}):
            rows = [(h, k, p) for k, i in enumerate(self.items) if min(SEED, len(i)) == n for p, h in enumerate(window_hash(i, n))]
            h = np.array([r[0] for r in rows], np.uint64)
            order = np.argsort(h, kind="stable")
            self.seeds[n] = (h[order], np.array([r[1] for r in rows])[order], np.array([r[2] for r in rows])[order])
        self.cache: dict[str, int] = {}

    def ids(self, text: str) -> np.ndarray:
        """Word ids of a text: 0 for words no item has; words of signs only are left out."""
        get, cache = self.vocabulary.get, self.cache
        out = []
        for w in text.lower().split():
            i = cache.get(w)
            if i is None:
                bare = w.strip(_SIGNS)
                i = get(bare, 0) if bare else -1
                if len(cache) >= CACHE_WORDS:
                    cache.clear()
                cache[w] = i
            out.append(i)
        ids = np.array(out, np.int64)
        return ids[ids >= 0] if len(ids) else ids

    def candidates(self, ids: np.ndarray) -> dict[int, np.ndarray]:
        """Items whose seeds in the text cover enough of them, with the text positions the seeds cover."""
        out = {}
        for n, (known, item, place) in self.seeds.items():
            full = np.flatnonzero(np.convolve(ids > 0, np.ones(n, int), "valid") == n) if len(ids) >= n else ()
            if not len(full):
                continue
            h = window_hash(ids, n)[full]
            lo = np.searchsorted(known, h, "left")
            hi = np.searchsorted(known, h, "right")
            hit = np.flatnonzero(hi > lo)
            if not len(hit):
                continue
            _, one, which = np.unique(lo[hit], return_index=True, return_inverse=True)
            by: dict[int, tuple[list, set]] = {}
            for k, j in enumerate(hit[one]):  # each seed once
                for r in range(lo[j], hi[j]):
                    at = by.setdefault(int(item[r]), ([], set()))
                    at[0].append(k)
                    at[1].update(range(int(place[r]), int(place[r]) + n))
            for i, (seeds, covered) in by.items():
                if len(covered) >= THRESHOLD * len(self.items[i]):
                    here = full[hit[np.isin(which, seeds)]]
                    edge = np.bincount(here, minlength=len(ids) + 1) - np.bincount(here + n, minlength=len(ids) + 1)
                    out[i] = np.cumsum(edge[: len(ids)]) > 0
        return out


def free_windows(ids: np.ndarray, free: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where n unmarked words in a row begin, and their hashes."""
    if len(ids) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    marks = np.concatenate([[0], np.cumsum(~free)])
    at = np.flatnonzero(marks[n:] == marks[:-n])
    return at, window_hash(ids, n)[at]


def tile(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles (item position, text position, length), no word in two; text words below 0 match nothing."""
    free_i, free_t = np.ones(len(item), bool), text >= 0
    tiles: list[tuple[int, int, int]] = []

    def meet(n: int) -> bool:
        return bool(np.isin(free_windows(item, free_i, n)[1], free_windows(text, free_t, n)[1]).any())

    most = min(len(item), len(text))
    while most >= least and meet(least):
        low, high = least, most + 1  # the longest match has `low` words or more, fewer than `high`
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if meet(mid) else (low, mid)
        at, hashes = free_windows(text, free_t, low)
        where: dict[int, list[int]] = {}
        for p, h in zip(at[::-1].tolist(), hashes[::-1].tolist()):
            where.setdefault(h, []).append(p)  # the first is taken last in
        found = False
        for q, h in zip(*(x.tolist() for x in free_windows(item, free_i, low))):
            places = where.get(h)
            if not places or not free_i[q : q + low].all():
                continue
            while places:
                p = places[-1]
                if not free_t[p : p + low].all():
                    places.pop()  # marked for good
                elif (item[q : q + low] == text[p : p + low]).all():
                    tiles.append((q, p, low))
                    free_i[q : q + low] = free_t[p : p + low] = False
                    found = True
                    places.pop()
                    break
                else:
                    break  # another text of the same hash
        most = low if found else low - 1
    return sorted(tiles)


def match(block: Block, text: str) -> list[tuple[int, float, int, int]]:
    """(item_id, coverage, tiles, longest tile) of the items that contaminate a text."""
    ids = block.ids(text)
    out = []
    for k, mask in block.candidates(ids).items():
        item = block.items[k]
        # runs that seeds cover hold all tiles; a sign of their own keeps them apart
        at = np.flatnonzero(mask)
        cut = np.flatnonzero(np.diff(at) > 1) + 1
        runs = [np.concatenate([ids[r], [-1]]) for r in np.split(at, cut)]
        tiles = tile(item, np.concatenate(runs), min(SEED, len(item)))
        covered = sum(t[2] for t in tiles) / len(item)
        if covered >= THRESHOLD:
            out.append((block.names[k], covered, len(tiles), max(t[2] for t in tiles)))
    return sorted(out)


def blocks(benchmark: DataFrame):
    """The benchmark in blocks of bounded bytes, in order of item_id; the driver holds one at a time."""
    size, rows = 0, []
    for r in benchmark.select("item_id", "text").where("item_id is not null and text is not null").orderBy("item_id", "text").toLocalIterator():
        n = len(r["text"]) * 4
        if rows and size + n > BLOCK_BYTES:
            yield Block(rows)
            size, rows = 0, []
        size += n
        rows.append((r["item_id"], r["text"]))
    if rows:
        yield Block(rows)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item that contaminates it."""
    spark = docs.sparkSession
    docs, out = common.text_docs(docs), None
    for block in blocks(benchmark):
        shared = common.Shared(spark, block)

        def fn(cols, shared=shared):
            rows = [(d, *m) for d, text in zip(*cols) for m in match(shared.get(), text)]
            return {n.split()[0]: [r[k] for r in rows] for k, n in enumerate(SCHEMA.split(", "))}

        found = common.map_rows(docs, fn, SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that no benchmark item contaminates, all columns kept."""
    spark = docs.sparkSession
    for block in blocks(benchmark):
        shared = common.Shared(spark, block)
        name = common.unused(docs, "_contaminated")
        flag = lambda texts, shared=shared, name=name: {name: [bool(t and match(shared.get(), t)) for t in texts]}
        docs = common.extend(docs, "text", flag, f"{name} boolean").where(~F.col(name)).drop(name)
    return docs
