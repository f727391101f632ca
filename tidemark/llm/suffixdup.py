"""Exact substring removal by a difference cover and blockwise sorting of suffixes.

Every byte that a string of LENGTH bytes covers which also starts anywhere else
is removed.  Suffixes matter to LENGTH bytes only, and of their order only the
ties: which starts have equal first LENGTH bytes.

1. Cover sample: positions p with p mod v in a difference cover.  Two equal
   strings of SHORT bytes or more at i and j have a d < v with i + d and j + d
   both in the sample, and equal bytes from there on to SHORT - v + 1 at least.
   The sample is ranked by that prefix; what counts is whether a rank is shared.
2. Suffix buckets: a start can only tie to LENGTH bytes if every v positions in
   a row from it, as far as whole prefixes fit, hold a sample of shared rank; all
   others are settled by the sample.  The rest are dealt to buckets by an 80-bit
   name of their LENGTH bytes, and one bucket at a time is sorted and its ties found.

Documents are held in packs of PACK_BYTES about.  A pack sends a bucket its sorted
distinct names as one row and gets back a bit for each, so a string that every
document holds is one entry for each pack, and rows are never more than names.
Names are polynomials over 64-bit words with mixing (two bases): equal names count
as equal strings; README has the bound.  Texts under LENGTH bytes lose nothing.
Texts that occur more than once as a whole (by a 128-bit digest) are removed whole,
and only the first pack that holds one sorts its suffixes.

Null text counts as empty; texts are taken whole, whatever their length (a long one
is a pack of its own); repeated rows are copies of each other; doc_id may be null or
repeat; ties need no order; other columns are ignored, whatever their names; an
empty table gives an empty result.
"""
from __future__ import annotations

import hashlib
import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH = 400
COVER_R = 1  # v = 73, 10 of its residues
PACK_BYTES = 6 << 20
BUCKET_BYTES = 6 << 20
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated long"
_SENT = "bucket long, kind int, pack long, names binary, twice binary"
_BACK = "pack long, kind int, bucket long, shared binary, first binary"
_BASES = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xC2B2AE3D27D4EB4F | 1)
SAMPLE, WINDOW, WHOLE = 0, 1, 2


def short(length: int) -> int:
    """Repeated strings of so many bytes show in n_repeated."""
    return length * 3 // 5


def difference_cover(r: int) -> tuple[int, np.ndarray]:
    """v and the cover of Colbourn and Ling: every d < v is a difference mod v of two of its 6r + 4 members."""
    steps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    return 24 * r * r + 36 * r + 13, np.concatenate([[0], np.cumsum(steps)])


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Powers:
    """Powers of a base and of its inverse mod 2^64, as far as needed."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = int(base), pow(int(base), -1, 1 << 64)
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def upto(self, n: int):
        while len(self.up) <= n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))])
        return self.up, self.down


class Rolling:
    """Polynomial hashes of all windows of one text."""

    def __init__(self, data: bytes, powers: Powers):
        n = len(data)
        up, self.down = powers.upto(n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(0x51ED270B)) * up[:n], out=self.sums[1:])

    def at(self, p: np.ndarray, size: int) -> np.ndarray:
        return mix((self.sums[p + size] - self.sums[p]) * self.down[p])


def distinct(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct pairs, whether each comes twice, and which one every entry is."""
    order = np.argsort(high, kind="stable")
    h, m = high[order], low[order]
    same = h[1:] == h[:-1]
    if (same & (m[1:] != m[:-1])).any():
        order = np.lexsort((low, high))
        h, m = high[order], low[order]
        same = (h[1:] == h[:-1]) & (m[1:] == m[:-1])
    first = np.concatenate([[True], ~same]) if len(h) else np.zeros(0, bool)
    place = np.empty(len(h), np.int64)
    place[order] = np.cumsum(first) - 1
    return h[first], m[first], np.bincount(place, minlength=int(first.sum())) > 1, place


class Pack:
    """The texts of a pack, in a fixed order."""

    def __init__(self, texts: list[str], length: int, r: int, powers: tuple[Powers, Powers] | None = None):
        self.data = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.length, self.powers = length, powers or tuple(map(Powers, _BASES))
        self.v, cover = difference_cover(r)
        self.prefix = short(length) - self.v + 1
        self.cover = np.sort(cover)
        whole: dict[bytes, list[int]] = {}
        for k, d in enumerate(self.data):
            if len(d) >= length:
                whole.setdefault(hashlib.blake2b(d, digest_size=16).digest(), []).append(k)
        self.groups = [whole[h] for h in sorted(whole)]  # equal texts
        names = np.frombuffer(b"".join(sorted(whole)), ">u8").astype(np.uint64).reshape(-1, 2)
        self.whole = names[:, 0], names[:, 1]

    def samples(self, k: int) -> np.ndarray:
        n = len(self.data[k]) - self.prefix + 1
        p = (np.arange(-(-n // self.v))[:, None] * self.v + self.cover[None, :]).ravel()
        return p[p < n]

    def sampled(self, buckets: int):
        """Of the distinct texts: names of the cover sample's ranks, whether each comes twice here, and each sample's."""
        each = [Rolling(self.data[g[0]], self.powers[0]).at(self.samples(g[0]), self.prefix) for g in self.groups]
        h = np.concatenate([np.zeros(0, np.uint64), *each]) & ~np.uint64(0) << np.uint64(48 - 8 * sample_width(buckets))
        known, _, twice, place = distinct(h, np.zeros(len(h), np.uint32))
        return known, twice, np.split(place, np.cumsum([len(x) for x in each])[:-1]) if each else []

    def starts(self, places: list[np.ndarray], shared: np.ndarray, take: np.ndarray) -> list[np.ndarray]:
        """For each distinct text (of those to take) the starts that may tie."""
        out, v = [], self.v
        reach = self.length - self.prefix + 1 - v  # the last block of v positions begins here
        steps = sorted({*range(0, reach, v), reach})
        for g, place, use in zip(self.groups, places, take):
            n = len(self.data[g[0]]) - self.length + 1
            p = self.samples(g[0])[shared[place]] if use else ()
            if not len(p):
                out.append(np.zeros(0, np.int64))
                continue
            near = np.zeros(len(self.data[g[0]]) + 2, np.int64)  # positions with a shared sample among the next v
            np.add.at(near, np.maximum(p - v + 1, 0), 1)
            np.add.at(near, p + 1, -1)
            near = np.cumsum(near) > 0
            ok = near[:n].copy()
            for step in steps[1:]:
                ok &= near[step : step + n]
            out.append(np.flatnonzero(ok))
        return out

    def windows(self, starts: list[np.ndarray]):
        each = [(Rolling(d, self.powers[0]).at(p, self.length), (Rolling(d, self.powers[1]).at(p, self.length) >> np.uint64(48)).astype(np.uint16))
                for d, p in ((self.data[g[0]], p) for g, p in zip(self.groups, starts)) if len(p)]
        high = np.concatenate([np.zeros(0, np.uint64), *[e[0] for e in each]])
        low = np.concatenate([np.zeros(0, np.uint16), *[e[1] for e in each]])
        high, low, twice, place = distinct(high, low)
        return high, low, twice, np.split(place, np.cumsum([len(p) for p in starts])[:-1]) if starts else []

    def repeated(self, k: int, place: np.ndarray, shared: np.ndarray) -> int:
        """Bytes of a text that prefixes of shared rank cover."""
        return int(removed(len(self.data[k]), self.samples(k)[shared[place]], self.prefix).sum())


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets in order of the name, from its top 32 bits."""
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def runs_of(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of the runs of a sorted array: only buckets that have names."""
    if not len(bucket):
        return []
    cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
    return list(zip(bucket[cuts[:-1]].tolist(), cuts[:-1].tolist(), cuts[1:].tolist()))


def sample_width(buckets: int) -> int:
    """Bytes of a sample's name below its first 16 bits: more with the buckets, so that false sharing stays as rare."""
    return min(6, 4 + (max(0, buckets.bit_length() - 9) + 7) // 8)


def packed(kind: int, high: np.ndarray, low: np.ndarray, buckets: int) -> bytes:
    """Sorted names: the values of the first 16 bits with their counts, then the bytes below, then the second part."""
    lead, first, counts = np.unique(high >> np.uint64(48), return_index=True, return_counts=True)
    rows = high.astype(">u8").view(np.uint8).reshape(len(high), 8)[:, 2 : 2 + (sample_width(buckets) if kind == SAMPLE else 6)]
    return struct.pack("<II", len(lead), len(high)) + lead.astype("<u2").tobytes() + counts.astype("<u4").tobytes() + rows.tobytes() + (b"" if kind == SAMPLE else low.astype(low.dtype.newbyteorder("<")).tobytes())


def unpacked(kind: int, raw: bytes, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    k, n = struct.unpack_from("<II", raw)
    width = sample_width(buckets) if kind == SAMPLE else 6
    at = 8 + 6 * k
    rows = np.zeros((n, 8), np.uint8)
    rows[:, 2 : 2 + width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(n, width)
    lead = np.repeat(np.frombuffer(raw, "<u2", k, 8).astype(np.uint64), np.frombuffer(raw, "<u4", k, 8 + 2 * k))
    low = np.zeros(n, np.uint32) if kind == SAMPLE else np.frombuffer(raw, "<u2" if kind == WINDOW else "<u8", n, at + n * width)
    return rows.view(">u8").ravel().astype(np.uint64) | lead << np.uint64(48), low


def send(kind: int, pack: int, names, twice: np.ndarray, buckets: int) -> list[tuple]:
    """One row for each bucket that sorted distinct names fall into."""
    high, low = names
    return [(b, kind, pack, packed(kind, high[lo:hi], low[lo:hi], buckets), np.packbits(twice[lo:hi]).tobytes()) for b, lo, hi in runs_of(bucket_of(high, buckets))]


def ties(kind: int, rows: list[tuple[int, bytes, bytes]], buckets: int) -> list[tuple[int, bytes, bytes]]:
    """Sort a bucket: for each pack's row the bits of names that come again, and of those that come here first."""
    parts = [unpacked(kind, raw, buckets) for _, raw, _ in rows]
    sizes = [len(p[0]) for p in parts]
    many = np.concatenate([np.unpackbits(np.frombuffer(t, np.uint8), count=n).astype(bool) for n, (_, _, t) in zip(sizes, rows)])
    place = distinct(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))[3]
    shared = ((np.bincount(place) > 1) | (np.bincount(place, many) > 0))[place]
    first = np.zeros(len(place), bool)
    first[np.unique(place, return_index=True)[1]] = True
    ends = np.cumsum(sizes)
    return [(r[0], np.packbits(shared[e - n : e]).tobytes(), np.packbits(first[e - n : e]).tobytes()) for r, n, e in zip(rows, sizes, ends)]


def bits_back(high: np.ndarray, buckets: int, back: dict[int, bytes]) -> np.ndarray:
    out = np.zeros(len(high), bool)
    for b, lo, hi in runs_of(bucket_of(high, buckets)):
        if b in back:
            out[lo:hi] = np.unpackbits(np.frombuffer(back[b], np.uint8), count=hi - lo).astype(bool)
    return out


def removed(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Mask of the bytes that windows at these starts cover."""
    if not len(starts):
        return np.zeros(n, bool)
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(starts + length, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


class Job:
    """The three passes over a pack; picklable."""

    def __init__(self, length: int, r: int, buckets: int):
        self.length, self.r, self.buckets = length, r, buckets

    def pack(self, docs) -> Pack:
        docs.sort_values(["doc_id", "text"], inplace=True, ignore_index=True)
        return Pack(docs["text"].tolist(), self.length, self.r, common.resident("powers", lambda: tuple(map(Powers, _BASES))))

    def first(self, pack_id: int, docs) -> list[tuple]:
        p = self.pack(docs)
        known, twice, _ = p.sampled(self.buckets)
        several = np.array([len(g) > 1 for g in p.groups], bool)
        return send(SAMPLE, pack_id, (known, np.zeros(len(known), np.uint32)), twice, self.buckets) + send(WHOLE, pack_id, p.whole, several, self.buckets)

    def again(self, p: Pack, back) -> tuple:
        """What the first pass found: distinct texts that are copies, the starts that may tie, samples of shared rank."""
        by = {k: {} for k in (SAMPLE, WINDOW, WHOLE)}
        first = {}
        for kind, bucket, shared, lead in zip(back["kind"], back["bucket"], back["shared"], back["first"]):
            by[kind][bucket] = shared
            if kind == WHOLE:
                first[bucket] = lead
        known, _, places = p.sampled(self.buckets)
        copies = bits_back(p.whole[0], self.buckets, by[WHOLE])
        take = bits_back(p.whole[0], self.buckets, first)
        shared = bits_back(known, self.buckets, by[SAMPLE])
        return copies, p.starts(places, shared, take), by[WINDOW], places, shared

    def second(self, pack_id: int, docs, back) -> list[tuple]:
        p = self.pack(docs)
        high, low, twice, _ = p.windows(self.again(p, back)[1])
        return send(WINDOW, pack_id, (high, low), twice, self.buckets)

    def third(self, docs, back):
        """Mask of removed bytes, and number of repeated ones, of each row of docs (sorted in place)."""
        p = self.pack(docs)
        copies, starts, tied, places, ranks = self.again(p, back)
        high, low, _, each = p.windows(starts)
        shared = bits_back(high, self.buckets, tied)
        masks, repeated = [np.zeros(len(d), bool) for d in p.data], [0] * len(p.data)
        for g, copied, at, own, place in zip(p.groups, copies, starts, each, places):
            k = g[0]
            mask = np.ones(len(p.data[k]), bool) if copied else removed(len(p.data[k]), at[shared[own]], self.length)
            n = len(mask) if copied else p.repeated(k, place, ranks)
            for k in g:
                masks[k], repeated[k] = mask, n
        return p.data, masks, repeated


def passes(docs: DataFrame, length: int, r: int):
    """Packed documents, the bits for each pack, and the job."""
    total, = docs.agg(F.sum(F.octet_length("text").cast("long"))).head()
    packs = max(1, int((total or 0) // PACK_BYTES))
    v, cover = difference_cover(r)
    buckets = max(1, int((total or 0) * 5 * len(cover) / v // BUCKET_BYTES))
    job = Job(length, r, buckets)
    slot = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(packs))
    dealt = docs.select("doc_id", "text", slot.alias("pack")).repartition(packs, "pack")

    def first(key, group):
        import pandas as pd

        return pd.DataFrame(job.first(int(key[0]), group), columns=[c.split()[0] for c in _SENT.split(", ")])

    def second(key, group, back):
        import pandas as pd

        rows = job.second(int(key[0]), group, back) if len(group) else []
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _SENT.split(", ")])

    def bucket(key, group):
        import pandas as pd

        group = group.sort_values("pack")
        rows = ties(int(key[1]), list(zip(group["pack"], group["names"], group["twice"])), buckets)
        return pd.DataFrame([(p, int(key[1]), int(key[0]), s, f if key[1] == WHOLE else b"") for p, s, f in rows], columns=[c.split()[0] for c in _BACK.split(", ")])

    sample = dealt.groupBy("pack").applyInPandas(first, _SENT).groupBy("bucket", "kind").applyInPandas(bucket, _BACK)
    windows = dealt.groupBy("pack").cogroup(sample.groupBy("pack")).applyInPandas(second, _SENT).groupBy("bucket", "kind").applyInPandas(bucket, _BACK)
    return dealt, sample.unionByName(windows), job


def _apply(docs: DataFrame, length: int, r: int, make, schema: str) -> DataFrame:
    docs = common.text_docs(docs)
    dealt, back, job = passes(docs, length, r)

    def third(key, group, back):
        import pandas as pd

        names = [c.split()[0] for c in schema.split(", ")]
        if not len(group):
            return pd.DataFrame([], columns=names)
        data, masks, repeated = job.third(group, back)
        out = pd.DataFrame([make(*row) for row in zip(group["doc_id"], data, masks, repeated)], columns=names)
        common.trim()
        return out

    return dealt.groupBy("pack").cogroup(back.groupBy("pack")).applyInPandas(third, schema)


def _id(i):
    return None if i is None or i != i else int(i)


def strip(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id and the bytes that stay: the operator's general output."""

    def make(i, data, mask, repeated):
        return _id(i), np.frombuffer(data, np.uint8)[~mask].tobytes()

    return _apply(docs, length, COVER_R, make, "doc_id long, kept binary")


def report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """n_repeated: bytes in strings that the cover sample finds again; every repeated string of short(length) bytes has some."""

    def make(i, data, mask, repeated):
        kept = np.frombuffer(data, np.uint8)[~mask].tobytes() if mask.any() else data
        spans = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())
        return _id(i), len(data), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest(), repeated

    return _apply(docs, length, COVER_R, make, SCHEMA)
