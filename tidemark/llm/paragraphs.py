"""Near-duplicate paragraphs: MinHash banding, exact Jaccard, components, removal.

A paragraph is a line with a word.  Equal word sequences are one node.  Nodes of
WORDS words or more get BANDS signatures of ROWS minima each over their shingles
of WORDS words; at a Jaccard similarity of PERCENT / 100 = 0.8 a pair meets with
probability 1 - (1 - 0.8^ROWS)^BANDS = 0.998.  In each band bucket a node is
compared with the bucket's smallest node and its predecessor, on exact shingle
sets.  The links that bands and buckets leave out come from the exact candidate
search of jaccard.py: signatures of parts, of which a linked pair shares one at
least, bitmaps, and products block by block.  Nodes linked so form components.  Of each component the first occurrence
(by doc_id, then line) stays.  The others are removed where a run of neighbouring
repeated paragraphs has RUN_WORDS words or more, so short common lines stay.

Buckets are never compared pair by pair: a map batch gives a signature once, with
its smallest node, and links within the batch by itself.

Null and empty texts have no paragraph.  Rows that repeat doc_id and text count
once and are reported each; rows without a doc_id lose nothing; an empty table
gives an empty result.  Node ids are
64-bit hashes of the words.
"""
from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .components import components
from .jaccard import TAG, flat_signatures, hub_edges, links, mix, parities, sets_of, slots_of, starred

WORDS = 5
PERCENT = 80
BANDS, ROWS = 12, 4
RUN_WORDS = 40
REACH = 4  # pieces have 5 words or more, 9 about
EDGE = 10  # words of a passage beyond its outermost cut, about
CHUNK = 1 << 19  # characters that are cut into words at a time, but for a longer text
LONG = 32  # bytes of a word that are hashed by table
BAND = 63  # the scheme of band signatures
_WORD = re.compile(rb"[^ \t\n\r\x0b\x0c]+")
SCHEMA = "doc_id long, n_paragraphs long, n_repeated long, n_removed long, words_removed long, kept_sha256 string"


def tokens(line: str) -> list[bytes]:
    return line.encode("utf-8", "surrogatepass").lower().split()


_TABLE = np.random.default_rng(11).integers(0, 1 << 64, LONG * 256, dtype=np.uint64)
_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Parsed:
    """The words of some texts, one text after the other, in arrays: words() of lower-case UTF-8 as by tokens().

    hash: of each word; begin, sizes: first word and number of words of every paragraph;
    text, line: its text and line.
    """

    def __init__(self, texts: list[str]):
        import xxhash

        raw = [x.encode("utf-8", "surrogatepass").lower() for x in texts]
        self.bytes = b"\n".join(raw) + b"\n"
        data = np.frombuffer(self.bytes, np.uint8)
        space = _SPACE[data]
        edges = np.flatnonzero(np.diff(space, prepend=True))
        self.start, self.end = edges[::2], edges[1::2]
        length = self.end - self.start
        first = np.cumsum(length) - length
        inside = np.flatnonzero(~space)
        place = np.arange(len(inside)) - np.repeat(first, length)
        value = _TABLE.take(np.minimum(place, LONG - 1) * 256 + data[inside])
        h = np.add.reduceat(value, first) if len(first) else np.zeros(0, np.uint64)
        self.hash = mix(h + length.astype(np.uint64) * _P1)
        for k in np.flatnonzero(length > LONG).tolist():
            self.hash[k] = xxhash.xxh64_intdigest(self.bytes[self.start[k] : self.end[k]])
        breaks = np.flatnonzero(data == 10)
        of = np.searchsorted(breaks, self.start)  # the line of each word, counted through all texts
        self.begin = np.flatnonzero(np.diff(of, prepend=-1))
        self.sizes = np.diff(np.append(self.begin, len(of)))
        ends = np.cumsum([len(x) + 1 for x in raw])
        self.text = np.searchsorted(ends, self.start[self.begin], "right")
        self.line = of[self.begin] - np.searchsorted(breaks, np.concatenate([[0], ends]))[self.text]

    def nodes(self) -> np.ndarray:
        return sequence_ids(self.hash, self.begin, self.sizes)

    def body(self, k: int) -> bytes:
        """A paragraph's words with spaces."""
        return b" ".join(self.bytes[self.start[self.begin[k]] : self.end[self.begin[k] + self.sizes[k] - 1]].split())


def sequence_ids(h: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of words that follow each other."""
    if not len(begin):
        return np.zeros(0, np.int64)
    place = (np.arange(len(h)) - np.repeat(begin, sizes)).astype(np.uint64)
    return mix(np.add.reduceat(mix(h + place * _P2), begin) + sizes.astype(np.uint64)).view(np.int64)


def node_id(words: list[bytes]) -> int:
    return int(Parsed([b" ".join(words).decode("utf-8", "surrogatepass")]).nodes()[0])


def chunks(texts: list[str]):
    """texts, and the number of the first, CHUNK characters about at a time."""
    low, size = 0, 0
    for k, x in enumerate(texts):
        size += len(x)
        if size >= CHUNK or k == len(texts) - 1:
            yield low, texts[low : k + 1]
            low, size = k + 1, 0


def shingles_of(h: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of paragraphs of WORDS words or more, one after the other, and where each begins."""
    m = max(0, len(h) - WORDS + 1)
    out = np.full(m, WORDS, np.uint64)
    for k in range(WORDS):
        out = mix(out * _P1 + h[k : m + k])
    counts = np.maximum(sizes - WORDS + 1, 0)
    at = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    counts = counts[counts > 0]
    return out[at], np.cumsum(counts) - counts


def shingle_sets(lines: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """shingles_of lines of WORDS words or more."""
    p = Parsed([b"\n".join(b" ".join(w) for w in lines).decode("utf-8", "surrogatepass")])
    return shingles_of(p.hash, p.begin, p.sizes)


def band_signatures(lines: list[list[bytes]], table=None) -> np.ndarray:
    """For each line BANDS hashes; words need no table."""
    return banded(*shingle_sets(lines))


def banded(s: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """BANDS hashes, of the least of ROWS permutations each, for each line's shingles."""
    odd = np.random.default_rng(7).integers(1, 1 << 32, (BANDS * ROWS, 2), dtype=np.uint32) | np.uint32(1)
    s, x, y = (s >> np.uint64(32)).astype(np.uint32), np.empty(len(s), np.uint32), np.empty(len(s), np.uint32)
    out = np.zeros((len(begin), BANDS), np.uint64)
    for band in range(BANDS):
        sig = np.full(len(begin), band + 1, np.uint64)
        for k in range(band * ROWS, band * ROWS + ROWS):
            np.multiply(s, odd[k, 0], out=x)
            np.right_shift(x, np.uint32(15), out=y)
            np.bitwise_xor(x, y, out=x)
            np.multiply(x, odd[k, 1], out=x)
            np.right_shift(x, np.uint32(16), out=y)
            np.bitwise_xor(x, y, out=x)
            sig = mix(sig * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(x, begin))
        out[:, band] = sig
    return out


def similar(a: list[bytes], b: list[bytes], percent: int = PERCENT) -> bool:
    """Exact Jaccard of the shingle sets."""
    x = set(zip(*(a[k:] for k in range(WORDS))))
    y = set(zip(*(b[k:] for k in range(WORDS))))
    both = len(x & y)
    return 100 * both >= percent * (len(x) + len(y) - both)


def lines_of(text: str) -> list[tuple[int, list[bytes]]]:
    return [(k, w) for k, line in enumerate(text.split("\n")) if (w := tokens(line))]


def cut(docs: DataFrame) -> DataFrame:
    """doc_id, copy (hash of the text), and of every document's paragraphs line and node, of its pieces at (first word), words, first, last (lines of these words) and piece (hash)."""
    names = ("doc_id", "copy", "line", "node", "at", "words", "first", "last", "piece")

    def fn(cols):
        out = {name: [] for name in names}
        for low, texts in chunks(cols[1]):
            p = Parsed(texts)
            node, lines = p.nodes(), np.repeat(p.line, p.sizes)
            ends = np.searchsorted(p.text, np.arange(len(texts) + 1))  # paragraphs of each text
            words = np.append(p.begin, len(p.hash))[ends]
            some = np.flatnonzero(np.diff(ends))
            begin, sizes, piece = pieces(p.hash, words[some], np.diff(words)[some])
            of = np.searchsorted(begin, words)  # pieces of each text
            first, last, at = lines[begin], lines[begin + sizes - 1], begin - np.repeat(words[:-1], np.diff(of))
            for k in some.tolist():
                own, cut = slice(ends[k], ends[k + 1]), slice(of[k], of[k + 1])
                row = cols[0][low + k], cols[2][low + k], p.line[own], node[own], at[cut], sizes[cut], first[cut], last[cut], piece[cut]
                for name, value in zip(names, row):
                    out[name].append(value)
        return out

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("copy"))
    lists = "line array<int>, node array<long>, at array<int>, words array<int>, first array<int>, last array<int>, piece array<long>"
    return common.map_rows(rows, fn, f"doc_id long, copy long, {lists}")


def distinct_sets(s: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are distinct within each line, one line after the other, and the lines' numbers of them."""
    line = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(s))))
    key = mix(s + line.astype(np.uint64) * _P2)
    order = np.sort(key)
    again = order[1:][order[1:] == order[:-1]]
    if len(again):
        at, new = np.flatnonzero(np.isin(key, again)), np.ones(len(s), bool)
        new[at] = False
        new[at[np.unique(key[at], return_index=True)[1]]] = True
        s, line = s[new], line[new]
    return s, np.bincount(line, minlength=len(begin))


def lots(texts: list[str], known: set[int]):
    """ids, shingles and where they begin, of paragraphs of WORDS words or more that are not known yet, chunk by chunk."""
    for _, some in chunks(texts):
        p = Parsed(some)
        node = p.nodes()
        new = [k for k in np.flatnonzero(p.sizes >= WORDS).tolist() if (i := int(node[k])) not in known and not known.add(i)]
        if new:
            yield node[new], *shingles_of(p.hash, p.begin[new], p.sizes[new])


def signed(docs: DataFrame, parts: bool = True) -> DataFrame:
    """a, b, scheme: in BAND nodes that share a band signature, each with the bucket's smallest and its predecessor;
    else, if asked for, slots of nodes joined to the smallest slot of a part signature they share: of two linked nodes some slots share one."""

    def fn(cols):
        found = [{"sig": np.zeros(0, np.int64), "id": np.zeros(0, np.int64)}]
        bands, names, sigs, own = [], [], [], []
        for ids, s, begin in lots(cols[0], set()):
            bands.append(banded(s, begin).ravel() & ~TAG | np.uint64(BAND))
            names.append(np.repeat(ids, BANDS))
            if parts:
                row, scheme, sig = flat_signatures(*distinct_sets(s, begin), PERCENT)
                sigs.append(sig)
                own.append(slots_of(ids[row], scheme))
        if bands:
            found.append(starred(np.concatenate(bands), np.concatenate(names), before=True))
        if sigs:
            found.append(starred(np.concatenate(sigs), np.concatenate(own)))
        return {name: np.concatenate([x[name] for x in found]) for name in ("sig", "id")}

    return hub_edges(common.map_rows(docs.select("text"), fn, "sig long, id long"), BAND)


def nodes_of(edges: DataFrame) -> DataFrame:
    """node: those that edges of signed() name, in bands or by slots."""

    def fn(cols):
        a, b, scheme = (np.array(c, np.int64) for c in cols)
        slot, scheme = np.concatenate([a, b]), np.concatenate([scheme, scheme])
        return {"node": np.unique(np.where(scheme == BAND, slot, sets_of(slot, scheme)))}

    return common.map_rows(edges.select("a", "b", "scheme"), fn, "node long").distinct()


def bodies_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, body (words with spaces) of the wanted nodes."""

    def fn(cols):
        out = {}
        for _, texts in chunks(cols[0]):
            p = Parsed(texts)
            node = p.nodes()
            for k in np.flatnonzero(p.sizes >= WORDS).tolist():
                if (i := int(node[k])) not in out:
                    out[i] = p.body(k)
        return {"node": list(out), "body": list(out.values())}

    return common.map_rows(docs.select("text"), fn, "node long, body binary").join(wanted, "node", "left_semi").groupBy("node").agg(F.first("body").alias("body"))


def rest(edges: DataFrame, bodies: DataFrame) -> DataFrame:
    """a, b: links that connect all nodes that reach the threshold, whatever bands and buckets leave out; of part edges and the bodies of their nodes."""
    groups = components(edges)
    common.free(edges.sparkSession)

    def fn(cols):
        out = {"set_id": cols[0], "n_shingles": [], "bits": [], "shingles": []}
        s, begin = shingle_sets([body.split(b" ") for body in cols[1]])
        for x in np.split(s, begin[1:]):
            x = np.unique(x)
            for name, value in (("n_shingles", len(x)), ("bits", parities(x)), ("shingles", x.tobytes())):
                out[name].append(value)
        return out

    slots = edges.select("a", "scheme").union(edges.select("b", "scheme")).distinct()

    def names(cols):
        return {"node": sets_of(np.array(cols[0], np.int64), np.array(cols[1], np.int64))}

    grouped = bodies.join(common.map_rows(slots, names, "node long").distinct(), "node", "left_semi")
    sets = common.saved(common.map_rows(grouped.select("node", "body"), fn, "set_id long, n_shingles long, bits binary, shingles binary"), "sets")

    def gather(members):
        return members.join(sets.select("set_id", "shingles"), "set_id").select("component", "blocks", "set_id", "shingles")

    return links(sets.drop("shingles"), groups, PERCENT, gather)


def candidates(docs: DataFrame) -> DataFrame:
    """a, b: nodes that share a band signature, each with the bucket's smallest and its predecessor."""
    return signed(docs, parts=False).select("a", "b")


def verified(docs: DataFrame, pairs: DataFrame, bodies: DataFrame | None = None) -> DataFrame:
    """The candidate pairs of exact similarity, a, b; bodies: those of their nodes, where known."""
    if bodies is None:
        bodies = common.saved(bodies_of(docs, pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()), "bodies")
    left = pairs.join(bodies.select(F.col("node").alias("a"), F.col("body").alias("x")), "a")
    both = left.join(bodies.select(F.col("node").alias("b"), F.col("body").alias("y")), "b").select("a", "b", "x", "y")

    def check(cols):
        keep = [similar(x.split(b" "), y.split(b" ")) for x, y in zip(cols[2], cols[3])]
        return {"a": [i for i, k in zip(cols[0], keep) if k], "b": [i for i, k in zip(cols[1], keep) if k]}

    return common.map_rows(both, check, "a long, b long")


def cuts(h: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions where pieces of sequences of word hashes begin; the sequences follow each other, with a word at least."""
    n = len(h)
    if n < 2 * REACH + 2:
        return first
    v = mix(h[:-1] * _P1 + h[1:])  # v[i]: a cut before word i + 1
    mid = v[REACH : n - 1 - REACH]
    least = np.ones(len(mid), bool)
    for k in range(1, REACH + 1):
        least &= (mid < v[REACH - k : n - 1 - REACH - k]) & (mid < v[REACH + k : n - 1 - REACH + k])
    at = np.flatnonzero(least) + REACH
    own = np.searchsorted(first, at, "right") - 1
    place = at - first[own]
    at = at[(place >= REACH) & (place < sizes[own] - 1 - REACH)]
    return np.sort(np.concatenate([first, at + 1]))


def pieces(h: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each piece of some sequences of word hashes begins, its number of words, and its 64-bit hash."""
    begin = cuts(h, first, sizes)
    sizes = np.diff(np.append(begin, len(h)))
    return begin, sizes, sequence_ids(h, begin, sizes)


def repeated_pieces(parts: DataFrame, lines: DataFrame) -> DataFrame:
    """doc_id, copy, pieces array<struct<at, words, kept>>: pieces of cut() that occur more than once."""
    often = parts.select(F.explode("piece").alias("node")).groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node")
    each = parts.select("doc_id", "copy", F.explode(F.arrays_zip("at", "words", "first", "last", "piece")).alias("_p"))
    each = each.select("doc_id", "copy", "_p.at", "_p.words", F.col("_p.first").alias("line"), "_p.last", F.col("_p.piece").alias("node"))
    back = each.join(often, "node", "left_semi").distinct()
    late = lines.select("doc_id", "copy", F.expr("transform(filter(lines, x -> not x.kept), x -> x.line)").alias("late"))
    gone = F.coalesce(F.arrays_overlap(F.array("line", "last"), "late"), F.lit(False))
    back = common.saved(back.join(late, ["doc_id", "copy"], "left").select("node", gone.alias("gone"), "doc_id", "copy", "at", "words"), "pieces")
    at = F.struct("gone", "doc_id", "copy", "at")
    many = back.groupBy("node").agg(F.min(at).alias("lead"), F.count("*").alias("n")).where("n > 1")
    tied = back.join(many, "node").select("doc_id", "copy", "at", "words", (F.col("lead") == at).alias("kept"))
    return tied.groupBy("doc_id", "copy").agg(F.collect_list(F.struct("at", "words", "kept")).alias("pieces"))


def runs(mask: np.ndarray, begin: np.ndarray, least: int) -> np.ndarray:
    """The marked words that stand in runs of `least` words or more; begin: where lines begin, and the end."""
    out = np.zeros(len(mask), bool)
    if not mask.any():
        return out
    ends = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    inside = ~np.isin(ends, begin)
    long = np.flatnonzero(ends[1::2] - ends[::2] + (inside[::2].astype(int) + inside[1::2]) * EDGE >= least)
    for k in long.tolist():
        out[ends[2 * k] : ends[2 * k + 1]] = True
    return out


def without(text: str, own: list[tuple[int, list[bytes]]], late: np.ndarray) -> str:
    """The text without the marked words; lines that lose all words go, in others a cut leaves a space."""
    if not late.any():
        return text
    lines, at, gone = text.split("\n"), 0, set()
    for k, words in own:
        lost = late[at : at + len(words)]
        at += len(words)
        if lost.all():
            gone.add(k)
        elif lost.any():
            raw = lines[k].encode("utf-8", "surrogatepass")
            spans = [m.span() for m in _WORD.finditer(raw)]
            ends = np.flatnonzero(np.diff(np.concatenate([[True], lost, [True]]).astype(np.int8)))
            parts = [raw[spans[a][0] if a else 0 : spans[b - 1][1] if b < len(spans) else len(raw)] for a, b in zip(ends[::2], ends[1::2])]
            lines[k] = b" ".join(parts).decode("utf-8", "surrogatepass")
    return "\n".join([x for k, x in enumerate(lines) if k not in gone])


def repeated_lines(docs: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """doc_id, copy, lines array<struct<line, kept>>: paragraphs whose component occurs more than once; parts: what cut() gives."""
    parts = common.saved(cut(docs), "cuts") if parts is None else parts
    seen = parts.select("doc_id", "copy", F.explode(F.arrays_zip("line", "node")).alias("_p")).select("doc_id", "copy", "_p.line", "_p.node").distinct()
    edges = common.saved(signed(docs), "edges")
    common.free(docs.sparkSession)
    bodies = common.saved(bodies_of(docs, nodes_of(edges)), "bodies")
    similar = common.saved(verified(docs, edges.where(F.col("scheme") == BAND).select("a", "b"), bodies), "similar")
    common.free(docs.sparkSession)
    linked = components(similar.unionByName(common.saved(rest(edges.where(F.col("scheme") != BAND), bodies), "rest")))
    keyed = seen.join(linked.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select(
        "doc_id", "copy", "line", F.coalesce("component", "node").alias("key"))
    at = F.struct("doc_id", "copy", "line")
    many = keyed.groupBy("key").agg(F.min(at).alias("lead"), F.count("*").alias("n")).where("n > 1")
    back = keyed.join(many, "key").select("doc_id", "copy", "line", (F.col("lead") == at).alias("kept"))
    return back.groupBy("doc_id", "copy").agg(F.sort_array(F.collect_list(F.struct("line", "kept"))).alias("lines"))


def deduplicate(docs: DataFrame, make, schema: str, run_words: int = RUN_WORDS) -> DataFrame:
    """make(doc_id, text, paragraphs, where they begin, repeated words, removed words) -> a row, for every document."""
    docs = common.text_docs(docs)
    parts = common.saved(cut(docs), "cuts")
    lines = common.saved(repeated_lines(docs, parts), "lines")
    common.free(docs.sparkSession)
    found = lines.join(repeated_pieces(parts, lines), ["doc_id", "copy"], "full")
    tied = docs.withColumn("copy", F.xxhash64("text")).join(found, ["doc_id", "copy"], "left")
    names = [c.split()[0] for c in schema.split(", ")]

    def fn(cols):
        rows = []
        for doc_id, text, lines, parts in zip(*cols):
            own = lines_of(text)
            begin = np.cumsum([0, *[len(w) for _, w in own]])
            place = {k: (begin[n], begin[n + 1]) for n, (k, _) in enumerate(own)} if lines else {}
            again, late = np.zeros(begin[-1], bool), np.zeros(begin[-1], bool)
            marks = [(*place[x["line"]], x["kept"]) for x in lines or ()] + [(x["at"], x["at"] + x["words"], x["kept"]) for x in parts or ()]
            for a, b, kept in marks:
                again[a:b] = True
                if not kept:
                    late[a:b] = True
            rows.append(make(doc_id, text, own, begin, runs(again, begin, run_words), runs(late, begin, run_words)))
        return {n: [r[k] for r in rows] for k, n in enumerate(names)}

    return common.map_rows(tied.select("doc_id", "text", "lines", "pieces"), fn, schema)


def strip(docs: DataFrame) -> DataFrame:
    """doc_id and the text that stays: the operator's general output."""

    def make(doc_id, text, own, begin, again, late):
        return doc_id, without(text, own, late)

    return deduplicate(docs, make, "doc_id long, text string")


def report(docs: DataFrame) -> DataFrame:
    """n_repeated, n_removed: paragraphs of which words are repeated, or removed."""

    def make(doc_id, text, own, begin, again, late):
        digest = hashlib.sha256(without(text, own, late).encode("utf-8", "surrogatepass")).hexdigest()
        touched = [int(np.logical_or.reduceat(mask, begin[:-1]).sum()) if mask.any() else 0 for mask in (again, late)]
        return doc_id, len(own), *touched, int(late.sum()), digest

    return deduplicate(docs, make, SCHEMA)
