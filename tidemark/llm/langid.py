"""Language identification by interpolated Kneser-Ney character models.

One model of ORDER characters for each language.  A text is its words (runs of
letters, lower case), each framed by boundary signs, so a word's score does not
depend on its neighbours and workers keep the scores of recent words.  All
languages share sorted arrays of n-gram hashes; a row holds the interpolated
probability in each language, and contexts hold the back-off weights.  The
language of the lowest cross-entropy a character wins.

Learning uses SAMPLE_DOCS documents about of each language, chosen by hash among
the labelled training rows (crc32 of doc_id mod 3 is not 1); one in four of them
calibrates the rejection: a text is rejected if its cross-entropy lies further
above the language's mean than the TAIL quantile of the calibration texts that the
models give their own label, and as far again as that quantile is from the median,
where deviations are taken in units of (0.05 + 1/sqrt(characters)).  So a few
mislabelled or junk rows do not set the limit.

A text that is null, empty or without a letter is `und`, score 0, rejected.
With no labelled rows every text is.  Texts are taken whole, whatever their length.
Repeated rows give repeated rows; ties go to the language first in order of name.
identify() replaces columns of the names it adds; keep() passes all columns,
whatever their names; an empty table gives an empty result.
"""
from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

ORDER = 4
SAMPLE_DOCS = 2_000
TAIL = 0.995
BROADCAST_LANGUAGES = 10_000  # sizes of so many languages are sent to the rows, more are joined
LEAST_LIMIT = 8.0  # no calibration makes it stricter: half a nat a character for long texts
CACHE_WORDS = 200_000
CHUNK = 500_000  # characters that are cut into words at a time
UND = "und"
_WORDS = re.compile(r"[^\W\d_]+")
_OPEN, _CLOSE = "\x02", "\x03"
_MIX = np.uint64(0x9E3779B97F4A7C15)
ADDED = "lang_pred string, score double, cross_entropy double, rejected boolean"


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def gram_hash(codes: list[np.ndarray]) -> np.ndarray:
    """Hash of n-grams given as n arrays of code points."""
    h = np.full(len(codes[0]), len(codes), np.uint64)
    for c in codes:
        h = (h ^ c.astype(np.uint64)) * _MIX
        h ^= h >> np.uint64(29)
    return h


class Models:
    """The languages' models as arrays; picklable, of a size bounded by the sample."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        self.langs = sorted(counts)
        self.grams: list = [None] * (ORDER + 1)  # by length: hashes, probabilities
        self.contexts: list = [None] * ORDER  # by length of context: hashes, back-off weights
        self.mean = np.zeros(len(self.langs))
        self.limit = np.full(len(self.langs), np.inf)
        if not self.langs:
            return
        tables = [self.levels(counts[lang]) for lang in self.langs]
        letters = sorted({g[-1] for t in tables for g in t[1]})
        self.floor = 1.0 / (len(letters) + 1)
        backs = []
        for levels in tables:
            back = {}
            for n in range(1, ORDER + 1):
                d = self.discount(levels[n].values())
                total, kinds = defaultdict(int), defaultdict(int)
                for g, c in levels[n].items():
                    total[g[:-1]] += c
                    kinds[g[:-1]] += 1
                back[n] = (d, total, {h: d * kinds[h] / total[h] for h in total})
            backs.append(back)
        known: dict[str, np.ndarray] = {}
        for n in range(1, ORDER + 1):
            names = sorted({g for t in tables for g in t[n]})
            for g in names:
                lower = known[g[1:]] if n > 1 else np.full(len(self.langs), self.floor)
                row = lower.copy()
                for k, back in enumerate(backs):
                    d, total, weight = back[n]
                    if g[:-1] in total:
                        row[k] = max(tables[k][n].get(g, 0) - d, 0) / total[g[:-1]] + weight[g[:-1]] * lower[k]
                known[g] = row
            self.grams[n] = self.packed(names, np.array([known[g] for g in names]), n)
            ctx = sorted({h for b in backs for h in b[n][1]})
            self.contexts[n - 1] = self.packed(ctx, np.array([[b[n][2].get(h, 1.0) for b in backs] for h in ctx]), n - 1)

    @staticmethod
    def levels(top: dict[str, int]) -> dict[int, dict[str, int]]:
        """Counts of the longest grams, and below them continuation counts."""
        out = {ORDER: top}
        for n in range(ORDER - 1, 0, -1):
            out[n] = Counter(g[1:] for g in out[n + 1])
        return out

    @staticmethod
    def discount(counts) -> float:
        ones = twos = 0
        for c in counts:
            ones += c == 1
            twos += c == 2
        return min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5

    @staticmethod
    def packed(names: list[str], rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n == 0:
            return np.zeros(1, np.uint64), np.log(rows[:1]).astype(np.float32)
        codes = np.array([[ord(c) for c in g] for g in names]).reshape(len(names), n)
        h = gram_hash([codes[:, i] for i in range(n)])
        order = np.argsort(h)
        return h[order], np.log(rows[order]).astype(np.float32)

    @staticmethod
    def find(table, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table[0], h), len(table[0]) - 1)
        return at, table[0][at] == h

    def score(self, words: list[str]) -> np.ndarray:
        """For each word the log probability in each language, and the number of characters (the end sign counts)."""
        text = "".join([_OPEN * (ORDER - 1) + w + _CLOSE for w in words])
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.array([len(w) + ORDER for w in words])
        starts = np.cumsum(sizes) - sizes
        at = np.ones(len(codes), bool)
        for k in range(ORDER - 1):
            at[starts + k] = False
        at = np.flatnonzero(at)
        out = np.zeros((len(at), len(self.langs)), np.float32)
        left = np.arange(len(at))
        for n in range(ORDER, 0, -1):
            here = [codes[at[left] - k] for k in range(n - 1, -1, -1)]
            row, hit = self.find(self.grams[n], gram_hash(here))
            out[left[hit]] += self.grams[n][1][row[hit]]
            left, here = left[~hit], [c[~hit] for c in here]
            if not len(left):
                break
            if n > 1:
                row, hit = self.find(self.contexts[n - 1], gram_hash(here[:-1]))
                out[left[hit]] += self.contexts[n - 1][1][row[hit]]
            else:
                out[left] += self.contexts[0][1][0] + np.log(self.floor)
        ends = np.cumsum(sizes - ORDER + 1)
        sums = np.add.reduceat(out, np.concatenate([[0], ends[:-1]]), axis=0)
        return np.concatenate([sums, (sizes - ORDER + 1)[:, None].astype(np.float32)], axis=1)


class Scorer:
    """Cross-entropies of texts; keeps the scores of recent words."""

    def __init__(self, models: Models):
        self.models = models
        self.forget()

    def forget(self):
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.models.langs) + 1), np.float32)

    def texts(self, texts: list[str | None]) -> np.ndarray:
        """For each text the cross-entropy in each language, and its number of characters (0: nothing to tell by)."""
        out = np.zeros((len(texts), len(self.models.langs) + 1))
        k = 0
        while k < len(texts):
            chunk, size = [], 0
            while k + len(chunk) < len(texts) and (not chunk or size < CHUNK):
                t = texts[k + len(chunk)]
                words = _WORDS.findall(t.lower()) if t and any(map(str.isalpha, t)) else []
                chunk.append(words)
                size += len(t or "")
            new = list(dict.fromkeys(w for words in chunk for w in words if w not in self.rows))
            if len(self.rows) + len(new) > CACHE_WORDS and self.rows:
                self.forget()
                new = list(dict.fromkeys(w for words in chunk for w in words))
            if new:
                self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new))))
                self.scores = np.concatenate([self.scores, self.models.score(new)])
            get = self.rows.__getitem__
            for words in chunk:
                if words:
                    total = self.scores[np.fromiter(map(get, words), np.int64, len(words))].sum(axis=0, dtype=np.float64)
                    out[k, :-1] = -total[:-1] / total[-1]
                    out[k, -1] = total[-1]
                k += 1
        return out


def decide(models: Models, found: np.ndarray) -> dict:
    """Columns of ADDED from cross-entropies."""
    out = {"lang_pred": [], "score": [], "cross_entropy": [], "rejected": []}
    for row in found:
        n = row[-1]
        if not n or not models.langs:
            out["lang_pred"].append(UND)
            out["score"].append(0.0)
            out["cross_entropy"].append(None)
            out["rejected"].append(True)
            continue
        ce = row[:-1]
        best = int(ce.argmin())
        out["lang_pred"].append(models.langs[best])
        out["score"].append(float(1 / np.exp(-(ce - ce[best]) * n).sum()))
        out["cross_entropy"].append(float(ce[best]))
        out["rejected"].append(bool((ce[best] - models.mean[best]) / (0.05 + n**-0.5) > models.limit[best]))
    return out


def learn(docs: DataFrame) -> Models:
    """Train on the bounded sample of labelled rows outside the held-out third."""
    rows = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null").where(~held_out())
    dice = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(4_000_000))
    share = F.floor(F.lit(SAMPLE_DOCS * 1_000_000) / F.col("_rows")) + 1  # one row a language on this side
    sizes = rows.groupBy("lang").agg(F.count("*").alias("_rows"))
    if sizes.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES:
        sizes = F.broadcast(sizes)
    picked = rows.withColumn("_dice", dice).join(sizes, "lang").where(F.col("_dice") % 1_000_000 < share)

    def count(cols):
        by = defaultdict(Counter)
        for text, lang in zip(*cols):
            by[lang].update(_WORDS.findall(text.lower()))
        out = {"lang": [], "gram": [], "n": []}
        for lang, words in by.items():
            grams = Counter()
            for w, c in words.items():
                w = _OPEN * (ORDER - 1) + w + _CLOSE
                for i in range(len(w) - ORDER + 1):
                    grams[w[i : i + ORDER]] += c
            out["lang"] += [lang] * len(grams)
            out["gram"] += grams
            out["n"] += grams.values()
        return out

    fit = picked.where("_dice >= 1000000").select("text", "lang")
    grams = common.map_rows(fit, count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = grams.toPandas()
    models = Models({lang: dict(zip(g["gram"], g["n"])) for lang, g in table.groupby("lang")})
    if not models.langs:
        return models
    shared = common.Shared(docs.sparkSession, models)

    def measure(cols):
        found = shared.get(Scorer).texts(cols[0])
        place = {lang: k for k, lang in enumerate(models_langs)}
        out = {"lang": [], "ce": [], "n": []}
        for row, lang in zip(found, cols[1]):
            if row[-1] and place.get(lang) == int(row[:-1].argmin()):
                out["lang"].append(lang)
                out["ce"].append(float(row[place[lang]]))
                out["n"].append(float(row[-1]))
        return out

    models_langs = models.langs
    tested = common.map_rows(picked.where("_dice < 1000000").select("text", "lang"), measure, "lang string, ce double, n double").toPandas()
    for k, lang in enumerate(models.langs):
        own = tested[tested["lang"] == lang]
        if len(own) < 20:  # too few to tell: all languages' together
            own = tested
        if len(own):
            models.mean[k] = (own["ce"] * own["n"]).sum() / own["n"].sum()
            far = (own["ce"] - models.mean[k]) / (0.05 + own["n"] ** -0.5)
            models.limit[k] = max(LEAST_LIMIT, 2 * far.quantile(TAIL) - far.median())
    return models


def identify(docs: DataFrame, models: Models | None = None) -> DataFrame:
    """All columns of docs and lang_pred, score, cross_entropy, rejected."""
    models = learn(docs) if models is None else models
    shared = common.Shared(docs.sparkSession, models)

    def fn(texts):
        scorer = shared.get(Scorer)
        return decide(scorer.models, scorer.texts(texts))

    return common.extend(docs, "text", fn, ADDED)


def report(docs: DataFrame) -> DataFrame:
    found = identify(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected", "cross_entropy")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language is not rejected, all columns kept."""
    models = learn(docs)
    shared = common.Shared(docs.sparkSession, models)
    flag = common.unused(docs, "_rejected")

    def fn(texts):
        scorer = shared.get(Scorer)
        return {flag: decide(scorer.models, scorer.texts(texts))["rejected"]}

    return common.extend(docs, "text", fn, f"{flag} boolean").where(~F.col(flag)).drop(flag)
