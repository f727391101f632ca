"""Personal data: rule spans, and spans that boosted trees add.

Base spans come from fixed patterns with checks.  Beyond them, high-recall
generators propose overlapping spans: runs around '@', addresses whose signs are
spelled out or bracketed, numeric addresses with guarded dots, runs of digits
with any separators and their pieces.  Boosted trees, one ensemble for each kind,
score them by format and context features; a candidate is added where its score
reaches the kind's calibrated threshold, what it spells passes the kind's check
(so no number that fails its checksum becomes a card), and it overlaps no base
span and no better candidate.

The trees are trained here, on a bounded sample: SAMPLE_DOCS documents about,
MAX_CANDIDATES candidates at most, both chosen by hash over the whole table.
Positives are base spans and disguised forms of them, written into the place of
the original.  Negatives are proven ones: candidates that spell nothing the kind's
check accepts, and decoys made of base spans (a digit changed so that the checksum
fails, a part beyond 255, dates, decimals, numbers of other lengths).  Candidates
of the text that would pass a check without being base spans are not used.  One
part in four is kept for calibration.  A kind without LEAST positives and negatives
in the sample adds none.

A null or empty text has no spans; texts are taken whole, whatever their length;
repeated rows give repeated rows; an empty table gives an empty result.  Of equal
scores the candidate that begins first, then ends first, then is of the first kind
goes first.  find() ignores other columns; redact() keeps them, whatever their names.
"""
from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS = 20_000
MAX_CANDIDATES = 40_000
PRECISION = 0.98  # on the calibration part
TREES, DEPTH, RATE, BINS, LEAST = 30, 3, 0.3, 16, 20
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9](?:[0-9 .-]*[0-9])")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_GUARD_AT = r"[\[({<]\s?at\s?[\])}>]|\s(?:at|AT)\s"
_GUARD_DOT = r"\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\s(?:dot|DOT)\s"
_AT, _DOT = re.compile(rf"\s?(?:{_GUARD_AT})\s?", re.I), re.compile(_GUARD_DOT, re.I)
_MARK = re.compile(_GUARD_AT, re.I)
_AFTER = re.compile(rf"\s?[A-Za-z0-9-]+(?:(?:{_GUARD_DOT}|\.)[A-Za-z0-9-]+)+", re.I)
_SPELLED = re.compile(rf"\s?[A-Za-z0-9-]+(?:(?:{_GUARD_DOT})[A-Za-z0-9-]+)+", re.I)
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_TOP = re.compile(r"\.[A-Za-z]{2,}$")
_LOOSE = re.compile(rf"[+(]?[0-9](?:(?:[ ().:/·–-]|{_GUARD_DOT})*[0-9])*", re.I)
_ANY_AT = re.compile(r"\S*@\S*")
_CUES = (("mail", "@", "contact"), ("ip", "host", "server"), ("card", "visa", "pay"), ("tel", "phone", "call", "fax"))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def digits_of(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping for each kind, in order."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:  # the only '@' of a match ends its local part, so each decides by itself
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _HOST.match(text, at) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            free = m.end()
        at = text.find("@", m.end() if m else at + 1)
    for piece in _DIGITS.finditer(text):
        s, a = piece.group(), piece.start()
        if s.count(".") > 2:
            for m in _IP.finditer(s):
                if all(map(small, m.group().split("."))):
                    out.append((a + m.start(), 1, a + m.end()))
        if len(s) > 11:
            for m in _CARD.finditer(s):
                if m.end() - m.start() > 11 and 12 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
                    out.append((a + m.start(), 2, a + m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(digits_of(m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def spelled(s: str, kind: int) -> str | None:
    """The plain form of what a span spells, if it passes the kind's check."""
    if kind == 0:
        t = _DOT.sub(".", _AT.sub("@", s.strip()))
        return t if _EMAIL.fullmatch(t) and _TOP.search(t) else None
    if kind == 1:
        t = _DOT.sub(".", s)
        return t if _IP.fullmatch(t) and all(map(small, t.split("."))) else None
    if re.search("[a-z]", s, re.I):
        return None
    d = digits_of(s)
    if kind == 2:
        return d if 12 <= len(d) <= 19 and luhn(d) else None
    return d if 9 <= len(d) <= 15 and len(re.findall("[0-9]+", s)) > 1 else None


def candidates(text: str) -> list[tuple[int, int]]:
    """Overlapping spans that may be personal data."""
    out = set()
    if "@" in text:
        for m in _ANY_AT.finditer(text):
            out.add(m.span())
            bare = m.group().strip(".,;:!?()[]{}<>\"'")
            a = m.start() + m.group().find(bare)
            out.add((a, a + len(bare)))
    free = 0
    for m in _MARK.finditer(text):
        a = m.start()
        if a > free and text[a - 1] == " ":
            a -= 1
        start = a
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        host = (_SPELLED if m.group()[0].isspace() else _AFTER).match(text, m.end()) if start < a else None
        if host:
            out.add((start, host.end()))
            free = host.end()
    for m in _LOOSE.finditer(text):
        if m.end() - m.start() < 7:
            continue
        out.add(m.span())
        if " " in m.group():
            at = [(m.start() + p.start(), m.start() + p.end(), len(digits_of(p.group()))) for p in re.finditer("[^ ]+", m.group())]
            for k, (a, _, _) in enumerate(at):  # runs of pieces, as far as a number may have digits
                n = 0
                for _, b, more in at[k:]:
                    n += more
                    if n > 19 and b != at[k][1]:
                        break
                    if b - a > 6 and text[a] in "+(0123456789":
                        out.add((a, b))
    return sorted(out)


def features(text: str, a: int, b: int) -> list[float]:
    s = text[a:b]
    groups = re.findall("[0-9]+", s)
    lengths = [len(g) for g in groups] or [0]
    before = text[max(0, a - 24) : a].lower()
    after = text[b : b + 12]
    plain = [spelled(s, k) for k in range(len(KINDS))]
    return [
        min(b - a, 1000), sum(lengths), len(groups), max(lengths), min(lengths), s.count("."), s.count(" "), s.count("-"), s.count("(") + s.count(")"),
        s.count(":") + s.count("/"), float(s[:1] == "+"), float(s[:1] == "("), s.count("@"), len(_DOT.findall(s)), len(_MARK.findall(s)),
        sum(c.isalpha() for c in s), sum(not (c.isalnum() or c in " .-()+@_%") for c in s),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:] == "+"), float(s[-1:].isalnum()),
        float(lengths == [4, 4, 4, 4]), float(lengths[-2:] == [3, 4]), float(lengths in ([4, 2, 2], [2, 2, 4], [1, 2, 4], [2, 1, 4])),
        *(float(p is not None) for p in plain), *(float(any(c in before for c in cues)) for cues in _CUES),
    ]


def disguised(s: str, kind: int, dice: int) -> str:
    """Another way in which people write a base span."""
    if kind == 0:
        at = (" (at) ", "[at]", " at ", " [at] ", "(at)")[dice % 5]
        dot = (" (dot) ", "[dot]", " dot ", ".", "[.]")[dice // 5 % 5]
        name, _, host = s.partition("@")
        return name + at + host.replace(".", " dot " if at == " at " else dot)
    if kind == 1:
        return s.replace(".", ("[.]", "(.)", " dot ", "[dot]")[dice % 4])
    d = digits_of(s)
    if kind == 2:
        return (".", "/", "–", " - ")[dice % 4].join([d[k : k + 4] for k in range(0, len(d), 4)])
    if len(d) > 10:
        d = d[-10:]
    return (f"({d[:-7]}) {d[-7:-4]}-{d[-4:]}", f"{d[:-7]}-{d[-7:-4]}-{d[-4:]}", f"{d[:-7]}.{d[-7:-4]}.{d[-4:]}", f"00 1 {d[:-7]} {d[-7:-4]} {d[-4:]}")[dice % 4]


def decoy(s: str, kind: int, dice: int) -> str:
    """Something alike that is no personal data of the kind."""
    d = digits_of(s) or "20210413"
    if kind == 0:
        name, _, host = s.partition("@")
        return (f"@{name}", f"{name} at {host.partition('.')[0]}", f"{name}@", f"{name} @ {dice % 100}")[dice % 4]
    if kind == 1:
        return (f"{256 + dice % 700}." + s.partition(".")[2], s.rpartition(".")[0], f"{s}.{dice % 90}.{dice % 7}", f"{dice % 90}.{dice % 10}")[dice % 4]
    if kind == 2:
        wrong = d[:-1] + str((int(d[-1]) + 1 + dice % 9) % 10)
        return (wrong, ".".join([wrong[k : k + 4] for k in range(0, len(wrong), 4)]), d[:8], "-".join([wrong[k : k + 4] for k in range(0, len(wrong), 4)]))[dice % 4]
    return (f"{1900 + dice % 130}-{1 + dice % 12:02d}-{1 + dice % 28:02d}", f"{1 + dice % 28:02d}.{1 + dice % 12:02d}.{1900 + dice % 130}", f"{d[:3]}.{d[3:5]}", f"{dice % 24:02d}:{dice % 60:02d}:{dice % 59:02d}")[dice % 4]


def examples(text: str, key: int) -> list[tuple[list[float], list[int]]]:
    """Features and, for each kind, 1, 0 or -1 (not used), of a text's candidates and of forms made of its base spans."""
    base, out = base_spans(text), []
    known = {(a, b): k for a, k, b in base}
    for a, b in candidates(text):
        plain = [spelled(text[a:b], k) for k in range(len(KINDS))]
        y = [0 if p is None else -1 for p in plain]
        if (a, b) in known:
            y = [1 if k == known[a, b] else 0 if plain[k] is None else -1 for k in range(len(KINDS))]
        out.append((features(text, a, b), y))
    for a, kind, b in base:
        dice = (key + a * 7919) % 1_000_003
        for k, form in enumerate((disguised(text[a:b], kind, dice), disguised(text[a:b], kind, dice // 7), decoy(text[a:b], kind, dice), decoy(text[a:b], kind, dice // 5))):
            near = text[max(0, a - 40) : a] + form + text[b : b + 40]
            at = min(a, 40)
            mine = [(x, y) for x, y in candidates(near) if x < at + len(form) and at < y]
            exact = (at, at + len(form))
            if k < 2:
                if spelled(form, kind) is not None and exact in mine:
                    out.append((features(near, *exact), [1 if j == kind else 0 if spelled(form, j) is None else -1 for j in range(len(KINDS))]))
            else:
                out += [(features(near, x, y), [0 if j == kind and spelled(near[x:y], j) is None or k == 2 and j == kind == 3 else -1 for j in range(len(KINDS))]) for x, y in mine]
    return out


def tree_fit(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int) -> list:
    """[feature, bin, left, right] or a leaf's value, by exact gain over binned features."""
    if depth and len(grad) >= 2 * LEAST:
        g, h = grad.sum(), hess.sum()
        best = (1e-6, None, None)
        for f in range(x.shape[1]):
            gs = np.cumsum(np.bincount(x[:, f], grad, BINS))[:-1]
            hs = np.cumsum(np.bincount(x[:, f], hess, BINS))[:-1]
            n = np.cumsum(np.bincount(x[:, f], minlength=BINS))[:-1]
            gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
            gain[(n < LEAST) | (len(grad) - n < LEAST)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], f, k)
        if best[1] is not None:
            left = x[:, best[1]] <= best[2]
            return [best[1], best[2], tree_fit(x[left], grad[left], hess[left], depth - 1), tree_fit(x[~left], grad[~left], hess[~left], depth - 1)]
    return [-grad.sum() / (hess.sum() + 1)]


def tree_score(tree: list, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    left = x[:, tree[0]] <= tree[1]
    return np.where(left, tree_score(tree[2], x), tree_score(tree[3], x))


def binned(edges: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)


def fit(x: np.ndarray, y: np.ndarray, hold: np.ndarray) -> dict:
    """Edges, an ensemble and a threshold for each kind. y: a column of 1, 0, -1 for each kind; hold: rows for calibration."""
    model = {"edges": [], "kinds": []}
    if not len(x):
        return model
    model["edges"] = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    bins = binned(model["edges"], x)
    for k in range(len(KINDS)):
        use = (y[:, k] >= 0) & ~hold
        check = (y[:, k] >= 0) & hold
        pos = y[use, k].sum()
        if pos < LEAST or use.sum() - pos < LEAST or not y[check, k].sum():
            model["kinds"].append(None)
            continue
        b, t = bins[use], y[use, k].astype(float)
        start = float(np.log(t.mean() / (1 - t.mean())))
        score, trees = np.full(len(t), start), []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            tree = tree_fit(b, p - t, p * (1 - p), DEPTH)
            trees.append(tree)
            score += RATE * tree_score(tree, b)
        got = probability({"edges": model["edges"]}, (start, trees), bins[check])
        order = np.argsort(-got)
        precision = np.cumsum(y[check, k][order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(precision >= PRECISION)
        model["kinds"].append((start, trees, max(0.5, float(got[order][good[-1]]))) if len(good) else None)
    return model


def probability(model: dict, kind: tuple, bins: np.ndarray) -> np.ndarray:
    score = np.full(len(bins), kind[0])
    for tree in kind[1]:
        score += RATE * tree_score(tree, bins)
    return 1 / (1 + np.exp(-score))


def train(docs: DataFrame) -> dict:
    """Fit on the bounded sample; the driver gets MAX_CANDIDATES feature rows at most."""
    docs = common.text_docs(docs)
    n = docs.count()
    share = min(1.0, SAMPLE_DOCS / max(1, n))
    picked = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("pii")), F.lit(1_000_000)) < int(share * 1_000_000) + 1)

    def fn(cols):
        out = {"key": [], "x": [], "y": []}
        for doc_id, text in zip(*cols):
            key = int.from_bytes(hashlib.blake2b(f"{doc_id}".encode(), digest_size=5).digest(), "big")
            for n, (x, y) in enumerate(examples(text, key)):
                if max(y) >= 0:
                    out["key"].append(int.from_bytes(hashlib.blake2b(f"{doc_id}:{n}".encode(), digest_size=6).digest(), "big"))
                    out["x"].append(x)
                    out["y"].append(y)
        return out

    rows = common.map_rows(picked, fn, "key long, x array<double>, y array<int>").orderBy("key").limit(MAX_CANDIDATES).toPandas()
    if not len(rows):
        return fit(np.zeros((0, 0)), np.zeros((0, 0), int), np.zeros(0, bool))
    x = np.array(rows["x"].tolist(), dtype=float).reshape(len(rows), -1)
    y = np.array(rows["y"].tolist(), dtype=int).reshape(len(rows), -1)
    return fit(x, y, rows["key"].to_numpy() % 4 == 0)


def all_spans(texts: list[str], model: dict) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text."""
    bases = [base_spans(t) for t in texts]
    out = [(b, []) for b in bases]
    if not any(model["kinds"]):
        return out
    rows, spans = [], []
    for k, t in enumerate(texts):
        taken = bases[k]
        for a, b in candidates(t):
            if not any(s < b and a < e for s, _, e in taken):
                spans.append((k, a, b))
                rows.append(features(t, a, b))
    if not rows:
        return out
    bins = binned(model["edges"], np.array(rows, dtype=float))
    offers = []
    for kind, m in enumerate(model["kinds"]):
        if m:
            p = probability(model, m[:2], bins)
            offers += [(-p[i], *spans[i], kind) for i in np.flatnonzero(p >= m[2]) if spelled(texts[spans[i][0]][spans[i][1] : spans[i][2]], kind) is not None]
    for _, k, a, b, kind in sorted(offers, key=lambda o: (round(o[0], 6), *o[1:])):
        if not any(s < b and a < e for s, _, e in out[k][1]):
            out[k][1].append((a, kind, b))
    for _, added in out:
        added.sort()
    return out


def joined(spans: list) -> str:
    return ",".join([f"{KINDS[k]}:{a}:{b}" for a, k, b in spans])


def find(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """Base counts and digest, and all spans, of every document."""
    shared = common.Shared(docs.sparkSession, train(docs) if model is None else model)

    def fn(cols):
        out = {name.split()[0]: [] for name in SCHEMA.split(", ")}
        out["doc_id"] = cols[0]
        for base, added in all_spans(cols[1], shared.get()):
            for k, kind in enumerate(KINDS):
                out[f"n_{kind}"].append(sum([x[1] == k for x in base]))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(sorted(base + added)))
            out["n_added"].append(len(added))
            out["n_spans"].append(len(base) + len(added))
        return out

    return common.map_rows(common.text_docs(docs), fn, SCHEMA)


def replaced(text: str, spans: list) -> str:
    """The text with each span (each run of overlapping ones) replaced by its kind in brackets."""
    parts, free = [], 0
    for a, kind, b in spans:
        if a >= free:
            parts += [text[free:a], f"[{KINDS[kind].upper()}]"]
        free = max(free, b)
    return "".join(parts) + text[free:]


def redact(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """The same rows and columns, each span of the text replaced by its kind in brackets; n_chars follows the text."""
    shared = common.Shared(docs.sparkSession, train(docs) if model is None else model)
    names = docs.columns
    at = names.index("text")

    def fn(cols):
        found = all_spans([t or "" for t in cols[at]], shared.get())
        texts = []
        for t, (base, added) in zip(cols[at], found):
            spans = sorted(base + added)
            while spans:  # what stays may match now that its neighbours are gone
                t = replaced(t, spans)
                spans = base_spans(t)
            texts.append(t)
        out = dict(zip(names, cols)) | {"text": texts}
        if "n_chars" in out:
            out["n_chars"] = [None if t is None else len(t) for t in texts]
        return out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return common.map_rows(docs, fn, schema)
