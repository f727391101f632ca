"""BPE encoding as a bounded-lookahead streaming transducer, and incremental decoding.

The encoding of a string ends in one token only, and two tokens may stand side
by side exactly if encoding their concatenation gives the two back.  So the
encodings of all prefixes form a tree: the encoding of a prefix is that of a
shorter one and one more token.  A token that starts after position n begins in
the last `lookahead` = (longest token - 1) symbols before n, so what all nodes
of that window have in common is stable and is emitted.  Live memory is the
window and what it has not yet agreed on.

A text is read in blocks of BLOCK characters, cut before white space, or inside
a longer run before an ASCII character; a pre-token that reaches a block's end
is fed to the transducer in parts.  Ids leave as soon as they are stable, go
through the decoder at once, and both streams are hashed as they go, so memory
does not grow with the text or with its longest word.  Words repeat, so a worker
keeps the ids of recent words in a cache of bounded size; a word's ids do not
depend on its neighbours.

Empty and null texts give no tokens and the digests of the empty string.
Repeated rows give repeated rows; other columns of the input are ignored by
digests() and decode(), and kept by encode(), where a column named ids is
replaced.  An empty table gives an empty result.
"""
from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata

from pyspark.sql import DataFrame, SparkSession

from . import common

END = "</w>"
CACHE_WORDS = 100_000  # a worker keeps the ids of twice as many words at most
CACHE_PAIRS = 200_000
NONE = 1 << 60  # the rank of a pair that does not merge
_LAST = "\x00"  # stands for the end of a word; no symbol of a vocabulary
BLOCK = 1 << 16  # characters read at a time
#: Letters whose case, class and composition need no Unicode tables (fixed by Latin-1).
PLAIN = "\t\n\r -~À-ÖØ-öø-ÿ"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


@functools.cache
def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = sorted({*range(256)} - {*own})
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def load_tables(path: str) -> dict:
    """What encoding needs of a tokenizers JSON file; a plain dict, small enough to broadcast (the file's own size)."""
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model = whole["model"]
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
    tables = {
        "vocab": model["vocab"],
        "ranks": {p: k for k, p in enumerate(pairs)},
        "end": model.get("end_of_word_suffix") or "",
        "special": {t["content"]: t["id"] for t in whole.get("added_tokens", [])},
    }
    t = Transducer(**tables)
    return tables | {"whole": t.whole}


class Transducer:
    """Encodes one pre-token after another: begin(), feed() with its parts, finish()."""

    def __init__(self, vocab: dict, ranks: dict, end: str = END, special: dict | None = None, whole: dict | None = None):
        import ahocorasick

        self.vocab, self.ranks, self.end, self.special = vocab, ranks, end, special or {}
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.text_names = {str(i): t for i, t in self.names.items()}
        self.letters = byte_letters()
        self.longest = max((len(self.symbols(a + b)) for a, b in ranks), default=1)
        self.lookahead = self.longest - 1
        self.whole = whole if whole is not None else {token: last for token in vocab if (last := self.stands(token))}
        self.words: dict[str, str] = {}  # of late, and of the time before
        self.older: dict[str, str] = {}
        self.sides: dict[tuple[str, str], bool] = {}
        self.finder = ahocorasick.Automaton()
        cut = len(end) or None
        for token in self.whole:
            if token.endswith(end) and end:
                self.finder.add_word(token[:-cut] + _LAST, (token, len(token) - cut + 1))
            else:
                self.finder.add_word(token, (token, len(token)))
        self.finder.make_automaton()
        self.begin()

    def symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            cut = len(token) - len(self.end) - 1
            return [*token[:cut], token[cut:]]
        return [*token]

    def stands(self, token: str) -> tuple[int, str, str] | None:
        """The last merge of a token that is its own encoding: rank (-1 for a single symbol), left, right."""
        parts = self.symbols(token)
        while len(parts) > 2:
            best, at = min((self.ranks.get((parts[i], parts[i + 1]), NONE), i) for i in range(len(parts) - 1))
            if best == NONE:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        rank = self.ranks.get(tuple(parts), NONE) if len(parts) == 2 else -1
        return (rank, parts[0], parts[-1]) if rank != NONE else None

    def beside(self, left: str, right: str) -> bool:
        """Whether two tokens that stand side by side stay two.

        Their merges are undone from the last to the first (of one rank the right
        one is the later).  They stay apart if at no time a merge across the border
        would have come before the one that is undone next.
        """
        whole, ranks, limit = self.whole, self.ranks, NONE
        a, b = whole[left], whole[right]
        while True:
            if ranks.get((left, right), NONE) < limit:
                return False
            if a[0] > b[0]:
                limit, left = a[0], a[2]
                a = whole[left]
            elif b[0] < 0:
                return True
            else:
                limit, right = b[0] + 1, b[1]
                b = whole[right]

    def begin(self) -> None:
        """Start a word.  text: its symbols from `base` on; nodes: last token and its start of each live prefix."""
        self.text, self.base, self.done = "", 0, 0
        self.nodes: dict[int, tuple[str, int]] = {}

    def feed(self, part: str) -> list[str]:
        """Take symbols of the word, not its last one; the tokens that no continuation can change."""
        out: list[str] = []
        n = self.base + len(self.text)
        self.text += part
        whole, beside, wide = self.whole, self.beside, 3 * self.longest
        for n in range(n + 1, n + len(part) + 1):
            text, base, nodes = self.text, self.base, self.nodes
            for start in range(max(self.done, n - self.longest), n):
                token = text[start - base : n - base]
                if token in whole and (not start or beside(nodes[start][0], token)):
                    nodes[n] = (token, start)
                    break
            else:
                raise ValueError(f"no token of the vocabulary ends in {text[-20:]!r}")
            if n - self.done >= wide:
                stable = self.agreed(n)
                if stable > self.done:
                    out += self.path(stable)
                    kept = self.nodes[stable]
                    self.nodes = {k: v for k, v in self.nodes.items() if k > stable} | {stable: kept}
                    self.text, self.base, self.done = self.text[stable - self.base :], stable, stable
        return out

    def finish(self, final: str) -> list[str]:
        """The word's last symbol, which carries the end sign; the rest of its tokens."""
        text = self.text + final + self.end
        for start in range(max(self.done, self.base + len(self.text) + 1 - self.longest), self.base + len(self.text) + 1):
            token = text[start - self.base :]
            if token in self.whole and (not start or self.beside(self.nodes[start][0], token)):
                return [*self.path(start), token]
        raise ValueError(f"no token of the vocabulary ends {text[-20:]!r}")

    def agreed(self, n: int) -> int:
        """The furthest boundary that the encodings of all prefixes ending in the window share."""
        done, nodes = self.done, self.nodes
        live = set(range(max(done, n - self.lookahead), n + 1))
        while len(live) > 1:
            far = max(live)
            live.discard(far)
            live.add(max(done, nodes[far][1]))
        return live.pop()

    def path(self, at: int) -> list[str]:
        out = []
        while at > self.done:
            token, at = self.nodes[at]
            out.append(token)
        return out[::-1]

    def short(self, text: str) -> list[str]:
        """The tokens of a word that fits the window: the same tree, its tokens found by an automaton, longest first."""
        n, sides, beside = len(text), self.sides, self.beside
        lasts: list = [None] * (n + 2)
        starts = [0] * (n + 2)
        if len(sides) > CACHE_PAIRS:
            sides.clear()
        for at, (token, size) in self.finder.iter(text + _LAST if self.end else text):
            at += 1
            if lasts[at] is None:
                start = at - size
                if start:
                    pair = (lasts[start], token)
                    ok = sides.get(pair)
                    if ok is None:
                        ok = sides[pair] = beside(*pair)
                    if not ok:
                        continue
                lasts[at], starts[at] = token, start
        at, out = n + 1 if self.end else n, []
        while at:
            out.append(lasts[at])
            at = starts[at]
        return out[::-1]

    def mapped(self, raw: str) -> str:
        return raw if raw.isascii() and raw.isprintable() else "".join([self.letters[b] for b in raw.encode("utf-8", "surrogatepass")])

    def join(self, tokens: list[str]) -> str:
        vocab = self.vocab
        return " ".join([str(vocab[t]) for t in tokens])

    def word(self, raw: str) -> str:
        """The ids of a whole pre-token, joined by a space."""
        got = self.words.get(raw) or self.older.get(raw)
        if got is None:
            text = self.mapped(raw)
            token = text + self.end
            if token in self.whole:
                got = str(self.vocab[token])
            elif len(text) <= 2 * self.longest:
                got = self.join(self.short(text))
            else:
                self.begin()
                got = self.join(self.feed(text[:-1]) + self.finish(text[-1]))
        if len(self.words) >= CACHE_WORDS:
            self.older, self.words = self.words, {}
        self.words[raw] = got
        return got


_FAST = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
_ODD = re.compile(f"[^{PLAIN}]")
_ASCII = re.compile(r"[\x00-\x7f]")
_SPACE = re.compile(r"\s")


def _patterns():
    """The pre-token pattern, and those that continue a run of letters or of other signs, for any text."""
    import regex

    other = r"[^\p{White_Space}\p{L}\p{N}]+"
    return regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|{other}"), (regex.compile(r"\p{L}+"), regex.compile(other)), regex.compile(r"\p{White_Space}+")


def normal(text: str) -> str:
    """NFC, white space to a space, lower case of each code point."""
    if not _ODD.search(text):
        return text.lower()
    return _patterns()[2].sub(" ", unicodedata.normalize("NFC", text)).replace("Σ", "σ").lower()


def split_words(text: str) -> list[str]:
    """The pre-tokens of a text taken whole."""
    return _FAST.findall(text.lower()) if not _ODD.search(text) else _patterns()[0].findall(normal(text))


def cut(text: str, at: int, end: int) -> int:
    """Where a block that begins at `at` ends: before white space, else before an ASCII sign; composition crosses neither."""
    if end - at <= BLOCK:
        return end
    stop = at + BLOCK
    for k in range(stop, max(at, stop - 2000), -1):
        if text[k].isspace():
            return k
    if m := _SPACE.search(text, stop, min(end, stop + BLOCK)):
        return m.start()
    return next((k for m in _ASCII.finditer(text, stop, end) if not (text[k := m.start()].isalpha() and "'" in text[k - 2 : k])), end)


def encode_parts(t: Transducer, text: str):
    """Yield ids joined by a space, some pre-tokens at a time, special tokens in the text included."""
    at = 0
    if t.special and "<" in text:
        for m in re.finditer("|".join(re.escape(s) for s in sorted(t.special, key=len, reverse=True)), text):
            yield from _segment(t, text, at, m.start())
            yield str(t.special[m.group()])
            at = m.end()
    yield from _segment(t, text, at, len(text))


def _segment(t: Transducer, text: str, at: int, end: int):
    while at < end:
        stop, known = cut(text, at, end), t.words.get
        if stop == end or text[stop].isspace():
            words = split_words(text[at:stop])
            if words:
                yield " ".join([known(w) or t.word(w) for w in words])
            at = stop
        else:
            at = yield from _long_run(t, text, at, end)


def _long_run(t: Transducer, text: str, at: int, end: int):
    """Encode blocks whose last pre-token may go on in the next; gives where it ended, before white space."""
    whole, more, _ = _patterns()
    running, held = None, ""  # the pattern of the run that is being fed, and its last sign
    while at < end:
        stop = cut(text, at, end)
        block = normal(text[at:stop])
        last = stop == end or text[stop].isspace()
        at, k = stop, 0
        while k < len(block) or (last and running):
            if running:
                m = running.match(block, k)
                signs = t.mapped(m.group()) if m else ""
                k = m.end() if m else k
                held += signs
                if k < len(block) or last:
                    ids = t.feed(held[:-1]) + t.finish(held[-1])
                    running = None
                else:
                    ids = t.feed(held[:-1])
                    held = held[-1]
                if ids:
                    yield t.join(ids)
                continue
            m = whole.search(block, k)
            if not m:
                break
            k = m.end()
            if k < len(block) or last:
                yield t.word(m.group())
            elif run := next((p for p in more if p.fullmatch(m.group())), None):
                running, held = run, t.mapped(m.group())
                t.begin()
            else:  # a number or a contraction; the latter ends where it ends
                yield t.word(m.group())
        if last:
            break
    return at


class Decoder:
    """Token ids to text, piece by piece.

    byte_level: tokens spell bytes; a code point is given out once its last byte
    has come, and what cannot be one becomes U+FFFD.  Otherwise (a file without
    a decoder) tokens are joined by one space, as the library does.
    """

    def __init__(self, names: dict[int, str], byte_level: bool):
        import codecs

        self.names, self.byte_level, self.first = names, byte_level, True
        self.bytes = {c: b for b, c in byte_letters().items()} if byte_level else {}
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        """The text that some more ids add."""
        tokens = list(map(self.names.__getitem__, ids))
        if self.byte_level:
            return self.state.decode(bytes([self.bytes[c] for token in tokens for c in token]))
        out = " ".join(tokens)
        if tokens and not self.first:
            out = " " + out
        self.first = self.first and not tokens
        return out

    def finish(self) -> str:
        return self.state.decode(b"", True) if self.byte_level else ""


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """All columns of docs and ids array<int>: the operator's general output."""
    state = _shared(docs.sparkSession, tokenizer)

    def fn(texts):
        import numpy as np

        t = _worker(state)
        return {"ids": [np.array(" ".join(encode_parts(t, text or "")).split(), np.int32) for text in texts]}

    return common.extend(docs, "text", fn, "ids array<int>")


def decode(encoded: DataFrame, tokenizer: str, byte_level: bool = False) -> DataFrame:
    """doc_id and decoded string of rows with ids array<int>; a null array decodes to the empty text."""
    state = _shared(encoded.sparkSession, tokenizer)

    def fn(cols):
        names, out = _worker(state).names, []
        for ids in cols[1]:
            d = Decoder(names, byte_level)
            out.append(d.feed(ids or ()) + d.finish())
        return {"doc_id": cols[0], "decoded": out}

    return common.map_rows(encoded.select("doc_id", "ids"), fn, "doc_id long, decoded string")


def digest(t: Transducer, names: dict[str, str], text: str) -> tuple[int, str, str]:
    """Number of ids, and the digests of the ids and of what the decoder makes of them, as streams."""
    ids_sha, text_sha, n = hashlib.sha256(), hashlib.sha256(), 0
    decoder = Decoder(names, False)
    for part in encode_parts(t, text):
        ids_sha.update((" " + part if n else part).encode())
        ids = part.split(" ")
        n += len(ids)
        text_sha.update(decoder.feed(ids).encode())
    text_sha.update(decoder.finish().encode())
    return n, ids_sha.hexdigest(), text_sha.hexdigest()


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the text decoded from them, without building either."""
    state = _shared(docs.sparkSession, tokenizer)

    def fn(cols):
        t = _worker(state)
        names = t.text_names
        n, ids, decoded = zip(*[digest(t, names, text) for text in cols[1]])
        return {"doc_id": cols[0], "n_tokens": n, "ids_sha256": ids, "decoded_sha256": decoded}

    return common.map_rows(common.text_docs(docs), fn, SCHEMA)


def _shared(spark: SparkSession, tokenizer: str) -> common.Shared:
    return common.Shared(spark, load_tables(tokenizer))


def _worker(state: common.Shared) -> Transducer:
    """One transducer for each worker process."""
    return state.get(lambda tables: Transducer(**tables))
