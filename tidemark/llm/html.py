"""Main text of web pages by union-free wrappers of each host.

A page is a stream of tags and texts.  Runs of equal groups are folded into
repeats; then the streams of a host are aligned one after the other: texts that
differ become slots, tokens that only some pages have become optional items, and
texts that all pages have in a place are constants.  All pages of a host take
part: a batch aligns its pages to a partial wrapper, partial wrappers are aligned
in turn, first in salted groups, then by host, so no task sees a host's pages.
Along with its items a wrapper holds for each element path how often it opens,
its text and its link text.

The wrapper chooses the main text: from the body it goes down to the element that
holds most of the text of slots (link text, constants and what by its tag, role,
class or id looks like no article weigh little, article and main elements much),
as long as one element holds it on each page.  Inside, paths of link lists and of
such marks are left out, and so are constants, but in article and main elements,
whose text is theirs.  A page whose wrapper finds nothing on it, or that has no
host or is its host's only page, is its own wrapper.

Text is decoded, runs of white space become a space, blocks are joined by one
space in page order; nothing is capped.  A null, empty or text-free html gives
an empty text; a null url has no host.  Repeated rows give repeated rows; ties
between paths go to the first by name; columns besides page_id, url and html are
ignored; an empty table gives an empty result.
"""
from __future__ import annotations

import difflib
import html as entities
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SALTS = 64  # first groups in which partial wrappers of a host are aligned
MOST = 3_000  # items of a wrapper; beyond, optional items that one page in a thousand has are dropped from the model
SHARE = 0.55  # of its parent's weight that an element needs to be gone down to
BROADCAST_BYTES = 16 << 20  # of all rules; beyond, they are joined by host and salt
#: Fixed lists: elements without an end tag, without page text, and ones that are no article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|template|textarea|iframe|noembed|xmp|svg|math|object|noscript|title"
ASIDE = frozenset("head nav footer aside form button select option label fieldset dialog menu header audio video canvas".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar".split())
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal "
    "newsletter subscribe sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments disqus reply replies respond "
    "related share sharing social widget toc pagination login signup search".split()
)
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[a-zA-Z/][^>]*>""",
    re.S | re.I,
)
_ATTR = re.compile(r"""\b(class|id|role|hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_NUMBER = re.compile("[0-9]+")
_TOP = ("", False, False, "", False)
#: Fixed list: elements that hold text rather than parts of a page.
_TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote figcaption caption summary".split())
_INLINE = frozenset("a abbr b bdi bdo cite code del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())


def parse(page: str):
    """Yield (signature, None, ...) for tags and (path, text, inside, aside) for texts; inside: in an article or main element."""
    stack: list[tuple[str, bool, bool, str, bool]] = []  # tag, aside, inside, path of block elements, in a link
    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            yield "#", page[at : m.start()], stack
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if m["end"]:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if depth is not None:
                del stack[depth:]
            yield "/" + tag, None, stack
            continue
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in _CLOSES.get(tag, ()):
                del stack[k:]
                break
            if stack[k][0] not in _INLINE:
                break
        words, role, hidden = "", "", False
        if m["attrs"]:
            for name, *value in _ATTR.findall(m["attrs"]):
                name, value = name.lower(), "".join(value).lower()
                if name == "role":
                    role = value
                elif name == "hidden":
                    hidden = True
                else:
                    words += " " + value
        parent = stack[-1] if stack else _TOP
        names = frozenset(_SPLIT.split(_NUMBER.sub("0", words))) if words else frozenset()
        main = tag in ("article", "main") or role in ("main", "article")
        aside = parent[1] or hidden or bool(names & ASIDE_WORDS and tag not in ("body", "html")) or role in ASIDE_ROLES
        aside = aside or (tag in ASIDE and not (tag == "header" and parent[2]))
        sig = tag + "".join([f".{w}" for w in sorted(names) if w]) if names else tag
        if tag not in VOID and not m["attrs"].endswith("/"):
            path = parent[3] if tag in _INLINE else f"{parent[3]}/{sig}" + "!" * (main and not aside) + "~" * (aside and not parent[1])
            stack.append((tag, aside, parent[2] or (main and not aside), path, parent[4] or tag == "a"))
        yield sig, None, stack
    if at < len(page):
        yield "#", page[at:], stack


def clean(raw: str) -> str:
    return entities.unescape(raw) if "&" in raw else raw


def text_key(path: str, text: str) -> int:
    from zlib import crc32

    t = " ".join(text.split())
    return crc32(t.encode("utf-8", "replace")) << 31 | crc32((path + "\0" + t).encode("utf-8", "replace")) >> 1


def read(page: str):
    """The stream of a page: (signature, path of the element, text, in a link); text None for a tag of a block element."""
    for sig, text, stack in parse(page):
        top = stack[-1] if stack else _TOP
        if text is None:
            if sig.lstrip("/").split(".")[0] not in _INLINE:
                yield sig, top[3], None, False
        else:
            yield "#", top[3], text, top[4]


class Wrapper:
    """A union-free expression over a host's pages, and what its element paths hold.

    items: [signature, constant text keys, optional, pages]; a repeat's signature
    begins with '*', and its keys are those of the texts in it.  paths: opens,
    characters, link characters, pages that have the path.
    """

    def __init__(self, items=(), paths=None, pages: int = 0):
        self.items, self.paths, self.pages = [list(i) for i in items], paths or {}, pages
        self.known: dict[tuple, list[int]] = {}  # where the items of streams met before are

    @classmethod
    def of(cls, page: str | None) -> Wrapper:
        tokens, paths = [], {}
        for sig, path, text, link in read(page or ""):
            if text is None:
                tokens.append((sig, frozenset()))
                if sig[0] != "/" and path.endswith((sig, sig + "!", sig + "~")):
                    paths.setdefault(path, [0, 0, 0, 1])[0] += 1
            elif not text.isspace():
                t = clean(text)
                n = len(" ".join(t.split()))
                tokens.append(("#", frozenset([text_key(path, t)])))
                at = paths.setdefault(path, [0, 0, 0, 1])
                at[1] += n
                at[2] += n * link
        return cls([[sig, keys, False, 1] for sig, keys in folded(tokens)], paths, 1)

    def align(self, other: Wrapper) -> None:
        """Take in another wrapper: mismatches become optional items, unlike texts slots."""
        for path, (opens, chars, link, n) in other.paths.items():
            at = self.paths.setdefault(path, [0, 0, 0, 0])
            at[0] += opens
            at[1] += chars
            at[2] += link
            at[3] += n
        self.pages += other.pages
        if not self.items:
            self.items = [list(i) for i in other.items]
            return
        sigs = tuple(i[0] for i in other.items)
        places = self.known.get(sigs)
        if places is None:
            mine = [i[0] for i in self.items]
            match = difflib.SequenceMatcher(None, mine, sigs, autojunk=False)
            merged, places, was = [], [0] * len(sigs), [0] * len(mine)
            for op, a, b, c, d in match.get_opcodes():
                for k in range(a, b):
                    was[k] = len(merged)
                    merged.append(self.items[k])
                    if op == "equal":
                        places[c + k - a] = was[k]
                    else:
                        self.items[k][2] = True
                if op != "equal":
                    for k in range(c, d):
                        places[k] = len(merged)
                        merged.append([sigs[k], other.items[k][1], True, 0])
            self.items = merged
            self.known = {s: [was[k] for k in old] for s, old in self.known.items()}
            self.known[sigs] = places
        for place, (_, keys, optional, n) in zip(places, other.items):
            item = self.items[place]
            item[1] = item[1] & keys
            item[2] = item[2] or optional
            item[3] += n
        if len(self.items) > MOST:
            self.items = [i for i in self.items if not i[2] or 1000 * i[3] > self.pages]
            self.known = {}

    def constants(self) -> list[int]:
        """Texts that all pages have which have the item, three or more pages and most pages of the host."""
        return sorted({key for _, keys, _, n in self.items if n > 2 and 2 * n > self.pages for key in keys})

    def pack(self) -> str:
        return json.dumps([[[sig, sorted(keys), o, n] for sig, keys, o, n in self.items], self.paths, self.pages])

    @classmethod
    def unpack(cls, raw: str) -> Wrapper:
        items, paths, pages = json.loads(raw)
        return cls([[sig, frozenset(keys), o, n] for sig, keys, o, n in items], paths, pages)

    def rule(self) -> tuple[str, list[str]]:
        """The path of the element that holds the main text, and the paths below it that are left out."""
        weight: dict[str, float] = {}
        for path, (_, chars, link, _) in self.paths.items():
            w = max(0, chars - 2 * link) * (0.02 if "~" in path else 8.0 if "!" in path else 1.0)
            parts = path.split("/")
            for k in range(1, len(parts)):
                at = "/".join(parts[: k + 1])
                weight[at] = weight.get(at, 0.0) + w
        children: dict[str, list[str]] = {}
        for path in weight:
            children.setdefault(path.rpartition("/")[0], []).append(path)
        main, below = "", sum(w for p, w in weight.items() if p.count("/") == 1)
        while True:
            best = max(sorted(children.get(main, [])), key=weight.__getitem__, default=None)
            if best is None or weight[best] <= 0 or weight[best] < SHARE * below or main.endswith("!") and not best.endswith("!"):
                break
            tag = best.rpartition("/")[2].split(".")[0].rstrip("!~")
            opens, _, _, pages = self.paths.get(best, (0, 0, 0, 0))
            if tag in _TEXTUAL or (opens > 1.5 * max(1, pages) and (main.endswith("!") or not best.endswith("!"))):
                break
            main, below = best, weight[best]
        out, whole = [], sum(v[1] for p, v in self.paths.items() if p.startswith(main))
        for path, (_, chars, link, _) in self.paths.items():
            if path.startswith(main) and (len(path) == len(main) or path[len(main)] == "/"):
                rest = path[len(main) :]
                if "~" in rest or ("!" not in path and link > 0.6 * chars and 4 * chars < whole):
                    out.append(path)
        return main, sorted(out)


def folded(items: list) -> list:
    """Neighbouring equal groups become one repeat, '*' and its signatures, with the keys of all its texts."""
    out: list = []
    sigs: list = []
    for item in items:
        out.append(item)
        sigs.append(item[0])
        for width in range(1, 9):
            if len(out) >= 2 * width and sigs[-width:] == sigs[-2 * width : -width]:
                keys = frozenset().union(*(k for _, k in out[-2 * width :]))
                group = sigs[-1] if width == 1 and sigs[-1].startswith("*") else "*" + " ".join(sigs[-width:])
                del out[-2 * width :], sigs[-2 * width :]
                out.append((group, keys))
                sigs.append(group)
                break
            if len(out) > width and sigs[-width - 1] == "*" + " ".join(sigs[-width:]):
                keys = frozenset().union(*(k for _, k in out[-width - 1 :]))
                group = sigs[-width - 1]
                del out[-width - 1 :], sigs[-width - 1 :]
                out.append((group, keys))
                sigs.append(group)
                break
    return out


def extract(page: str | None, rule: tuple[str, list[str], list[int]] | None = None) -> str:
    """The page's main text, given its host's main path, paths left out and constants."""
    if not page:
        return ""
    if rule is None:
        rule = (*Wrapper.of(page).rule(), ())
    main, dropped, constants = rule[0], set(rule[1]), set(rule[2])
    out, some = [], False
    for _, path, text, _ in read(page):
        if text is None:
            out.append(" ")
        elif path.startswith(main) and (len(path) == len(main) or path[len(main)] == "/") and "~" not in path[len(main) :] and path not in dropped:
            t = clean(text)
            if not constants or "!" in path or t.isspace() or text_key(path, t) not in constants:
                out.append(t)
                some = some or not t.isspace()
    if not some and main:
        own = Wrapper.of(page).rule()
        if own[0] != main:
            return extract(page, (*own, ()))
    return " ".join("".join(out).split())


def host_of(url):
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def infer(pages: DataFrame) -> DataFrame:
    """host, main, dropped array<string>, constants array<long>, pages of every host with two pages or more."""

    def partial(cols):
        by: dict[str, Wrapper] = {}
        for host, page in zip(*cols):
            if host and page:
                by.setdefault(host, Wrapper()).align(Wrapper.of(page))
        return {"host": list(by), "wrapper": [w.pack() for w in by.values()]}

    bare = pages.where("url is not null and html is not null").select(host_of(F.col("url")).alias("host"), "html")
    parts = common.map_rows(bare, partial, "host string, wrapper string", 32 << 20).withColumn("salt", (F.monotonically_increasing_id() % SALTS).cast("int"))

    def joined(group) -> Wrapper:
        whole = Wrapper()
        for raw in sorted(group):
            whole.align(Wrapper.unpack(raw))
        return whole

    def some(key, group):
        import pandas as pd

        return pd.DataFrame({"host": [key[0]], "wrapper": [joined(group["wrapper"]).pack()]})

    def last(key, group):
        import pandas as pd

        w = joined(group["wrapper"])
        main, dropped = w.rule()
        return pd.DataFrame({"host": [key[0]], "main": [main], "dropped": [dropped], "constants": [w.constants()], "pages": [w.pages]})

    merged = parts.groupBy("host", "salt").applyInPandas(some, "host string, wrapper string")
    return merged.groupBy("host").applyInPandas(last, "host string, main string, dropped array<string>, constants array<long>, pages long").where("pages > 1")


def with_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Add main, dropped, constants.  Rules of a checked size are sent to the pages; more are joined by host and salt, so no host meets in one task."""
    rules = common.saved(rules.drop("pages"), "rules").withColumnRenamed("host", "_host")
    size = rules.agg(F.sum(F.octet_length("main") + 8 * F.size("constants") + F.octet_length(F.array_join("dropped", ",")) + 64)).head()[0] or 0
    tied = pages.withColumn("_host", host_of(F.col("url")))
    if size <= BROADCAST_BYTES:
        return tied.join(F.broadcast(rules), "_host", "left").drop("_host")
    salted = rules.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return tied.withColumn("_salt", F.pmod(F.xxhash64("page_id", "html"), F.lit(SALTS)).cast("int")).join(salted, ["_host", "_salt"], "left").drop("_host", "_salt")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    pages = pages.select("page_id", "url", "html")
    tied = with_rules(pages, infer(pages)).select("page_id", "url", "html", "main", "dropped", "constants")

    def fn(cols):
        texts = [extract(page, None if main is None else (main, dropped, constants)) for page, main, dropped, constants in zip(*cols[2:])]
        return {"page_id": cols[0], "url": cols[1], "text": texts, "n_chars": [len(t) for t in texts]}

    return common.map_rows(tied, fn, "page_id long, url string, text string, n_chars long")
