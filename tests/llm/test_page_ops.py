"""Web archives and page text: round trips, brute force, odd rows."""
import gzip
import hashlib
import html
import io
import os
import re
from glob import glob

import pytest

from tidemark.llm import html as pages
from tidemark.llm import warc

from .conftest import SF

PAGES = "page_id long, url string, html string"


def sha1(t):
    return hashlib.sha1((t or "").encode()).hexdigest()


def odd_pages():
    big, other = "<p>é" + "x" * 1200, "<p>" + "y" * 999
    return [(1, "http://a/", big), (2, "http://a/2", big), (3, None, big), (4, "http://b/\r\nx", None), (5, "", ""), (-6, "http://c/", "<p>tiny"), (7, "http://c/", "<p>tiny"),
            (8, "u", other[:999]), (9, "u", other[:999]), (10, "u", other), (11, "u", other), (12, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 40), (11, "u", other)]


def check_warc(df, rows):
    got = warc.round_trip(df).collect()
    assert len(got) == len(rows)
    last, taken = {}, set()
    for i, _, h in rows:
        last[h] = max(i, last.get(h, i))
    for r in sorted(got, key=lambda r: (r["page_id"], r["record_type"])):
        h = next(x[2] for x in rows if x[0] == r["page_id"] and sha1(x[2]) == r["payload_digest"])
        big = len((h or "").encode()) >= 1000
        response = not big or (r["page_id"] == last[h] and h not in taken)
        if big and response:
            taken.add(h)
        assert (r["payload_bytes"], r["record_type"], r["refers_to"]) == (len((h or "").encode()), "response" if response else "revisit", None if response else last[h])
        assert r["has_request"] and r["n_metadata"] == 1


def test_round_trip(spark):
    rows = odd_pages()
    check_warc(spark.createDataFrame(rows, PAGES).repartition(3), rows)
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0
    big = rows[0][2]
    lone = [(None, "u", "x"), (None, None, big), (None, "v", None), (None, "w", "z" * 2000), (None, "w", "z" * 2000), (2, "y", big)]
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(spark.createDataFrame(lone, PAGES)).collect())
    n = len(big.encode())
    assert got == [(0, 0, "response", None), (0, 1, "response", None), (0, n, "revisit", 2), (0, 2000, "response", None), (0, 2000, "response", None), (2, n, "response", None)]


def test_round_trip_of_the_table(spark):
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    df = spark.read.parquet(f"{SF}/pages.parquet")
    check_warc(df, [tuple(r) for r in df.select("page_id", "url", "html").collect()])


def test_archives_are_plain_records(spark, tmp_path):
    rows = odd_pages()
    warc.write(spark.createDataFrame(rows, PAGES), f"{tmp_path}/w")
    kinds, payloads = [], {}
    for f in glob(f"{tmp_path}/w/*.gz"):
        for head, block in warc.parse(io.BytesIO(gzip.open(f).read())):
            kinds.append(head["warc-type"])
            if head["warc-type"] == "response":
                payload = block.partition(b"\r\n\r\n")[2]
                assert head["warc-payload-digest"] == "sha1:" + hashlib.sha1(payload).hexdigest()
                payloads[head["warc-target-uri"]] = payload
    assert kinds.count("request") == kinds.count("metadata") == len(rows) == kinds.count("response") + kinds.count("revisit")
    assert payloads["urn:page:3"].decode() == rows[0][2]
    nested = warc.assemble(warc.read(spark, f"{tmp_path}/w"))
    assert all(bytes(r["request"]["block"]).startswith(b"GET ") and len(r["metadata"]) == 1 for r in nested.collect())


def test_bad_framing_is_an_error():
    good = b"WARC/1.1\r\nWARC-Type: x\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    assert [b for _, b in warc.parse(io.BytesIO(good * 2))] == [b"ab", b"ab"]
    for bad in (good[:-6], b"junk\r\n" + good):
        with pytest.raises(ValueError):
            list(warc.parse(io.BytesIO(bad)))


def test_article_text():
    page = """<!DOCTYPE html><head><title>t</title><script>var a="</p>";</script></head><body><header>Site</header><nav><ul><li>menu</ul></nav><div class="cookie-notice">ok?</div>
    <article><header><h1>Head&amp;line &am</h1></header><p><b>One</b>two&nbsp; &lt;3<br>line<p>par<i>a</i>graph <!-- no --> end<aside>box</aside><div class="ad">buy</div>
    <form>mail <input></form><section id="comments"><article><p>reader</article></section></article><footer>&copy; x</footer>"""
    assert pages.extract(page) == "Head&line &am Onetwo <3 line paragraph end"
    assert pages.extract("no tags at all &eacute;") == "no tags at all é"
    assert pages.extract(None) == pages.extract("") == pages.extract("<div><p></p></div>") == ""


def test_wrapper_takes_out_template_text(spark):
    body = lambda n: f"<body><div class=x>Our site slogan</div><div><p>Text {n} of its own<p>and {n * 7}</div><div>All rights kept</div></body>"
    rows = [(k, "http://h.example/%d" % k, body(k)) for k in range(5)] + [(9, "http://lone.example/", body(9)), (10, None, body(10)), (11, "http://h.example/x", None)]
    got = {r["page_id"]: r["text"] for r in pages.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[3] == "Text 3 of its own and 21" and got[9] == "Our site slogan Text 9 of its own and 63 All rights kept" and got[11] == ""
    assert pages.main_text(spark.createDataFrame([], PAGES)).count() == 0


def test_repeats_fold():
    text = lambda *keys: ("#", frozenset(keys))
    tag = lambda name: (name, frozenset())
    items = [tag("ul"), *(x for k in (5, 6, 7) for x in (tag("li"), text(k), tag("/li"))), tag("/ul")]
    assert pages.folded(items) == [tag("ul"), ("*li # /li", frozenset((5, 6, 7))), tag("/ul")]


def test_alignment_makes_slots_optionals_and_repeats():
    w = pages.Wrapper()
    for n in range(4):
        w.align(pages.Wrapper.of(f"<div><h2>Same</h2>{'<em2>extra</em2>' if n == 2 else ''}<p>t{n}</p>{f'<p>more {n}</p>' * n}</div>"))
    assert w.pages == 4 and w.constants() == [pages.text_key("/div/h2", "Same")]
    by = {i[0]: i for i in w.items}
    assert by["em2"][2] and by["em2"][3] == 1 and not by["h2"][2] and by["h2"][3] == 4 and "*p # /p" in by
    again = pages.Wrapper.unpack(w.pack())
    assert again.items == w.items and again.paths == w.paths and again.rule() == w.rule()


def plain_sites(rng, hosts, n):
    """Sites without a telling tag or class: (page_id, url, html), and the text of each page's main element."""
    words = lambda k: " ".join(rng.choice("era tion wh lyer an heo st ing ou es".split()) + str(rng.randrange(1000)) for _ in range(k))
    rows, want = [], {}
    for h in range(hosts):
        menu = "".join(f"<li><a href=/{k}>{words(2)}</a>" for k in range(rng.randrange(3, 9)))
        slogan, rights, order = words(6), words(12), rng.random() < 0.5
        for k in range(n):
            paragraphs = [words(rng.randrange(20, 60)) for _ in range(rng.randrange(2, 8))]
            head = words(5)
            body = f"<div class=c{h}><h2>{head}</h2>" + "".join(f"<p>{p}</p>" for p in paragraphs) + "</div>"
            side = "<div class=s><ul>" + "".join(f"<li><a href=x>{words(3)}</a></li>" for _ in range(rng.randrange(2, 7))) + "</ul></div>"
            top = f"<div class=t>{slogan}</div><div class=m><ul>{menu}</ul></div>"
            i = len(rows)
            rows.append((i, f"http://h{h}.example/{k}", f"<html><body>{top}{side if order else ''}{body}{'' if order else side}<div class=b>{rights}</div></body></html>"))
            want[i] = " ".join([head, *paragraphs])
    return rows, want


def test_wrappers_find_main_text_without_telling_marks(spark):
    import random

    rows, want = plain_sites(random.Random(4), 12, 15)
    df = spark.createDataFrame(rows, PAGES).repartition(7)
    assert pages.infer(df).count() == 12
    got = {r["page_id"]: r["text"] for r in pages.main_text(df).collect()}
    right = sum(got[i] == t for i, t in want.items())
    kept = sum(len(set(got[i].split()) & set(t.split())) for i, t in want.items()) / sum(len(set(t.split())) for t in want.values())
    assert right >= 0.95 * len(want) and kept >= 0.98, (right, len(want), kept)


def test_rules_joined_by_salt_are_the_same(spark, monkeypatch):
    import random

    rows, _ = plain_sites(random.Random(5), 3, 6)
    rows += [(100, None, "<p>x"), (100, None, "<p>x"), (None, "http://h0.example/q", None), (101, "u", "")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], PAGES + ", main string").repartition(3)
    few = sorted(map(tuple, pages.main_text(df).collect()), key=str)
    monkeypatch.setattr(pages, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, pages.main_text(df).collect()), key=str) == few and len(few) == len(rows)


def test_articles_of_the_table(spark):
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    df = spark.read.parquet(f"{SF}/pages.parquet")
    want = {}
    for r in df.collect():
        a = re.search(r"<article>(.*)</article>", r["html"], re.S).group(1)
        want[r["page_id"]] = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)>", " ", a))).split())
    got = pages.main_text(df).collect()
    assert {r["page_id"]: (r["text"], r["n_chars"]) for r in got} == {i: (t, len(t)) for i, t in want.items()}
