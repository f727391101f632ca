"""Language, fingerprints, tokens, personal data, benchmark passages: against brute force and on odd rows."""
import hashlib
import random
import re
import unicodedata
from collections import Counter

import public_tokenizers
import pytest
import xxhash

from tidemark.llm import bpe, decontaminate, fingerprint, langid, pii

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# --- 1


def test_held_out_accuracy(spark, corpus):
    df, texts = corpus
    lang = {r["doc_id"]: r["lang"] for r in df.collect()}
    rows = langid.report(df).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    held = [r for r in rows if r["held_out"]]
    import zlib

    assert {r["doc_id"] for r in held} == {i for i in texts if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows) and sum(r["rejected"] for r in rows) <= 0.01 * len(rows)


def test_gibberish_is_rejected(spark, corpus):
    df, _ = corpus
    rng = random.Random(1)
    noise = ["".join(rng.choice("qxzjkvwpgbfmczxqyj ") for _ in range(2000)), "字" * 500]
    new = spark.createDataFrame([(900001 + k, t, None) for k, t in enumerate(noise)], "doc_id long, text string, lang string")
    models = langid.learn(df)
    assert all(r["rejected"] for r in langid.identify(new, models).collect())


def test_model_is_a_distribution():
    models = langid.Models({"a": langid.Models.levels(Counter({"\x02\x02\x02a": 3, "\x02\x02ab": 2, "\x02\x02a\x03": 1, "\x02ab\x03": 2}))[langid.ORDER]})
    probs = [float(models.score([w])[0, 0]) for w in ("ab", "a", "ba", "zz")]
    assert probs[0] > probs[1] > probs[3] and all(p < 0 for p in probs)


def test_language_odd_rows(odd_docs, no_docs):
    df, rows = odd_docs
    got = langid.report(df).collect()
    assert len(got) == len(rows)
    for r in got:
        text = rows[r["doc_id"]][1]
        assert (r["lang_pred"] == "und") == (not text or not any(map(str.isalpha, text)))
    assert langid.report(no_docs).count() == 0
    assert langid.keep(df).columns == df.columns


# --- 2


def canonical(t):
    t = unicodedata.normalize("NFC", unicodedata.normalize("NFC", t).lower())
    return re.sub(r"[\s\x1c-\x1f\x85]+", " ", t).strip(" ")


def fingerprint_of(t):
    form = canonical(t).encode()
    first = xxhash.xxh64_intdigest(form, 42)
    second = xxhash.xxh64_intdigest(b"second", 42)
    # an int column folds 4 bytes into the running seed, as Spark's xxhash64 does
    return f"{first:016x}", form, second


def test_fingerprints(spark, odd_docs, no_docs):
    df, rows = odd_docs
    got = fingerprint.near_report(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        text = rows[r["doc_id"]][1] or ""
        assert r["n_chars"] == len(text) and r["fingerprint"][:16] == fingerprint_of(text)[0] and len(r["fingerprint"]) == 32
        by.setdefault(r["fingerprint"], set()).add(canonical(text))
    assert all(len(forms) == 1 for forms in by.values()) and len(by) == len({canonical(r[1] or "") for r in rows})
    assert fingerprint.near_report(no_docs).count() == 0


def test_edits_follow_doc_id(spark, corpus, monkeypatch):
    monkeypatch.setattr(fingerprint, "SLICE_ROWS", 17)  # many slices
    df, texts = corpus
    order = sorted(texts)
    got = {r["doc_id"]: r for r in fingerprint.near_report(df).collect()}
    assert sorted(got) == order
    for k, i in enumerate(order):
        text, after = texts[i], texts[order[(k + 1) % len(order)]]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        assert got[i]["edited_sha256"] == sha(edited)
        assert got[i]["near_edited"] == float(canonical(text) == canonical(edited)) and got[i]["near_next"] == float(canonical(text) == canonical(after))


def test_shared_hashes_are_told_apart(spark):
    forms = spark.createDataFrame([("h", "b"), ("h", "a"), ("h", "a"), ("g", "c")], "hash string, form string")
    assert sorted(map(tuple, fingerprint.collisions(forms).select("hash", "form", "rank").collect())) == [("h", "a", 1), ("h", "b", 2)]


# --- 5


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    t.no_truncation()
    t.no_padding()
    return t


def test_tokens_are_the_librarys(spark, odd_docs, no_docs, corpus, library):
    for df in (odd_docs[0], corpus[0]):
        texts = df.select("doc_id", "text").collect()
        want = {}
        for r in texts:
            ids = library.encode(r["text"] or "", add_special_tokens=False).ids
            want[r["doc_id"]] = (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
        got = bpe.digests(df, TOKENIZER).collect()
        assert len(got) == len(texts) and all(want[r["doc_id"]] == (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got)
    assert bpe.digests(no_docs, TOKENIZER).count() == 0


def test_streaming_equals_merging(library):
    t = bpe.Transducer(**bpe.load_tables(TOKENIZER))
    rng = random.Random(2)
    for n in (2, 31, 32, 33, 64, 65, 200, 900):
        for letters in ("ab", "thean", "the"):
            word = "".join(rng.choice(letters) for _ in range(n))
            want = library.encode(word, add_special_tokens=False).tokens
            for step in (1, 7, n):  # fed in parts, and by the automaton
                t.begin()
                got = [x for k in range(0, n - 1, step) for x in t.feed(word[k : min(k + step, n - 1)])]
                assert got + t.finish(word[-1]) == want and t.short(word) == want


def test_special_tokens_and_scripts(library):
    t = bpe.Transducer(**bpe.load_tables(TOKENIZER))
    for text in ("a<|endoftext|>B <|STARTOFTEXT|>", "ΑΣ İ ² Ⅷ \x1c x", "日本語 don't L'ÉTÉ ½", "é 　 x\u0085y"):
        e = library.encode(text, add_special_tokens=False)
        assert " ".join(bpe.encode_parts(t, text)).split() == list(map(str, e.ids))


def test_blocks_do_not_change_ids(library, monkeypatch):
    t = bpe.Transducer(**bpe.load_tables(TOKENIZER))
    rng = random.Random(3)
    pools = ["abcdefghij", "a", "the ", "éßçñüÄÖ", "日本語", "!?.,;:'\"*#", "0123456789", " \n\t", "e\u0301a\u0308\u0327", "ΣσςİIı", "'st've", "😀"]
    texts = ["".join(rng.choice(rng.choice(pools)) for _ in range(n)) for n in (3, 40, 900, 3000) for _ in range(8)]
    texts += [x * 700 for x in ("a", "é", "日", "!", "x'", "the", "\u0301", "İ")] + ["." * 500 + "'s", "it" * 300 + "'ve" + "<|endoftext|>" + "9" * 200]
    for block in (7, 64, 300):
        monkeypatch.setattr(bpe, "BLOCK", block)
        for text in texts:
            ids = library.encode(text, add_special_tokens=False).ids
            want = len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))
            assert bpe.digest(t, t.text_names, text) == want, (block, text[:40])


def test_memory_does_not_grow_with_a_word_or_a_text():
    import tracemalloc

    t = bpe.Transducer(**bpe.load_tables(TOKENIZER))
    peaks = []
    for n in (70_000, 280_000):
        for text in ("z" * n, "ab cd efg " * (n // 10)):
            tracemalloc.start()
            bpe.digest(t, t.text_names, text)
            peaks.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
    assert peaks[2] < 1.5 * peaks[0] and peaks[3] < 1.5 * peaks[1], peaks


def test_decoder_waits_for_whole_code_points():
    letters = bpe.byte_letters()
    raw = "aé日😀".encode()
    names = {k: letters[b] for k, b in enumerate(raw)}
    d = bpe.Decoder(names, byte_level=True)
    pieces = [d.feed([k]) for k in range(len(raw))]
    assert pieces == ["a", "", "é", "", "", "日", "", "", "", "😀"] and d.finish() == ""
    d = bpe.Decoder(names, byte_level=True)
    assert d.feed([1]) + d.finish() == "�"


def test_round_trip(spark, corpus):
    df, _ = corpus
    encoded = bpe.encode(df.limit(20), TOKENIZER)
    assert encoded.columns == [*df.columns, "ids"]
    got = {r["doc_id"]: r["decoded"] for r in bpe.decode(encoded, TOKENIZER).collect()}
    want = {r["doc_id"]: r["decoded_sha256"] for r in bpe.digests(df.limit(20), TOKENIZER).collect()}
    assert {i: sha(t) for i, t in got.items()} == want


# --- 8


def plain_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for kind, pattern, low, high in ((2, r"[0-9]([\x20-]?[0-9])+", 12, 19), (3, r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m.group())
            total = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d)))
            if low <= len(d) <= high and (kind == 3 or total % 10 == 0):
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_on_random_text():
    rng = random.Random(1)
    letters = "0123456789" * 2 + " -.+()@ab._%"
    for _ in range(20000):
        t = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 100)))
        assert pii.base_spans(t) == plain_spans(t)


def test_personal_data(spark, odd_docs, no_docs, corpus):
    for df in (odd_docs[0], corpus[0]):
        texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
        for r in pii.find(df).collect():
            base = plain_spans(texts[r["doc_id"]])
            assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == n for s in base) for n in range(4)]
            assert r["base_sha256"] == sha(pii.joined(base))
            assert set(pii.joined(base).split(",")) <= set(r["spans"].split(","))
    assert pii.find(no_docs).count() == 0
    df, rows = odd_docs
    clean = pii.redact(df).collect()
    assert len(clean) == len(rows) and pii.redact(df).columns == df.columns
    assert all(r["text"] is None or not plain_spans(r["text"]) for r in clean)


def test_disguised_data_is_added_and_decoys_are_not(spark):
    rng = random.Random(9)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card():
        d = "4" + digits(14)
        return next(d + c for c in "0123456789" if pii.luhn(d + c))

    def fill():
        return " ".join(rng.choice(["and", "the", "ofer", "tion", "wh", "look", "at", "noon", "era."]) for _ in range(rng.randrange(5, 30)))

    plant = [lambda: f"{rng.choice('abcdef')}{digits(3)}.x@mail{digits(1)}.example.com", lambda: ".".join(str(rng.randrange(1, 256)) for _ in range(4)), card,
             lambda: f"+1 ({rng.randrange(200, 999)}) 555-{digits(4)}"]
    train = [f"{fill()} {plant[k % 4]()} {fill()}" for k in range(800)]
    model = pii.train(spark.createDataFrame(list(enumerate(train)), "doc_id long, text string"))
    assert all(model["kinds"])
    caught = Counter()
    for n in range(400):
        kind = n % 4
        s = pii.disguised(plant[kind](), kind, rng.randrange(10**6))
        if pii.spelled(s, kind) is None:
            continue
        before = fill() + " "
        base, added = pii.all_spans([before + s + " " + fill()], model)[0]
        caught[kind, any(a < len(before) + len(s) and b > len(before) for a, _, b in base + added)] += 1
    for kind in range(4):
        assert caught[kind, True] >= 0.9 * (caught[kind, True] + caught[kind, False]), caught
    for text in [fill() for _ in range(300)] + [f"{fill()} {pii.decoy(card(), 2, k)} {fill()}" for k in range(300)] + ["on 2021-04-13 and 12.05.2019 at 10:11:12 it was 3.14159", "a" * 5000 + "@"]:
        base, added = pii.all_spans([text], model)[0]
        assert not base and not [x for x in added if x[1] != 3], (text, added)


def test_boosted_trees_learn_a_rule():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.integers(0, 20, (4000, 22)).astype(float)
    y = np.zeros((4000, 4), int)
    y[:, 0] = (x[:, 0] > 10) & (x[:, 3] < 5)
    model = pii.fit(x, y, rng.random(4000) < 0.25)
    start, trees, threshold = model["kinds"][0]
    got = pii.probability(model, (start, trees), pii.binned(model["edges"], x)) >= threshold
    assert (got == (y[:, 0] == 1)).mean() > 0.97 and model["kinds"][1] is None


# --- 10


def test_reordered_passages_are_found(spark, odd_docs, no_docs):
    df, rows = odd_docs
    rng = random.Random(4)
    item = [f"w{n}" for n in range(40)]
    halves = " ".join(item[20:]) + " other words between " + " ".join(item[:20]).upper() + "."
    partial = " ".join(item[:20])
    clean = " ".join(rng.sample(item, 40))
    docs = spark.createDataFrame([(1, halves), (2, partial), (3, clean), (4, None), (5, "W1 w2")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "w1 w2"), (9, None), (10, "!!")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["coverage"], r["n_tiles"]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got.pop((1, 7)) == (1.0, 2)
    assert {k for k in got} == {(1, 8), (2, 8), (5, 8)}
    assert decontaminate.contaminated(no_docs, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns and kept.count() == len(rows)


def test_tiling_is_greedy_longest_first():
    import numpy as np

    rng = random.Random(3)
    for _ in range(300):
        item = np.array([rng.randrange(1, 5) for _ in range(rng.randrange(3, 30))])
        text = np.array([rng.randrange(1, 5) for _ in range(rng.randrange(3, 60))])
        a, b, total = set(range(len(item))), set(range(len(text))), 0
        while True:  # brute force
            best = 0
            for q in a:
                for p in b:
                    n = 0
                    while q + n in a and p + n in b and item[q + n] == text[p + n]:
                        n += 1
                    best = max(best, n)
            if best < 3:
                break
            q, p = min((q, p) for q in a for p in b if all(q + n in a and p + n in b and item[q + n] == text[p + n] for n in range(best)))
            a -= set(range(q, q + best))
            b -= set(range(p, p + best))
            total += best
        tiles = decontaminate.tile(item, text, 3)
        assert all((item[q : q + n] == text[p : p + n]).all() for q, p, n in tiles)
        assert len({q + k for q, _, n in tiles for k in range(n)}) == len({p + k for _, p, n in tiles for k in range(n)}) == sum(n for *_, n in tiles)
        assert sum(n for *_, n in tiles) == total


def test_tiling_goes_on_with_what_a_longer_tile_left():
    import numpy as np

    item = np.arange(1, 26)
    text = np.concatenate([item[0:9], [-1], item[5:14], [-1], item[14:25]])
    assert sum(n for *_, n in decontaminate.tile(item, text, 5)) == 9 + 5 + 11


def test_repeated_words_cost_no_more():
    import time

    import numpy as np

    began = time.perf_counter()
    assert sum(n for *_, n in decontaminate.tile(np.ones(300, int), np.ones(100_000, int), 5)) == 300
    block = decontaminate.Block([(1, "so " * 300), (2, "it is " * 200)])
    assert [m[0] for m in decontaminate.match(block, "so " * 100_000 + "it is " * 50_000)] == [1, 2]
    assert time.perf_counter() - began < 20


def brute_coverage(item, text):
    """Coverage of greedy tiling with tiles of five words or more, by definition."""
    least = min(5, len(item))
    a, b, total = set(range(len(item))), set(range(len(text))), 0
    while True:
        best, at = 0, None
        for q in sorted(a):
            for p in sorted(b):
                n = 0
                while q + n in a and p + n in b and item[q + n] == text[p + n]:
                    n += 1
                if n > best:
                    best, at = n, (q, p)
        if best < least:
            return total / len(item)
        a -= set(range(at[0], at[0] + best))
        b -= set(range(at[1], at[1] + best))
        total += best


def test_contamination_is_as_by_definition(spark):
    rng = random.Random(8)
    vocabulary = [f"w{n}" for n in range(12)]
    items = {i: [rng.choice(vocabulary) for _ in range(rng.randrange(2, 25))] for i in range(12)}
    texts = {}
    for d in range(60):
        t = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 20))]
        for i in rng.sample(sorted(items), 2):
            w = items[i]
            cut = rng.randrange(len(w))
            t += w[cut:] + [rng.choice(vocabulary)] * rng.randrange(3) + w[: max(0, cut - rng.randrange(4))]
        texts[d] = t
    want = {(d, i): c for d, t in texts.items() for i, w in items.items() if (c := brute_coverage(w, t)) >= 0.8}
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in texts.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["coverage"] for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == pytest.approx(want) and len(want) > 20


def test_columns_of_any_name_pass(spark, no_docs):
    text = "the only text of this table that has as many words as this one has"
    df = spark.createDataFrame([(1, text, None, True, False, "x", [1]), (1, text, None, True, False, "x", [1])], "doc_id long, text string, lang string, _rejected boolean, _contaminated boolean, _Host string, ids array<int>")
    bench = spark.createDataFrame([(1, "nothing of that")], "item_id long, text string")
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns and [r["_contaminated"] for r in kept.collect()] == [False, False]
    assert langid.keep(df).columns == df.columns and pii.redact(df).collect()[0]["_rejected"]
    encoded = bpe.encode(df, TOKENIZER)
    assert encoded.columns == df.columns and len(encoded.head()["ids"]) > 5


def test_benchmark_passages(spark, corpus):
    from .conftest import SF

    df, texts = corpus
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r["item_id"]: r["text"] for r in bench.collect()}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, bench).collect()}
    assert {(d, i) for d, t in texts.items() for i, p in items.items() if p in t} <= got
