"""Quality model, language, personal data, rules, packing, WARC: against brute force, planted cases and round trips."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import language_id, packing, pii, quality_model, quality_rules, warc
from quillon.llm.queries import queries

SF = "/root/testdata/sf0.001"
AWKWARD = [None, "", " ", "\n\n", "a", "é" * 5, "x " * 3, "one two three one two three", "w" * 200_000]


def awkward(spark, texts=AWKWARD):
    """Nulls in every column, repeated rows, and extra columns whose names clash with the operators'."""
    rows = [(i if i % 4 else None, t, None if i % 3 else "en", None if i % 2 else "s", 1, "mine", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[-2:], "doc_id long, text string, lang string, source string, size long, key string, score int")


def brute_rules(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c, at = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if c[tuple(w[i : i + 3])] > 1:
            at |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t), dup, len(at)


def test_rules_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    got = queries()["op10_quality_rules"](spark, SF).collect()
    assert len(got) == len(text)
    for r in got:
        n = brute_rules(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert r.kept == (not r.base_failed and not r.failed_rules)


def test_rules_of_many_repeated_windows(spark):
    words = [f"w{k}" for k in range(200)]
    texts = [" ".join(words * 2), " ".join(words), "a a a a", "\t a\n\na \x0bb  \n", "é è é è é è"]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    for r in quality_rules.text_statistics(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_rules(texts[r.doc_id])


def test_rules_keep_clean_and_drop_odd(spark):
    rng = random.Random(0)
    clean = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 9))) for _ in range(120)) for _ in range(300)]
    odd = [t.replace(" ", "### ") for t in clean[:10]]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(clean + odd)], "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality_rules.quality_rules(df).collect()}
    assert all(kept[i] for i in range(300)) and not any(kept[i] for i in range(300, 310))


def test_fences_move_with_each_group(spark):
    """Half-widths are each group's own; values that stand apart from zero are told from those that do not."""
    rng = random.Random(1)

    def text(sd, end=""):
        return " ".join("a" * max(1, round(rng.gauss(6, sd))) for _ in range(90)) + end

    rows = [(text(1), "narrow", "s") for _ in range(400)] + [(text(4), "wide", "s") for _ in range(400)]
    rows += [(text(1, " #" * rng.randint(28, 32)) if k % 10 == 0 else text(1), "symbols", "s") for k in range(1200)]
    rows += [(text(1), "narrow", "few")] * 3
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    scratch = quality_rules.Scratch(spark, "test")
    stats = quality_rules.text_statistics(df).withColumn("base_failed", F.lit(False))
    f = {(r.lang, r.source): r for r in quality_rules.adaptive_fences(stats, scratch).collect()}
    width = {k: r.mean_word_chars_high.at - r.mean_word_chars_low.at for k, r in f.items()}
    assert width["wide", "s"] > 2 * width["narrow", "s"] > 0
    assert f["narrow", "s"].mean_word_chars_low.rule == "spread" and f["narrow", "s"].mean_word_chars_low.level == "group"
    assert f["narrow", "few"].mean_word_chars_low.level == "lang"
    apart = f["symbols", "s"].symbol_ratio_high
    assert (apart.rule, apart.level) == ("apart", "group") and 0 < apart.at < 28 / 700
    assert all(r.shout_ratio_high.rule == "none" and r.shout_ratio_high.at is None for r in f.values())


def test_few_fences_have_no_rule_and_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    got = quality_rules.quality_rules(spark.read.parquet(f"{sf}/documents.parquet")).cache()
    used = [x.split(":") for r in got.select("fences").collect() for x in r.fences.split(",")]
    varied = [x for x in used if not x[0].startswith("shout")]  # no document there has a mark of shouting
    assert sum(x[1] == "none" for x in varied) < 0.1 * len(varied)
    judged = got.where("NOT base_failed").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    good, bad = ([r.kept for r in judged if r.quality == q] for q in (1, 0))
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1


def test_rules_awkward_and_empty(spark):
    assert quality_rules.quality_rules(awkward(spark)).where("kept").count() == 0
    assert quality_rules.quality_rules(awkward(spark).limit(0)).count() == 0


def test_forest_learns_and_walks_like_a_loop():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] > 0)).astype(float)
    f = quality_model.fit(x[:1500], y[:1500])
    assert ((f.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    for row in x[:20]:
        margin = f.base
        for t in range(len(f.feature)):
            k = 0
            while k < f.feature.shape[1]:
                k = 2 * k + 1 + int(row[f.feature[t, k]] > f.threshold[t, k])
            margin += f.value[t, k - f.feature.shape[1]]
        assert f.score(row[None])[0] == pytest.approx(1 / (1 + np.exp(-margin)))
    assert quality_model.fit(np.zeros((0, 5)), np.zeros(0)).score(x[:2]).tolist() == [0.5, 0.5]
    assert (quality_model.fit(x[:9], np.ones(9)).score(x[:2]) > 0.99).all()


def test_quality_held_out(spark):
    got = queries()["op1_quality_classifier"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_quality_awkward(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (99, 1)], "doc_id long, quality int")
    got = quality_model.classify(awkward(spark), labels)
    assert got.columns.count("score") == 1 and got.count() == len(AWKWARD) + 2
    assert quality_model.classify(awkward(spark).limit(0), labels).count() == 0


def test_language_held_out(spark):
    got = queries()["op3_language_id"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.lang_pred == r.lang for r in got if r.held_out]) > 0.97


def test_language_blocks_and_awkward(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.learn(docs)
    long_ = docs.orderBy(F.length("text").desc()).first()["text"]
    whole = model.predict(long_)
    monkeypatch.setattr(language_id, "BLOCK", 97)
    assert model.predict(long_) == pytest.approx(whole)
    assert model.predict(None) == model.predict("12 !") == ("und", 0.0, True)
    got = language_id.identify(awkward(spark, [*AWKWARD[:-1], "123"]), model)
    assert got.columns.count("score") == 1 and got.count() == len(AWKWARD) + 2
    nothing = language_id.learn(docs.limit(0))
    assert {r.lang_pred for r in language_id.identify(docs, nothing).collect()} == {"und"}


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(t):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, t or ""):
            digits = "".join(re.findall("[0-9]", m[0]))
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_spans_equal_patterns():
    r = random.Random(3)
    bits = ["1", "2", "25", "300", ".", ".", "@", "+", " ", "-", "a", "é", "(", ")", "b.c", "4111111111111111", "\n", "1.2.3.4", "0", "İ", "iban", "token="]
    for _ in range(40_000):
        t = "".join(r.choice(bits) for _ in range(r.randint(0, 14)))
        assert [x for x in pii.spans(t) if x[0] in PATTERNS] == brute_spans(t), t


def test_pii_query_equals_patterns(spark):
    import hashlib

    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries()["op4_pii_anchors"](spark, SF).collect():
        want = brute_spans(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pii.joined(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, *_ in want) for kind in PATTERNS]
        assert r.spans == pii.joined(pii.spans(text[r.doc_id]))


def test_added_kinds_and_redaction(spark):
    t = "IBAN DE89 3704 0044 0532 0130 00, acct: 12345678 https://bob:pw@h.de/x token = \"abe29cfcdae4f03e1e33\" a@b.co"
    kinds = [(k, t[s:e]) for k, s, e in pii.spans(t)]
    assert ("account", "DE89 3704 0044 0532 0130 00") in kinds and ("account", "12345678") in kinds
    assert ("secret", "abe29cfcdae4f03e1e33") in kinds and ("url", "https://bob:pw@h.de/x") in kinds
    clean = pii.redacted(t, pii.spans(t))
    assert clean == "IBAN <account>, acct: <account> <url> token = \"<secret>\" <email>"
    for cue in ("account no. 12345678", "account number: 12345678", "Konto Nr. 12345678", "acct #12345678"):
        assert [cue[s:e] for _, s, e in pii.spans(cue)] == ["12345678"], cue
    assert pii.spans("account notes 12345678") == []
    assert pii.spans("the token passed; account of a day; see https://x.org/a") == []
    df = awkward(spark)
    assert pii.redact(df).columns == df.columns and pii.find(df.withColumn("pii", F.lit(1))).count() == df.count()
    assert pii.find(df.limit(0)).count() == 0 and pii.redact(df.limit(0)).count() == 0


def test_ids_equal_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    e, r = packing.Encoder(), random.Random(1)
    bits = [" ", " ", "a", "the", "\n", "é", "1", "'s", "!", "  ", "\t", "漢", "½", "\x1c", "\x85", "<|endoftext|>"]
    for _ in range(4000):
        x = "".join(r.choice(bits) for _ in range(r.randint(0, 9)))
        assert e.document(x) == np.array(t.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes(), x


def check_packing(rows, length):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= length
    return len(bins)


def test_packing_query(spark):
    rows = queries()["op7_best_two_fit"](spark, SF).collect()
    bins = check_packing(rows, 2048)
    assert bins <= -(-sum(r.length for r in rows) // 2048) + 1
    e = packing.Encoder()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = e.document(d.text) + b"\0\0\0\0"
        got = sorted(by[d.doc_id], key=lambda r: r.piece)
        assert [r.piece for r in got] == list(range(len(got))) and sum(r.length for r in got) == len(ids) // 4
        assert all(r.length == 2048 for r in got[1:])
        for r in got:
            assert r.ids_crc32 == zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)])


def test_best_two_fit_swaps_the_smallest():
    counts = np.zeros(11, dtype=int)
    counts[[7, 2, 4, 3]] = [1, 1, 1, 1]  # greedy 7 + 3; then 4 + 2
    assert packing.best_two_fit(counts) == [(1, [(7, 1), (3, 1)]), (1, [(4, 1), (2, 1)])]
    counts = np.zeros(11, dtype=int)
    counts[[6, 3, 2]] = [1, 1, 2]  # greedy 6 + 3 leaves 1; 2 + 2 in place of 3 fits exactly
    assert packing.best_two_fit(counts) == [(1, [(6, 1), (2, 2)]), (1, [(3, 1)])]
    rng = np.random.default_rng(0)
    for _ in range(200):
        counts = rng.integers(0, 4, 13)
        used = np.zeros(13, dtype=int)
        for repeats, bin_ in packing.best_two_fit(counts):
            assert sum(n * c for n, c in bin_) <= 12
            for n, c in bin_:
                used[n] += repeats * c
        assert (used[1:] == counts[1:]).all()


def test_packing_awkward(spark):
    rows = packing.pack(awkward(spark), length=64).collect()
    check_packing(rows, 64)
    assert sum(r.piece == 0 for r in rows) == len(AWKWARD) + 2
    assert packing.pack(awkward(spark).limit(0)).count() == 0


def test_warc_round_trip_and_links(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries()["op6_warc_derivatives"](spark, SF).collect()
    assert len(rows) == 2 * len(pages)
    for r in rows:
        headers, block = warc.parse(bytes(r.record))
        source, body = warc.parse(warc.response(pages[r.page_id].url, pages[r.page_id].html, name=str(r.page_id)))
        assert block == bytes(r.block) and r.content_length == len(block) and r.block_digest == warc.digest(block)
        assert r.refers_to == warc.value_of(source, "WARC-Record-ID") == warc.value_of(headers, "WARC-Refers-To")
        assert r.payload_digest == warc.digest(body.split(b"\r\n\r\n", 1)[1]) == warc.value_of(source, "WARC-Payload-Digest")
        assert warc.value_of(headers, "WARC-Target-URI") == " ".join(pages[r.page_id].url.split())
        assert warc.parse(warc.build([h for h in headers if h[0] != "Content-Length"], block)) == (headers, block)


def test_warc_text_and_problems(spark):
    p = warc.read_page("<html lang=DE><title>A &amp; B</title><script>x<p></script><p>one<b> two</b><br>3 &lt; 4<!-- no --><a href='/u?a=1&amp;b=2'>l</a> 1 < 2<style>open")
    assert (p.text, p.title, p.language, p.links) == ("one two\n3 < 4l 1 < 2", "A & B", "de", ("/u?a=1&b=2",))
    assert warc.outlinks(("/a", "#x", "javascript:1", "/a", "http://["), "http://h/d/") == ["http://h/a"]
    good = warc.response("http://h/", "<p>x</p>")
    bad = [None, b"", b"WARC/1.1\r\n\r\n", good[:-1], good.replace(b"WARC-Type: response", b"WARC-Type: request!")]
    df = spark.createDataFrame([(i, bytearray(x) if x is not None else None, "k") for i, x in enumerate([*bad, good])], "page_id long, record binary, block string")
    rows = warc.derivatives(df).collect()
    assert sum(r.problem is not None for r in rows) == 5 and sum(r.problem is None for r in rows) == 2
    assert warc.derivatives(df.limit(0)).count() == 0


def test_warc_codings_and_media_types():
    import gzip

    html = b"<html><title>T</title><p>caf\xc3\xa9 one</p><a href=/x>two</a></html>"

    def record(payload, *fields):
        block = b"\r\n".join([b"HTTP/1.1 200 OK", *fields]) + b"\r\n\r\n" + payload
        return warc.build([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Target-URI", "http://h/")], block)

    def chunks(x, n):
        return b"".join(b"%x;q=1\r\n%s\r\n" % (len(x[i : i + n]), x[i : i + n]) for i in range(0, len(x), n)) + b"0\r\n\r\n"

    kind, packed = b"Content-Type: text/html; charset=utf-8", b"Content-Encoding: gzip"
    raw = zlib.compressobj(wbits=-15)
    deflated = raw.compress(html) + raw.flush()
    same = [
        record(html, kind),
        record(chunks(html, 7), kind, b"Transfer-Encoding: chunked"),
        record(html, kind, b"Transfer-Encoding: chunked"),  # stored without its chunk sizes
        record(gzip.compress(html), kind, packed),
        record(html, kind, packed),  # stored unpacked
        record(chunks(gzip.compress(html), 11), kind, packed, b"Transfer-Encoding: chunked"),
        record(zlib.compress(html), kind, b"Content-Encoding: deflate"),
        record(deflated, kind, b"Content-Encoding: deflate"),
    ]
    for r in same:
        (_, _, about), (_, _, text) = warc.derive(r)
        assert text.decode() == "café one\ntwo" and b"outlink: http://h/x" in about
    assert warc.derive(record(b"a < b <p>", b"Content-Type: text/plain"))[1][2] == b"a < b <p>"
    for r, why in (
        (record(b"%PDF-1.4", b"Content-Type: application/pdf"), b"no text in application/pdf"),
        (record(gzip.compress(html)[:20], kind, packed), b"a broken gzip body"),
        (record(html, kind, b"Content-Encoding: br"), b"unknown content coding br"),
        (record(b"5\r\nab", kind, b"Transfer-Encoding: chunked"), b"a chunk is cut short"),
    ):
        got = warc.derive(r)
        assert [t for t, *_ in got] == ["metadata"] and b"no-conversion: " + why in got[0][2]
        assert warc.value_of(got[0][1], "WARC-Concurrent-To") is None


def test_walk_of_two_bins_against_a_document_by_document_packing():
    """Best-two-fit with a plain list of documents: the plan on counts packs the same multisets of lengths, bin by bin."""

    def plain(lengths, size):
        rest, bins = sorted(lengths, reverse=True), []
        while rest:
            bin_, gap = [], size
            for n in rest[:]:
                if n <= gap:
                    bin_.append(n)
                    rest.remove(n)
                    gap -= n
            if gap:
                small, room = min(bin_), gap + min(bin_)
                pairs = [(a + b, -a) for i, a in enumerate(rest) for b in rest[i + 1 :] if a + b <= room]
                if pairs and max(pairs)[0] > small:
                    best = max(p[0] for p in pairs)
                    a, b = min((sorted((a, best - a)) for a in set(rest) if best - a in rest and (best != 2 * a or rest.count(a) > 1)), key=lambda p: p[0])
                    bin_.remove(small)
                    rest = sorted([*rest, small], reverse=True)
                    for n in (a, b):
                        bin_.append(n)
                        rest.remove(n)
            bins.append(sorted(bin_, reverse=True))
        return bins

    r = random.Random(8)
    for _ in range(150):
        lengths = [r.randint(1, 20) for _ in range(r.randint(1, 40))]
        counts = np.bincount(lengths, minlength=21)
        want = [tuple(b) for b in plain(lengths, 20)]
        got = [tuple(n for n, c in bin_ for _ in range(c)) for repeats, bin_ in packing.best_two_fit(counts) for _ in range(repeats)]
        assert sorted(got) == sorted(want)
