"""Time and memory that stay bounded, and odd pages: personal data in long texts, repeated training rows, WARC bodies."""

import gzip
import time
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import language_id, pii, quality_model, warc


@pytest.mark.parametrize("piece", ["see the account of it ", "token=", "account ", "iban a ", "secret: ab1", "+1 (2) ", "a@b", "1.2.", "http://x ", "konto   ", "no. account no. "])
def test_personal_data_in_linear_time(piece):
    def seconds(n):
        began = time.perf_counter()
        pii.spans(piece * n)
        return time.perf_counter() - began

    seconds(1000)
    short = min(seconds(10_000) for _ in range(2))
    assert seconds(20_000) < 3 * short + 0.2


def test_accounts_and_secrets_after_many_cues():
    iban = "DE89 3704 0044 0532 0130 00"
    text = f"account account iban {iban} and token=token=abcdefgh12345678 secret=aaaaaaaaaaaaaaaaaaaa password=xx"
    found = {k: text[s:e] for k, s, e in pii.spans(text) if k in ("account", "secret")}
    assert found == {"account": iban, "secret": "token=abcdefgh12345678"}
    assert [k for k, _, _ in pii.spans("account " + "9" * 100)] == ["account"]
    assert not [k for k, _, _ in pii.spans("account 12345") if k == "account"]


def test_training_rows_of_a_repeated_document(spark):
    docs = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("row "), (F.col("id") % 5000).cast("string")).alias("text"), F.lit("en").alias("lang"))
    docs = docs.unionByName(spark.createDataFrame([(k, f"text {k} of words", "de") for k in range(8, 40)], "doc_id long, text string, lang string"))
    labels = spark.createDataFrame([(k, k % 2) for k in range(7, 40)], "doc_id long, quality int")
    x, y = quality_model.training_rows(docs, labels, sample=100)
    assert len(x) == len(y) == 100
    bags, langs = language_id.training_bags(docs, per_language=20, sample=100)
    assert len(bags) == len(langs) <= 100 and {"en", "de"} == set(langs)


def test_rows_that_count_once(spark):
    base = spark.createDataFrame([(k, f"text {k} of words", "de") for k in range(40)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    for a, b in ((quality_model.training_rows(base, labels), quality_model.training_rows(base.unionAll(base), labels)),):
        assert np.array_equal(a[0], b[0]) and np.array_equal(a[1], b[1])
    assert len(language_id.training_bags(base.unionAll(base))[0]) == 40


def plain_fit(x, y, trees, depth, bins, rate, penalty, least):
    """The boosted trees as loops over rows, features and cuts."""
    n, width = x.shape
    base = float(np.clip(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)), -8, 8))
    edges = [sorted(set(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1]))) for f in range(width)]
    margin = np.full(n, base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        groups = [np.arange(n)]
        for _ in range(depth):
            after = []
            for rows in groups:
                best, cut = 1e-6, None
                for f in range(width):
                    for e in edges[f]:
                        left = rows[x[rows, f] <= e]
                        right = rows[x[rows, f] > e]
                        if h[left].sum() >= least / 4 and h[right].sum() >= least / 4:
                            part = lambda r: g[r].sum() ** 2 / (h[r].sum() + penalty)
                            gain = part(left) + part(right) - part(rows)
                            if gain > best + 1e-9:
                                best, cut = gain, (f, e)
                after += [rows, rows[:0]] if cut is None else [rows[x[rows, cut[0]] <= cut[1]], rows[x[rows, cut[0]] > cut[1]]]
            groups = after
        for rows in groups:
            margin[rows] -= rate * g[rows].sum() / (h[rows].sum() + penalty)
    return 1 / (1 + np.exp(-margin))


def test_boosted_trees_equal_plain_growth():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(120, 3)).round(2)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3) ^ (rng.random(120) < 0.1)).astype(float)
    options = {"trees": 4, "depth": 3, "bins": 8, "rate": 0.3, "penalty": 2.0, "least": 3.0}
    assert np.allclose(quality_model.fit(x, y, **options).score(x), plain_fit(x, y, **options))


class Visible(HTMLParser):
    """Text and links by the standard library's own parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.links, self.hidden = [], [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in warc.HIDDEN
        self.parts.append("\n" if tag in warc.BLOCKS else " " if tag in warc.HIDDEN else "")
        if tag == "a" and not self.hidden and "href" in dict(attrs):
            self.links.append((dict(attrs)["href"] or "").strip())

    def handle_endtag(self, tag):
        self.hidden -= tag in warc.HIDDEN
        self.parts.append("\n" if tag in warc.BLOCKS else "")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def test_pages_read_like_html_parser(spark):
    html = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect() if r.html]
    html += ['<p>one<a title="a > b" href="q">l</a><br/>two &amp; three', "<div a='x>y'>t</div><title>no</title>end"]
    for page in html:
        other = Visible()
        other.feed(page)
        other.close()
        want = "\n".join(x for x in (" ".join(line.split()) for line in "".join(other.parts).split("\n")) if x)
        got = warc.read_page(page)
        assert got.text == want and list(got.links) == other.links


def test_tags_with_quotes_self_closing_and_base():
    page = warc.read_page('<base href="/dir/"><a title="a > b" href="q">l</a><script src=x />hidden()</script>seen<svg/>too <a b=\'>\' href=z>m</a><a href=it\'s>n</a> end')
    assert page.text == "l seentoo mn end" and page.links == ("q", "z", "it's") and page.base == "/dir/"
    assert warc.read_page('<a title="never closed>text').text == "text"
    record = warc.response("http://h.example/a/b", '<base href="/dir/"><a href="q">l</a>')
    (_, _, block), _ = warc.derive(record)
    assert b"outlink: http://h.example/dir/q\r\n" in block
    began = time.perf_counter()
    warc.read_page("<a b=\"c' " * 20_000)
    warc.read_page("<a b='c\" >" * 20_000)
    assert time.perf_counter() - began < 20


def coded(body, coding):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\nContent-Encoding: " + coding + b"\r\n\r\n" + body
    headers = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("WARC-Target-URI", "http://h.example/")]
    return warc.derive(warc.build(headers, http))


def test_members_and_limits_of_compressed_bodies(monkeypatch):
    two = gzip.compress(b"first ") + gzip.compress(b"second") + b"\0\0"
    assert coded(two, b"gzip")[1][2] == b"first second"
    assert len(coded(two[: len(two) // 2 + 4], b"gzip")) == 1  # cut short: no conversion
    monkeypatch.setattr(warc, "INFLATED", 10)
    assert len(coded(two, b"gzip")) == 1 and b"no-conversion: a body of more than 10 bytes" in coded(two, b"gzip")[0][2]
