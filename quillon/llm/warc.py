"""WARC derivative builder: response records become linked metadata and plain-text conversion records.

A response record is parsed strictly (version line, named headers, Content-Length many bytes, two line
ends), its HTTP block split into status line, headers and payload. From it come

* a ``metadata`` record (application/warc-fields): title, language, HTTP status, content type, character
  set, payload length, and every outlink in order of appearance, resolved against the target;
* a ``conversion`` record (text/plain; charset=UTF-8): the visible text, one block element a line.

Both carry WARC-Refers-To (the response's WARC-Record-ID), WARC-Target-URI, WARC-Date and, where the source
has them, its WARC-Payload-Digest, IP address and warcinfo id; both have block digests of their own; their
ids are name-based on the source id, so reruns give the same records and the metadata record names its
conversion sibling (WARC-Concurrent-To). Every record is built and parsed one at a time.

Defined results: a null or malformed record, or one that is no response, gives one row with ``problem`` set
and no record; a body that unpacks to more than ``INFLATED`` bytes has no conversion; an empty payload gives an empty conversion; undecodable bytes become U+FFFD; repeated
records give repeated rows; an empty table gives no rows; other input columns than the key and the record
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bounded_batches

VERSION = b"WARC/1.1"
NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the public name space of URLs
COPIED = ("WARC-Target-URI", "WARC-Date", "WARC-Payload-Digest", "WARC-IP-Address", "WARC-Warcinfo-ID")

# Elements whose content is never text, and elements that end a line.
HIDDEN = frozenset("script style noscript template svg title".split())
BLOCKS = frozenset(
    "address article aside blockquote br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr li main nav ol p pre section table td th tr ul".split()
)

#: Most bytes that a compressed body may unpack to.
INFLATED = 64 << 20

_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*)|<[!?]")
_QUOTE = re.compile(r"=\s*([\"'])|>")
_ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?([A-Za-z0-9_.:-]+)", re.I)
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in HIDDEN}

Headers = list[tuple[str, str]]


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*names: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, ' '.join(names))}>"


def build(headers: Headers, block: bytes) -> bytes:
    """A record; Content-Length is added, line ends inside header values become blanks."""
    lines = [VERSION, *(f"{n}: {' '.join(v.split())}".encode() for n, v in headers), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(record: bytes) -> tuple[Headers, bytes]:
    """(headers, block) of one record; ValueError if it is malformed."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not gap or not re.fullmatch(rb"WARC/1\.[01]", first):
        raise ValueError("no WARC header")
    headers: Headers = []
    for line in lines:
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if line[:1] in b" \t" and headers:
            headers[-1] = headers[-1][0], f"{headers[-1][1]} {name.strip()}{colon}{value}"
        elif not colon or not name.strip():
            raise ValueError("a header line has no name")
        else:
            headers.append((name.strip(), value.strip()))
    size = value_of(headers, "Content-Length")
    if size is None or not size.isdigit():
        raise ValueError("no Content-Length")
    block = rest[: int(size)]
    if len(block) < int(size) or rest[int(size) :] != b"\r\n\r\n":
        raise ValueError("the block's length is not Content-Length")
    return headers, block


def value_of(headers: Headers, name: str) -> str | None:
    return next((v for n, v in headers if n.lower() == name.lower()), None)


def response(url: str, html: str, date: str = "1970-01-01T00:00:00Z", name: str = "") -> bytes:
    """A response record around a page, its id made from url and name."""
    payload = html.encode("utf-8", "replace")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    headers = [
        ("WARC-Type", "response"),
        ("WARC-Record-ID", record_id("response", name, url)),
        ("WARC-Target-URI", url),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", digest(payload)),
        ("WARC-Block-Digest", digest(http)),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return build(headers, http)


@dataclass(frozen=True)
class Page:
    text: str
    title: str
    language: str
    links: tuple[str, ...]
    base: str = ""


def _tag_end(html: str, at: int) -> int:
    """Place of the ``>`` that ends a tag read up to ``at``, not one within a quoted attribute value; -1 without.

    A quote that is never closed is no quote.
    """
    end = html.find(">", at)
    seen = html[at:end]
    if end < 0 or "'" not in seen and seen.count('"') % 2 == 0:
        return end
    while True:
        mark = _QUOTE.search(html, at)
        if mark is None:
            return -1
        if mark[1] is None:
            return mark.start()
        close = html.find(mark[1], mark.end())
        at = (close if close >= 0 else mark.end()) + (close >= 0)


def attributes(tag: str) -> dict[str, str]:
    """Names in lower case and values of a tag's attributes; of a repeated name the first counts."""
    out: dict[str, str] = {}
    for got in _ATTRIBUTE.finditer(tag):
        out.setdefault(got[1].lower(), unescape(got[2] or got[3] or got[4] or "").strip())
    return out


def read_page(html: str) -> Page:
    """Visible text (entities resolved, blanks collapsed, one block element a line), title, language, links and the first base.

    One pass from tag to tag; a comment, tag or hidden element that never ends hides the rest. As in HTML, ``/>`` closes
    no element of its own but those of svg.
    """
    parts: list[str] = []
    title, language, base, links, at = None, "", "", [], 0
    while (mark := html.find("<", at)) >= 0:
        parts.append(html[at:mark])
        if html.startswith("<!--", mark):
            end = html.find("-->", mark + 4)
            at = end + 3 if end >= 0 else len(html)
            continue
        got = _NAME.match(html, mark)
        if got is None:
            parts.append("<")
            at = mark + 1
            continue
        end = _tag_end(html, got.end())
        if end < 0:
            at = len(html)
            break
        at, name = end + 1, (got[2] or "").lower()
        if name in BLOCKS:
            parts.append("\n")
        if got[1]:
            continue
        if name == "a":
            if "href" in (found := attributes(html[got.end() : end])):
                links.append(found["href"])
        elif name == "html":
            language = attributes(html[got.end() : end]).get("lang", "").lower() or language
        elif name == "base":
            base = base or attributes(html[got.end() : end]).get("href", "")
        elif name in HIDDEN and not (name == "svg" and html[end - 1] == "/"):
            close = _CLOSE[name].search(html, at)
            inner = html[at : close.start() if close else len(html)]
            at = close.end() if close else len(html)
            parts.append(" ")
            if name == "title" and title is None:
                title = " ".join(unescape(inner).split())
    parts.append(html[at:])
    lines = (" ".join(line.split()) for line in unescape("".join(parts)).split("\n"))
    return Page("\n".join(x for x in lines if x), title or "", language, tuple(links), base)


def outlinks(links: tuple[str, ...], base: str) -> list[str]:
    """Links resolved against the page, in order of appearance, each once; those that lead nowhere are left out."""
    out = []
    for link in dict.fromkeys(links):
        if not link or link.lower().startswith(("javascript:", "data:", "#")):
            continue
        try:
            out.append("".join(urljoin(base, link).split()))
        except ValueError:
            continue
    return list(dict.fromkeys(out))


class Unreadable(ValueError):
    """A body that no text can be taken from, and why."""


def unchunked(payload: bytes) -> bytes:
    """The body of a chunked payload; one that was stored without its chunk sizes is returned as it is."""
    out, at = [], 0
    while True:
        line, end, _ = payload[at : at + 64].partition(b"\r\n")
        size = line.split(b";")[0].strip()
        if not end or not re.fullmatch(rb"[0-9A-Fa-f]{1,8}", size):
            if at == 0:
                return payload
            raise Unreadable("a chunk has no size")
        start, n = at + len(line) + 2, int(size, 16)
        if n == 0:
            return b"".join(out)
        out.append(payload[start : start + n])
        if payload[start + n : start + n + 2] != b"\r\n":
            raise Unreadable("a chunk is cut short")
        at = start + n + 2


def inflated(payload: bytes, bits: int, limit: int) -> bytes:
    """All members of a compressed body, one after the other; what follows the last one is padding."""
    out, size = [], 0
    while payload:
        member = zlib.decompressobj(bits)
        part = member.decompress(payload, limit - size + 1)
        size += len(part)
        if size > limit:
            raise Unreadable(f"a body of more than {limit} bytes")
        if not member.eof:
            raise zlib.error("cut short")
        out.append(part)
        payload = member.unused_data
        if bits != 31 or payload[:2] != b"\x1f\x8b":
            break
    return b"".join(out)


def body_of(http: Headers, payload: bytes) -> bytes:
    """The payload without its transfer and content codings (chunked, gzip, deflate)."""
    if "chunked" in (value_of(http, "Transfer-Encoding") or "").lower():
        payload = unchunked(payload)
    for coding in reversed([x.strip().lower() for x in (value_of(http, "Content-Encoding") or "").split(",") if x.strip()]):
        try:
            if coding in ("gzip", "x-gzip"):
                payload = inflated(payload, 31, INFLATED) if payload[:2] == b"\x1f\x8b" else payload  # some crawlers store it unpacked
            elif coding == "deflate":
                payload = inflated(payload, 15 if payload[:1] == b"\x78" else -15, INFLATED)
            elif coding != "identity":
                raise Unreadable(f"unknown content coding {coding}")
        except zlib.error:
            raise Unreadable(f"a broken {coding} body") from None
    return payload


def page_of(kind: str, body: bytes) -> tuple[Page, str]:
    """Text and charset of a body by its media type: HTML is read, other text is taken as it is."""
    media = kind.split(";")[0].strip().lower()
    if media and not media.startswith("text/") and not media.endswith(("+xml", "/xml")):
        raise Unreadable(f"no text in {media}")
    named = _CHARSET.search(kind.encode()) or _CHARSET.search(body[:1024])
    charset = named[1].decode().lower() if named else "utf-8"
    try:
        text = body.decode(charset, "replace")
    except LookupError:
        charset, text = "utf-8", body.decode("utf-8", "replace")
    return (Page(text, "", "", ()) if media.startswith("text/") and media != "text/html" else read_page(text)), charset


def derive(record: bytes) -> list[tuple[str, Headers, bytes]]:
    """(type, headers, block) of the metadata and the conversion record of a response record.

    Codings are undone first. A body of no text (another media type, an unknown or broken coding) has a
    metadata record alone, which says why.
    """
    headers, block = parse(record)
    source = value_of(headers, "WARC-Record-ID")
    if (value_of(headers, "WARC-Type") or "").lower() != "response":
        raise ValueError("no response record")
    if not source:
        raise ValueError("no WARC-Record-ID")
    head, gap, payload = block.partition(b"\r\n\r\n")
    status, *fields = head.split(b"\r\n")
    if not gap or not status.startswith(b"HTTP/"):
        raise ValueError("no HTTP response in the block")
    http: Headers = [(n.strip(), v.strip()) for n, _, v in (f.decode("latin-1").partition(":") for f in fields)]
    kind = value_of(http, "Content-Type") or ""
    unread = ""
    try:
        page, charset = page_of(kind, body_of(http, payload))
    except Unreadable as why:
        page, charset, unread = Page("", "", "", ()), "", str(why)
    target = value_of(headers, "WARC-Target-URI") or ""
    try:
        base = urljoin(target, page.base)
    except ValueError:
        base = target
    copied = [(n, v) for n in COPIED if (v := value_of(headers, n)) is not None]
    ids = {t: record_id(t, source) for t in ("metadata", "conversion")}
    info = [
        ("title", page.title),
        ("language", page.language),
        ("http-status", status.split(b" ")[1].decode("latin-1") if b" " in status else ""),
        ("content-type", kind.split(";")[0].strip().lower()),
        ("charset", charset),
        ("payload-length", str(len(payload))),
        *([("no-conversion", unread)] if unread else []),
        *(("outlink", x) for x in outlinks(page.links, base)),
    ]
    blocks = {"metadata": ("application/warc-fields", "".join(f"{n}: {v}\r\n" for n, v in info).encode("utf-8", "replace"))}
    if not unread:
        blocks["conversion"] = ("text/plain; charset=UTF-8", page.text.encode("utf-8", "replace"))
    out = []
    for t, (content, body) in blocks.items():
        linked = [("WARC-Concurrent-To", ids["conversion"])] if t == "metadata" and not unread else []
        own = [("WARC-Type", t), ("WARC-Record-ID", ids[t]), ("WARC-Refers-To", source), *copied, *linked, ("WARC-Block-Digest", digest(body)), ("Content-Type", content)]
        out.append((t, own, body))
    return out


COLUMNS = "record_type string, record_id string, refers_to string, target_uri string, payload_digest string, block_digest string, content_length long, block binary, record binary, problem string"


def derivatives(records: DataFrame, key: str = "page_id", column: str = "record") -> DataFrame:
    """Key and the derived records, two rows a response."""
    return _derived(records.select(F.col(key), F.col(column).alias("__record")), key, lambda batch: batch.column(1).to_pylist())


def page_derivatives(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """``derivatives`` of the response records that the pages (url, html) make."""

    def made(batch: pa.RecordBatch) -> Iterator[bytes | None]:
        for name, url, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            yield None if url is None or html is None else response(url, html, name=str(name))

    return _derived(pages.select(F.col(key), "url", "html"), key, made)


def _derived(df: DataFrame, key: str, records_of) -> DataFrame:
    bounded_batches(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    names = [key, *(c.split()[0] for c in COLUMNS.split(", "))]
    text, large = pa.string(), pa.binary()
    types = [text, text, text, text, text, text, pa.int64(), large, large, text]

    def derived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, rows = [], []
            for i, record in enumerate(records_of(batch)):
                try:
                    if record is None:
                        raise ValueError("no record")
                    for t, headers, block in derive(record):
                        get = dict(headers).get
                        rows.append((t, get("WARC-Record-ID"), get("WARC-Refers-To"), get("WARC-Target-URI"), get("WARC-Payload-Digest"), get("WARC-Block-Digest"), len(block), block, build(headers, block), None))
                        index.append(i)
                except ValueError as problem:
                    rows.append((None,) * 9 + (str(problem),))
                    index.append(i)
            keys = batch.column(0).take(pa.array(index, pa.int64()))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([keys, *columns], names=names)

    return df.mapInArrow(derived, f"{key} {kind}, {COLUMNS}")
