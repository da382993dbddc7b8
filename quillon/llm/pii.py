"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, URL schemes and identifier
cues ("iban", "account", "token = " and the like). Deterministic local parsers expand each anchor to its
bounds and validate it. Time is linear in the text: an account reads 68 characters and one run of digits behind its
cue, and a run of opaque characters is read once, however many secret cues stand in it:

* base kinds ``email``, ``ip``, ``card``, ``phone``: exactly the leftmost non-overlapping matches of the
  contract's patterns, then the kind's check (parts up to 255, Luhn over 13 to 19 digits, 9 to 15 digits);
  a match that fails its check is consumed and dropped;
* added kinds: ``url`` whose authority carries a user part or a literal IPv4 address, ``account`` (an IBAN
  passing mod 97, or at least 6 digits after an account cue) and ``secret`` (an opaque value of 16 or more
  characters with letters and digits after a secret cue).

Spans are half-open code-point intervals. ``redact`` replaces them, overlaps merged, by ``<kind>`` marks.

Defined results: null and empty texts have no spans; repeated rows get the same spans; null ids pass
through; texts of any length are read whole; an empty table gives no rows; input columns pass through
``find`` and ``redact``, clashing output names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import bounded_batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account", "secret")

# Characters of the contract's patterns.
DIGITS = frozenset("0123456789")
ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
LOCAL = ALNUM | frozenset("._%+-")
LABEL = ALNUM | frozenset("-")
PHONE_INNER = DIGITS | frozenset(" ().-")
# Schemes and cues (matched in lower case).
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "mailto:", "tel:")
ACCOUNT_CUES = ("iban", "account", "acct", "konto", "compte", "cuenta")
SECRET_CUES = ("token", "password", "passwd", "secret", "api_key", "apikey")
NUMBER_WORDS = ("number", "no.", "nr.", "num.")
OPAQUE = ALNUM | frozenset("_-+/=.")
#: Characters of the longest IBAN; with blanks between, an account is looked for in twice as many.
IBAN_LONGEST = 34


@cache
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for d in DIGITS:
        a.add_word(d, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    for kind, words in (("scheme", SCHEMES), ("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def _run(text: str, at: int, allowed: frozenset) -> int:
    """End of the longest run of allowed characters from ``at``."""
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def _back(text: str, at: int, allowed: frozenset, stop: int) -> int:
    """Start of the longest run of allowed characters that ends before ``at``, not before ``stop``."""
    while at > stop and text[at - 1] in allowed:
        at -= 1
    return at


def _email(text: str, at: int, free: int) -> tuple[int, int] | None:
    start = _back(text, at, LOCAL, free)
    end = _run(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    dots = 0
    while end < len(text) and text[end] == "." and (stop := _run(text, end + 1, LABEL)) > end + 1:
        end, dots = stop, dots + 1
    return (start, end) if dots else None


def _dotted(text: str, start: int) -> tuple[int, bool] | None:
    """End of four dot-joined digit runs from a digit, and whether all parts are at most 255."""
    end, fits = start, True
    for part in range(4):
        stop = _run(text, end, DIGITS)
        if stop == end:
            return None
        digits = text[end:stop].lstrip("0")
        fits = fits and (len(digits) < 3 or len(digits) == 3 and digits <= "255")
        if part < 3:
            if stop >= len(text) or text[stop] != ".":
                return None
            stop += 1
        end = stop
    return end, fits


def _spaced(text: str, start: int) -> tuple[int, str]:
    """End and digits of the run of digits, single blanks or hyphens between, from a digit."""
    parts, end, n = [], start, len(text)
    while True:
        stop = _run(text, end, DIGITS)
        parts.append(text[end:stop])
        if stop + 1 < n and text[stop] in " -" and text[stop + 1] in DIGITS:
            end = stop + 1
        else:
            return stop, "".join(parts)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) << (k & 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _phone(text: str, at: int) -> int | None:
    """End of a phone match from a plus sign."""
    if at + 1 >= len(text) or text[at + 1] not in DIGITS:
        return None
    end = _run(text, at + 2, PHONE_INNER)
    while end > at + 3 and text[end - 1] not in DIGITS:
        end -= 1
    return end if end > at + 3 and text[end - 1] in DIGITS else None


def _iban(value: str) -> bool:
    if not 15 <= len(value) <= 34 or not value[:2].isalpha() or not value[2:4].isdigit():
        return False
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _value(text: str, at: int) -> int:
    """Where the value after a cue starts: blanks, quotes, ``:``, ``=``, ``#`` and words for "number" in between are stepped over (24 characters at most)."""
    start = at
    while start < len(text) and start - at < 24:
        if text[start] in " \t:=#'\"":
            start += 1
        elif start > at and text[start - 1] in " \t" and (word := next((w for w in NUMBER_WORDS if text[start : start + len(w)].lower() == w), None)):
            start += len(word)
        else:
            break
    return start


def _account(text: str, start: int) -> int:
    """End of the account that starts there: of the longest IBAN, blanks within, else of at least 6 digits, else ``start``."""
    window = text[start : start + 2 * IBAN_LONGEST]
    ends, joined = [], []
    for k, c in enumerate(window):
        if c in ALNUM:
            joined.append(c.upper())
            ends.append(start + k + 1)
        elif c != " ":
            break
    value = "".join(joined[:IBAN_LONGEST])
    fits = next((k for k in range(len(value), 14, -1) if _iban(value[:k])), 0)
    if fits:
        return ends[fits - 1]
    stop = _run(text, start, DIGITS)
    return stop if stop - start >= 6 else start


def _opaque(text: str, start: int) -> tuple[int, int, int]:
    """End of the run of opaque characters from ``start``, and places of its last letter and its last digit (-1: none)."""
    end, letter, digit = start, -1, -1
    n = len(text)
    while end < n and text[end] in OPAQUE:
        if text[end] in DIGITS:
            digit = end
        elif text[end] in ALNUM:
            letter = end
        end += 1
    return end, letter, digit


def _authority(text: str, at: int) -> tuple[int, int, bool]:
    """End of a URL, of its authority, and whether the authority carries a user part or a literal address."""
    end = at
    while end < len(text) and not text[end].isspace() and text[end] not in "<>\"'":
        end += 1
    host = at
    while host < end and text[host] not in "/?#":
        host += 1
    got = _dotted(text, at) if at < host and text[at] in DIGITS else None
    return end, host, "@" in text[at:host] or bool(got and got[1] and got[0] <= host)


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all personal data of a whole text, by kind and then start."""
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):  # some letters lower to two code points: fold ASCII alone, offsets stay
        low = "".join(c.lower() if c.isascii() else c for c in text)
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    free = dict.fromkeys(KINDS, 0)  # where the last match of a kind, kept or dropped, ended
    run_end = 0
    opaque = (0, -1, -1)  # the opaque run read last
    for last, (anchor, length) in _automaton().iter(low):
        at = last - length + 1
        if anchor == "digit":
            # Inside a digit run only its first digit can begin a match; a match that ended inside has freed the rest.
            if at >= free["ip"] and (at >= run_end or at == free["ip"]):
                run_end = _run(text, at, DIGITS)
                if got := _dotted(text, at):
                    free["ip"] = got[0]
                    if got[1]:
                        found["ip"].append((at, got[0]))
            if at >= free["card"]:
                end, digits = _spaced(text, at)
                free["card"] = end
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append((at, end))
        elif anchor == "at":
            if got := _email(text, at, free["email"]):
                free["email"] = got[1]
                found["email"].append(got)
        elif anchor == "plus":
            if at >= free["phone"] and (end := _phone(text, at)):
                free["phone"] = end
                if 9 <= sum(c in DIGITS for c in text[at:end]) <= 15:
                    found["phone"].append((at, end))
        elif anchor == "scheme":
            if at >= free["url"]:
                end, _, private = _authority(text, last + 1)
                free["url"] = end
                if private:
                    found["url"].append((at, end))
        elif at == 0 or text[at - 1] not in ALNUM:
            if anchor == "account" and at >= free["account"]:
                start = _value(text, last + 1)
                if (stop := _account(text, start)) > start:
                    found["account"].append((start, stop))
                    free["account"] = stop
            elif anchor == "secret" and at >= free["secret"]:
                start = _value(text, last + 1)
                if start >= opaque[0]:  # else the value ends where the run read last does
                    opaque = _opaque(text, start)
                end, letter, digit = opaque
                if start > last + 1 and end - start >= 16 and letter >= start and digit >= start:
                    found["secret"].append((start, end))
                    free["secret"] = end
    return [(kind, s, e) for kind in KINDS for s, e in found[kind]]


def joined(items) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in items)


def redacted(text: str, items: list[tuple[str, int, int]]) -> str:
    """The text with each group of overlapping spans replaced by the mark of its first and longest kind."""
    out, at = [], 0
    for kind, start, end in sorted(items, key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, column: str = "pii") -> DataFrame:
    """``docs`` with an array of (kind, start, end) structs."""
    return _apply(docs, column, "array<struct<kind:string,start:long,end:long>>", lambda t: [{"kind": k, "start": s, "end": e} for k, s, e in spans(t)])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; null stays null."""
    return _apply(docs, "text", "string", lambda t: None if t is None else redacted(t, spans(t)))


def _apply(docs: DataFrame, column: str, kind: str, what) -> DataFrame:
    bounded_batches(docs.sparkSession)
    at = docs.columns.index("text")
    schema = docs.withColumn(column, F.lit(None).cast(kind)).schema
    target = schema.names.index(column)
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])) if kind.startswith("array") else pa.string()

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = pa.array([what(t) for t in batch.column(at).to_pylist()], arrow)
            columns = list(batch.columns)
            columns[target : target + 1] = [new]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(applied, schema)
