"""License scans by an exact set-similarity join of text blocks with license templates, in DataFrame functions only.

A text's words (A-Z lower-cased; digits, letters and all that is not ASCII) are cut into overlapping blocks of
2 * ``LONGEST`` words, a new one every ``LONGEST``: any run of up to ``LONGEST`` words, such as a template, lies whole in some
block. A block matches a template if it holds at least ``pct`` per cent of the template's distinct words. All
such pairs are found:

- tokens are ordered by how many documents of the whole table hold them, rarest first. Only tokens of templates
  can be shared, so only these are counted (a row a token of the templates comes to the driver);
- prefix: a template with ``need`` of its ``size`` words in a block has one of its rarest size - need + 1 there.
  These prefixes are the index; blocks without any of their tokens are not even put into order;
- length: a block with fewer template tokens than ``need`` cannot match;
- position: after the shared token, and with it, the block and the template must still have ``need`` tokens each,
  because in a matching pair this holds of the first token they share.

What is left is verified by intersection. The labels of matched templates join those of the base phrases, which are
found as consecutive words.

Defined results: null, empty and wordless texts have no words, no labels, score 0; score is 1 where a base phrase
stands, else the highest share of a matched template, else 0; rows are joined by a row number of the written
scan, so repeated rows and null or repeated doc_ids each have their own result; empty tables give no rows;
columns besides doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Scratch

# Phrases of the contract and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Sentences that identify licenses, as words.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
#: Words of the longest template, and per cent of its distinct words that a block must hold.
LONGEST, PCT = 32, 90
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    tokens: tuple[str, ...]  # distinct, rarest first
    need: int


def words_of(text: Column) -> Column:
    """Words of a text; null text has none."""
    bare = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), f"^{_BETWEEN}|{_BETWEEN}\\z", "")
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _BETWEEN))


def _places(words: Column, phrase: str) -> Column:
    """Numbers, from 0, of the words where the phrase starts."""
    parts = phrase.split()

    def stands(i):
        held = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            held = held & (F.get(words, i + k) == part)
        return held

    found = F.filter(F.sequence(F.lit(0), F.size(words) - 1), stands)
    return F.when(F.array_contains(words, parts[0]) & F.array_contains(words, parts[-1]), found).otherwise(F.array().cast("array<int>"))


def ordered_templates(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, pct: int = PCT) -> tuple[list[Template], list[str]]:
    """The templates, and all their tokens, in the global order: rarest first, by documents of the whole table."""
    vocabulary = sorted({w for _, text in templates for w in text.split()})
    held = docs.select(F.explode(F.array_intersect(words_of(F.col("text")), F.lit(vocabulary))).alias("token"))
    frequency = {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most a row a template token
    ordered = sorted(vocabulary, key=lambda w: (frequency.get(w, 0), w))
    rank = {w: i for i, w in enumerate(ordered)}
    out = []
    for label, text in templates:
        tokens = tuple(sorted(set(text.split()), key=rank.__getitem__))
        if len(text.split()) > LONGEST:
            raise ValueError(f"a template of more than {LONGEST} words: {text}")
        out.append(Template(label, tokens, -(-pct * len(tokens) // 100)))
    return out, ordered


def blocks(words: Column, vocabulary: Sequence[str], index: Sequence[str], least: int) -> Column:
    """Start and template tokens, in the global order of ``vocabulary``, of every block that can match."""
    last = F.greatest(F.size(words) - LONGEST - 1, F.lit(0))
    starts = F.sequence(F.lit(0), last, F.lit(LONGEST))
    cut = F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice(words, s + 1, F.lit(2 * LONGEST)).alias("tokens")))
    hit = F.filter(cut, lambda b: F.arrays_overlap(b["tokens"], F.lit(list(index))))
    own = F.transform(hit, lambda b: F.struct(b["start"].alias("start"), F.array_intersect(F.lit(list(vocabulary)), b["tokens"]).alias("tokens")))
    some = F.filter(own, lambda b: F.size(b["tokens"]) >= least)
    return F.when(F.arrays_overlap(words, F.lit(list(index))), some).otherwise(F.array().cast("array<struct<start:int,tokens:array<string>>>"))


def matches(scan: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """rid, label, overlap and size of every pair of a block of ``scan`` (rid, blocks) and a template with ``need`` shared tokens."""
    spark = scan.sparkSession
    postings = [(token, t, i, len(x.tokens), x.need) for t, x in enumerate(templates) for i, token in enumerate(x.tokens[: len(x.tokens) - x.need + 1])]
    rows = ", ".join(f"('{token}', {t}, {i}, {size}, {need})" for token, t, i, size, need in postings)
    index = spark.sql(f"SELECT * FROM VALUES {rows} AS p(token, template, i, size, need)")
    least = min(x.need for x in templates)
    block = scan.select("rid", F.explode("blocks").alias("b")).select("rid", F.col("b.start").alias("start"), F.col("b.tokens").alias("tokens"), F.size("b.tokens").alias("held"))
    # The probing prefix for the least ``need``; the position filter shortens it for each template.
    probe = block.select("*", F.posexplode(F.slice("tokens", F.lit(1), F.col("held") - least + 1)).alias("j", "token"))
    length = F.col("held") >= F.col("need")
    position = (F.col("held") - F.col("j") >= F.col("need")) & (F.col("size") - F.col("i") >= F.col("need"))
    pairs = probe.join(F.broadcast(index), "token").where(length & position)  # a row a token of a template's prefix
    own = F.element_at(F.lit([list(x.tokens) for x in templates]), F.col("template") + 1)
    overlap = F.size(F.array_intersect("tokens", own))
    found = pairs.select("rid", "template", "size", "need", overlap.alias("overlap")).where("overlap >= need")
    label = F.element_at(F.lit([x.label for x in templates]), F.col("template") + 1)
    return found.select("rid", label.alias("label"), "overlap", "size")


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, pct: int = PCT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document row."""
    scratch = Scratch(docs.sparkSession, "license_scan")
    known, vocabulary = ordered_templates(docs, templates, pct)
    index = sorted({w for x in known for w in x.tokens[: len(x.tokens) - x.need + 1]})
    # The words are bound by a generator of one row, so that they are made once a document.
    bound = docs.select("doc_id", F.explode(F.array(words_of(F.col("text")))).alias("words"))
    places = [_places(F.col("words"), phrase) for phrase, _ in phrases]
    scan = bound.select(
        F.monotonically_increasing_id().alias("rid"),
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.array(*places).alias("places"),
        blocks(F.col("words"), vocabulary, index, min(x.need for x in known)).alias("blocks"),
    )
    scan = scratch.save(scan, "scan")
    hits = matches(scan, known).groupBy(F.col("rid").alias("hit_rid")).agg(F.collect_set("label").alias("found"), F.max(F.col("overlap") / F.col("size")).alias("share"))
    base = F.filter(F.array(*[F.when(F.size(F.col("places")[k]) > 0, F.lit(label)) for k, (_, label) in enumerate(phrases)]), lambda x: x.isNotNull())
    every = F.flatten("places")
    none = F.array().cast("array<string>")
    return scan.join(hits, F.col("rid") == F.col("hit_rid"), "left").select(
        "doc_id",
        "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("found", none))), ",").alias("labels"),
        F.when(F.size(every) > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def _sql() -> str:
    """DuckDB SQL of op13: every block against every template, without filters."""
    rows = ", ".join(f"('{label}', '{text}')" for label, text in TEMPLATES)
    stands = " UNION ALL ".join(
        f"SELECT r, '{label}' AS label, i - 1 AS place FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM w WHERE list_contains(ws, '{text.split()[0]}')) WHERE "
        + " AND ".join(f"ws[i + {k}] = '{part}'" for k, part in enumerate(text.split()))
        for text, label in PHRASES
    )
    return rf"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
places AS ({stands}),
base AS (SELECT r, count(*) AS n, min(place) AS a, max(place) AS b, list(DISTINCT label) AS ls FROM places GROUP BY r),
block AS (
  SELECT r, list_distinct(ws[s + 1 : s + {2 * LONGEST}]) AS b FROM (SELECT r, ws, unnest(range(0, greatest(len(ws) - {LONGEST + 1}, 0) + 1, {LONGEST})) AS s FROM w)),
template AS (SELECT label, list_distinct(string_split(text, ' ')) AS t FROM (VALUES {rows}) v(label, text)),
hit AS (
  SELECT r, label, len(list_intersect(b, t)) AS o, len(t) AS size FROM block, template WHERE 100 * len(list_intersect(b, t)) >= {PCT} * len(t)),
found AS (SELECT r, list(DISTINCT label) AS ls, max(o::DOUBLE / size) AS share FROM hit GROUP BY r)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, b::BIGINT AS last_word,
  array_to_string(list_sort(coalesce(base.ls, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.ls, []), coalesce(found.ls, [])))), ',') AS labels,
  CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN found USING (r)
"""


#: DuckDB SQL of op13.
SQL = _sql()
