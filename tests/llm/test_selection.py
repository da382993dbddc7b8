"""Importance resampling, filter audit, license scan: against SQL, brute force and awkward tables."""

import hashlib
import math
import random
import re
import zlib
from itertools import permutations

import duckdb
import numpy as np
import pytest

from quillon.llm import filter_audit, importance, license_scan
from quillon.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
AWKWARD = [None, "", " ", "\n\n", "a", "É" * 5, "MIT License, mit license;MIT\nLICENSE", "x " * 30, "x " * 30, "Released under the MIT licence.", "w" * 200_000]
CLASHING = "doc_id long, text string, lang string, source string, score long, part string, rid long, words string, bits int"


def awkward(spark, texts=AWKWARD):
    rows = [(i if i % 4 else None, t, None if i % 3 else "en", None, 1, "p", 2, "w", 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[-2:], CLASHING)


def by_sql(name, **tables):
    c = duckdb.connect()
    for table in ("documents", "benchmark", "labels"):
        frame = tables.get(table)
        c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'") if frame is None else c.register(table, frame)
    got = c.sql(oracle_sql()[name])
    return got.columns, sorted(got.fetchall(), key=str)


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_filter_audit", "op13_license_scan"])
def test_queries_equal_sql(spark, name):
    columns, want = by_sql(name)
    got = queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=str) == want


def brute_scores(docs, target, max_n, buckets, seed=2024):
    def features(t):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]

    s, t = ([sum(b) for b in zip(*[np.bincount(features(x)[1], minlength=buckets) for x in texts], strict=True)] or [0] * buckets for texts in ([d[1] for d in docs], target))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        n, f = features(text)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        out.append((i, len(f), n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    return out


@pytest.mark.parametrize("max_n,buckets", [(1, 50), (2, 1000)])
def test_resampling_equals_brute_force(spark, max_n, buckets):
    rng = random.Random(max_n)
    texts = [" ".join(rng.choice(["Ä", "b", "C", "dd", "e1"]) for _ in range(rng.randrange(0, 30))) for _ in range(80)] + AWKWARD[:9]
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)]
    rows += rows[40:44]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    target = ["b dd b", None, "c e1 É"]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = importance.resample(docs, frame, max_n=max_n, buckets=buckets, pct=30, min_words=5).collect()
    want = brute_scores(rows, target, max_n, buckets)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(((r.doc_id, r.n_features, r.n_words, r.weight, r.score) for r in got), key=key) == sorted(want, key=key)
    fit = sorted((r for r in want if r[2] >= 5), key=lambda r: (-r[4], r[0] is None, r[0]))
    size = 30 * len(fit) // 100
    drawn = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, size + 1)) and [(r.score, r.doc_id) for r in drawn] == [(r[4], r[0]) for r in fit[:size]]


def test_resampling_awkward_and_empty(spark):
    docs = awkward(spark)
    target = spark.createDataFrame([(1, "x")], "item_id long, text string")
    got = importance.resample(docs, target)
    assert got.count() == docs.count() and got.where("n_features = 0 AND weight <> 0").count() == 0
    assert importance.resample(docs.limit(0), target).count() == 0
    assert importance.resample(docs, target.limit(0)).count() == docs.count()
    with pytest.raises(ValueError):
        importance.streams(docs, buckets=1 << 17)


def test_streams_hold_every_feature(spark):
    packed = importance.streams(awkward(spark), max_n=2).collect()
    for block in packed:
        stream = np.frombuffer(block.stream, "<u2")
        ends = [*block.starts[1:], len(stream)]
        assert [b - a for a, b in zip(block.starts, ends, strict=True)] == [n + max(n - 1, 0) for n in block.words]


def brute_audit(docs, good, toxic):
    rules = filter_audit.Rules()
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    rows = []
    for i, t, lang in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        fails = {"A"} if len(w) < rules.min_words else set()
        fails |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        fails |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t or "") > 3 * len(t or "") else set()
        fails |= {"D"} if set(t or "") & set("#$%&*|") else set()
        fails |= {"E"} if i is not None and first[t or ""] < i else set()
        rows.append((lang or "", fails, i in good, i in toxic))
    out, shapley = [], {}
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            alive = [r for r in rows if r[0] == part]
            whole = alive
            for k, f in enumerate(order):
                gone = [r for r in alive if f in r[1]]
                alive = [r for r in alive if f not in r[1]]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                out.append((part, "".join(order), k + 1, f, len(alive), len(gone), sum(f in r[1] for r in whole) - len(gone), sum(r[1] == {f} for r in whole), sum(r[2] for r in gone), sum(r[3] for r in gone)))
    return sorted((p, o, k, a, b, c, d, e, x, shapley[p, f]) for p, o, k, f, a, b, c, d, e, x in out)


def test_audit_equals_brute_force(spark):
    rng = random.Random(3)
    made = [" ".join(rng.choice(["Ab", "cd#", "e", "ZZ", "q%"]) + (str(rng.randrange(400)) if k % 3 else "") for _ in range(rng.randrange(0, 420))) for k in range(60)]
    texts = [*AWKWARD[:10], *made, *made[:15], *made[:5]]
    rows = [(None if k % 17 == 3 else k // 2 if k % 5 == 0 else k, t, [None, "en", "", "ü"][k % 4]) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    labels = spark.createDataFrame([(k, k % 2, k % 3 == 0) for k in range(40)] + [(1, None, None), (None, 1, True), (2, 1, True)], "doc_id long, quality int, toxic boolean")
    labels = labels.selectExpr("doc_id", "quality", "CAST(toxic AS INT) AS toxic")
    good, toxic = {k for k in range(40) if k % 2} | {2}, {k for k in range(40) if k % 3 == 0} | {2}
    assert sorted(tuple(r) for r in filter_audit.audit(docs, labels).collect()) == brute_audit(rows, good, toxic)


def test_index_blocks_give_one_result(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([(f"p{rng.randrange(3)}", rng.randrange(128)) for _ in range(500)], "part string, bits int").repartition(3)
    whole, small = (sorted(map(tuple, filter_audit.subset_counts(filter_audit.bitmap_index(rows, block=b)).collect())) for b in (1 << 16, 7))
    assert whole == small and len(whole) == 3 * 32
    want = sum(1 for r in rows.collect() if r.part == "p1" and not r.bits & 5 and r.bits & 64)
    assert next(x for x in whole if x[:2] == ("p1", 5))[4] == want


def test_audit_awkward_and_empty(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, labels).collect()
    assert len(got) == 2 * 600 and {r.part for r in got} == {"", "en"}
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    assert filter_audit.audit(docs, labels.limit(0)).count() == 1200


def brute_licenses(text, pct=license_scan.PCT):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(i, label) for phrase, label in license_scan.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    base, found, share = {x[1] for x in at}, set(), 0.0
    step = license_scan.LONGEST
    for s in range(0, max(len(w) - step - 1, 0) + 1, step):
        block = set(w[s : s + 2 * step])
        for label, t in license_scan.TEMPLATES:
            own = set(t.split())
            if 100 * len(own & block) >= pct * len(own):
                found.add(label)
                share = max(share, len(own & block) / len(own))
    starts = [x[0] for x in at]
    return (len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), 1.0 if at else share)


def test_license_scan_equals_brute_force(spark):
    rng = random.Random(5)
    notices = [t for _, t in license_scan.TEMPLATES] + [p for p, _ in license_scan.PHRASES]
    filler = ["plain", "WORDS", "license", "the", "of", "mit", "Ünder", "software", "2", "a"]
    texts = list(AWKWARD)
    for _ in range(150):
        parts = [" ".join(rng.choice(filler) for _ in range(rng.randrange(0, 90))) for _ in range(3)]
        notice = rng.choice(notices).split()
        for _ in range(rng.randrange(0, 4)):
            notice[rng.randrange(len(notice))] = rng.choice(["gap", "the"])
        parts.insert(rng.randrange(4), rng.choice([" ", ", ", "\n"]).join(notice).title())
        texts.append("; ".join(parts))
    docs = awkward(spark, texts).repartition(4)
    got = sorted((tuple(r) for r in license_scan.scan_licenses(docs).collect()), key=str)
    want = sorted(((r.doc_id, *brute_licenses(r.text)) for r in docs.collect()), key=str)
    assert got == want
    assert sum(x[6] != x[5] for x in got) > 10 and sum(x[6] == "" for x in got) > 10


def test_license_notices_at_any_place_and_empty(spark):
    notice = dict(license_scan.TEMPLATES[::-1])["isc"]
    rows = [(k, "word " * k + notice + " word" * (100 - k)) for k in range(0, 100, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.labels for r in license_scan.scan_licenses(docs).collect()} == {"isc"}
    assert license_scan.scan_licenses(docs.limit(0)).count() == 0
    plan = license_scan.scan_licenses(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "MapInArrow" not in plan
