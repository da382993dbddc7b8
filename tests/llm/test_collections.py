"""Join, top-k, sharding, mixing and the pipeline: against brute force, SQL and planted groups."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import jaccard_join as J
from quillon.llm import mixing, sharding, topk
from quillon.llm.components import roots
from quillon.llm.common import Scratch
from quillon.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def shingles(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if len(words) >= width else frozenset([tuple(words)])


def brute_components(texts, width, num, den):
    sets = [shingles(t, width) for t in texts]
    home = list(range(len(texts)))

    def top(i):
        while home[i] != i:
            i = home[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and den * both >= num * (len(a) + len(sets[j]) - both):
                x, y = sorted((top(i), top(j)))
                home[y] = x
    return [(len(s), top(i)) for i, s in enumerate(sets)]


def near_copies(seed, n, edits):
    r = random.Random(seed)
    base = [f"w{r.randrange(500)}" for _ in range(150)]
    out = []
    for _ in range(n):
        words = base[:]
        for _ in range(r.randint(0, edits)):
            words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize(("width", "num", "cluster"), [(3, 90, 6144), (5, 80, 6144), (3, 80, 1)])
def test_components_equal_brute_force(spark, monkeypatch, width, num, cluster):
    monkeypatch.setattr(J, "CLUSTER_NODES", cluster)
    monkeypatch.setattr(J, "ROUND_PAIRS", 2 if cluster == 1 else 64)
    if cluster == 1:
        monkeypatch.setattr(J, "BLOCK_NODES", 3)
    texts = near_copies(1, 40, 8) + near_copies(2, 15, 3) + ["a b c d e f", "A B  c D e\tF", "a", "A", "", None, " \n", "a b"] + [f"u{k} v{k} w{k}" for k in range(5)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.components(df, width, num, 100).collect()}
    assert got == dict(enumerate(brute_components(texts, width, num, 100)))


def test_sets_of_one_name_are_told_apart(spark, monkeypatch):
    """Names of 11 bits: different sets often share one, and the join begins again until none do."""
    monkeypatch.setattr(J, "NAME_BITS", 11)
    texts = near_copies(5, 30, 6) + [f"a{k} b{k} c{k} d{k}" for k in range(25)] + ["x y z w"] * 4
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.components(df, 3, 90, 100).collect()}
    assert got == dict(enumerate(brute_components(texts, 3, 90, 100)))


def test_fullest_segments_are_found_by_both(spark):
    """Sets just at the threshold, whose largest partner is larger or smaller, in one band or two."""
    rng = np.random.default_rng(77)
    for num in (80, 90):
        t = J.Threshold(num, 100)
        for _ in range(1500):
            n = int(rng.integers(5, 400))
            both = int(rng.integers(max(1, n * num // 110), n + 1))
            extra = int(rng.integers(0, max(1, both * (100 - num) // num) + 1))
            h = np.unique(rng.integers(0, 2**64, n + extra, dtype=np.uint64))
            rng.shuffle(h)
            a, b = np.sort(h[:n]), np.sort(np.concatenate([h[:both], h[n:]]))
            if len(a) and len(b) and t.linked(a, b) and len(np.setxor1d(a, b)):
                assert len(np.intersect1d(J.join_keys(a, t), J.join_keys(b, t)))


def test_join_query_equals_brute_force(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id)
    want = brute_components([r.text for r in docs], 3, 90, 100)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries()["op8_parity_jaccard_join"](spark, SF).collect()}
    assert got == {docs[i].doc_id: (n, docs[c].doc_id) for i, (n, c) in enumerate(want)}


def test_pigeonhole_and_hamming_bounds():
    for num in (90, 80):
        t, rng = J.Threshold(num, 100), np.random.default_rng(num)
        for k in range(600):
            n = int(rng.choice([3, 12, 20, 60, 300, 1500]))
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            cut = int(rng.integers(0, t.most_different(2 * n) // 2 + 2))
            b = np.unique(np.concatenate([a[cut:], rng.integers(0, 2**64, int(rng.integers(0, cut + 1)), dtype=np.uint64)]))
            different = len(np.setxor1d(a, b))
            bits = J.sketch_bits(n)
            assert np.bitwise_count(J.parity_sketch(a, bits) ^ J.parity_sketch(b, bits)).sum() <= different
            if len(b) and different and t.linked(a, b):
                assert different <= t.most_different(len(a) + len(b))
                assert len(np.intersect1d(J.join_keys(a, t), J.join_keys(b, t)))


def test_distinct_documents_keeps_one_of_each(spark):
    rows = [(3, "a b c d e f g", "k"), (1, "A b c d e f g", "l"), (None, "a b c d e f g", "m"), (5, "", "n"), (6, None, "o"), (7, "other words that stand alone here", "p")]
    rows += [(9, "same row same text twice over", "q")] * 3 + [(None, "id is missing in both of these", "r")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, root string")
    got = J.distinct_documents(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == sorted([(1, "A b c d e f g"), (5, ""), (6, ""), (7, rows[5][1]), (9, rows[6][1]), (0, rows[9][1])])
    assert J.distinct_documents(df.limit(0)).count() == 0


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (101, 101)], "a long, b long")
    got = {r.node: r.root for r in roots(edges, Scratch(spark, "test")).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[101] == 100
    assert roots(edges.limit(0), Scratch(spark, "test")).count() == 0


def equals_sql(spark, name, sf=SF):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.execute(oracle_sql()[name])
    columns = [d[0] for d in found.description]
    got = queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(found.fetchall())


def test_top_k_equals_sql(spark):
    equals_sql(spark, "op2_exact_top_k")


def test_mixing_equals_sql(spark):
    equals_sql(spark, "op9_source_mixing")


@pytest.mark.parametrize("scale", [1, 10**8, 10**14])
def test_top_k_ties_and_cells(spark, scale):
    rng = np.random.default_rng(0)
    x = rng.integers(-3, 4, size=(700, 6)) * scale
    x[5] = 0
    rows = [(i, [float(v) / 1024 for v in r], None) for i, r in enumerate(x)]
    rows += [(1000, None, 1), (1001, [1.0, None] * 3, 1), (1002, [float("nan")] * 6, 1), (1003, [float("inf")] * 6, 1), (None, [1.0] * 6, 1), (1004, [1.0] * 5, 1), (1005, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = topk.top_k(df, lambda i: i % 35 == 0, k=4, cell_candidates=90, cell_queries=5)
    if scale == 10**14:  # scores beyond 64 bits are an error, never other numbers
        with pytest.raises(Exception, match="beyond 64 bits"):
            got.collect()
        return
    by = {}
    for r in got.collect():
        by.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    big = [[int(v) for v in r] for r in np.floor(1024 * (x / 1024)).astype(object)]
    for q in range(0, 700, 35):
        scores = sorted((-sum(a * b for a, b in zip(big[q], big[i])), i) for i in range(700) if i != q)[:4]
        assert sorted(by[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(scores)]
    assert topk.top_k(df.limit(0), lambda i: i % 35 == 0).count() == 0


def plain_no_random_access(x, q, own, k):
    """Fagin's loop, entry by entry: read the lists in step, keep bounds of the seen rows, stop when no outsider can qualify."""
    n, dims = len(x), [d for d in range(len(q)) if q[d]]
    lists = [sorted(((q[d] * x[i][d], i) for i in range(n)), reverse=True) for d in dims]
    seen, depth = {}, 0
    while True:
        for d, entries in enumerate(lists):
            gain, i = entries[depth]
            seen.setdefault(i, {})[d] = gain
        depth += 1
        front, least = [e[depth - 1][0] for e in lists], [e[-1][0] for e in lists]
        low = {i: sum(got.get(d, least[d]) for d in range(len(dims))) for i, got in seen.items() if i != own}
        high = {i: sum(got.get(d, front[d]) for d in range(len(dims))) for i, got in seen.items() if i != own}
        best = sorted(low, key=lambda i: (-low[i], i))[:k]
        if depth == n or len(best) == k and sum(front) < low[best[-1]] and all(high[i] < low[best[-1]] for i in high if i not in best):
            return sorted(((sum(a * b for a, b in zip(x[i], q)), i) for i in best), key=lambda s: (-s[0], s[1])), depth * len(dims)


def test_reading_stops_early_and_is_exact():
    rng = np.random.default_rng(3)
    for kind in (np.float64, object):
        x = rng.integers(-9, 10, size=(400, 3))
        x[:6] *= 12
        block = topk.Block(np.arange(400), x.astype(kind))
        for own in range(0, 30):
            q = x[own] if own else np.array([0, 5, 0])
            before = block.read
            scores, ids = topk._best(*block.search(q.astype(kind)[None], np.array([own]), 4, [None])[0], 4)
            want, entries = plain_no_random_access(x.tolist(), q.tolist(), own, 4)
            if entries < 400 * np.count_nonzero(q):  # else ties at the end of the lists, which ids break
                assert [int(s) for s in scores] == [s for s, _ in want]
            brute = sorted((-int(x[i] @ q), i) for i in range(400) if i != own)[:4]
            assert [(-int(s), int(i)) for s, i in zip(scores, ids)] == brute
            # Never more than a step and what few outstanding rows save beyond the plain loop.
            assert block.read - before <= entries + (int(400 * topk.STEP) + 1) * np.count_nonzero(q)
        assert block.read < 0.7 * 30 * x.size
        assert len(block.search(np.zeros((1, 3)).astype(kind), np.array([0]), 4, [None])[0][1]) == 399


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 11])
def test_one_more_shard_takes_rows_only_into_itself(n):
    keys = np.random.default_rng(n).integers(0, 2**63, 20_000).astype(np.uint64)
    tree = sharding.Tree.of(n)
    before = tree.place(keys)
    assert np.bincount(before, minlength=n).min() > 0.85 * len(keys) / n
    for k in range(n, n + 3):
        tree = tree.grown()
        after = tree.place(keys)
        assert set(after[before != after]) == {k}
        assert np.bincount(after, minlength=k + 1).min() > 0.85 * len(keys) / (k + 1)
        before = after


def test_placement_equals_a_plain_descent():
    """One key at a time, with Python integers and math.log."""
    import math

    def mix(x):
        x = (x + 0x9E3779B97F4A7C15) % 2**64
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
        return x ^ (x >> 31)

    def weigh(node):
        return node if isinstance(node, float) else sum(weigh(c) for c in node)

    def place(tree, key):
        path, node, name = [], tree, mix(0)
        while not isinstance(node, float):
            bids = []
            for k, child in enumerate(node):
                own = mix((name + k + 1) % 2**64)
                u = ((mix(key ^ own) >> 11) + 0.5) / 2**53
                bids.append((-math.log(u) / weigh(child) if weigh(child) else math.inf, k, own))
            _, k, name = min(bids)
            path.append(k)
            node = node[k]
        return tuple(path)

    weights = (((1.0, 0.25), (0.0, 2.0, 0.5)), ((0.001,),), ((3.0, 1.0), (1.0,)))
    numbers = {p: i for i, p in enumerate((r, k, s) for r, region in enumerate(weights) for k, rack in enumerate(region) for s in range(len(rack)))}
    keys = np.random.default_rng(4).integers(0, 2**64, 3000, dtype=np.uint64)
    assert sharding.Tree(weights).place(keys).tolist() == [numbers[place(weights, int(k))] for k in keys]


def test_movement_is_confined_to_subtrees_whose_weights_change():
    keys = np.random.default_rng(9).integers(0, 2**63, 40_000).astype(np.uint64)
    even = tuple(tuple((1.0,) * 3 for _ in range(3)) for _ in range(3))
    less = (*even[:2], (*even[2][:2], (1.0, 1.0, 0.25)))
    a, b = (sharding.Tree(w).place(keys) for w in (even, less))
    region, rack = (lambda x: x // 9), (lambda x: x // 3)
    assert (a != b).any()
    moved = region(a) != region(b)
    assert set(region(a[moved])) == {2}  # out of the region that lost weight, never between the others
    within = ~moved & (rack(a) != rack(b))
    assert within.any() and set(rack(a[within])) == {8}
    last = ~moved & ~within & (a != b)
    assert last.any() and set(a[last]) == {26}
    assert np.array_equal(a[region(b) < 2] == b[region(b) < 2], region(a[region(b) < 2]) < 2)
    assert np.mean(b == 26) == pytest.approx(0.25 / 26.25, rel=0.15)


def test_time_does_not_depend_on_weights():
    import time

    keys = np.random.default_rng(2).integers(0, 2**63, 100_000).astype(np.uint64)

    def seconds(w):
        tree, best = sharding.Tree((((w, w), (w, w)),)), 9.0
        for _ in range(5):
            began = time.perf_counter()
            tree.place(keys)
            best = min(best, time.perf_counter() - began)
        return best

    assert seconds(0.001) < 3 * seconds(1.0)
    assert np.array_equal(sharding.Tree((((1.0, 0.5),),)).place(keys), sharding.Tree((((0.001, 0.0005),),)).place(keys))
    with pytest.raises(ValueError):
        sharding.Tree((((0.0,),),))


def test_sharding_query(spark):
    rows = queries()["op5_hash_tree_sharding"](spark, SF).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.law for r in rows} == {"key"} and len(rows) == len(text)
    for s in range(8):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 8) and r.size == len(text[r.doc_id].encode()) + 1 for r in rows)
    odd = spark.createDataFrame([(None, None, 1), (None, None, 1), (1, "é", 2), (1, "é", 2)], "doc_id long, text string, slot int")
    got = sharding.shard(odd).collect()
    assert len({(r.shard, r.slot) for r in got}) == 4 and sorted(r.size for r in got) == [1, 1, 3, 3]
    assert sharding.shard(odd.limit(0)).count() == 0


def test_water_level(spark):
    def targets(sizes):
        df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
        return {r.source: r.target for r in mixing.water_fill(df).collect()}

    def brute(sizes):
        names = sorted(sizes, key=lambda k: (k is None, k or ""))
        weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
        target, open_ = {}, set(names)
        budget = 1.5 * sum(sizes.values())
        while open_:
            w = sum(weight[n] for n in open_)
            over = {n for n in open_ if weight[n] * budget / w >= 2 * sizes[n]}
            if not over:
                target |= {n: weight[n] * budget / w for n in open_}
                break
            target |= {n: 2.0 * sizes[n] for n in over}
            budget -= sum(2 * sizes[n] for n in over)
            open_ -= over
        return target

    rng = random.Random(0)
    for _ in range(6):
        sizes = {rng.choice("abcdefgh") + str(i): rng.choice([0, 1, 50, 1000, 10**6]) for i in range(rng.randint(1, 9))} | {None: rng.randint(0, 500)}
        assert targets(sizes) == pytest.approx(brute(sizes))


def test_mix_takes_what_is_assigned(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = mixing.assign(docs)
    goal = {r.source: int(r.t) for r in plan.groupBy("source").agg(F.floor(F.max("target")).alias("t")).collect()}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    got = {r.source: r.n for r in mixed.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    assert got == {k: v for k, v in goal.items() if v}
    assert plan.where("taken > 2 * size").count() == 0
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (None, "d e", None), (2, None, None), (3, "", "s")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("taken", F.lit("mine"))
    want = mixing.assign(odd).agg(F.sum("taken")).first()[0]
    assert mixing.mix(odd).agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == want
    assert mixing.mix(odd.limit(0)).count() == 0 and mixing.assign(odd.limit(0)).count() == 0


def test_mixed_rows_are_those_assigned(spark):
    """Rows, not only words: repeated rows, wordless texts, null ids and sources, clashing names, small and large buckets."""
    r = random.Random(5)
    rows = [(k, " ".join(f"w{r.randrange(9)}" for _ in range(r.randint(1, 12))), r.choice("abc"), k) for k in range(300)]
    rows += [(7, "same words here", "a", 1)] * 40 + [(None, "no id at all", "b", 2)] * 30 + [(None, f"no id {k}", "b", 3) for k in range(20)]
    rows += [(900, None, "a", 4), (901, "", "b", 5), (902, " \n", None, 6), (903, "x y", None, 7), (904, "", "only", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long").withColumns({"row": F.lit(1), "side": F.lit(2), "key": F.lit(3), "a.b": F.lit(4)})
    for per in (4, 4096):
        plan = [p.asDict() for p in mixing.assign(docs, rows_per_bucket=per).collect()]
        assert len(plan) == len(rows)
        for source in {p["source"] for p in plan}:
            own = [p for p in plan if p["source"] == source]
            assert sum(p["taken"] for p in own) == int(own[0]["target"]) and sum(0 < p["extra"] < p["size"] for p in own) <= 1
        mixed = mixing.mix(docs, rows_per_bucket=per)
        assert mixed.columns == docs.columns
        got = {}
        for m in mixed.collect():
            got.setdefault((m.doc_id, m.source), []).append(m.text)
        want = {}
        for p in plan:
            key = (p["doc_id"], p["source"])
            want.setdefault(key, [0, 0])
            want[key][0] += p["passes"] + (p["extra"] > 0)
            want[key][1] += p["taken"]
        for key, (times, words) in want.items():
            texts = got.pop(key, [])
            assert (len(texts), sum(len((t or "").split()) for t in texts)) == (times, words), key
        assert not got


def test_pipeline_of_awkward_and_empty_tables(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeated rows, clashing names, no rows at all: every stage's defined result."""
    import corpus_pipeline as P

    schema = "doc_id long, text string, lang string, source string, n_chars long, size long, row int, __id long, __y int, __key long, root string"
    good = "plain words that make a sentence of a kind, and more of them follow here. " * 12
    texts = [None, "", " \n", "a", "w" * 100_000, good, good, good + "tail", "mail me at some.one@mail.example or call +49 30 1234567 today", "é ü " * 40]
    rows = [(i if i % 5 else None, t, None if i % 3 else "en", None if i % 2 else "s", None, 1, 2, 3, 4, 5, "r") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[-2:] + [(None,) * 11], schema)
    labels = spark.createDataFrame([(6, 1), (7, 1), (None, 1), (1, None), (99, 0), (3, 1)], "doc_id long, quality int")
    for name, frame in (("awkward", docs), ("none", docs.limit(0))):
        folder = str(tmp_path / name)
        frame.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        now = spark.read.parquet(f"{folder}/documents.parquet")
        for k, (stage, f) in enumerate(P.STAGES):
            after = f(spark, now, folder)
            if stage != "best_fit_packing":
                assert after.columns == docs.columns, stage
            after.write.parquet(f"{folder}/{k}")
            before, now = now, spark.read.parquet(f"{folder}/{k}")
            if name == "none":
                assert now.count() == 0
            elif stage == "quality_classifier":  # labels of one kind: every score is its share, and all stay
                assert now.count() == before.count()
            elif stage == "near_duplicates":  # one of each set; the wordless all stay
                words = [[bool((r.text or "").split()) for r in df.select("text").collect()] for df in (before, now)]
                assert words[1].count(False) == words[0].count(False) and words[1].count(True) == 5
            elif stage == "personal_data":
                assert now.where("text LIKE '%@mail%' OR text LIKE '%1234567%'").count() == 0 and now.count() == before.count()
            elif stage == "best_fit_packing":
                assert now.where("piece = 0").count() == before.count()
        assert P.run(spark, folder).count() == now.count()


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = P.quality_classifier(spark, docs, SF)
    assert kept.columns == docs.columns
    good = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").join(docs, "doc_id")
    assert kept.join(good.select("doc_id"), "doc_id", "left_semi").count() >= 0.97 * good.count()
    one = P.near_duplicates(spark, kept, SF)
    want = brute_components([r.text for r in kept.collect()], 5, 80, 100)
    assert one.columns == docs.columns and one.count() == len({c for _, c in want})
    assert P.personal_data(spark, one, SF).where(F.col("text").rlike(r"[a-z0-9]@mail")).count() == 0
    out = P.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "near_duplicates", "personal_data", "source_mixing", "best_fit_packing"]
