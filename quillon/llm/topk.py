"""Exact top-k inner products by no-random-access aggregation.

Vectors are scaled to whole numbers. Queries and candidates meet in a grid of cells: candidates are dealt by
hash to ``columns`` of a bounded number of rows, queries to ``rows`` of a bounded number, and a cell scores
its queries against its candidates, so nothing that grows is broadcast and no task holds more than a cell.

Inside a cell, candidates form blocks that keep one list a dimension: (value, row) in order of value. A query
reads the lists of a block sequentially, all in step, each from the end that contributes most. Of a row it
knows only what it has read. The row's lower bound takes the least that each unread list can still give, its
upper bound the value at that list's reading front. Reading stops when no unseen row can reach the k-th best
lower bound (kept over all blocks of the cell) and few enough seen rows can; only these outstanding rows'
final scores are then resolved from their vectors. The best k of every cell are merged per query.

Numbers are exact: doubles while every sum of products lies below 2^53, else Python's integers. A score that
64 bits cannot hold raises an OverflowError, as does Spark for a scaled component that they cannot hold.

Defined results: vectors that are null or hold null or non-finite components take no part; vectors of
different length never meet; rows with the query's own vec_id are not its candidates; equal query rows
count once; repeated candidate rows each count; ties go to the smaller vec_id; fewer candidates than k give
fewer rows; null vec_ids take no part; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Most candidates and queries of a cell, candidates of a block, and queries that read a block together.
CELL_CANDIDATES, CELL_QUERIES, BLOCK, TOGETHER = 16_384, 16_384, 4_096, 128
#: Rows of each list between two looks at the bounds, as a share of the block, and seen rows that may stay outstanding when reading stops.
STEP, OUTSTANDING = 1 / 10, 192
#: Largest sum of products in doubles.
EXACT = 1 << 53


class Block:
    """Vectors in order of id, and per dimension the list of (value, row) in order of value."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.rows = np.argsort(x, axis=0, kind="stable")
        self.values = np.take_along_axis(x, self.rows, axis=0)
        self.read = 0  # entries read so far, by all queries

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, floors: list) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query (scores, ids) of the rows that can be among its best k; ``floors`` are lower bounds of the k-th from elsewhere, or None.

        Queries read together: what one list gives up to a depth is the same rows for all queries that read it
        from the same end, so each adds its multiple of these values to its bounds.
        """
        n, kind = len(self.x), self.x.dtype
        ends = {1: (self.rows[::-1], self.values[::-1]), -1: (self.rows, self.values)}
        signs = {e: np.where(queries * e > 0, queries, 0).astype(kind) for e in ends}
        far = {e: v[-1] for e, (_, v) in ends.items()}
        low = np.repeat((signs[1] @ far[1] + signs[-1] @ far[-1])[None, :], n, axis=0)
        unread = {e: np.ones((n, self.x.shape[1]), dtype=np.float64 if kind != object else object) for e in ends}
        known = np.zeros((n, len(queries)), dtype=bool)
        first, last = np.searchsorted(self.ids, own, side="left"), np.searchsorted(self.ids, own, side="right")
        mine = np.zeros((n, len(queries)), dtype=bool)
        for j in range(len(queries)):
            mine[first[j] : last[j], j] = True
        floor = np.array([-np.inf if f is None else f for f in floors], dtype=kind)
        out: list[np.ndarray | None] = [None] * len(queries)
        active = np.arange(len(queries))
        step = max(1, int(n * STEP))
        for a in range(0, n, step):
            b = min(n, a + step)
            for e, (rows, values) in ends.items():
                for d in range(self.x.shape[1]):
                    reads = signs[e][:, d] != 0
                    if some := np.count_nonzero(reads[active]):
                        part = rows[a:b, d]  # the next entries of the list: each row once
                        low[part] += np.multiply.outer(values[a:b, d] - far[e][d], signs[e][:, d])
                        known[part] |= reads
                        unread[e][part, d] = 0
                        self.read += len(part) * some
            fronts = {e: v[b - 1] for e, (_, v) in ends.items()}
            unseen = sum(signs[e][active] @ fronts[e] for e in ends)
            seen = np.where((known & ~mine)[:, active], low[:, active], -np.inf).T.copy()
            best = floor[active]
            if n > k:
                kth = (np.sort(seen, axis=1) if kind == object else np.partition(seen, n - k, axis=1))[:, n - k]
                best = np.maximum(best, kth)
            # Ready: no unseen row can reach the best, or the lists are at their end.
            ready = np.flatnonzero((unseen < best) | (b == n))
            if len(ready):
                # What is left to read of each row, at each front instead of at the list's end.
                rest = sum(unread[e] @ (signs[e][active[ready]] * (fronts[e] - far[e])).T for e in ends)
                for c, j in enumerate(ready):
                    i = active[j]
                    possible = np.flatnonzero(seen[j] + rest[:, c] >= best[j])
                    if b == n and not queries[i].any():
                        possible = np.flatnonzero(~mine[:, i])  # a query without lists
                    possible = possible[~mine[possible, i]]
                    if len(possible) <= OUTSTANDING or b == n:
                        out[i] = possible
            active = np.array([i for i in active if out[i] is None], dtype=np.int64)
            if not len(active):
                break
        return [(self.x[rows] @ queries[i], self.ids[rows]) for i, rows in enumerate(out)]


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    take = np.lexsort((ids, -scores))[:k]
    return scores[take], ids[take]


def cell_search(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """(query id, scores, ids) of one cell: the best k of each query among its candidates, given in order of id."""
    # A bound's difference of two sums is less than twice the largest sum.
    largest = lambda a: max(abs(int(a.min(initial=0))), abs(int(a.max(initial=0))))
    reach = 2 * largest(x) * largest(queries) * x.shape[1]
    kind = np.float64 if reach < EXACT else object
    blocks = [Block(ids[a : a + BLOCK], x[a : a + BLOCK].astype(kind)) for a in range(0, len(x), BLOCK)]
    for a in range(0, len(queries), TOGETHER):
        owns, q = query_ids[a : a + TOGETHER], queries[a : a + TOGETHER].astype(kind)
        best = [(np.zeros(0, dtype=kind), np.zeros(0, dtype=np.int64))] * len(q)
        for block in blocks:
            got = block.search(q, owns, k, [s[-1] if len(s) == k else None for s, _ in best])
            best = [_best(np.concatenate([s, t]), np.concatenate([i, j]), k) for (s, i), (t, j) in zip(best, got, strict=True)]
        for own, (scores, found) in zip(owns, best, strict=True):
            if kind is object and any(abs(s) >= 1 << 63 for s in scores):
                raise OverflowError(f"a score of vec_id {own} is beyond 64 bits")
            yield own, scores.astype(np.int64), found


def top_k(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024, cell_candidates: int = CELL_CANDIDATES, cell_queries: int = CELL_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score for every row that ``is_query(vec_id)`` marks."""
    spark = vectors.sparkSession
    good = F.coalesce(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))), F.lit(False))
    whole = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale).cast("long"))
    rows = vectors.where(F.col("vec_id").isNotNull() & good).select(F.col("vec_id").cast("long").alias("id"), whole.alias("v")).withColumn("dim", F.size("v"))
    n = vectors.count()
    asked = vectors.where(is_query(F.col("vec_id"))).count()
    columns = max(1, -(-n // cell_candidates), min(spark.sparkContext.defaultParallelism, n // 1024))
    grid_rows = max(1, -(-asked // cell_queries))
    salt = F.xxhash64("id", "v")

    def replicated(name: str, times: int):
        return F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias(name)

    candidates = rows.select("id", "v", "dim", F.lit(False).alias("asks"), F.pmod(salt, F.lit(columns)).cast("int").alias("c"), replicated("r", grid_rows))
    queries = rows.where(is_query(F.col("id"))).dropDuplicates(["id", "v"])
    queries = queries.select("id", "v", "dim", F.lit(True).alias("asks"), F.pmod(salt, F.lit(grid_rows)).cast("int").alias("r"), salt.alias("tag"), replicated("c", columns))
    cells = candidates.withColumn("tag", F.lit(0).cast("long")).unionByName(queries)

    def searched(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["asks"].to_numpy(dtype=bool)
        q, c = pdf[asks].sort_values(["id", "tag"]), pdf[~asks]
        out = {"query_id": [], "tag": [], "vec_id": [], "score": []}
        if len(q) and len(c):
            x, y = np.stack(c["v"].to_numpy()), np.stack(q["v"].to_numpy())
            ids = c["id"].to_numpy(dtype=np.int64)
            order = np.argsort(ids, kind="stable")
            tags = q["tag"].to_numpy()
            for at, (own, scores, found) in enumerate(cell_search(ids[order], x[order], q["id"].to_numpy(dtype=np.int64), y, k)):
                out["query_id"] += [own] * len(found)
                out["tag"] += [tags[at]] * len(found)
                out["vec_id"] += found.tolist()
                out["score"] += scores.tolist()
        return pd.DataFrame(out).astype("int64")

    found = cells.groupBy("dim", "r", "c").applyInPandas(searched, "query_id long, tag long, vec_id long, score long")
    order = Window.partitionBy("query_id", "tag").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
