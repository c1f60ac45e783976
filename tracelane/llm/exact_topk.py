"""Exact top-k search: columnar branch and bound.

Candidates lie dimension by dimension (vertical layout), the dimensions of most energy in their block first. For a query, inner products
are accumulated over one block of dimensions after another; after each block a candidate stays only if its partial product plus the
remaining mass (Cauchy-Schwarz over the dimensions not yet seen) can still reach the best scores known; survivors are compacted. What is
known comes from the candidate blocks that the task has met before, and in the first one from a whole search of its first `SEED` rows.
A block whose largest norm can't reach it is skipped whole.

Vectors that are null, empty or hold null or non-finite components take no part; vectors of another length than the query's are no
candidates of it. Rows that repeat an id, with another vector or the same, are candidates and queries of their own. Components beyond
the range of a long are the nearest long, and so are scores: larger ones tie. Sums are exact: in doubles that hold whole numbers below
2**53, in whole numbers of any size for blocks of larger components.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.blocks import FOUND, best, distinct, pack, pair, scan, usable
from .common import cut, table, tune

DIM_BLOCK, BLOCK, QUERY_BLOCK, SEED, SCALE = 8, 16384, 1024, 2048, 256
LONG = (-(1 << 63), (1 << 63) - 1)


class Columns:
    """A block of candidates: whole-number components dimension by dimension, norms of what is left after each block of dimensions."""

    def __init__(self, vectors: np.ndarray):
        whole = np.floor(SCALE * vectors.T)
        self.order = np.argsort(-np.square(whole / max(1.0, np.abs(whole).max(initial=0))).sum(axis=1), kind="stable")
        self.values = np.ascontiguousarray(whole[self.order])
        self.most = np.abs(whole).max(initial=0)
        self.edges = list(range(0, len(whole), DIM_BLOCK))
        with np.errstate(over="ignore"):
            mass = np.add.reduceat(np.square(self.values), self.edges, axis=0)[::-1].cumsum(axis=0)[::-1]
        self.tails = np.sqrt(mass)  # tails[b]: of blocks b and later
        self.longest = self.tails[0].max(initial=0)


def exact_scores(columns: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers of any size, cut to the range of a long."""
    long = lambda x: max(LONG[0], min(LONG[1], int(x)))
    q = [long(x) for x in query.tolist()]
    return np.array([long(sum(a * long(b) for a, b in zip(q, c, strict=True))) for c in columns.T.tolist()], np.int64)


def leading(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """The n best by score, then smaller id."""
    if scores.size > n:
        rows = np.flatnonzero(scores >= np.partition(scores, -n)[-n])
        return rows[np.lexsort((ids[rows], -scores[rows]))[:n]]
    return np.lexsort((ids, -scores))


def search_block(c: Columns, ids: np.ndarray, query: np.ndarray, floor, n: int, counts: list | None = None) -> tuple[np.ndarray, np.ndarray, object]:
    """The n best rows that are not below `floor` (None: none known), their scores, the floor after them. counts: receives how many candidates
    are left after each block of dimensions."""
    q = np.floor(SCALE * query)[c.order]
    if c.most * np.abs(q).max(initial=0) * q.size >= 1 << 53:  # doubles don't hold these sums
        scores = exact_scores(c.values, q)
        rows = leading(scores, ids, n)
        rows = rows if floor is None else rows[scores[rows] >= floor]
        return rows, scores[rows], _raised(floor, scores[rows], n)
    mass = np.sqrt(np.add.reduceat(np.square(q), c.edges)[::-1].cumsum()[::-1])
    if floor is None:
        seed = q @ c.values[:, :SEED]
        floor = np.partition(seed, -n)[-n] if seed.size >= n else None
    if floor is not None and mass[0] * c.longest * (1 + 1e-9) + 1 < floor:
        return np.empty(0, np.int64), np.empty(0), floor
    alive, partial = np.arange(ids.size), np.zeros(ids.size)
    whole = True
    for b, lo in enumerate(c.edges):
        hi = min(lo + DIM_BLOCK, q.size)
        partial += q[lo:hi] @ (c.values[lo:hi] if whole else c.values[lo:hi, alive])
        if floor is not None:
            reach = partial if hi == q.size else partial + mass[b + 1] * (1 + 1e-9) * (c.tails[b + 1] if whole else c.tails[b + 1, alive]) + 1e-3
            keep = np.flatnonzero(reach >= floor)
            if keep.size < 0.9 * alive.size or hi == q.size:
                alive, partial, whole = alive[keep], partial[keep], False
        if counts is not None:
            counts.append(alive.size)
    rows = leading(partial, ids[alive], n)
    return alive[rows], partial[rows], _raised(floor, partial[rows], n)


def _raised(floor, scores: np.ndarray, n: int):
    if scores.size < n:
        return floor
    return scores.min() if floor is None else max(floor, scores.min())


def topk(vectors: DataFrame, is_query, k: int, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """is_query: a Column over `id`. Returns query_id, rank, vec_id, score."""
    tune(vectors.sparkSession)
    rows = usable(vectors, id_col, vector_col, nonzero=False)
    queries = cut(pack(distinct(rows.where(is_query)), QUERY_BLOCK))
    groups, parts = max(1, queries.count()), max(1, -(-vectors.count() // (2 * block)))

    def search(columns, cand, asked, i, floor):
        return search_block(columns, cand.ids, asked.vectors[i], floor, k + 1)

    found = pair(pack(rows, block), queries, groups, parts).mapInArrow(scan(search, lambda c: Columns(c.vectors), "int64"), FOUND.format("long"))
    return best(found, k)


def query(spark, sf_dir: str) -> DataFrame:
    return topk(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, 5)


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r AND len(q.v) = len(c.v))
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
