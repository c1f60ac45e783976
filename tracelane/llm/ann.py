"""Approximate nearest neighbours: multi-index hashing over learned rotated binary codes.

Fit, on a bounded sample (`fit_rows`): centre and rotations (principal axes, then iterative quantisation: alternate signs and an
orthogonal Procrustes step), as many as make up the code's bits. Radius: the true neighbours of `ASKED` vectors of the sample among all
rows are found by one scan, and the radius covers the share `COVER` of their code distances. Every vector is indexed by its code.

A code splits into substrings of SUB_BITS bits, each with its own table; by the pigeonhole principle a code within Hamming radius r agrees
with the query's up to r_i bits on some substring i, if the r_i add up to r - substrings + 1, so probing those buckets retrieves every
code within r. A table is probed value by value, or, where that is dearer (PROBE), by comparing its rows' values. What is
retrieved is checked against r and reranked by the inner products of the original vectors. A block that holds too few codes within r
widens r, unless better scores are known from the blocks that the task met before.

Vectors that are null, empty, zero or hold null or non-finite components take no part; other lengths are no candidates. Rows that repeat
an id are candidates and queries of their own.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.blocks import FOUND, best, distinct, pack, pair, scan, usable
from .common import bounded, cut, table, tune
from .exact_topk import leading

#: The sample that fits the rotations, at most so many vectors; the vectors whose true neighbours fit the radius; bits of a substring and of a
#: code at most; the share of those neighbours that the radius covers; the rows whose comparison costs as much as probing for one value.
FIT_ROWS, ASKED, SUB_BITS, BITS, COVER, PROBE, BLOCK, QUERY_BLOCK = 4000, 200, 16, 128, 0.96, 64, 16384, 1024


def rotation_of(projected: np.ndarray, seed: int, rounds: int) -> np.ndarray:
    """Iterative quantisation: the rotation that brings the projections nearest to their signs."""
    n = projected.shape[1]
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, n)))[0]
    for _ in range(rounds):
        u, _, vt = np.linalg.svd(np.where(projected @ rotation >= 0, 1.0, -1.0).T @ projected)
        rotation = (u @ vt).T
    return rotation


def fit(sample: np.ndarray, rounds: int = 25) -> dict:
    """Centre and directions of a code's bits from a sample (n, dim)."""
    dim = sample.shape[1]
    bits = min(BITS, -(-2 * dim // SUB_BITS) * SUB_BITS)
    centre = sample.mean(axis=0)
    x = sample - centre
    _, _, axes = np.linalg.svd(x, full_matrices=False)
    axes = axes[: min(bits, dim)].T
    projected, turns = x @ axes, []
    while sum(t.shape[1] for t in turns) < bits:
        turns.append(axes @ rotation_of(projected, 3 + len(turns), rounds))
    return {"centre": centre, "axes": np.hstack(turns)[:, :bits], "bits": bits, "radius": bits // 2}


def encode(vectors: np.ndarray, model: dict) -> np.ndarray:
    """(n, substrings) of 16 bits each."""
    signs = ((vectors - model["centre"]) @ model["axes"]) >= 0
    return np.packbits(signs, axis=1, bitorder="little").view(np.uint16)


def distances(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ code).sum(axis=1, dtype=np.int64)


class MultiIndex:
    """Tables of one block of codes, one for each substring: row numbers sorted by the substring's value."""

    FLIPS = [np.array([sum(1 << b for b in bs) for bs in combinations(range(SUB_BITS), n)], dtype=np.int64) for n in range(SUB_BITS // 2)]

    def __init__(self, codes: np.ndarray):
        self.codes, self.parts = codes, codes.shape[1]
        self.columns = [np.ascontiguousarray(codes[:, p]) for p in range(self.parts)]
        self.orders = [np.argsort(c, kind="stable") for c in self.columns]
        self.sorted = [c[o] for c, o in zip(self.columns, self.orders, strict=True)]

    def radii(self, radius: int) -> list[int]:
        """Per substring; -1: not probed."""
        each, more = divmod(radius - self.parts + 1, self.parts)
        return [each + (p < more) for p in range(self.parts)]

    def touched(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Whether a row agrees with `code` on some substring up to its share of the radius."""
        seen = np.zeros(len(self.codes), dtype=bool)
        for p, r in enumerate(self.radii(radius)):
            if r < 0:
                continue
            probes = sum(f.size for f in self.FLIPS[: r + 1])
            if r >= len(self.FLIPS) or probes * PROBE > seen.size:
                seen |= np.bitwise_count(self.columns[p] ^ code[p]) <= r
                continue
            values = (int(code[p]) ^ np.concatenate(self.FLIPS[: r + 1])).astype(np.uint16)
            low, high = np.searchsorted(self.sorted[p], values, "left"), np.searchsorted(self.sorted[p], values, "right")
            for a, b in zip(low[low < high].tolist(), high[low < high].tolist(), strict=True):
                seen[self.orders[p][a:b]] = True
        return seen

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose code is within `radius` of `code`: all of them."""
        rows = np.flatnonzero(self.touched(code, radius))
        return rows[distances(self.codes[rows], code) <= radius]


def inner(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products summed in the order of the dimensions, so that equal vectors have equal scores."""
    out = np.zeros(vectors.shape[0])
    for d in range(query.size):
        out += vectors[:, d] * query[d]
    return out


def search_block(index: MultiIndex, vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, code: np.ndarray, model: dict, floor, n: int) -> tuple[np.ndarray, np.ndarray, object]:
    """The n best of the rows found that are not below `floor`, their scores, the floor after them."""
    enough, radius = min(n, ids.size), model["radius"]
    while True:
        rows = index.within(code, radius)
        if rows.size >= enough or floor is not None or radius >= model["bits"]:
            break
        radius = min(model["bits"], radius + index.parts)
    scores = inner(vectors[rows], query)
    if floor is not None:
        keep = scores >= floor
        rows, scores = rows[keep], scores[keep]
    order = leading(scores, ids[rows], n)
    if order.size == n:
        floor = scores[order[-1]]
    return rows[order], scores[order], floor


def fit_radius(rows: DataFrame, samples: dict[int, np.ndarray], models: dict[int, dict], k: int) -> None:
    """Sets each model's radius from the true neighbours, among all rows, of ASKED vectors of its sample."""
    asked = {dim: s[:: max(1, len(s) // ASKED)][:ASKED] for dim, s in samples.items()}
    codes = {dim: encode(a, models[dim]) for dim, a in asked.items()}

    def near(batches):
        for batch in batches:
            by_dim: dict[int, list] = {}
            for v in batch.column("v").to_pylist():
                by_dim.setdefault(len(v), []).append(v)
            for dim in by_dim.keys() & asked.keys():
                v = np.array(by_dim[dim])
                scores, own = v @ asked[dim].T, encode(v, models[dim])
                top = min(k + 1, len(v))
                best_rows = np.argpartition(-scores, top - 1, axis=0)[:top]
                which = np.tile(np.arange(len(asked[dim])), top)
                at = best_rows.ravel()
                far = np.bitwise_count(own[at] ^ codes[dim][which]).sum(axis=1, dtype=np.int64)
                yield pa.RecordBatch.from_pydict({"dim": np.full(at.size, dim, np.int64), "asked": which.astype(np.int64), "score": scores[at, which], "far": far})

    from pyspark.sql.window import Window

    found = rows.select("v").mapInArrow(near, "dim long, asked long, score double, far long")
    rank = F.row_number().over(Window.partitionBy("dim", "asked").orderBy(F.desc("score"), "far"))
    got = found.withColumn("rank", rank).where((F.col("rank") <= k + 1) & (F.col("rank") > 1)).toArrow()  # the first is the vector itself or its twin
    dims, far = got.column("dim").to_numpy(), got.column("far").to_numpy()
    for dim, model in models.items():
        if (dims == dim).any():
            model["radius"] = int(np.ceil(np.quantile(far[dims == dim], COVER)))


def nearest(vectors: DataFrame, is_query, k: int, id_col: str = "vec_id", vector_col: str = "embedding", fit_rows: int = FIT_ROWS, block: int = BLOCK) -> DataFrame:
    """Returns query_id, rank, vec_id, score; recall is what the tests measure, every query gets min(k, candidates) rows."""
    tune(vectors.sparkSession)
    rows = usable(vectors, id_col, vector_col, nonzero=True)
    sample = bounded(rows, "id", fit_rows).orderBy("mark").limit(fit_rows).toArrow()
    by_dim: dict[int, list] = {}
    for v in sample.column("v").to_pylist():
        by_dim.setdefault(len(v), []).append(v)
    samples = {dim: np.array(vs) for dim, vs in by_dim.items()}
    models = {dim: fit(s) for dim, s in samples.items()}
    if models:
        fit_radius(rows, samples, models, k)
    queries = cut(pack(distinct(rows.where(is_query)), QUERY_BLOCK))
    groups, parts = max(1, queries.count()), max(1, -(-vectors.count() // (2 * block)))

    def prepare(cand):
        model = models.get(cand.vectors.shape[1]) or fit(cand.vectors[:FIT_ROWS])  # a length that the sample lacks
        return model, MultiIndex(encode(cand.vectors, model))

    def search(made, cand, asked, i, floor):
        model, index = made
        return search_block(index, cand.vectors, cand.ids, asked.vectors[i], encode(asked.vectors[i : i + 1], model)[0], model, floor, k + 1)

    found = pair(pack(rows, block), queries, groups, parts).mapInArrow(scan(search, prepare, "float64"), FOUND.format("double"))
    return best(found, k)


def query(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)
