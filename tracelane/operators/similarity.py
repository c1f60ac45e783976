"""Similarity of vectors to a set of targets: inner products, whole, in blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import bounded_batches
from .blocks import FOUND, best, distinct, pack, pair, scan, usable

BLOCK, TARGET_BLOCK, PLACES = 8192, 1024, 6


def similar_pairs(vectors: DataFrame, is_target: Column, id_col: str, vector_col: str, above: float | None = None, k: int | None = None) -> DataFrame:
    """Every row against every target. Returns target_id, vec_id, score (rounded to PLACES) of the pairs with a score above `above`, or target_id, rank,
    vec_id, score of each target's k best, ties to the smaller vec_id. is_target: a Column over `id`.

    Vectors that are null, empty or hold null or non-finite components take no part. Rows that repeat an id with another vector are rows of
    their own; with `above`, rows equal to the target in id and vector count as the target itself."""
    bounded_batches(vectors.sparkSession)
    rows = usable(vectors, id_col, vector_col, nonzero=False)
    targets = pack(distinct(rows.where(is_target)), TARGET_BLOCK)
    groups, parts = max(1, -(-rows.where(is_target).count() // TARGET_BLOCK)), max(1, -(-rows.count() // BLOCK))

    def search(_, cand, asked, i, floor):
        score = np.round(cand.vectors @ asked.vectors[i], PLACES)
        if k is None:
            keep = np.flatnonzero(score > above)
            return keep, score[keep], None
        if score.size > k:
            low = np.partition(score, -k - 1)[-k - 1]
            floor = low if floor is None else max(low, floor)
        keep = np.arange(score.size) if floor is None else np.flatnonzero(score >= floor)
        return keep, score[keep], floor

    found = pair(pack(rows, BLOCK), targets, groups, parts).mapInArrow(scan(search, lambda c: None, "float64"), FOUND.format("double"))
    if k is None:
        return found.where(~F.col("own")).select(F.col("query_id").alias("target_id"), "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy")).drop("_copy")
    return best(found, k).select(F.col("query_id").alias("target_id"), F.col("rank").cast("bigint").alias("rank"), "vec_id", "score")
