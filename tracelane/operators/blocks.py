"""A stated query set against all rows, in blocks: rows are packed into matrices of bounded bytes, each pair of blocks is one unit of work.

A row is known by its id and a hash of id and vector (`mark`), so rows that repeat an id stay apart. Queries that repeat both are asked once
and answered `copies` times. Every row is a candidate, a query's own too: `best` takes one row equal to the query out of its k + 1 best, which
is the query's own or can't be told from it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK_SCHEMA = "ids binary, marks binary, copies binary, vectors binary, n int, dim int"
#: Most bytes of a block's vectors.
BLOCK_BYTES = 8 << 20
FOUND = "query_id long, mark long, copies long, vec_id long, own boolean, score {}"


def usable(df: DataFrame, id_col: str, vector_col: str, nonzero: bool) -> DataFrame:
    """Rows (id, v: array<double>, mark, copies = 1) with an id and a vector that is neither null nor holds null or non-finite components."""
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.where(~F.exists("v", bad))
    rows = rows.where(F.exists("v", lambda x: x != 0)) if nonzero else rows
    return rows.select("id", "v", F.xxhash64("id", "v").alias("mark"), F.lit(1).cast("long").alias("copies"))


def distinct(queries: DataFrame) -> DataFrame:
    """usable rows, each once with the number of its copies."""
    return queries.groupBy("id", "mark").agg(F.first("v").alias("v"), F.count("*").alias("copies")).select("id", "v", "mark", "copies")


def pack(rows: DataFrame, size: int) -> DataFrame:
    """Packs rows (id, v, mark, copies) where they lie into blocks of at most `size` vectors of one length and BLOCK_BYTES bytes."""

    def packed(batches):
        held: dict[int, list[tuple]] = {}

        def block(dim):
            ids, marks, copies, vectors = zip(*held.pop(dim), strict=True)
            texts = [np.array(x, dtype=np.int64).tobytes() for x in (ids, marks, copies)]
            names = ["ids", "marks", "copies", "vectors", "n", "dim"]
            return pa.RecordBatch.from_arrays([*(pa.array([t], pa.binary()) for t in (*texts, np.concatenate(vectors).tobytes())), pa.array([len(ids)], pa.int32()), pa.array([dim], pa.int32())], names=names)

        for batch in batches:
            column = batch.column("v")
            flat, offsets = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.offsets)
            offsets = offsets - offsets[0]
            for i, key in enumerate(zip(*(batch.column(c).to_pylist() for c in ("id", "mark", "copies")), strict=True)):
                v = flat[offsets[i] : offsets[i + 1]]
                mine = held.setdefault(v.size, [])
                mine.append((*key, v.copy()))
                if len(mine) == max(1, min(size, BLOCK_BYTES // (8 * v.size))):
                    yield block(v.size)
        for dim in list(held):
            yield block(dim)

    return rows.mapInArrow(packed, BLOCK_SCHEMA)


def pair(candidates: DataFrame, queries: DataFrame, groups: int, parts: int) -> DataFrame:
    """Every candidate block beside every query block of its dimension: (c_*, q_*). Query blocks are dealt to `groups` and candidate blocks
    to `parts`; a (part, group) is a join key of its own, so neither side of a key grows with the data."""
    dealt = lambda n: F.pmod(F.xxhash64("marks"), F.lit(n)).cast("int")
    spread = candidates.withColumn("h", dealt(parts)).select(*[F.col(c).alias("c_" + c) for c in candidates.columns], F.col("h").alias("ch"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("cg"))
    asked = queries.withColumn("g", dealt(groups)).select(*[F.col(c).alias("q_" + c) for c in queries.columns], F.col("g").alias("qg"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("qh"))
    return spread.join(asked, (spread["ch"] == asked["qh"]) & (spread["cg"] == asked["qg"]) & (F.col("c_dim") == F.col("q_dim"))).drop("ch", "cg", "qh", "qg")


def matrix(blob: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(blob, dtype=np.float64).reshape(-1, dim)


class Side:
    """One side of a pair of blocks."""

    def __init__(self, row: dict, side: str):
        self.ids, self.marks, self.copies = (np.frombuffer(row[f"{side}_{c}"], np.int64) for c in ("ids", "marks", "copies"))
        self.vectors = matrix(row[f"{side}_vectors"], row[f"{side}_dim"])


def scan(search, prepare, kind: str):
    """A mapInArrow function over `pair`. prepare(candidates: Side) makes what a block's searches share, once for consecutive pairs of the block;
    search(prepared, candidates, queries, i, floor) returns (rows, scores, floor) of query i: rows that may be among its best, none of a score below
    `floor`, and the new floor. Floors of a query block last over the candidate blocks that a task meets: FLOORS blocks at most."""

    def run(batches):
        last, made, cand, floors = None, None, None, {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["c_marks"] != last:
                    last, cand = r["c_marks"], Side(r, "c")
                    made = prepare(cand)
                asked = Side(r, "q")
                floor = floors.pop(r["q_marks"], None)
                floors[r["q_marks"]] = floor = [None] * asked.ids.size if floor is None else floor
                if len(floors) > FLOORS:
                    floors.pop(next(iter(floors)))
                rows, scores, sizes = [], [], []
                for i in range(asked.ids.size):
                    own, values, floor[i] = search(made, cand, asked, i, floor[i])
                    rows.append(own)
                    scores.append(values)
                    sizes.append(own.size)
                at, who = np.concatenate(rows), np.repeat(np.arange(asked.ids.size), sizes)
                yield pa.RecordBatch.from_pydict({
                    "query_id": asked.ids[who], "mark": asked.marks[who], "copies": asked.copies[who], "vec_id": cand.ids[at],
                    "own": (cand.ids[at] == asked.ids[who]) & (cand.marks[at] == asked.marks[who]), "score": np.concatenate(scores).astype(kind),
                })

    return run


FLOORS = 256


def best(found: DataFrame, k: int) -> DataFrame:
    """found: FOUND. The k best rows of each query by score, then smaller vec_id, but for one row equal to the query; each task first keeps its
    own k + 1 best."""
    of = Window.partitionBy("query_id", "mark")
    top = found.withColumn("_r", F.row_number().over(of.orderBy(F.desc("score"), "vec_id", F.desc("own")))).where(F.col("_r") <= k + 1)
    top = top.withColumn("_own", F.min(F.when(F.col("own"), F.col("_r"))).over(of)).where(F.col("_own").isNull() | (F.col("_r") != F.col("_own")))
    top = top.withColumn("rank", F.col("_r") - F.when(F.col("_r") > F.col("_own"), 1).otherwise(0)).where(F.col("rank") <= k)
    return top.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
