"""Nearest neighbours by a block matrix join: products of int8 tiles bound the cosines, survivors are recomputed and merged by heaps.

Vectors are scaled to length 1 and rounded to int8 with a scale of their own. The product of two rounded vectors differs from the cosine by
no more than the lengths of what rounding took away allow, so a pair whose upper bound lies below the k-th best lower bound, or below the
k-th best cosine found so far, can't be among the k nearest. The others are recomputed from the original vectors in double precision; each
query keeps a heap of its k best in a tile, and the heaps of all tiles are merged. The result is exact, not approximate.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import scratch
from spanloom.llm.tiles import finite, matrix, numbered_rows, tile_join

#: Queries and candidates whose products are held at a time, inside a tile.
INNER = (512, 4096)
#: Components whose int8 products add up exactly in single precision: 1024 * 127 * 127 < 2 ** 24.
EXACT = 1024
#: What double precision may add to a bound.
SLACK = 1e-9
#: Pairs that are recomputed at a time.
PAIRS = 65_536


def rounded(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of unit vectors, the scale of each, the length of what the codes stand for, and the length of what rounding took away."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    stands = codes * scale[:, None]
    return codes, scale, np.sqrt((stands**2).sum(axis=1)), np.sqrt(((unit - stands) ** 2).sum(axis=1))


def products(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Integer products of all pairs of int8 rows."""
    out = np.zeros((len(one), len(two)))
    for a in range(0, one.shape[1], EXACT):
        out += one[:, a : a + EXACT].astype(np.float32) @ two[:, a : a + EXACT].astype(np.float32).T
    return out


def dots(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Inner products of the pairs of rows, added component by component, so that equal pairs give equal values in any company."""
    out = np.zeros(len(one))
    for i in range(one.shape[1]):
        out += one[:, i] * two[:, i]
    return out


def lengths(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt(dots(vectors, vectors))


def nearest(ids: np.ndarray, queries: np.ndarray, names: np.ndarray, candidates: np.ndarray, k: int) -> list[list[tuple[float, int]]]:
    """A heap of (cosine, -name) for each query, at most k entries, of candidates of another name; no vector has length 0."""
    heaps: list[list[tuple[float, int]]] = [[] for _ in ids]
    floor = np.full(len(ids), -np.inf)  # no cosine below it can be among the query's k best
    own, other = lengths(queries), lengths(candidates)
    q_codes, q_scale, q_length, q_lost = rounded(queries / own[:, None])
    for c in range(0, len(names), INNER[1]):
        part = slice(c, c + INNER[1])
        c_codes, c_scale, _, c_lost = rounded(candidates[part] / other[part, None])
        for q in range(0, len(ids), INNER[0]):
            rows = slice(q, q + INNER[0])
            about = products(q_codes[rows], c_codes) * (q_scale[rows, None] * c_scale[None])
            about[ids[rows, None] == names[None, part]] = -np.inf
            bound = q_length[rows, None] * c_lost[None] + (q_lost[rows, None] + SLACK)
            if about.shape[1] >= k:
                floor[rows] = np.maximum(floor[rows], np.partition(about - bound, -k, axis=1)[:, -k])
            x, y = np.nonzero((about + bound >= floor[rows, None]) & (about > -np.inf))
            x, y = x + q, y + c
            for a in range(0, len(x), PAIRS):
                i, j = x[a : a + PAIRS], y[a : a + PAIRS]
                cosine = np.clip(dots(queries[i], candidates[j]) / (own[i] * other[j]), -1, 1)
                for query, value, name in zip(i.tolist(), cosine.tolist(), names[j].tolist(), strict=True):
                    if len(heaps[query]) < k:
                        heapq.heappush(heaps[query], (value, -name))
                    elif (value, -name) > heaps[query][0]:
                        heapq.heapreplace(heaps[query], (value, -name))
            for query in np.unique(x).tolist():
                if len(heaps[query]) == k:
                    floor[query] = max(floor[query], heaps[query][0][0])
    return heaps


@scratch
def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank from 1, the neighbour's id and score: the k rows of largest cosine to each row that is_query (a condition on id_col)
    picks, nearest first, ties to the smaller id; all there are, if fewer. Rows of the query's own id aren't its neighbours.

    Ids are whole numbers. Rows without an id, and vectors that are null, empty, of length 0 or hold a component that is null or not
    finite take no part; so do those whose length double precision can't hold. Vectors meet those of their own dimension only. Repeated rows are
    neighbours each; equal query rows are searched once, and rows that share an id with other vectors each, under their one id. An empty
    table gives an empty result. Other columns aren't read.
    """
    long = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), is_query.alias("asks"))
    rows = numbered_rows(rows.where(F.col("id").isNotNull() & finite(F.col("v")) & (long > 0) & (long < float("inf"))))
    queries = rows.where("asks").groupBy("id", "v").agg(F.min("row").alias("row"))

    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        ids, row = one["id"].to_numpy(), one["row"].to_numpy()
        heaps = nearest(ids, matrix(one["v"]), two["id"].to_numpy(), matrix(two["v"]), k) if len(one) and len(two) else []
        found = [(i, value, -name) for i, heap in enumerate(heaps) for value, name in heap]
        at, score, name = zip(*found, strict=True) if found else ((), (), ())
        at = np.array(at, np.int64)
        return pa.table({"row": row[at], "query_id": ids[at], "id": np.array(name, np.int64), "score": np.array(score, np.float64)})

    best = tile_join(queries, rows, run, "row long, query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
