"""Block joins of vectors: a table of queries meets a table of candidates tile by tile, each tile in a task of bounded memory."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import materialise

#: Bytes that the vectors of one side of a tile take as doubles.
SIDE_BYTES = 32 << 20
#: Rows of candidates in a tile, at least, where tiles are cut smaller to use all cores.
LEAST_ROWS = 1024


def finite(vector: Column) -> Column:
    """Whether a vector is there, isn't empty, and has no component that is null or not finite."""
    return F.coalesce(F.size(vector) > 0, F.lit(False)) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def numbered_rows(rows: DataFrame) -> DataFrame:
    """The rows as a written table with a number of their own (row), which a task that runs again finds unchanged."""
    return materialise(rows.withColumn("row", F.monotonically_increasing_id()))


def matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """The vectors, all of one length, as rows of doubles."""
    flat = vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1) if len(vectors) else flat.reshape(0, 0)


def tile_join(queries: DataFrame, candidates: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, place: str = "row", side_bytes: int = SIDE_BYTES) -> DataFrame:
    """run(queries, candidates) over the tiles of two written tables with v, their vectors; vectors meet those of their own length only.

    Queries whose place is equal share a tile. Rows are dealt to as many parts as keep a side of a tile within side_bytes: each query is
    copied once for each part of the candidates, each candidate once for each part of the queries, and no task holds more than a tile.
    """
    sizes = candidates.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    rows = max(1, side_bytes // (8 * (sizes.d or 1)))
    least = min(2 * queries.sparkSession.sparkContext.defaultParallelism, math.ceil(sizes.n / LEAST_ROWS))
    parts = max(1, least, math.ceil(sizes.n / rows))
    query_parts = max(1, math.ceil(queries.count() / rows))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    key = ["length", "query_part", "part"]
    one = queries.withColumn("length", F.size("v")).withColumn("query_part", deal(place, query_parts)).withColumn("part", every(parts))
    two = candidates.withColumn("length", F.size("v")).withColumn("part", deal("row", parts)).withColumn("query_part", every(query_parts))
    return one.groupBy(*key).cogroup(two.groupBy(*key)).applyInArrow(run, schema)
