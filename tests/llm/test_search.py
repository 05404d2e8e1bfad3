"""Nearest neighbours and hard negatives against brute force, with small tiles, ties, repeats and awkward rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import negatives, neighbours, tiles

SCHEMA = "vec_id long, label int, embedding array<float>, score double, row string, v string"
NAN, INF = float("nan"), float("inf")


def table(n, d, seed, levels=None):
    """Vectors, some of them equal or of one direction; levels makes ties frequent."""
    r = np.random.default_rng(seed)
    x = r.integers(-levels, levels + 1, (n, d)).astype(np.float64) if levels else r.standard_normal((n, d))
    x[n // 3], x[n // 2] = x[3], 2 * x[3]
    return [(i, int(r.integers(0, 4)), v.tolist(), 0.1, "r", "v") for i, v in enumerate(x)]


AWKWARD = [(1000, 1, None, 0.1, "r", "v"), (1050, 1, [], 0.1, "r", "v"), (1100, 1, [0.0] * 8, 0.1, "r", "v"), (1150, 1, [NAN] + [1.0] * 7, 0.1, "r", "v"), (1200, 1, [INF] + [1.0] * 7, 0.1, "r", "v"), (1250, 1, [None] + [1.0] * 7, 0.1, "r", "v"), (None, 1, [1.0] * 8, 0.1, "r", "v"), (1300, None, [1.0] * 8, None, None, None), (1350, 2, [1.0, 2.0], 0.1, "r", "v"), (1400, 2, [2.0, 1.0], 0.1, "r", "v")]


def good(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def brute_nearest(rows, every, k):
    rows = [(i, [float(np.float32(x)) for x in v]) for i, _, v, *_ in rows if i is not None and good(v) and any(v)]
    out, seen = [], set()
    for i, v in rows:
        if i % every or (i, tuple(v)) in seen:
            continue
        seen.add((i, tuple(v)))
        scored = []
        for j, w in rows:
            if j != i and len(w) == len(v):
                dot = norm = other = 0.0
                for a, b in zip(v, w, strict=True):
                    dot, norm, other = dot + a * b, norm + a * a, other + b * b
                scored.append((-max(-1.0, min(1.0, dot / (math.sqrt(norm) * math.sqrt(other)))), j))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize(("seed", "levels"), [(1, None), (2, 1), (3, 2)])
def test_nearest(spark, monkeypatch, seed, levels):
    monkeypatch.setattr(tiles, "SIDE_BYTES", 8 * 8 * 40)
    monkeypatch.setattr(neighbours, "INNER", (7, 30))
    monkeypatch.setattr(tiles.tile_join, "__defaults__", ("row", 8 * 8 * 40))
    rows = table(210, 8, seed, levels) + AWKWARD + table(210, 8, seed, levels)[:2]
    rows.append((10, 0, [0.5] * 8, 0.1, "r", "v"))  # a second vector of a query's id
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = neighbours.nearest_neighbours(frame, F.col("vec_id") % 10 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    got = sorted(tuple(r) for r in got.collect())
    assert got == brute_nearest(rows, 10, 5)


def test_nearest_of_few_and_none(spark):
    frame = spark.createDataFrame(table(12, 8, 1)[:1] + AWKWARD[-2:], SCHEMA)
    assert [tuple(r) for r in neighbours.nearest_neighbours(frame, F.col("vec_id") >= 0).orderBy("query_id").collect()] == [(1350, 1, 1400, 0.7999999999999998), (1400, 1, 1350, 0.7999999999999998)]
    assert neighbours.nearest_neighbours(frame.limit(0), F.lit(True)).count() == 0
    assert neighbours.nearest_neighbours(frame, F.lit(False)).count() == 0


def test_bounds_hold():
    """No cosine lies outside of its bounds, and they leave few candidates."""
    r = np.random.default_rng(5)
    x, y = r.standard_normal((200, 64)), r.standard_normal((3000, 64))
    x, y = x / neighbours.lengths(x)[:, None], y / neighbours.lengths(y)[:, None]
    a, b = neighbours.rounded(x), neighbours.rounded(y)
    about = neighbours.products(a[0], b[0]) * (a[1][:, None] * b[1][None])
    bound = a[2][:, None] * b[3][None] + a[3][:, None]
    assert (np.abs(x @ y.T - about) <= bound + 1e-9).all() and bound.max() < 0.03
    wide = r.integers(-127, 128, (3, 5000)).astype(np.int8)
    assert (neighbours.products(wide, wide) == wide.astype(np.int64) @ wide.astype(np.int64).T).all()


# --- hard negatives --------------------------------------------------------------------------------------------------------


def brute_negatives(rows, every, k, least=80, most=100):
    rows = [(i, y, [math.floor(256 * float(np.float32(x))) for x in v]) for i, y, v, *_ in rows if i is not None and y is not None and good(v)]
    out, seen = [], set()
    for i, y, v in rows:
        if i % every or (i, y, tuple(v)) in seen:
            continue
        seen.add((i, y, tuple(v)))
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, z) for j, z, w in rows if len(w) == len(v))
        for s, j, _ in [x for x in scored if x[2] == y and x[1] != i][:k]:
            own = [x for x in scored if x[2] != y and least * -s <= 100 * -x[0] <= most * -s][:k]
            out += [(i, j, r + 1, m, -s, -t) for r, (t, m, _) in enumerate(own)]
    return sorted(out)


@pytest.mark.parametrize(("seed", "levels", "tree", "inner"), [(1, None, 256, 2048), (2, 1, 4, 30), (3, 2, 6, 64)])
def test_hard_negatives(spark, monkeypatch, seed, levels, tree, inner):
    monkeypatch.setattr(negatives, "TREE", tree)
    monkeypatch.setattr(negatives, "INNER", inner)
    monkeypatch.setattr(tiles.tile_join, "__defaults__", ("row", 8 * 8 * 50))
    rows = table(230, 8, seed, levels) + AWKWARD + table(230, 8, seed, levels)[20:23]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumn("embedding", negatives.whole(F.col("embedding")))
    got = negatives.hard_negatives(frame, F.col("vec_id") % 10 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute_negatives(rows, 10, 5)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 100


def test_hard_negatives_of_none(spark):
    frame = spark.createDataFrame(table(20, 8, 1), SCHEMA)
    assert negatives.hard_negatives(frame.limit(0), F.lit(True)).count() == 0
    assert negatives.hard_negatives(frame, F.lit(False)).count() == 0
    assert negatives.hard_negatives(frame.withColumn("label", F.lit(1)), F.lit(True)).count() == 0


def test_tree_bounds():
    """Edges and parents make a tree, bounds hold every score, and near anchors save most of the work."""
    r = np.random.default_rng(7)
    anchors = np.rint(r.standard_normal((1, 16)) * 100 + r.standard_normal((60, 16)) * 2)
    order, parents, edges = negatives.spanning_tree(anchors)
    assert sorted(order.tolist()) == list(range(60)) and parents[0] == -1 and (parents[1:] < np.arange(1, 60)).all()
    tree = anchors[order]
    assert np.allclose(edges[1:], np.sqrt(((tree[1:] - tree[parents[1:]]) ** 2).sum(axis=1)))
    held = np.rint(r.standard_normal((2000, 16)) * 100)
    exact, taken = held @ tree.T, [set() for _ in tree]

    def wanted(i, low, high):
        assert (low <= exact[:, i]).all() and (exact[:, i] <= high).all()
        return high >= np.sort(exact[:, i])[-5]

    done = negatives.walk(tree, parents, edges, held, wanted, lambda i, at, score: taken[i].update(at.tolist()))
    for i in range(60):
        assert set(np.argsort(-exact[:, i])[:5].tolist()) <= taken[i]
    assert done < 0.2 * exact.size


def test_large_scores_are_exact():
    big = np.array([[2.0**26 - 1, 2.0**26 - 1, 1], [2.0**26 - 1, 2.0**26 - 1, 2]])
    assert negatives.scores(big, np.array([2.0**26 - 1, 2.0**26 - 1, 3])).tolist() == [2 * (2**26 - 1) ** 2 + 3, 2 * (2**26 - 1) ** 2 + 6]


def test_whole(spark):
    row = spark.createDataFrame([([0.5, -0.001, NAN, INF, None, 1e30],)], "v array<double>").select(negatives.whole(F.col("v")).alias("w")).first()["w"]
    assert row[:2] == [128.0, -1.0] and math.isnan(row[2]) and row[3] == INF and row[4] is None and row[5] == 256e30
