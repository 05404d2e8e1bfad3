"""Cosine clusters against brute force, in both modes, with blocks, hot buckets and awkward rows."""

import numpy as np
import pytest

from spanloom.operators import vectors
from spanloom.operators.vectors import bands_for, bucket_components, cosine_clusters, distinct_vectors, double_vectors, hyperplane_buckets, least_connected

SCHEMA = "vec_id long, embedding array<float>, other string"


def planted(n=700, d=32, seed=4, spread=0.12):
    """Vectors of which about two thirds lie near one of 60 centres, the first centre's being a third of all."""
    r = np.random.default_rng(seed)
    centres = r.standard_normal((60, d))
    kind = r.random(n)
    own = np.where(kind < 0.33, 0, r.integers(0, 60, n))
    x = centres[own] + r.standard_normal((n, d)) * spread * np.where(r.random((n, 1)) < 0.5, 1, 2)
    x[kind > 0.66] = r.standard_normal(((kind > 0.66).sum(), d))
    x[5] = x[3]
    x[9] = x[3]
    return x.astype(np.float32)


def brute(x, threshold, excluded=()):
    u = x.astype(np.float64)
    u /= np.sqrt((u**2).sum(axis=1, keepdims=True))
    c = u @ u.T
    label = least_connected(len(x), iter([np.nonzero(c >= threshold)]))
    out = set()
    for root in np.unique(label):
        own = np.flatnonzero(label == root)
        free = [i for i in own if i not in excluded] or own
        rep = min(free)
        kept = [i for i in own if i == rep or c[i, rep] >= threshold]
        if len(kept) > 1:
            out |= {(int(i), int(rep), len(kept)) for i in kept}
    return out


def rows(frame):
    return {(r["key"], r["rep"], r["size"]) for r in frame.collect()}


@pytest.fixture(scope="module")
def table(spark):
    x = planted()
    more = [(900, None, "x"), (901, [], "x"), (902, [0.0] * 32, "x"), (903, [float("nan")] + [1.0] * 31, "x"), (None, [1.0] * 32, "x"), (904, [None] + [1.0] * 31, "x"), (905, [1.0, 2.0], "x")]
    return x, spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)] + more, SCHEMA).repartition(5)


@pytest.mark.parametrize("threshold", [0.75, 0.9])
def test_exact_in_blocks(table, monkeypatch, threshold):
    x, frame = table
    monkeypatch.setattr(vectors, "BLOCK", 96)
    monkeypatch.setattr(vectors, "LEADERS", 3)
    assert rows(cosine_clusters(frame, threshold)) == brute(x, threshold)


def test_one_block_and_excluded(spark, table):
    x, frame = table
    out = {i for i in range(len(x)) if i % 3}
    assert rows(cosine_clusters(frame, 0.9, excluded=spark.createDataFrame([(i,) for i in out], "key long"))) == brute(x, 0.9, out)


def test_hyperplanes_find_the_links(table, monkeypatch):
    """Of the pairs that reach the threshold at least nine tenths are connected, and the clusters are nearly those of the exact mode."""
    x, frame = table
    monkeypatch.setattr(vectors, "BLOCK", 96)
    threshold = 0.85
    distinct, _ = distinct_vectors(double_vectors(frame, "vec_id", "embedding"))
    bits, bands = bands_for(len(x), threshold, 0.95)
    buckets = hyperplane_buckets(distinct, bits, bands, 5).distinct()
    shared = buckets.groupBy("bucket").count().where("count > 1").agg({"count": "max"}).first()[0]
    assert shared < len(x)  # candidates, not all pairs
    root = {r["node"]: r["root"] for r in bucket_components(distinct, buckets, threshold).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(u @ u.T >= threshold, 1))
    same = {5: 3, 9: 3}
    pairs = [(same.get(a, a), same.get(b, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    pairs = [(a, b) for a, b in pairs if a != b]
    met = sum(root.get(a, a) == root.get(b, b) for a, b in pairs)
    assert len(pairs) > 1000 and met >= 0.9 * len(pairs)
    got, want = rows(cosine_clusters(frame, threshold, mode="lsh")), brute(x, threshold)
    assert len({g[0] for g in got} & {w[0] for w in want}) >= 0.9 * len(want)


def test_plan_grows_more_selective():
    assert bands_for(10**3, 0.9, 0.95)[0] < bands_for(10**9, 0.9, 0.95)[0]
    assert bands_for(10**6, -0.99, 0.95) is None


def test_empty(spark):
    assert cosine_clusters(spark.createDataFrame([], SCHEMA), 0.9).count() == 0
    assert cosine_clusters(spark.createDataFrame([], SCHEMA), 0.9, mode="lsh").count() == 0


def test_copies_of_one_vector(spark):
    frame = spark.createDataFrame([(i, [1.0, 2.0, 3.0], "x") for i in range(50)] + [(1, [1.0, 2.0, 3.0], "x"), (70, [-1.0, 0.0, 0.0], "x")], SCHEMA)
    got = cosine_clusters(frame, 0.99).collect()
    assert {r["rep"] for r in got} == {0} and {r["size"] for r in got} == {51} and {r["cosine"] for r in got} == {1.0}


def brute_density(x, ids, radius, least, smallest):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) if len(x) <= 400 else np.array([np.sqrt(((x - row) ** 2).sum(axis=1)) for row in x])
    near = d <= radius
    core = near.sum(axis=1) >= least
    label = least_connected(len(x), iter([np.nonzero(near & core[:, None] & core[None])]))
    cluster, kind = np.full(len(x), -1), np.array(["noise"] * len(x), object)
    for i in range(len(x)):
        if core[i]:
            cluster[i], kind[i] = ids[label[i]], "core"
        elif (near[i] & core).any():
            own = np.flatnonzero(near[i] & core)
            best = min(own, key=lambda j: (d[i, j], ids[j]))
            cluster[i], kind[i] = ids[label[best]], "border"
    for c in np.unique(cluster):
        if c >= 0 and (cluster == c).sum() < smallest:
            kind[cluster == c], cluster[cluster == c] = "noise", -1
    return {(int(i), None if c < 0 else int(c), k) for i, c, k in zip(ids, cluster, kind, strict=True)}


@pytest.mark.parametrize(("n", "d", "radius", "block"), [(2000, 64, 3.0, 512), (300, 3, 0.6, 40), (300, 2, 0.25, 2048)])
def test_density_clusters(spark, monkeypatch, n, d, radius, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    r = np.random.default_rng(d)
    centres = r.standard_normal((25, d)) * 2
    own = np.where(r.random(n) < 0.3, 0, r.integers(0, 25, n))
    x = centres[own] + r.standard_normal((n, d)) * np.where(r.random((n, 1)) < 0.8, 0.25, 1.2)
    x[7] = x[3]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(n + 1, None), (n + 2, [float("inf")] * d)], "vec_id long, embedding array<double>").repartition(4)
    got = {(r["vec_id"], r["cluster"], r["kind"]) for r in vectors.density_clusters(frame, radius, 5, 3).collect()}
    want = brute_density(x, np.arange(n), radius, 5, 3) | {(n + 1, None, "noise"), (n + 2, None, "noise")}
    assert got == want and {k for _, _, k in got} == {"core", "border", "noise"} and len({c for _, c, _ in got}) > 3


def test_density_of_nothing(spark):
    assert vectors.density_clusters(spark.createDataFrame([], SCHEMA), 1.0).count() == 0


@pytest.mark.parametrize(("by_cells", "block"), [(True, 40), (False, 5)])
def test_density_clusters_by_cells_and_in_blocks(spark, monkeypatch, by_cells, block):
    """Both ways to look for neighbours find the same, and no table of their places is broadcast."""
    monkeypatch.setattr(vectors, "BLOCK", block)
    r = np.random.default_rng(4)
    x = (r.standard_normal((12, 6))[r.integers(0, 12, 250)] + r.standard_normal((250, 6)) * 0.25).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = vectors.density_clusters(frame, 0.7, 4, 3, by_cells=by_cells)
    assert {tuple(r) for r in got.select("vec_id", "cluster", "kind").collect()} == brute_density(x.astype(float), np.arange(250), 0.7, 4, 3)


@pytest.mark.parametrize(("scale", "shift"), [(1.0, 0.0), (1e-9, 0.0), (1e20, 0.0), (1.0, 1e6)])
def test_near_pairs_at_any_scale(scale, shift):
    r = np.random.default_rng(2)
    x, y = r.standard_normal((60, 8)) * scale + shift, r.standard_normal((90, 8)) * scale + shift
    y[5] = x[7]
    found = {(int(i), int(j)) for a, b in vectors.near_pairs(x, y, 2.5 * scale, 1000) for i, j in zip(a, b, strict=True)}
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(((x[:, None] - y[None]) ** 2).sum(axis=2) <= (2.5 * scale) ** 2), strict=True)}
    assert found == want and 0 < len(want) < 2000
