"""ML jobs: GMM blob recovery, DTW against a brute-force reference, forest smoke."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from faultlens.plans import clustering, dtw, forest


def _blobs(n=400, seed=0):
    rng = np.random.default_rng(seed)
    centres = np.array([[0, 0, 0], [10, 10, 10], [-10, 10, -10], [10, -10, 10]], float)
    lab = np.arange(n) % 4
    pts = centres[lab] + rng.normal(0, 0.6, size=(n, 3))
    return pts, lab


def test_gmm_recovers_blobs(spark):
    pts, lab = _blobs()
    df = spark.createDataFrame([(f"p{i}", *map(float, p), int(l)) for i, (p, l) in enumerate(zip(pts, lab))],
                               "nodename string, foo double, bar double, zoom double, truth int")
    out, _, _ = clustering.gmm(df, ["foo", "bar", "zoom"], k=4, seed=3)
    j = out.join(df.select("nodename", "truth"), "nodename")
    pairs = j.groupBy("cluster").agg(F.countDistinct("truth").alias("t")).collect()
    assert all(r["t"] == 1 for r in pairs) and len(pairs) == 4


def _dtw_ref(a, b):
    n, m = len(a), len(b)
    D = np.full((n + 1, m + 1), np.inf)
    D[0, 0] = 0
    for i, j in itertools.product(range(1, n + 1), range(1, m + 1)):
        D[i, j] = np.sum((a[i - 1] - b[j - 1]) ** 2) + min(D[i - 1, j], D[i, j - 1], D[i - 1, j - 1])
    return np.sqrt(D[n, m])


def test_dtw_distance_and_path():
    rng = np.random.default_rng(1)
    for _ in range(5):
        a, b = rng.normal(size=(7, 2)), rng.normal(size=(9, 2))
        assert abs(dtw.dtw_distance(a, b) - _dtw_ref(a, b)) < 1e-9
        path = dtw.dtw_path(a, b)
        assert path[0] == (0, 0) and path[-1] == (6, 8)
        cost = np.sqrt(sum(np.sum((a[i] - b[j]) ** 2) for i, j in path))
        assert abs(cost - _dtw_ref(a, b)) < 1e-9


def test_dtw_kmeans_separates_shapes(spark):
    t = np.linspace(0, 2 * np.pi, 20)
    rows = []
    for i in range(6):
        base = np.sin(t) if i < 3 else np.cos(3 * t)
        s = np.stack([base + 0.01 * i, base * 0.5], axis=1)
        rows.append((f"N{i}", s.tolist()))
    df = spark.createDataFrame(rows, "node string, series array<array<double>>")
    assign, cents = dtw.dtw_kmeans(df, 2, max_iter=3, max_iter_barycenter=2, seed=1)
    got = {r["node"]: r["cluster"] for r in assign.collect()}
    assert len({got[f"N{i}"] for i in range(3)}) == 1 and len({got[f"N{i}"] for i in range(3, 6)}) == 1
    assert got["N0"] != got["N5"]
    near = dtw.nearest_nodes(df, cents).collect()
    assert len(near) == 2


def test_forest_learns_separable_data(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):
        y = i % 3
        rows.append((f"N{i % 4}", i, float(y * 5 + rng.normal()), float(rng.normal()), y))
    df = spark.createDataFrame(rows, "node string, pos long, a double, b double, label int")
    m = forest.fit(df, ["a", "b"], num_trees=10, max_depth=5)
    p = forest.predict(m, df, ["a", "b"])
    acc = p.select(F.avg((F.col("y") == F.col("pred")).cast("double"))).first()[0]
    assert acc > 0.95
