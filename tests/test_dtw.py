"""Alignment in linear space, lower bounds and blocks against plain tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultlens.plans import dtw


def plain(a, b):
    D = np.full((len(a) + 1, len(b) + 1), np.inf)
    D[0, 0] = 0
    for i in range(len(a)):
        for j in range(len(b)):
            D[i + 1, j + 1] = ((a[i] - b[j]) ** 2).sum() + min(D[i, j], D[i, j + 1], D[i + 1, j])
    return float(np.sqrt(D[-1, -1]))


def walks(n, seed, long=40):
    rng = np.random.default_rng(seed)
    return [rng.normal(size=(int(rng.integers(1, long)), 2)).cumsum(0) * rng.choice([0.2, 1, 5]) + rng.normal() * 3 for _ in range(n)]


@pytest.mark.parametrize("cells", [1, 6, 50])
def test_linear_space_path_is_optimal(cells):
    """However small the kept tables are, the path is a path, costs the least, and
    is the table's own where that is the only best one."""
    xs = walks(24, 1)
    for a, b in zip(xs[::2], xs[1::2]):
        path = dtw.dtw_path(a, b, cells)
        assert path[0] == (0, 0) and path[-1] == (len(a) - 1, len(b) - 1)
        steps = {(i1 - i0, j1 - j0) for (i0, j0), (i1, j1) in zip(path, path[1:])}
        assert steps <= {(0, 1), (1, 0), (1, 1)}
        assert np.sqrt(sum(((a[i] - b[j]) ** 2).sum() for i, j in path)) == pytest.approx(plain(a, b))
        assert path == dtw._table_path(a, b)


def test_long_series_align_without_a_table():
    rng = np.random.default_rng(2)
    a = np.sin(np.linspace(0, 60, 9000))[:, None] + 0.01 * rng.normal(size=(9000, 1))
    b = np.sin(np.linspace(0, 60, 7000) ** 1.01)[:, None]
    import tracemalloc

    tracemalloc.start()
    path = dtw.dtw_path(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6  # a table of directions alone has 63e6 cells
    assert np.sqrt(sum(((a[i] - b[j]) ** 2).sum() for i, j in path)) == pytest.approx(dtw.dtw_distance(a, b))


def test_lower_bound_and_early_abandoning():
    xs = walks(40, 3)
    for a, b in zip(xs[::2], xs[1::2]):
        true = plain(a, b)
        assert dtw.lower_bound(a, b) <= true + 1e-9
        A, la = dtw._pad([a, a, a])
        got = dtw._dtw_batch(A, la, np.stack([b, b, b]), np.full(3, len(b)), np.array([true * 1.01 + 1e-9, true, np.inf]))
        assert np.allclose(got, true)
        assert dtw._dtw_batch(A[:1], la[:1], b[None], np.array([len(b)]), np.array([true * 0.1]))[0] >= true - 1e-9


def stored(spark, xs, block):
    rows = [(f"N{k:02d}", b, x[b * block:(b + 1) * block].tolist()) for k, x in enumerate(xs) for b in range(-(-len(x) // block))]
    return spark.createDataFrame(rows, "node string, block long, series array<array<double>>").repartition(5)


def test_nearest_nodes_over_blocks(spark):
    xs = walks(30, 4)
    cents = [xs[3] + 0.01, xs[17][::-1], walks(1, 9)[0]]
    want = []
    for k, c in enumerate(cents):
        d, name = min((plain(x, c), f"N{i:02d}") for i, x in enumerate(xs))
        want.append((k, name, pytest.approx(d)))
    for block in (7, 1000):
        got = dtw.nearest_nodes(stored(spark, xs, block), cents, counts=True).orderBy("centroid").collect()
        assert [(r.centroid, r.node, r.dtw) for r in got] == want
        assert all(r.tried == 30 for r in got)
        assert sum(r.ruled_out for r in got) / 90 > 0.25  # share of pairs that no table was walked for
    assert dtw.nearest_nodes(stored(spark, xs, 7).limit(0), cents).collect() == []


def test_assignments_do_not_depend_on_blocks(spark):
    xs = walks(12, 5)
    one, cents = dtw.dtw_kmeans(stored(spark, xs, 1000), 3, max_iter=2, max_iter_barycenter=1)
    two, again = dtw.dtw_kmeans(stored(spark, xs, 6), 3, max_iter=2, max_iter_barycenter=1)
    assert all(np.allclose(a, b) for a, b in zip(cents, again))
    a, b = ({r.node: (r.cluster, round(r.dtw, 9)) for r in t.collect()} for t in (one, two))
    assert a == b and len(a) == 12
    for k, x in enumerate(xs):
        assert a[f"N{k:02d}"][1] == pytest.approx(min(plain(x, c) for c in cents))


def test_node_series_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(dtw, "BLOCK", 4)
    df = spark.range(22).select(F.lit("a").alias("node"), (F.col("id") + 1).alias("pos"), F.sin(F.col("id")).alias("x"))
    s = dtw.node_series(df, ["x"], start=3, length=18, scale=False).orderBy("block").collect()
    assert [len(r.series) for r in s] == [4, 4, 4, 4, 2]
    assert np.allclose([v[0] for r in s for v in r.series], np.sin(np.arange(2, 20)))


def test_tables_walked_together_give_each_path_alone():
    rng = np.random.default_rng(4)
    for n, longest in ((30, 50), (1, 4), (6, 1), (5, 9)):
        c = rng.normal(size=(n, 2)).round()  # many ties
        series = [rng.normal(size=(int(rng.integers(1, longest + 1)), 2)).round() for _ in range(20)]
        for x, path in zip(series, dtw._table_paths(c, series)):
            assert [tuple(p) for p in path.tolist()] == dtw._table_path(c, x)
