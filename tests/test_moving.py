"""The moving-window engine against pandas, whatever the window, batch and chunk."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from faultlens.constants import PERCENTILES, STATS_11
from faultlens.operators import features, moving


def windows(sizes, w, step=1):
    first = np.concatenate([np.full(n, a) for n, a in zip(sizes, np.cumsum([0, *sizes]))])
    pos = np.concatenate([np.arange(1, n + 1) for n in sizes])
    return moving.Windows(first, pos, w, (pos - w) % step == 0)


def rolled(x, sizes, w):
    """pandas' rolling objects of each group."""
    parts = np.split(x, np.cumsum(sizes)[:-1])
    return [pd.Series(p).rolling(w, min_periods=1) for p in parts if len(p)]


def joined(parts, sizes, w):
    return np.concatenate([np.asarray(p)[w - 1:] for p in parts])


@pytest.mark.parametrize("w", [1, 2, 7, 40, 200])
@pytest.mark.parametrize("holes", [0.0, 0.2])
def test_statistics_against_pandas(w, holes):
    rng = np.random.default_rng(w)
    sizes = [500, 3, 39, 40, 200, 650, 1]
    x = rng.normal(size=sum(sizes)) * 10
    y = 0.5 * x + rng.normal(size=len(x))
    x[100:100 + w] = 4.0  # a constant window
    if holes:
        x[rng.random(len(x)) < holes] = np.nan
        x[300:300 + w + 3] = np.nan  # a window without values
    at = windows(sizes, w)
    c, d = moving.Column(x, at), moving.Column(y, at)
    r = rolled(x, sizes, w)
    assert np.allclose(c.mean(), joined([q.mean() for q in r], sizes, w), equal_nan=True)
    assert np.allclose(c.std(), joined([q.std() for q in r], sizes, w), equal_nan=True, atol=1e-6)
    assert np.allclose(c.extreme(np.fmin), joined([q.min() for q in r], sizes, w), equal_nan=True)
    assert np.allclose(c.extreme(np.fmax), joined([q.max() for q in r], sizes, w), equal_nan=True)
    for f, got in zip(PERCENTILES.values(), c.percentiles(list(PERCENTILES.values()))):
        assert np.allclose(got, joined([q.quantile(f) for q in r], sizes, w), equal_nan=True)
    if w > 1:
        parts, other = np.split(x, np.cumsum(sizes)[:-1]), np.split(y, np.cumsum(sizes)[:-1])
        want = np.concatenate([pd.Series(a).rolling(w).corr(pd.Series(b)).to_numpy()[w - 1:] for a, b in zip(parts, other)])
        got = c.correlation(d)
        constant = c.std() < 1e-12
        assert np.allclose(np.where(constant, 0, got), np.where(constant, 0, np.nan_to_num(want)), atol=1e-6) and (got[constant] == 0).all()


@pytest.mark.parametrize("w", [10, 300])
def test_precision_beside_huge_values(w):
    rng = np.random.default_rng(0)
    x = 1e9 + rng.normal(size=4000) * 1e-3
    x[1500] = 1e15
    at = windows([4000], w)
    c = moving.Column(x, at)
    clean = (at.ends < 1500) | (at.starts > 1500)
    views = np.lib.stride_tricks.sliding_window_view(x, w)[clean]
    centred = views - 1e9
    assert np.abs(c.mean()[clean] - 1e9 - centred.mean(1)).max() < 1e-6
    assert np.allclose(c.std()[clean], centred.std(1, ddof=1), rtol=1e-3)


def test_wide_windows_use_order_statistics_of_ranks():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 50, 3000).astype(float)
    tree = moving.WaveletMatrix(x)
    lo = rng.integers(0, 2900, 400)
    hi = lo + rng.integers(1, 100, 400)
    k = (rng.random(400) * (hi - lo)).astype(int)
    assert [sorted(x[a:b])[i] for a, b, i in zip(lo, hi, k)] == tree.kth(lo, hi, k).tolist()


@pytest.mark.parametrize("labels", [5, 400])
@pytest.mark.parametrize("step", [1, 13])
def test_mode_and_last_label(labels, step):
    rng = np.random.default_rng(labels)
    sizes = [700, 8, 900]
    x = rng.integers(0, labels, sum(sizes)).astype(float) // 3
    x[rng.random(len(x)) < 0.2] = np.nan
    x[200:230] = np.nan
    at = windows(sizes, 9, step)
    mode, last = moving.mode_labels(x, at), moving.last_labels(x, at)
    for k, (a, b) in enumerate(zip(at.starts, at.ends + 1)):
        seen = pd.Series(x[a:b]).dropna()
        assert mode[k] == seen.mode().min() if len(seen) else np.isnan(mode[k])
        live = seen[seen != 0]
        assert last[k] == (live.iloc[-1] if len(live) else 0)


def test_batches_of_any_size_give_the_same_rows(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(n, i + 1, None if rng.random() < 0.1 else float(rng.normal()), float(rng.normal()), int(rng.integers(0, 4)))
            for n, size in ((None, 70), ("a", 33), ("b", 5), ("c", 150)) for i in range(size)]
    df = spark.createDataFrame(rows, "node string, pos long, x double, y double, label int").repartition(3)
    kw = dict(w=6, step=2, numfeatures=11, label="label", corr=True)
    want = sorted(features.window_features(df, ["x", "y"], **kw).collect(), key=str)
    assert len(want) == sum((n - 6) // 2 + 1 for n in (70, 33, 150))
    assert sorted(features.window_features(df, ["x", "y"], chunk_rows=8, **kw).collect(), key=str) == want
    monkeypatch.setattr(moving, "ROWS", 10)
    assert sorted(features.window_features(df, ["x", "y"], **kw).collect(), key=str) == want
    assert sum(r.node is None for r in want) == 33
    assert features.window_features(df.limit(0), ["x", "y"], **kw).collect() == []


def test_cost_of_a_row_does_not_grow_with_the_window():
    import time

    x = np.random.default_rng(3).normal(size=40_000)
    took = {}
    for w in (150, 3600):
        t = time.process_time()
        at = windows([len(x)], w)
        c = moving.Column(x, at)
        c.mean(), c.std(), c.percentiles(list(PERCENTILES.values())), moving.mode_labels(np.floor(x), at)
        took[w] = time.process_time() - t
    assert took[3600] < 3 * took[150] + 0.5


def test_rounding_in_the_engine_is_that_of_the_expression(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=300) * 100
    a[:40] = np.arange(40) / 8 - 2.49995  # on and beside half-way values
    a[100], a[101], a[200] = 1e300, -1e300, -0.0
    rows = [(i % 3, i // 3 + 1, None if i % 11 == 0 else float(x), float(i % 7)) for i, x in enumerate(a)]
    df = spark.createDataFrame(rows, "node int, pos long, a double, b double")
    plain = features.window_features(df, ["a", "b"], w=5, corr=True)
    names = [c for c in plain.columns if c not in ("node", "pos", "window_id")]
    want = sorted(plain.withColumns({c: features.quantize(F.col(c), 4) for c in names}).collect(), key=lambda r: (r.node, r.pos))
    got = features.window_features(df, ["a", "b"], w=5, corr=True, digits=4)
    assert sorted(got.collect(), key=lambda r: (r.node, r.pos)) == want
    native = features.window_features(df.where("abs(a) < 1e6 OR a IS NULL"), ["a", "b"], w=5, corr=True, digits=4, engine="native")
    plain = features.window_features(df.where("abs(a) < 1e6 OR a IS NULL"), ["a", "b"], w=5, corr=True, engine="native")
    want = sorted(plain.withColumns({c: features.quantize(F.col(c), 4) for c in names}).collect(), key=lambda r: (r.node, r.pos))
    assert sorted(native.collect(), key=lambda r: (r.node, r.pos)) == want


@pytest.mark.parametrize("name", ["w11_feature_vectors_big", "w11_feature_vectors_big_pandas"])
def test_window_tasks_stay_apart_and_rounding_is_theirs(spark, tmp_path, name):
    from faultlens.queries import QUERIES

    rows = spark.range(600).selectExpr(
        "id % 4 AS l_suppkey", "id AS l_orderkey", "id AS l_partkey", "CAST(id % 5 + 1 AS int) AS l_linenumber", "timestamp_seconds(id) AS l_shipdate",
        *(f"CAST(id * 7 % {k} AS double) / 3 AS {c}" for k, c in ((50, "l_quantity"), (97, "l_extendedprice"), (11, "l_discount"), (9, "l_tax"))))
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    made = QUERIES[name](spark, str(tmp_path))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "floor" not in plan[:plan.index("MapInArrow")].lower()
    assert made.count() == 4 * (150 - 59)
    assert made.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))  # a few kB, and not put together
