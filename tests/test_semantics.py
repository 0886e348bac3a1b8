"""Cases that a plausible implementation gets wrong: holes, ties, absent
classes, wide ids, large groups and long series."""

import json
import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from faultlens.functions.scalar import truncate_decimals
from faultlens.operators import align, features, metrics, profile
from faultlens.operators.positions import add_positions
from faultlens.plans import dtw
from faultlens.sources import telemetry as tv
from faultlens.sources.featurelist import FeatureReader


def test_ids_beyond_five_digits_stay_apart(spark, tmp_path):
    rows = [(1, 1, 7, "click", 1.0, json.dumps({"k": 3})), (2, 2, 100000, "click", 2.0, "{}"), (3, 3, 100001, "view", 3.0, '{"k": "x"}')]
    spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double, props string").select(
        "event_id", F.timestamp_seconds("s").alias("ts"), "user_id", "event_type", "value", "props").write.parquet(f"{tmp_path}/events.parquet")
    paths = tv.sensor_paths(spark, str(tmp_path))
    assert {r.path for r in paths.collect()} == {"/site/rack/chassis/n00007/click", "/site/rack/chassis/n100000/click", "/site/rack/chassis/n100001/view"}
    got = align.sensors_of_nodes(paths, tv.node_list(spark, str(tmp_path)))
    assert [r.path for r in got.collect()] == ["/site/rack/chassis/n100000/click"]
    assert {r.event_id: r.fault for r in tv.readings(spark, str(tmp_path)).collect()} == {1: 3, 2: None, 3: None}


def test_counter_holes_are_filled_from_the_next_difference(spark):
    values = [None, None, None, None, 5.0, 7.0, None, 12.0, 12.0]
    df = spark.createDataFrame([("N1", "c", i, v) for i, v in enumerate(values)], "node string, metric string, ts int, value double")
    out = align.delta_encode_counters(df).orderBy("ts").collect()
    assert [r.value for r in out] == [2.0] * 6 + [0.0] * 3


def test_feature_list_drops_the_first_line_by_position(spark, tmp_path):
    p = os.path.join(tmp_path, "list.txt")
    with open(p, "w") as f:
        f.write("---- header\n---- a\nb\n---- c: 0.5\n")
    assert FeatureReader(spark, p, "ranked").get_features() == ["a", "b", "c"]


@pytest.fixture(scope="module")
def holes(spark):
    rng = np.random.default_rng(0)
    rows = [(n, i + 1, None if rng.random() < 0.1 and n else float(rng.normal()), None if rng.random() < 0.05 and n else float(rng.normal()), int(rng.integers(0, 3)))
            for n in range(3) for i in range(60)]
    return spark.createDataFrame(rows, "node int, pos long, a double, b double, label int")


def test_both_window_engines_agree_on_holes(holes):
    kw = dict(metrics=["a", "b"], w=6, stats=["mean", "last", "min"], corr=True, label="label")
    native = features.window_features(holes, chunk_rows=16, **kw).orderBy("node", "pos").toPandas()
    kernel = features.window_features(holes, engine="moving", **kw).orderBy("node", "pos").toPandas()
    assert (native.corr_a_b.abs() <= 1 + 1e-12).all() and (native.corr_a_b == 0).sum() > 5
    for c in native.columns:
        assert np.allclose(native[c].astype(float), kernel[c].astype(float), equal_nan=True), c
    pdf = holes.toPandas().sort_values(["node", "pos"])
    want = pdf.groupby("node").apply(lambda g: g.a.rolling(6).corr(g.b).iloc[5:].fillna(0.0)).to_numpy().ravel()
    assert np.allclose(native.corr_a_b, want)


def test_correlation_matrix_uses_complete_pairs(holes):
    pdf = holes.toPandas()
    got = {(r.a, r.b): r["corr"] for r in profile.correlation_matrix(holes, ["a", "b"]).collect()}
    assert math.isclose(got["a", "b"], pdf.a.corr(pdf.b), rel_tol=1e-9)


def test_scaling_keeps_missing_values(spark):
    df = spark.createDataFrame([("N1", 1.0, 5.0), ("N1", None, 5.0), ("N1", 3.0, 5.0)], "node string, x double, c double")
    assert sorted((r.x is None, r.x, r.c) for r in features.minmax_scale(df, ["x", "c"]).collect()) == [(False, 0.0, 0.0), (False, 1.0, 0.0), (True, None, 0.0)]
    assert sorted((r.x is None, r.x) for r in features.zscore_scale(df, ["x"]).collect()) == [(False, -1.0), (False, 1.0), (True, None)]


def test_truncation_cuts_the_printed_number(spark):
    df = spark.createDataFrame([(x,) for x in (0.29, 0.57, 0.58, 0.999, 1.0, 0.005, -0.29, 12.345)], "x double")
    assert [r[0] for r in df.select(truncate_decimals("x")).collect()] == [0.29, 0.57, 0.58, 0.99, 1.0, 0.0, -0.29, 12.34]


def test_absent_classes_have_only_true_negatives(spark):
    df = spark.createDataFrame([("N1", 0, 0), ("N1", 1, 0)], "node string, y int, pred int")
    got = {(r.metric, r.cls): r.score for r in metrics.scores(df, ["node"], metrics=["specificity", "fp_rate"], labels=[0, 1, 5]).collect()}
    assert got["specificity", "5"] == 1.0 and got["fp_rate", "5"] == 0.0


def test_positions_of_large_groups_with_ties_and_null_keys(spark):
    rows = [("hot", 1, i) for i in range(700)] + [("cold", 2, i) for i in range(5)] + [(None, 1, i) for i in range(300)]
    df = spark.createDataFrame(rows, "node string, day int, id int").repartition(7)
    split = add_positions(df, "node", ["day", "id"], max_group_rows=50).collect()
    assert {(r.node, r.id, r.pos) for r in split} == {(n, i, i + 1) for n, _, i in rows} and len(split) == len(rows)


def test_fills_carry_over_chunks(spark):
    rng = np.random.default_rng(2)
    rows = [(n, p + 1, None if rng.random() < 0.8 else float(rng.integers(0, 9)), None if rng.random() < 0.9 else int(rng.integers(0, 4))) for n in ("a", None) for p in range(60)]
    df = spark.createDataFrame(rows, "node string, pos long, x double, s int")
    whole, cut = (align.fill_table(df, steps=["s"], lines=["x"], chunk_rows=c).orderBy("node", "pos").collect() for c in (1000, 4))
    assert whole == cut and len(cut) == 120
    pdf = pd.DataFrame(rows, columns=["node", "pos", "x", "s"])
    a = pdf[pdf.node == "a"]
    assert np.allclose([r.x for r in cut if r.node], a.x.astype(float).interpolate().bfill())
    assert [r.s for r in cut if r.node] == a.s.ffill().bfill().astype(int).tolist()


def test_first_difference_crosses_chunks(spark):
    df = spark.createDataFrame([("N", "m", i, float(i * i)) for i in range(20)], "node string, metric string, ts int, value double")
    got = align.first_difference(df, "value", chunk_rows=3).orderBy("ts").collect()
    assert [r.value for r in got] == [None] + [float(2 * i - 1) for i in range(1, 20)]


def test_alignment_keeps_null_keys_in_one_row(spark):
    df = spark.createDataFrame([(None, 1, "a", 1.0, 3), (None, 1, "b", 2.0, 4)], "node string, ts int, metric string, value double, f int")
    got = align.pivot_metrics(df, ["a", "b"], extra_aggs=[F.max("f").alias("f")]).collect()
    assert [tuple(r) for r in got] == [(None, 1, 1.0, 2.0, 4)]


def test_regular_grid_is_built_in_blocks(spark):
    df = spark.createDataFrame([("N", 0, 1.0), ("N", 70, 2.0), ("M", 5, 3.0)], "node string, s long, v double").select(
        "node", F.timestamp_seconds("s").alias("ts"), "v")
    got = align.regular_grid(df, 10, block=3).select("node", F.unix_seconds("ts").alias("s"), "v").orderBy("node", "s").collect()
    assert [(r.node, r.s, r.v) for r in got] == [("M", 5, 3.0)] + [("N", 10 * i, {0: 1.0, 7: 2.0}.get(i)) for i in range(8)]


def plain_dtw(a, b):
    D = np.full((len(a) + 1, len(b) + 1), np.inf)
    D[0, 0] = 0
    for i in range(len(a)):
        for j in range(len(b)):
            D[i + 1, j + 1] = ((a[i] - b[j]) ** 2).sum() + min(D[i, j], D[i, j + 1], D[i + 1, j])
    return math.sqrt(D[-1, -1])


def test_dtw_equals_the_full_table():
    rng = np.random.default_rng(3)
    series = [rng.normal(size=(int(rng.integers(1, 15)), 2)) for _ in range(12)]
    A, la = dtw._pad(series)
    c = rng.normal(size=(9, 2))
    got = dtw._dtw_batch(A, la, np.broadcast_to(c, (12, 9, 2)), np.full(12, 9))
    for s, g in zip(series, got):
        assert math.isclose(g, plain_dtw(s, c))
        path = dtw.dtw_path(s, c)
        assert path[0] == (0, 0) and path[-1] == (len(s) - 1, 8)
        assert math.isclose(math.sqrt(sum(((s[i] - c[j]) ** 2).sum() for i, j in path)), g)


def test_dtw_of_long_series_stays_small():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(1, 7200, 2))
    assert np.isfinite(dtw._dtw_batch(a, np.array([7200]), a[:, :5000], np.array([5000]))).all()


def test_user_aggregates_share_the_frame(holes):
    """Any window aggregate, also a pandas one, goes through ``extra``."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def spread(v: pd.Series) -> float:
        return float(v.max() - v.min())

    out = features.window_features(holes, ["a"], w=6, stats=["min", "max"], extra=[F.count("a"), spread("a")])
    pdf = out.toPandas()
    assert np.allclose(pdf.iloc[:, -1], pdf.max_a - pdf.min_a) and pdf.iloc[:, -2].between(0, 6).all()


def test_node_pca_separates_planted_directions(spark):
    from faultlens.plans.clustering import pca_node_means
    rng = np.random.default_rng(5)
    rows = []
    for n in ("A", "B"):
        for _ in range(200):
            t, e = rng.normal(), rng.normal(scale=0.05, size=3)
            x = (t + e[0], t + e[1], e[2]) if n == "A" else (e[0], t + e[1], -t + e[2])
            rows.append((n, *map(float, x), int(t > 0)))
    df = spark.createDataFrame(rows, "node string, x double, y double, z double, fault int")
    got = {r.node: r for r in pca_node_means(df, ["x", "y", "z"], faults=[1], k=2).collect()}
    for n, cols in (("A", "xyz"), ("B", "xyz")):
        own = np.array([r[1:4] for r in rows if r[0] == n])
        z = (own - own.mean(0)) / own.std(0)
        _, v = np.linalg.eigh(np.cov(z.T, bias=True))
        top = v[:, ::-1][:, :2].T
        top = top * np.sign(top[np.arange(2), np.abs(top).argmax(1)])[:, None]
        want = top @ z[np.array([r[4] for r in rows if r[0] == n]) == 1].mean(0)
        assert np.allclose([got[n].pc1, got[n].pc2], want)


def plain_spline(x, y, at):
    """Natural cubic spline by one dense solve."""
    n = len(x)
    A, r = np.eye(n), np.zeros(n)
    for i in range(1, n - 1):
        a, b = x[i] - x[i - 1], x[i + 1] - x[i]
        A[i, i - 1:i + 2] = a, 2 * (a + b), b
        r[i] = 6 * ((y[i + 1] - y[i]) / b - (y[i] - y[i - 1]) / a)
    m = np.linalg.solve(A, r)
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    h = x[k + 1] - x[k]
    s, t = (x[k + 1] - at) / h, (at - x[k]) / h
    return s * y[k] + t * y[k + 1] + ((s**3 - s) * m[k] + (t**3 - t) * m[k + 1]) * h * h / 6


@pytest.mark.parametrize("points", [130, 10**9])
def test_spline_equals_one_solve_across_chunks(spark, points):
    """Chunks of 130 known points with 64 of each neighbour give the curve of one system."""
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for node, n in (("a", 1500), (None, 300)):
        y = np.cumsum(rng.normal(size=n)) * 100
        known = rng.random(n) < rng.choice([0.1, 0.9], n)
        known[[3, n - 6]] = True
        known[:3] = known[n - 5:] = False
        x = np.arange(1, n + 1, dtype=float)
        rows += [(node, i + 1, float(y[i]) if known[i] else None) for i in range(n)]
        inner = plain_spline(x[known], y[known], x)
        want[node] = np.where(x < 4, y[3], np.where(x > n - 5, y[n - 6], inner))
    rows += [("one", 1, None), ("one", 2, 5.0), ("one", 3, None), ("none", 1, None), ("two", 1, 0.0), ("two", 2, None), ("two", 4, 3.0)]
    df = spark.createDataFrame(rows, "node string, pos long, x double").repartition(4)
    got = {}
    for r in align.fill_cubic(df, ["x"], chunk_points=points, chunk_rows=200).orderBy("pos").collect():
        got.setdefault(r.node, []).append(r.x)
    for node, w in want.items():
        assert np.allclose(got[node], w, rtol=1e-9, atol=1e-7)
    assert got["one"] == [5.0, 5.0, 5.0] and got["none"] == [None] and np.allclose(got["two"], [0, 1, 3])


def test_nearest_known_value_and_method_names(spark):
    df = spark.createDataFrame([("a", i + 1, v) for i, v in enumerate([None, 1.0, None, None, None, 9.0, None])], "node string, pos long, x double")
    assert [r.x for r in align.interpolate(df, ["x"], "nearest").orderBy("pos").collect()] == [1.0, 1.0, 1.0, 1.0, 9.0, 9.0, 9.0]
    assert align.interpolate(df, ["x"], "spline", order=1).exceptAll(align.fill_linear(df, ["x"])).count() == 0
    with pytest.raises(ValueError):
        align.interpolate(df, ["x"], "spline", order=7)
