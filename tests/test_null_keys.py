"""Rows of a NULL node or label stay, and count as a node or label of their own."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultlens.operators import align, features, metrics, profile, sampling
from faultlens.operators.keys import join_same
from faultlens.operators.positions import ranked, running_totals


@pytest.fixture(scope="module")
def twenty(spark):
    """Two nodes of ten rows, one without a name; every fifth label is missing."""
    rows = [(n, i + 1, float(i * i), None if i % 5 == 4 else i % 2) for n in ("a", None) for i in range(10)]
    return spark.createDataFrame(rows, "node string, pos long, x double, label int").cache()


def by_node(df, col):
    return {r.node: r.v for r in df.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("pos", col)))[col].alias("v")).collect()}


def test_splits_folds_and_halves(twenty):
    split = by_node(sampling.positional_split(twenty), "split")
    assert split[None] == split["a"] == ["train"] * 6 + ["test"] * 4
    for fold in (sampling.kfold(twenty, 3), sampling.stratified_kfold(twenty, 3)):
        got = by_node(fold, "fold")
        assert got[None] == got["a"] and len(got["a"]) == 10
    assert sampling.kfold(twenty, 3, shuffle=True).count() == 20
    half = by_node(profile.with_halves(twenty), "half")
    assert half[None] == half["a"] == [1] * 5 + [2] * 5
    means = {r.nodename: r.x for r in profile.filtered_half_means(twenty, ["x"], faults=None).collect()}
    assert len(means) == 4 or None in means


def test_scalers_use_the_nodes_own_statistics(twenty):
    shifted = twenty.withColumn("x", F.when(F.col("node").isNull(), F.col("x") * 3 + 7).otherwise(F.col("x")))
    for scale in (features.zscore_scale, features.minmax_scale):
        got = by_node(scale(shifted, ["x"]), "x")
        assert np.allclose(got[None], got["a"]) and max(got["a"]) > 0.9


def test_confusion_and_scores(spark):
    rows = [(n, y, p) for n in ("a", None) for y, p in [(0, 0), (0, 1), (1, 1), (1, 1), (2, 0)]]
    df = spark.createDataFrame(rows, "node string, y int, pred int")
    got = {}
    for r in metrics.confusion(df).collect():
        got.setdefault(r.node, set()).add((r.cls, r.tp, r.fp, r.fn, r.tn))
    assert got[None] == got["a"] == {(0, 1, 1, 1, 2), (1, 2, 1, 0, 2), (2, 0, 0, 1, 4)}
    for labels in (None, [0, 1, 2, 3]):
        s = {}
        for r in metrics.scores(df, labels=labels).collect():
            s.setdefault(r.node, {})[r.metric, r.cls] = r.score
        assert s[None] == s["a"] and len(s["a"]) == 5 * ((4 if labels else 3) + 1)


def test_grid_keeps_values_and_counters_are_encoded(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(n, t0 + dt.timedelta(seconds=s), float(s)) for n in ("a", None) for s in (0, 2, 3, 4, 8)]
    df = spark.createDataFrame(rows, "node string, ts timestamp, x double")
    got = {}
    for r in align.regular_grid(df, 2).orderBy("ts").collect():
        got.setdefault(r.node, []).append(r.x)
    assert got[None] == got["a"] == [0.0, 2.0, 4.0, None, 8.0]
    series = spark.createDataFrame([(n, m, i, v) for n in ("a", None) for m in ("c", None) for i, v in enumerate([1.0, 4.0, 9.0])],
                                   "node string, metric string, ts int, value double")
    out = {}
    for r in align.delta_encode_counters(series).orderBy("ts").collect():
        out.setdefault((r.node, r.metric), []).append(r.value)
    assert out["a", "c"] == out[None, "c"] == [3.0, 3.0, 5.0] and len(out) == 4


def test_counters_of_an_unnamed_metric(spark):
    series = spark.createDataFrame([("a", None, i, v) for i, v in enumerate([1.0, 4.0, 9.0])], "node string, metric string, ts int, value double")
    assert [r.value for r in align.delta_encode_counters(series).orderBy("ts").collect()] == [3.0, 3.0, 5.0]


def test_join_same_keeps_columns_and_sides(spark):
    a = spark.createDataFrame([(1, None, "x"), (None, 2, "y"), (3, 3, "z")], "k int, l int, v string")
    b = spark.createDataFrame([(1, None, 10), (None, 2, 20), (4, 4, 30)], "k int, l int, w int")
    assert sorted(map(tuple, join_same(a, b, ["k", "l"]).collect()), key=repr) == [(1, None, "x", 10), (None, 2, "y", 20)]
    assert join_same(a, b, ["k", "l"], "left").count() == 3 and join_same(a, b, ["k", "l"], "left_anti").collect() == [(3, 3, "z")]


def test_ranks_and_totals_without_one_task(spark):
    rng = np.random.default_rng(0)
    values = rng.permutation(5000)
    df = spark.createDataFrame([(int(v), int(v) % 7) for v in values], "k int, n int").repartition(6)
    assert {r.k: r.pos for r in ranked(df, [F.desc("k")]).collect()} == {k: 5000 - k for k in range(5000)}
    before = np.concatenate([[0], np.cumsum(np.arange(5000) % 7)])
    assert all(before[r.k] == r.t for r in running_totals(df, ["k"], "n", "t").collect())
    assert ranked(df.limit(0), ["k"]).collect() == []


def test_collections_of_runs(spark):
    from faultlens.operators import runs_of

    rows = [("a", 0, 20, 1.0), ("a", 0, 21, 3.0), ("a", None, 20, 9.0), ("b", 1, 20, 5.0), (None, 0, None, 7.0)]
    df = spark.createDataFrame(rows, "node string, fault int, app int, value double").withColumn("collection", F.lit("old"))
    runs = runs_of.gather(df, {"healthy": {"faults": [0]}, "kripke a": {"apps": [20], "nodes": ["a"]}, "every": {}, "none": {"faults": [7]}},
                          extend=lambda t: t.withColumn("twice", F.col("value") * 2))
    assert {(r.collection, r.node, r.n) for r in runs.nodes().collect()} == {
        ("healthy", "a", 2), ("healthy", None, 1), ("kripke a", "a", 2), ("every", "a", 3), ("every", "b", 1), ("every", None, 1)}
    assert {(r.collection, r.node): r.mean for r in runs.mean_std("twice").collect()}["kripke a", "a"] == 10.0
    assert {(r.collection, r.node): r.median for r in runs.box("value").collect()}["every", "a"] == 3.0
    with pytest.raises(ValueError):
        runs_of.gather(df, {"x": {"fault": [0]}})


def test_a_scorer_per_label(spark):
    df = spark.createDataFrame([("a", 0, 0), ("a", 1, 0), ("a", 1, 1), ("b", 0, 0)], "node string, y int, pred int")
    scorers = metrics.label_scorers([0, 1, 1], zero_division=1.0)
    assert list(scorers) == ["0", "1", "weighted"]
    got = {name: {r.node: round(r.score, 4) for r in score(df).collect()} for name, score in scorers.items()}
    assert got == {"0": {"a": 0.6667, "b": 1.0}, "1": {"a": 0.6667, "b": 1.0}, "weighted": {"a": 0.6667, "b": 1.0}}
