"""Many forests in one job: both plans grow the same trees, what is planted is
learnt, every odd row has its defined place."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultlens.operators.sampling import hash_key
from faultlens.plans import forest, keyed_forest, selection

COLS = ["f0", "f1", "f2"]
SCHEMA = "node string, pos long, f0 double, f1 double, f2 double, label int, test boolean"


def planted_rows(nodes, n, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for k in nodes:
        for i in range(n):
            x = rng.normal(size=3)
            rows.append((k, i + 1, *map(float, x), int(x[0] > 0) + 2 * int(x[1] > 0), i >= 0.6 * n))
    return rows


@pytest.fixture(scope="module")
def planted(spark):
    return spark.createDataFrame(planted_rows(["a", "b", "c"], 90), SCHEMA).cache()


def grown(df, **kw):
    f = keyed_forest.grow_forests(df, COLS, model=["node"], **{"num_trees": 3, **kw})
    nodes = sorted(map(str, f.nodes.select("model", "tree", "path", "feature", "cut", "gain", "counts").collect()))
    return nodes, sorted(map(str, f.predictions().collect()))


def test_levels_and_local_growth_agree(planted):
    """The same trees, gains and predictions whether nodes of over 40 rows are
    split by the grouped aggregation or whole models in one task."""
    nodes, judged = grown(planted)
    again, judged_again = grown(planted, local_rows=40)
    assert nodes == again and judged == judged_again and len(judged) == 3 * 36


def test_shallow_levels_agree_with_shuffled_joins(planted, monkeypatch):
    monkeypatch.setattr(keyed_forest, "BROADCAST_SPLITS", 0)
    assert grown(planted, max_depth=2, local_rows=1) == grown(planted, max_depth=2)


def test_every_model_learns_its_own_labels(planted):
    flipped = planted.withColumn("label", F.when(F.col("node") == "b", 3 - F.col("label")).otherwise(F.col("label")))
    f = keyed_forest.grow_forests(flipped, COLS, model=["node"])
    right = {r.node: r.a for r in f.predictions().groupBy("node").agg(F.avg((F.col("y") == F.col("pred")).cast("double")).alias("a")).collect()}
    assert set(right) == {"a", "b", "c"} and min(right.values()) > 0.8
    top = f.importances().where("rank <= 2").groupBy("model").agg(F.sort_array(F.collect_list("feature")).alias("f"), F.sum("importance").alias("s")).collect()
    assert all(r.f == ["f0", "f1"] and 0.8 < r.s <= 1 for r in top)
    total = f.importances().groupBy("model").agg(F.sum("importance").alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in total)


def test_depth_is_not_limited(spark):
    """Labels that alternate along one feature need a long chain of splits."""
    rows = [("n", i + 1, float(i), 0.0, 0.0, i % 2, False) for i in range(120)] + [("n", 500 + i, float(i), 0.0, 0.0, i % 2, True) for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    edges = [[float(i) for i in range(119)], [], []]
    f = keyed_forest.grow_forests(df, COLS, model=["node"], num_trees=1, max_depth=None, tried=3, bootstrap=False, bins=127, edges=edges)
    assert f.nodes.agg(F.max(F.length("path"))).first()[0] > 30
    assert f.predictions().where("y <> pred").count() == 0
    flat = keyed_forest.grow_forests(df, COLS, model=["node"], num_trees=1, max_depth=0, bootstrap=False, edges=edges)
    assert flat.nodes.count() == 1 and {r.pred for r in flat.predictions().collect()} == {0}


def test_one_tree_over_all_rows_ranks_features(planted):
    rank = {r.feature: r for r in selection.tree_importance(planted, COLS).collect()}
    assert {rank["f0"].rank, rank["f1"].rank} == {1, 2} and sum(r.importance for r in rank.values()) == pytest.approx(1)


def test_odd_rows(spark):
    rows = planted_rows([None, "a"], 40) + [("a", 900, None, float("nan"), 0.0, 1, False), ("a", 901, None, None, None, 2, True),
                                            ("a", 902, 0.0, 0.0, 0.0, None, True), ("only test", 1, 0.0, 0.0, 0.0, 1, True), ("one class", 1, 0.0, 0.0, 0.0, 3, False),
                                            ("one class", 2, 5.0, 0.0, 0.0, 1, True)]
    rows += [("a", 903, 1.0, 1.0, 0.0, 3, True)] * 2
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit("x"), "y": F.lit(9), "bins": F.lit(0), "model": F.lit(None).cast("int")})
    got = keyed_forest.grow_forests(df, COLS, model=["node"], num_trees=3, max_depth=3, bootstrap=False).predictions().collect()
    assert sum(r.node is None for r in got) == 16 and sum(r.pos == 901 for r in got) == 1 and sum(r.pos == 903 for r in got) == 1
    assert not any(r.pos == 902 or r.node == "only test" for r in got)
    assert [r.pred for r in got if r.node == "one class"] == [3]
    empty = keyed_forest.grow_forests(df.limit(0), COLS, model=["node"])
    assert empty.predictions().collect() == [] and empty.nodes.collect() == []


def test_bins_and_bags(spark):
    df = spark.range(20000).select(F.lit("n").alias("node"), F.col("id").alias("pos"), (F.col("id") % 997).cast("double").alias("f0"))
    edges = keyed_forest.bin_edges(df, ["f0"], ["node", "pos"], bins=32, sample_rows=4000)
    assert len(edges[0]) == 31 and edges[0] == sorted(edges[0])
    sizes = df.select(F.element_at(keyed_forest.binned(["f0"], edges), 1).alias("b")).groupBy("b").count().collect()
    assert len(sizes) == 32 and max(r["count"] for r in sizes) < 900
    x, y = keyed_forest._seeds(hash_key(42, "pos"))
    draw = keyed_forest._draw(x, y, F.lit(7).cast("long"))
    weight = sum(((draw >= p).cast("int") for p in keyed_forest.POISSON), F.lit(0))
    r = df.agg(F.avg(weight).alias("m"), F.var_samp(weight).alias("v")).first()
    assert r.m == pytest.approx(1, abs=0.03) and r.v == pytest.approx(1, abs=0.06)


def test_designs_judge_the_other_nodes(planted, spark):
    designs = spark.createDataFrame([(1, 1, "a", "train"), (1, 1, "b", "test"), (1, 1, "c", "test"),
                                     (2, 2, "a", "test"), (2, 2, "b", "train"), (2, 2, "c", "train")], "iter int, k int, node string, role string")
    rows = forest.random_design_runs(planted, COLS, designs, num_trees=5).where("metric = 'f1' AND cls = 'overall'").collect()
    assert {(r.iter, r.num_train, r.node) for r in rows} == {(1, 1, "b"), (1, 1, "c"), (2, 2, "a")} and min(r.score for r in rows) > 0.7


def test_without_repeated_test_rows_each_is_judged_once(planted):
    f = forest.node_fold_forests(planted, COLS, k=3, num_trees=3)
    assert f.predictions().groupBy("node", "pos").count().where("count > 1").count() == 0
    kept = forest.node_fold_forests(planted, COLS, k=3, num_trees=3, balance=False).predictions()
    assert kept.count() == planted.count()


def test_saved_forests_judge_like_grown_ones(planted, tmp_path):
    f = keyed_forest.grow_forests(planted, COLS, model=["node"], num_trees=3, max_depth=3)
    f.save(str(tmp_path / "f"))
    rows = planted.where("test").withColumns({"counts": F.lit(0), "tree": F.lit("x")})
    again = keyed_forest.judge_saved(str(tmp_path / "f"), rows.union(rows.withColumn("node", F.lit("unknown")).limit(3)), model=["node"])
    assert sorted(map(str, again.collect())) == sorted(map(str, f.predictions().collect()))
