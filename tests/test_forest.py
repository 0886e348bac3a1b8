"""Forest jobs on planted data: what is predictable is predicted, every fold
and node is scored, and the end-to-end path meets its parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultlens.operators import features
from faultlens.plans import forest, keyed_forest, selection
from faultlens.queries import QUERIES, round_doubles


@pytest.fixture(scope="module")
def planted(spark):
    """Label = sign pattern of f0 and f1 on every node; f2 and f3 are noise."""
    rng = np.random.default_rng(0)
    rows = []
    for n in range(3):
        for i in range(80):
            x = rng.normal(size=4)
            rows.append((f"N{n}", i + 1, *map(float, x), int(x[0] > 0) + 2 * int(x[1] > 0)))
    return spark.createDataFrame(rows, "node string, pos long, f0 double, f1 double, f2 double, f3 double, label int").cache()


COLS = ["f0", "f1", "f2", "f3"]
SMALL = dict(num_trees=10, max_depth=6)


def test_pooled_cross_validation_has_every_fold_and_the_mean(planted):
    rows = forest.cross_validate(planted, COLS, k=4, folds="stratified", **SMALL).where("cls = 'overall'").collect()
    by = {(r.node, r.fold): r.score for r in rows}
    assert set(by) == {(f"N{n}", f) for n in range(3) for f in ("0", "1", "2", "3", "all")}
    for n in range(3):
        assert by[f"N{n}", "all"] == pytest.approx(np.mean([by[f"N{n}", str(f)] for f in range(4)])) and by[f"N{n}", "all"] > 0.6


def test_cross_validation_per_node_sees_one_node(planted):
    flipped = planted.withColumn("label", F.when(F.col("node") == "N2", 3 - F.col("label")).otherwise(F.col("label")))
    rows = forest.cross_validate_nodes(flipped, COLS, ["N0", "N2"], k=2, **SMALL).where("cls = 'overall' AND fold = 'all'").collect()
    assert {r.node for r in rows} == {"N0", "N2"} and all(r.score > 0.5 for r in rows)  # own labels, learnt apart


def test_random_nodes_train_and_all_are_scored(planted, spark):
    tr = spark.createDataFrame([("N0",)], "node string")
    rows = forest.cross_validate(planted, COLS, k=2, train_nodes=tr, **SMALL).collect()
    assert {r.node for r in rows} == {"N0", "N1", "N2"}


def test_same_node_split_and_selected_nodes(planted, spark):
    got = {r.node: r.score for r in forest.same_node_split(planted, COLS, ["N0", "N1"], **SMALL).where("metric = 'f1' AND cls = 'overall'").collect()}
    assert set(got) == {"N0", "N1"} and min(got.values()) > 0.5
    tr = spark.createDataFrame([("N1",)], "node string")
    rest = forest.train_test_nodes(planted, COLS, tr, **SMALL).where("metric = 'f1' AND cls = 'overall'").collect()
    assert {r.node for r in rest} == {"N0", "N2"}


def test_selection_finds_the_planted_columns(planted):
    rank = {r.feature: r for r in selection.rfe(planted, COLS, 2, **SMALL).collect()}
    assert {c for c, r in rank.items() if r.selected} == {"f0", "f1"}
    curve, chosen = selection.rfecv(planted, COLS, k=2, **SMALL)
    assert curve.count() == 4 and {"f0", "f1"} <= {r.feature for r in chosen.collect() if r.selected}
    top = [r.feature for r in selection.forest_importance(planted, COLS).orderBy("rank").collect()][:2]
    assert set(top) == {"f0", "f1"}


def test_a_large_forest_judges_as_a_small_one(planted, monkeypatch):
    """Trees that go to every task, trees dealt over tasks, and trees walked by level
    above their subtrees give the same predictions, repeated rows included."""
    from faultlens.plans import keyed_forest

    m = forest.fit(planted, COLS, **SMALL)
    twice = planted.union(planted.limit(5)).withColumn("label", F.when(F.col("pos") != 7, F.col("label")))
    want = sorted(map(str, forest.predict(m, twice, COLS, ["node", "pos"]).collect()))
    assert len(want) == 245 and sum("y=None" in r for r in want) >= 3
    monkeypatch.setattr(keyed_forest, "SHIPPED_NODES", 3)
    for local in (1000, 9):
        got = keyed_forest.predictions_of(m, twice, ["node", "pos"], local=local).collect()
        assert sorted(map(str, got)) == want


def test_leaves_of_a_few_rows_split_as_counted_ones():
    from faultlens.plans import keyed_forest as kf

    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 33, 900)
    leaf = rng.permutation(np.repeat(np.arange(900), sizes))
    bins = rng.integers(0, 6, (len(leaf), 7)).astype(np.int8)
    label, weight = rng.integers(0, 3, len(leaf)), rng.integers(1, 5, len(leaf))
    tries = np.sort(np.argsort(rng.random((900, 7)), axis=1)[:, :3], axis=1)
    rule = kf._Rule(1, 1, 7, 3, 3, 8, None, 2, True)
    few = kf._best_splits(rule, bins, label, weight, leaf, tries)
    every = kf._splits_by_table(rule, bins, label, weight, np.argsort(leaf, kind="stable"), sizes, tries)
    assert np.array_equal(few[1], every[0]) and np.array_equal(few[2], tries[np.arange(900), every[1]]) and np.array_equal(few[3], every[2])


def test_training_rows_need_labels(planted):
    with pytest.raises(Exception, match="Labels MUST NOT be Null"):
        forest.fit(planted.withColumn("label", F.when(F.col("pos") > 3, F.col("label"))), COLS, **SMALL)


@pytest.mark.parametrize("shipped", [keyed_forest.SHIPPED_NODES, 0])
def test_vectors_of_test_nodes_are_judged_before_rows_are_dealt(planted, monkeypatch, shipped):
    """Balancing sorts rows by class; judged rows are keys and classes by then, as long
    as the forest goes to the tasks. The scores are those of vectors balanced first."""
    monkeypatch.setattr(keyed_forest, "SHIPPED_NODES", shipped)
    some = planted.where("NOT (label = 0 AND pos % 3 = 0)")
    tr = planted.sparkSession.createDataFrame([("N0",)], "node string")
    test = forest.sampling.undersample(some.where("node <> 'N0'"), group=["node"])
    model = forest.fit(forest.sampling.undersample(some.where("node = 'N0'"), group=["node"]), COLS, **SMALL)
    want = forest.metrics.scores(forest.predict(model, test, COLS), ["node"])
    seen, plain = [], forest.sampling.undersample
    monkeypatch.setattr(forest.sampling, "undersample", lambda df, *a, **kw: seen.append(df.columns) or plain(df, *a, **kw))
    got = forest.train_test_nodes(some, COLS, tr, **SMALL)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and {r.node for r in got.collect()} == {"N1", "N2"}
    assert len(seen) == 2 and "f0" in seen[0] and ("f0" in seen[1]) == (not shipped)


def test_windows_to_forest_is_the_forest_of_all_windows(spark, tmp_path):
    """The query parts the nodes before it makes vectors; the scores are those of parting the vectors."""
    rows = spark.range(8 * 60).selectExpr(
        "id AS event_id", "CAST(timestamp_seconds(1704067200 + id * 3) AS timestamp_ntz) AS ts", "IF(id % 8 = 7 AND id > 64, NULL, id % 8) AS user_id",
        "element_at(array('click', 'error', 'purchase', 'signup', 'view'), CAST(id * 7 % 5 + 1 AS int)) AS event_type",
        "CAST(id * 37 % 101 AS double) AS value", """concat('{"k": ', id DIV 48, '}') AS props""")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    from faultlens.functions.scalar import node_number
    from faultlens.sources import telemetry as tv
    w = features.window_features(tv.node_table(spark, str(tmp_path)), tv.EVENT_METRICS, w=10, label="fault").cache()
    cols = [c for c in w.columns if c not in ("node", "pos", "window_id", "label")]
    nodes = w.select("node", node_number("node").alias("node_no")).distinct()
    tr = forest.sampling.random_designs(nodes, seed=42, iterations=1, sizes=[3]).where("role = 'train'")
    want = round_doubles(forest.train_test_nodes(w, cols, tr)).collect()
    got = QUERIES["r1_windows_to_forest"](spark, str(tmp_path)).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) > 100 and None in {r.node for r in got}
