"""Property tests of the operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultlens.constants import STATS_11
from faultlens.operators import features, metrics, sampling
from faultlens.operators.positions import add_positions
from faultlens.sources import telemetry as tv

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def big(spark):
    return tv.windows_big(spark, SF_SMALL).cache()


def test_range_positions_equal_window_positions(spark):
    from faultlens.sources.tables import table
    li = table(spark, SF_SMALL, "lineitem")
    order = tv.LINEITEM_ORDER
    a = add_positions(li, "l_suppkey", order, method="window").select("l_suppkey", "pos", "l_extendedprice")
    for rows in (40, 100, 10**9):  # hot nodes split into several buckets / none split
        b = add_positions(li, "l_suppkey", order, method="range", max_group_rows=rows) \
            .select("l_suppkey", "pos", "l_extendedprice")
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_halo_chunks_equal_whole_node_windows(big):
    kw = dict(w=7, step=2, stats=STATS_11, label="label", corr=[("l_quantity", "l_tax")])
    whole = features.window_features(big, tv.LINEITEM_METRICS, chunk_rows=None, **kw)
    small = features.window_features(big, tv.LINEITEM_METRICS, chunk_rows=9, **kw)
    assert whole.count() == small.count()
    assert whole.exceptAll(small).count() == 0


def test_pandas_engine_matches_native(big):
    kw = dict(w=5, step=3, numfeatures=11, label="label", corr=True, chunk_rows=11)
    a = features.window_features(big, tv.LINEITEM_METRICS, engine="native", **kw)
    b = features.window_features(big, tv.LINEITEM_METRICS, engine="moving", **kw)
    cols = [c for c in a.columns]
    pa = a.toPandas().sort_values(["node", "pos"]).reset_index(drop=True)
    pb = b.select(*cols).toPandas().sort_values(["node", "pos"]).reset_index(drop=True)
    for c in cols:
        np.testing.assert_allclose(pa[c].astype(float), pb[c].astype(float), rtol=1e-9, atol=1e-9, err_msg=c)


def test_window_statistic_properties(big):
    w, step = 10, 3
    f = features.window_features(big, ["l_quantity"], w=w, step=step, numfeatures=11)
    bad = f.where((F.col("min_l_quantity") > F.col("perc5_l_quantity"))
                  | (F.col("perc5_l_quantity") > F.col("perc25_l_quantity"))
                  | (F.col("perc25_l_quantity") > F.col("median_l_quantity"))
                  | (F.col("median_l_quantity") > F.col("perc75_l_quantity"))
                  | (F.col("perc75_l_quantity") > F.col("perc95_l_quantity"))
                  | (F.col("perc95_l_quantity") > F.col("max_l_quantity")))
    assert bad.count() == 0
    n = big.groupBy("node").agg(F.max("pos").alias("n"))
    got = f.groupBy("node").count().join(n, "node")
    exp = got.withColumn("e", F.when(F.col("n") >= w, F.floor((F.col("n") - w) / step) + 1).otherwise(0))
    assert exp.where(F.col("count") != F.col("e")).count() == 0
    # sumdiff = last - first of the window
    first = big.select("node", (F.col("pos") + w - 1).alias("pos"), F.col("l_quantity").alias("first"))
    chk = f.join(first, ["node", "pos"]).where(
        F.abs(F.col("sumdiff_l_quantity") - (F.col("last_l_quantity") - F.col("first"))) > 1e-9)
    assert chk.count() == 0


def test_metric_complements(spark):
    p = tv.predictions(spark, SF_SMALL)
    s = metrics.scores(p, ["node"])
    wide = s.groupBy("node", "cls").pivot("metric").agg(F.first("score"))
    bad = wide.where((F.abs(F.col("sensitivity") + F.col("fn_rate") - 1) > 1e-12)
                     | (F.abs(F.col("specificity") + F.col("fp_rate") - 1) > 1e-12))
    assert bad.count() == 0


def test_sampler_counts_equal_targets(big):
    for strategy in ["majority", "not minority", "all", "majority_mean", "minority_mean", {0: 3, 1: 2}]:
        c = sampling.class_counts(big, "label", ["node"])
        t = sampling.targets(c, "label", ["node"], strategy)
        out = sampling.undersample(big, "label", strategy=strategy, group=["node"])
        got = sampling.class_counts(out, "label", ["node"]).withColumnRenamed("n", "got")
        j = t.join(got, ["node", "label"], "left").fillna(0, ["got"])
        assert j.where(F.col("got") != F.col("target")).count() == 0, strategy
        # bucketed plan = exact window plan
        ex = sampling.undersample(big, "label", strategy=strategy, group=["node"], max_class_rows=3)
        assert out.exceptAll(ex).count() == 0 and ex.exceptAll(out).count() == 0


def test_callable_strategy(big):
    out = sampling.undersample(big, "label", strategy=lambda c: {k: min(v, 2) for k, v in c.items()},
                               group=["node"])
    assert out.groupBy("node", "label").count().where(F.col("count") > 2).count() == 0


def test_split_and_folds_partition_rows(big):
    s = sampling.positional_split(big)
    assert s.count() == big.count()
    for fn in (lambda d: sampling.kfold(d, 5), lambda d: sampling.kfold(d, 5, shuffle=True),
               lambda d: sampling.stratified_kfold(d, 5)):
        f = fn(big)
        assert f.count() == big.count()
        sizes = f.groupBy("node", "fold").count().groupBy("node").agg(
            (F.max("count") - F.min("count")).alias("spread"))
        assert sizes.where(F.col("spread") > 1).count() == 0


def test_train_test_designs_disjoint(spark):
    nodes = tv.readings(spark, SF_SMALL).select("node", "node_no").distinct()
    d = sampling.random_designs(nodes, iterations=2, sizes=[3, 5])
    per = d.groupBy("iter", "k").agg(F.sum((F.col("role") == "train").cast("int")).alias("tr"),
                                      F.count(F.lit(1)).alias("n"))
    n = nodes.count()
    assert per.where((F.col("tr") != F.col("k")) | (F.col("n") != n)).count() == 0
    train = d.where((F.col("iter") == 1) & (F.col("k") == 3) & (F.col("role") == "train"))
    test = sampling.test_nodes(nodes, train)
    assert test.count() + 3 == n and test.join(train, "node").count() == 0


def test_positions_are_dense(big):
    p = add_positions(big.drop("pos"), "node", ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "label"],
                      method="range", max_group_rows=50)
    chk = p.groupBy("node").agg(F.min("pos").alias("a"), F.max("pos").alias("b"), F.count(F.lit(1)).alias("n"))
    assert chk.where((F.col("a") != 1) | (F.col("b") != F.col("n"))).count() == 0


def test_node_tables_are_one_file_each(spark, tmp_path, monkeypatch):
    from faultlens import queries_ml

    path = str(tmp_path / "nodes")
    monkeypatch.setattr(queries_ml, "_scratch", lambda spark, name: path)
    rows = spark.range(4000).selectExpr("concat('N', id % 20) AS node", "id AS ts", "double(id) AS click").repartition(6)
    monkeypatch.setattr(queries_ml.tv, "node_seconds", lambda spark, sf_dir: rows)
    got = {r.node: r.n for r in queries_ml.s07_node_tables_roundtrip(spark, "").collect()}
    assert got == {f"N{i}": 200 for i in range(20)}
    assert all(len(list(d.glob("*.parquet"))) == 1 for d in (tmp_path / "nodes").glob("node=*"))
