"""Registered queries for sources/sinks round trips and the ML jobs.

Round trips write data that Spark derives from the driver's tables into the
shared checkpoint folder and read it back. ML jobs have no SQL twin (rows-only
check); their properties are tested in ``tests/``.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from faultlens.functions import scalar as fx
from faultlens.oracles import with_views
from faultlens.operators import features, metrics, profile, sampling
from faultlens.operators.positions import add_positions
from faultlens.plans import clustering, dtw, forest, keyed_forest, l1_models, selection
from faultlens.queries import ORACLES, qz, register, round_doubles
from faultlens.queries_ops import conf_ctes, scores_ctes
from faultlens.session import shared_path
from faultlens.sources import featurelist, readers, sinks
from faultlens.sources import telemetry as tv


def _scratch(spark, name: str) -> str:
    return shared_path(spark, f"faultlens/{name}-{uuid.uuid4().hex[:12]}")


# Exported sensor CSVs -------------------------------------------------
_T0_NS = 1704067200 * 10**9            # 2024-01-01T00:00:00Z
_T1_NS = (1704067200 + 14 * 86400) * 10**9  # two weeks later


def s01_sensor_exports_scan(spark, sf_dir):
    r = tv.readings(spark, sf_dir)
    export = r.select(
        F.format_string("/site/rack/chassis/n%05d/%s", "node_no", "metric").alias("Sensor"),
        (fx.epoch_micros("ts") * 1000).alias("Time"), F.col("value").alias("Value"))
    path = _scratch(spark, "exports")
    export.write.option("header", True).mode("overwrite").csv(path)
    sensors = tv.sensor_paths(spark, sf_dir).where(F.col("user_id") % 2 == 0).select("path")
    out = readers.read_sensor_exports(spark, path, t0_ns=_T0_NS, t1_ns=_T1_NS, sensors=sensors)
    return round_doubles(out.select("sensor", "metric", fx.epoch_micros("ts").alias("micros"), "value"))


register("s01_sensor_exports_scan", f"""SELECT printf('/site/rack/chassis/n%05d/%s', user_id, event_type) AS sensor, event_type AS metric, epoch_us(ts) AS micros, {qz('value')} AS value
FROM events WHERE user_id % 2 = 0 AND epoch_us(ts) * 1000 BETWEEN {_T0_NS} AND {_T1_NS}""")(s01_sensor_exports_scan)


# S5 / S6 -------------------------------------------------------------------------
def s05_positional_range(spark, sf_dir):
    b = tv.windows_big(spark, sf_dir)
    return readers.positional_range(b, 100, 72).select("node", "pos", "label")


register("s05_positional_range", with_views("windows_big") +
         "SELECT node, pos, label FROM windows_big WHERE pos BETWEEN 100 AND 171")(s05_positional_range)


def s06_systematic_sample(spark, sf_dir):
    return readers.systematic_sample(tv.windows_big(spark, sf_dir), 10).select("node", "pos", "label")


register("s06_systematic_sample", with_views("windows_big") +
         "SELECT node, pos, label FROM windows_big WHERE (pos - 1) % 10 = 0")(s06_systematic_sample)


# Node tables written per node and read back in one scan ----------
def s07_node_tables_roundtrip(spark, sf_dir):
    ns = tv.node_seconds(spark, sf_dir)
    path = _scratch(spark, "nodes")
    sinks.write_table(sinks.dealt(ns, ["node"]), path, fmt="parquet", partition_by=["node"])  # a file per node
    back = spark.read.parquet(path)  # partition discovery gives ``node``
    return round_doubles(back.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.avg("click").alias("click")))


register("s07_node_tables_roundtrip", with_views("node_seconds") +
         f"SELECT node, count(*) AS n, {qz('avg(click)')} AS click FROM node_seconds GROUP BY node")(
    s07_node_tables_roundtrip)


# Append score runs ----------------------------------------------------
def s13_append_scores(spark, sf_dir):
    s = metrics.scores(tv.predictions(spark, sf_dir), ["node"], metrics=["f1", "sensitivity"])
    path = _scratch(spark, "scores")
    for run in (1, 2):
        sinks.append_scores(sinks.with_run_tags(s, num_train=run * 4, num_iter=run), path)
    back = spark.read.parquet(path)
    return round_doubles(back.groupBy("metric", "cls", "num_train", "num_iter")
                         .agg(F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("n")))


register("s13_append_scores", with_views("predictions", extra=conf_ctes("predictions", "node") +
                                         scores_ctes("node", ["f1", "sensitivity"])) + f"""
SELECT metric, cls, r * 4 AS num_train, r AS num_iter, {qz('avg(score)')} AS mean_score, count(*) AS n
FROM scores, (VALUES (1), (2)) v(r) GROUP BY metric, cls, r""")(s13_append_scores)


# Chosen training nodes written and read back --------------------------------
def s17_training_nodes(spark, sf_dir):
    nodes = tv.readings(spark, sf_dir).select("node", "node_no").distinct()
    d = sampling.random_designs(nodes, seed=42, iterations=1, sizes=[6])
    path = _scratch(spark, "train-nodes")
    d.where(F.col("role") == "train").select(F.col("node").alias("nodename")) \
        .write.option("header", True).mode("overwrite").csv(path)
    tr = readers.read_training_nodes(spark, path)
    return tv.readings(spark, sf_dir).join(tr, "node", "left_semi") \
        .groupBy("node").agg(F.count(F.lit(1)).alias("n"))


register("s17_training_nodes", with_views("readings", extra=[
    ("pool", "  SELECT DISTINCT node, node_no FROM readings"),
    ("d", "  SELECT node, row_number() OVER (ORDER BY md5('42:1:6:' || node), node) AS rn FROM pool")]) +
    "SELECT node, count(*) AS n FROM readings WHERE node IN (SELECT node FROM d WHERE rn <= 6) GROUP BY node")(
    s17_training_nodes)


# Feature lists ---------------------------------------------------
def _vectors(spark, sf_dir):
    v = tv.ml_vectors(spark, sf_dir)
    return add_positions(v, "node", "vec_id")


_VCOLS = [f"f{i}" for i in range(tv.VECTOR_DIMS)]


def s09_feature_list_roundtrip(spark, sf_dir):
    """The correlation ranking, written as a list and read in both formats."""
    corr = round_doubles(profile.target_correlation(tv.windows_big(spark, sf_dir), tv.LINEITEM_METRICS, "label"))
    ranks = corr.select("feature", F.col("abs_corr").alias("importance"),
                        F.row_number().over(Window.orderBy(F.desc("abs_corr"), "feature")).alias("rank"))  # a row per metric
    path = _scratch(spark, "featlist")
    featurelist.write_feature_list(ranks, path, "Most important features", fmt="ranked")
    ranked = featurelist.feature_table(spark, path, "ranked")
    plain = featurelist.feature_table(spark, path, "plain")
    return ranked.join(plain.select("rank", F.length("feature").alias("raw_length")), "rank").select(
        "rank", "feature", "importance", (F.col("raw_length") > F.length("feature")).alias("plain_keeps_number"))


register("s09_feature_list_roundtrip", ORACLES["a11_target_correlation"].replace(
    "SELECT 'l_quantity'", "SELECT row_number() OVER (ORDER BY abs_corr DESC, feature) AS rank, feature, "
    "abs_corr AS importance, true AS plain_keeps_number FROM (SELECT 'l_quantity'", 1) + ")")(s09_feature_list_roundtrip)


def s03_node_files(spark, sf_dir):
    """Node tables written as CSV files of their own and read back in one scan by node name."""
    ns = tv.node_seconds(spark, sf_dir).select("node", F.unix_seconds(F.col("ts").cast("timestamp")).alias("Time"), "click", "fault")
    path = _scratch(spark, "node-files")
    sinks.write_table(sinks.dealt(ns, ["node"]), path, fmt="csv", partition_by=["node"])
    back = readers.read_node_tables(spark, path, schema="Time long, click double, fault int", columns=["Time", "click", "fault"],
                                    node_pattern=r"node=([^/]+)/[^/]+$", ts_col="")
    return round_doubles(back)


register("s03_node_files", with_views("node_seconds") +
         f"SELECT node, epoch(ts)::BIGINT AS \"Time\", {qz('click')} AS click, fault FROM node_seconds")(s03_node_files)


# ML jobs (rows-only) ---------------------------------------------------------------
def _train_nodes(spark):
    return spark.createDataFrame([(f"N{i}",) for i in range(3)], "node string")


def l01_forest_predictions(spark, sf_dir):
    v = sampling.positional_split(_vectors(spark, sf_dir))
    m = forest.fit(v.where(F.col("split") == "train"), _VCOLS, "label")
    return forest.predict(m, v.where(F.col("split") == "test"), _VCOLS, ["node", "vec_id"], "label")


register("l01_forest_predictions")(l01_forest_predictions)


def l02_same_node_split(spark, sf_dir):
    return round_doubles(forest.same_node_split(_vectors(spark, sf_dir), _VCOLS))


register("l02_same_node_split")(l02_same_node_split)


def l03_train_selected_nodes(spark, sf_dir):
    return round_doubles(forest.train_test_nodes(_vectors(spark, sf_dir), _VCOLS, _train_nodes(spark)))


register("l03_train_selected_nodes")(l03_train_selected_nodes)


def _designs(v, sizes, iterations=1):
    nodes = v.select("node", fx.node_number("node").alias("node_no")).distinct()
    return sampling.random_designs(nodes, seed=42, iterations=iterations, sizes=sizes)


def l04_random_design_runs(spark, sf_dir):
    """Every size that leaves a test node, two runs each: fourteen forests in one job."""
    v = _vectors(spark, sf_dir)
    return round_doubles(forest.random_design_runs(v, _VCOLS, _designs(v, range(1, 8), iterations=2)))


register("l04_random_design_runs")(l04_random_design_runs)


def l06_train_save_score(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    m = forest.fit(v.where(fx.node_number("node") < 4), _VCOLS)
    path = _scratch(spark, "model")
    forest.save(m, path)
    return round_doubles(forest.score_saved_model(path, v.where(fx.node_number("node") >= 4), _VCOLS))


register("l06_train_save_score")(l06_train_save_score)


def l07_cross_validation(spark, sf_dir):
    return round_doubles(forest.cross_validate(_vectors(spark, sf_dir), _VCOLS, k=5, folds="stratified",
                                               labels=list(range(10))))


register("l07_cross_validation")(l07_cross_validation)


def l07_node_cross_validation(spark, sf_dir):
    """A cross-validation of every node by itself: forty forests in one job."""
    return round_doubles(forest.cross_validate_nodes(_vectors(spark, sf_dir), _VCOLS, folds="stratified", labels=list(range(10))))


register("l07_node_cross_validation")(l07_node_cross_validation)


def l07_random_node_cv(spark, sf_dir):
    """One pooled cross-validation trained on four random nodes (M12), scored on all."""
    v = _vectors(spark, sf_dir)
    nodes = v.select("node", fx.node_number("node").alias("node_no")).distinct()
    tr = sampling.random_designs(nodes, seed=42, iterations=1, sizes=[4]).where("role = 'train'")
    return round_doubles(forest.cross_validate(v, _VCOLS, folds="shuffled", train_nodes=tr))


register("l07_random_node_cv")(l07_random_node_cv)


_R1_W = 10


def r1_windows_to_forest(spark, sf_dir):
    """End to end (R2): readings -> aligned, filled node table -> window vectors of
    11 statistics -> balanced forest on three nodes -> scores of all other nodes.

    Windows lie inside nodes, so the training nodes are told from the others before
    their vectors are made: a vector of 55 numbers is judged in the task that made it.
    """
    from faultlens.operators import features as ft
    points = _node_points(spark, sf_dir).checkpoint()
    nodes = points.where(F.col("pos") >= _R1_W).select("node", fx.node_number("node").alias("node_no")).distinct()  # those with a window
    tr = forest.settled(sampling.random_designs(nodes, seed=42, iterations=1, sizes=[3]).where("role = 'train'").select("node"))
    learnt, judged = (ft.window_features(points.join(F.broadcast(tr), "node", how), tv.EVENT_METRICS, w=_R1_W, step=1, numfeatures=11, label="fault",
                                         engine="moving") for how in ("left_semi", "left_anti"))
    cols = [c for c in learnt.columns if c not in ("node", "pos", "window_id", "label")]
    return round_doubles(forest.settled(forest.train_test_rows(learnt, judged, cols)))


register("r1_windows_to_forest")(r1_windows_to_forest)


def l08_forest_importance(spark, sf_dir):
    return round_doubles(selection.forest_importance(_vectors(spark, sf_dir), _VCOLS))


register("l08_forest_importance")(l08_forest_importance)


def l08_tree_importance(spark, sf_dir):
    return round_doubles(selection.tree_importance(_vectors(spark, sf_dir), _VCOLS))


register("l08_tree_importance")(l08_tree_importance)


# Shallow forests and their twins: bins, bags, features of a node and splits in SQL.
_SHALLOW = dict(num_trees=3, max_depth=2, seed=42)


def _ints(n, expr):
    return ", ".join(expr.format(k=k) for k in range(n))


def _shallow_twin(rows_sql: str, tail: str, trees: int = 3, tried: int = 8, classes: int = 10) -> str:
    """SQL for ``tail`` over ``nodes`` (splits and leaves by model, tree and path)
    and ``votes`` of the forests of depth two over ``rows_sql``: ``model, node, pos, label, test``."""
    P, dims = keyed_forest._P, tv.VECTOR_DIMS
    draw = "(({x}) * (2 * {k} + 1) + ({y}) * ((({k} + 1) * ({k} + 1)) % " + str(P) + ")) % " + str(P)
    seeds = "('0x' || substr({h}, 1, 8))::BIGINT % " + str(P) + " AS s0, ('0x' || substr({h}, 9, 8))::BIGINT % " + str(P) + " AS s1"
    by, K = "model, tree, path", classes
    ends = lambda c: f"(list_max({c}) = list_sum({c}) OR list_sum({c}) < 2)"
    weight = " + ".join(f"(d >= {t})::INT" for t in keyed_forest.POISSON)
    edge = _ints(31, "x[(floor(len(x) * ({k} + 1) / 32))::INT + 1]")
    extra = [
        ("v", f"  SELECT *, row_number() OVER (PARTITION BY node ORDER BY vec_id) AS pos, [{_ints(dims, 'f{k}')}] AS f FROM ml_vectors"),
        ("sizes", "  SELECT node, count(*) AS n FROM v GROUP BY node"),
        ("rows_of", rows_sql),
        ("sample", f"  SELECT unnest(f) AS value, unnest(range({dims})) AS feature FROM (SELECT v.f FROM rows_of JOIN v USING (node, pos) ORDER BY md5('42:' || node || ':' || pos) LIMIT 10000)"),
        ("edges", f"  SELECT feature, [{edge}] AS e FROM (SELECT feature, list(value ORDER BY value) AS x FROM sample WHERE value IS NOT NULL GROUP BY feature)"),
        ("bins", f"  SELECT node, pos, feature, len(list_filter(list_distinct(e), lambda q: q < value)) AS bin FROM (SELECT node, pos, unnest(f) AS value, unnest(range({dims})) AS feature FROM v) JOIN edges USING (feature)"),
        ("seeded", f"  SELECT *, {seeds.format(h='h')} FROM (SELECT *, md5('42:' || model || ':' || node || ':' || pos) AS h FROM rows_of)"),
        ("drawn", f"  SELECT *, {draw.format(x='s0', y='s1', k='tree')} AS d FROM (SELECT *, unnest(range({trees})) AS tree FROM seeded)"),
        ("state0", f"  SELECT model, node, pos, label, test, tree, '' AS path, CASE WHEN test THEN 0 ELSE {weight} END AS w FROM drawn"),
    ]
    for d in (0, 1):
        extra += [
            (f"tries{d}", f"  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {draw.format(x='s0', y='s1', k='feature')}, feature) AS r "
                          f"FROM (SELECT *, unnest(range({dims})) AS feature FROM (SELECT *, {seeds.format(h='h')} FROM (SELECT DISTINCT {by}, md5('42:' || model || ':' || tree || ':' || path) AS h FROM state{d})))) WHERE r <= {tried}"),
            (f"hist{d}", f"  SELECT {by}, feature, bin, {_ints(K, 'sum(CASE WHEN label = {k} THEN w ELSE 0 END)::BIGINT AS c{k}')} FROM state{d} JOIN tries{d} USING ({by}) JOIN bins USING (node, pos, feature) WHERE w > 0 GROUP BY {by}, feature, bin"),
            (f"sides{d}", f"  SELECT {by}, feature, bin, [{_ints(K, '(sum(c{k}) OVER upto)::BIGINT')}] AS low, [{_ints(K, '(sum(c{k}) OVER every)::BIGINT')}] AS total FROM hist{d} "
                          f"WINDOW upto AS (PARTITION BY {by}, feature ORDER BY bin), every AS (PARTITION BY {by}, feature)"),
            (f"scored{d}", "  SELECT *, coalesce(list_sum(list_transform(low, lambda c: c * c)) / list_sum(low) + list_sum(list_transform(high, lambda c: c * c)) / nullif(list_sum(high), 0), -1.0) AS score "
                           f"FROM (SELECT *, list_transform(range(1, {K + 1}), lambda i: total[i] - low[i]) AS high FROM sides{d})"),
            (f"best{d}", f"  SELECT *, score < 0 OR {ends('total')} AS final FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, feature, bin) AS r FROM scored{d}) WHERE r = 1"),
            (f"moved{d}", f"  SELECT s.*, final, CASE WHEN final THEN total WHEN b.bin <= best{d}.bin THEN low ELSE high END AS counts, CASE WHEN b.bin <= best{d}.bin THEN '0' ELSE '1' END AS side "
                          f"FROM state{d} s JOIN best{d} USING ({by}) JOIN bins b ON b.node = s.node AND b.pos = s.pos AND b.feature = best{d}.feature"),
        ]
        if d == 0:
            extra.append(("state1", f"  SELECT model, node, pos, label, test, tree, side AS path, w FROM moved0 WHERE NOT final AND NOT {ends('counts')}"))
    extra.append(("votes", f"  SELECT model, node, pos, label, {_ints(K, 'sum(counts[{k} + 1] * 1000000 // list_sum(counts)) AS v{k}')} FROM "
                           f"(SELECT * FROM moved0 WHERE final OR {ends('counts')} UNION ALL SELECT * FROM moved1) WHERE test GROUP BY model, node, pos, label"))
    extra.append(("predicted", f"  SELECT model, node, pos, label AS y, list_position(v, list_max(v)) - 1 AS pred FROM (SELECT *, [{_ints(K, 'v{k}')}] AS v FROM votes)"))
    extra.append(("gains", "  SELECT model, tree, feature, score - list_sum(list_transform(total, lambda c: c * c)) / list_sum(total) AS gain FROM "
                           "(SELECT * FROM best0 UNION ALL SELECT * FROM best1) WHERE NOT final"))
    return with_views("ml_vectors", extra=extra) + tail


_PREDICTED = "SELECT model, node, pos::BIGINT AS pos, y::INT AS y, pred::INT AS pred FROM predicted"
_SAME_NODE = "  SELECT node AS model, node, pos, label, pos > floor(n * 6 / 10) AS test FROM v JOIN sizes USING (node)"


def l02_shallow_predictions(spark, sf_dir):
    """Per node three trees of depth two, the predictions of its last 40 % of rows."""
    return forest.same_node_forests(_vectors(spark, sf_dir), _VCOLS, **_SHALLOW).predictions()


register("l02_shallow_predictions", _shallow_twin(_SAME_NODE, _PREDICTED))(l02_shallow_predictions)


def l04_shallow_predictions(spark, sf_dir):
    """Designs of two, four and six training nodes, unbalanced, trees of depth two."""
    v = _vectors(spark, sf_dir)
    return forest.design_forests(v, _VCOLS, _designs(v, [2, 4, 6]), balance=False, **_SHALLOW).predictions()


register("l04_shallow_predictions", _shallow_twin(
    "  SELECT '1:' || k AS model, v.node, pos, label, r > k AS test FROM v JOIN (SELECT node, k, row_number() OVER (PARTITION BY k ORDER BY md5('42:1:' || k || ':' || node), node) AS r "
    "FROM sizes, (VALUES (2), (4), (6)) s(k)) USING (node)", _PREDICTED))(l04_shallow_predictions)


def l05_score_saved_forest(spark, sf_dir):
    """Forests learnt on the first 60 % of every node, saved, loaded and scored on the rest."""
    v = _vectors(spark, sf_dir)
    grown = forest.same_node_forests(v, _VCOLS, **_SHALLOW)
    path = _scratch(spark, "forests")
    grown.save(path)
    rest = sampling.positional_split(v).where("split = 'test'")
    return keyed_forest.judge_saved(path, rest, model=["node"])


register("l05_score_saved_forest", _shallow_twin(_SAME_NODE, _PREDICTED))(l05_score_saved_forest)


def l07_shallow_predictions(spark, sf_dir):
    """Per node five contiguous folds, unbalanced, trees of depth two."""
    return forest.node_fold_forests(_vectors(spark, sf_dir), _VCOLS, balance=False, **_SHALLOW).predictions()


register("l07_shallow_predictions", _shallow_twin(
    "  SELECT node || ':' || run AS model, node, pos, label, fold = run AS test FROM (SELECT *, ntile(5) OVER (PARTITION BY node ORDER BY pos) - 1 AS fold FROM v), range(5) r(run)",
    _PREDICTED))(l07_shallow_predictions)


def l08_shallow_importance(spark, sf_dir):
    """Importances of the per-node forests of ``l02_shallow_predictions``."""
    return round_doubles(forest.same_node_forests(_vectors(spark, sf_dir), _VCOLS, **_SHALLOW).importances())


register("l08_shallow_importance", _shallow_twin(_SAME_NODE, f"""
SELECT model, 'f' || feature AS feature, {qz('importance')} AS importance, row_number() OVER (PARTITION BY model ORDER BY importance DESC, 'f' || feature) AS rank FROM (
  SELECT model, feature, coalesce(g / sum(g) OVER (PARTITION BY model), 0) AS importance
  FROM (SELECT * FROM (SELECT DISTINCT model FROM gains), range({tv.VECTOR_DIMS}) d(feature)) LEFT JOIN (
    SELECT model, feature, sum(g) AS g FROM (SELECT model, tree, feature, sum(gain) / sum(sum(gain)) OVER (PARTITION BY model, tree) AS g FROM gains GROUP BY model, tree, feature)
    GROUP BY model, feature) USING (model, feature))"""))(l08_shallow_importance)


def l09_rfe(spark, sf_dir):
    return selection.rfe(_vectors(spark, sf_dir), _VCOLS, 4, step=12)


register("l09_rfe")(l09_rfe)


def l10_rfecv(spark, sf_dir):
    curve, sel = selection.rfecv(_vectors(spark, sf_dir), _VCOLS, k=5, step=21)
    n_sel = sel.where(F.col("selected")).count()  # scalar
    return curve.withColumn("n_selected", F.lit(n_sel))


register("l10_rfecv")(l10_rfecv)


def l11_lasso_selection(spark, sf_dir):
    return round_doubles(selection.lasso_selection(_vectors(spark, sf_dir), _VCOLS))


register("l11_lasso_selection")(l11_lasso_selection)


_LASSO = ["l_quantity", "l_discount", "l_tax", "label"]


def l11_lasso_path(spark, sf_dir):
    """What a lasso of the price finds among four columns: coefficients at the chosen penalty."""
    coefs, curve = l1_models.lasso_path(tv.windows_big(spark, sf_dir), _LASSO, label="l_extendedprice")
    best = curve.agg(F.min_by("alpha", F.struct("mse", -F.col("alpha"))).alias("alpha"))
    return round_doubles(coefs.crossJoin(F.broadcast(best)), 3)  # one row


def _lasso_twin(sweeps: int = 12) -> str:
    """Coordinate descent as recursion: a step is a sweep, ``sweeps`` of them to a penalty."""
    x, d = _LASSO, len(_LASSO)
    g = [f"covar_pop({x[i]}, {x[j]}) AS g{i}{j}" for i in range(d) for j in range(d)]
    c = [f"covar_pop({a}, l_extendedprice) AS c{i}, avg({a}) AS m{i}" for i, a in enumerate(x)]
    step = "SELECT * FROM s"
    for i in range(d):
        pull = f"(c{i} - ({' + '.join(f'g{i}{j} * w{j}' for j in range(d) if j != i)}))"
        step = f"SELECT * REPLACE (sign({pull}) * greatest(abs({pull}) - alpha, 0) / g{i}{i} AS w{i}) FROM ({step})"
    ws = ", ".join(f"w{i}" for i in range(d))
    fit = " + ".join(f"w{i} * ({a} - m{i})" for i, a in enumerate(x))
    extra = [
        ("sizes", "  SELECT node, count(*) AS n FROM windows_big GROUP BY node"),
        ("train", "  SELECT *, ntile(5) OVER (PARTITION BY node ORDER BY pos) - 1 AS fold FROM windows_big JOIN sizes USING (node) WHERE pos <= floor(n * 6 / 10)"),
        ("stats", f"  SELECT h, {', '.join(g + c)}, avg(l_extendedprice) AS my FROM train, (VALUES (-1), (0), (1), (2), (3), (4)) v(h) WHERE fold <> h GROUP BY h"),
        ("top", f"  SELECT greatest({', '.join(f'abs(c{i})' for i in range(d))}) AS top FROM stats WHERE h = -1"),
        ("walk", f"  SELECT h, 0 AS k, {', '.join(f'0.0::DOUBLE AS w{i}' for i in range(d))} FROM stats\n  UNION ALL\n"
                 f"  SELECT h, k + 1, {ws} FROM (WITH s AS (SELECT walk.*, stats.* EXCLUDE (h), top * pow(0.001, (k // {sweeps}) / 99) AS alpha FROM walk JOIN stats ON walk.h = stats.h, top WHERE k < {100 * sweeps}) {step})"),
        ("path", f"  SELECT *, k // {sweeps} - 1 AS a FROM walk WHERE k > 0 AND k % {sweeps} = 0"),
        ("errors", f"  SELECT a, h, avg(pow(l_extendedprice - my - ({fit}), 2)) AS mse FROM train JOIN path ON path.h = fold JOIN stats ON stats.h = fold GROUP BY a, h".replace("SELECT a, h,", "SELECT a, path.h,").replace("GROUP BY a, h", "GROUP BY a, path.h")),
        ("best", "  SELECT a FROM (SELECT a, avg(mse) AS e FROM errors GROUP BY a) ORDER BY e, a LIMIT 1"),
    ]
    sql = with_views("windows_big", extra=extra).replace("WITH ", "WITH RECURSIVE ", 1)
    return sql + f"SELECT unnest([{', '.join(repr(a) for a in x)}]) AS feature, unnest([{', '.join(qz(f'w{i}', 3) for i in range(d))}]) AS coef, {qz('top * pow(0.001, a / 99)', 3)} AS alpha FROM path JOIN best USING (a), top WHERE h = -1"


register("l11_lasso_path", _lasso_twin())(l11_lasso_path)


def l12_l1_logistic_selection(spark, sf_dir):
    return round_doubles(selection.l1_logistic_selection(_vectors(spark, sf_dir), _VCOLS, max_features=5))


register("l12_l1_logistic_selection")(l12_l1_logistic_selection)


def l13_l1_threshold_selection(spark, sf_dir):
    return round_doubles(l1_models.hinge_selection(_vectors(spark, sf_dir), _VCOLS))


register("l13_l1_threshold_selection")(l13_l1_threshold_selection)


def _node_points(spark, sf_dir):
    return tv.node_table(spark, sf_dir)


def l14_gmm_mahalanobis(spark, sf_dir):
    pts = profile.filtered_node_means(_node_points(spark, sf_dir), ["click", "error", "view"]) \
        .withColumn("nodename", F.col("node"))
    out, _, _ = clustering.gmm(pts, ["click", "error", "view"], k=3, seed=42)
    return round_doubles(out)


register("l14_gmm_mahalanobis")(l14_gmm_mahalanobis)


def l15_pca_node_means(spark, sf_dir):
    return round_doubles(clustering.pca_node_means(_node_points(spark, sf_dir), tv.EVENT_METRICS,
                                                   faults=[0, 1, 2, 3], apps=None))


register("l15_pca_node_means")(l15_pca_node_means)


def l16_clustering_job(spark, sf_dir):
    res = clustering.clustering_job(_node_points(spark, sf_dir), ["click", "error", "view"], k=3,
                                    faults=[0, 1], apps=[20, 21, 22], halves=True, threshold=2.0)
    return round_doubles(res["candidates"])


register("l16_clustering_job")(l16_clustering_job)


def _series(spark, sf_dir):
    return dtw.node_series(_node_points(spark, sf_dir), ["click", "error", "view"])


def l17_dtw_kmeans(spark, sf_dir):
    assign, _ = dtw.dtw_kmeans(_series(spark, sf_dir), 3, max_iter=3, max_iter_barycenter=2)
    return round_doubles(assign)


register("l17_dtw_kmeans")(l17_dtw_kmeans)


def l18_nearest_nodes(spark, sf_dir):
    s = _series(spark, sf_dir)
    _, cents = dtw.dtw_kmeans(s, 3, max_iter=2, max_iter_barycenter=1)
    return round_doubles(dtw.nearest_nodes(s, cents))


register("l18_nearest_nodes")(l18_nearest_nodes)


def s16_run_config(spark, sf_dir):
    """The parameters of a run are written beside its results and read back: whether
    halves were asked for, and which rows, decides what the next run computes."""
    path = _scratch(spark, "run")
    table = _node_points(spark, sf_dir)
    sinks.write_run_config(spark, f"{path}/config", faults=[0, 1], apps=[20, 21, 22], columns=["click", "error", "view"], halves=True)
    run = sinks.read_run_config(spark, f"{path}/config")
    means = profile.filtered_half_means if run["halves"] else profile.filtered_node_means
    sinks.write_table(means(table, run["columns"], faults=run["faults"], apps=run["apps"]), f"{path}/means")
    return round_doubles(spark.read.parquet(f"{path}/means"))


_IN_RUN = "fault IN (0, 1) AND app IN (20, 21, 22)"
register("s16_run_config", with_views("node_table", extra=[
    ("h", "  SELECT *, CASE WHEN pos <= floor(count(*) OVER (PARTITION BY node) / 2) THEN 1 ELSE 2 END AS half FROM node_table")]) +
    "SELECT node, half, " + ", ".join(f"{qz(f'avg(CASE WHEN {_IN_RUN} THEN {c} END)')} AS {c}" for c in ("click", "error", "view")) +
    ", node || '_' || half AS nodename FROM h GROUP BY node, half")(s16_run_config)


def l08_top_n_refit(spark, sf_dir):
    """The eight most important features of the first 60 % refitted, the rest scored."""
    v = sampling.positional_split(_vectors(spark, sf_dir))
    return round_doubles(selection.top_n_refit(v.where("split = 'train'"), v.where("split = 'test'"), _VCOLS, 8))


register("l08_top_n_refit")(l08_top_n_refit)


def l16_pca_clustering(spark, sf_dir):
    """The clustering job on components: node-local PCA, mixture, outliers, prototypes."""
    res = clustering.clustering_job(_node_points(spark, sf_dir), tv.EVENT_METRICS, k=3, faults=[0, 1, 2, 3], apps=None, method="pca", threshold=2.0)
    return round_doubles(res["clustered"])


register("l16_pca_clustering")(l16_pca_clustering)


_DTW_START, _DTW_LENGTH = 100, 24
_DTW_METRICS = ["l_quantity", "l_tax"]


def l18_nearest_to_means(spark, sf_dir):
    """On a positional range (S5): suppliers in three groups, their mean series per
    group, and the supplier whose series is nearest to each."""
    w = readers.positional_range(tv.windows_big(spark, sf_dir), _DTW_START, _DTW_LENGTH)
    scaled = features.zscore_scale(w, _DTW_METRICS)
    means = scaled.groupBy((F.col("node") % 3).alias("g"), "pos").agg(*(F.avg(m).alias(m) for m in _DTW_METRICS)).orderBy("g", "pos").collect()  # 3 x 24 x 2 numbers
    cents = [np.array([[r[m] for m in _DTW_METRICS] for r in means if r["g"] == g]) for g in range(3)]
    return round_doubles(dtw.nearest_nodes(dtw.node_series(w, _DTW_METRICS, start=_DTW_START, length=_DTW_LENGTH), cents))


def _dtw_twin():
    T, a, b = _DTW_LENGTH, *_DTW_METRICS
    cost = "pow(a1[i] - b1[{j}], 2) + pow(a2[i] - b2[{j}], 2)"
    far = "'Infinity'::DOUBLE"
    cell = (f"CASE WHEN k + 3 - i BETWEEN 1 AND {T} THEN {cost.format(j='(k + 3 - i)')} + least(last[i], "
            f"CASE WHEN i > 1 THEN least(last[i - 1], before[i - 1]) ELSE {far} END) ELSE {far} END")
    z = lambda m: f"coalesce(({m} - avg({m}) OVER (PARTITION BY node)) / nullif(stddev_pop({m}) OVER (PARTITION BY node), 0), 0)"
    extra = [
        ("scaled", f"  SELECT node, pos, {z(a)} AS x, {z(b)} AS y FROM windows_big WHERE pos BETWEEN {_DTW_START} AND {_DTW_START + T - 1}"),
        ("series", "  SELECT node, list(x ORDER BY pos) AS a1, list(y ORDER BY pos) AS a2 FROM scaled GROUP BY node"),
        ("means", "  SELECT g, list(x ORDER BY pos) AS b1, list(y ORDER BY pos) AS b2 FROM (SELECT node % 3 AS g, pos, avg(x) AS x, avg(y) AS y FROM scaled GROUP BY 1, 2) GROUP BY g"),
        ("walk", f"  SELECT node, g, a1, a2, b1, b2, 0 AS k, list_transform(range(1, {T + 1}), lambda i: {far}) AS before,\n"
                 f"    list_transform(range(1, {T + 1}), lambda i: CASE WHEN i = 1 THEN {cost.format(j='1')} ELSE {far} END) AS last FROM series, means\n  UNION ALL\n"
                 f"  SELECT node, g, a1, a2, b1, b2, k + 1, last, list_transform(range(1, {T + 1}), lambda i: {cell}) FROM walk WHERE k < {2 * T - 2}"),
        ("ends", f"  SELECT node, g, sqrt(last[{T}]) AS d, row_number() OVER (PARTITION BY g ORDER BY last[{T}], node) AS r FROM walk WHERE k = {2 * T - 2}"),
    ]
    return with_views("windows_big", extra=extra).replace("WITH ", "WITH RECURSIVE ", 1) + \
        f"SELECT g::INT AS centroid, node, {qz('d')} AS dtw FROM ends WHERE r = 1"


register("l18_nearest_to_means", _dtw_twin())(l18_nearest_to_means)


def j08_candidate_rows(spark, sf_dir):
    """The rows of the suppliers that ``l18_nearest_to_means`` finds, by name."""
    found = l18_nearest_to_means(spark, sf_dir).select("node", "centroid")
    rows = tv.windows_big(spark, sf_dir).join(F.broadcast(found), "node")  # one row per centroid
    return round_doubles(rows.groupBy("centroid", "node").agg(F.count(F.lit(1)).alias("n_rows"), F.avg("l_quantity").alias("quantity")))


register("j08_candidate_rows", _dtw_twin().rsplit("SELECT g::INT", 1)[0] + f"""SELECT g::INT AS centroid, w.node, count(*) AS n_rows, {qz('avg(l_quantity)')} AS quantity
FROM ends JOIN windows_big w ON w.node = ends.node WHERE r = 1 GROUP BY g, w.node""")(j08_candidate_rows)


def f10_mahalanobis(spark, sf_dir):
    """Distance of every node to its cluster (node number by 4) over mean and
    spread of its readings, the 2 x 2 covariance inverted in closed form."""
    p = tv.readings(spark, sf_dir).groupBy("node", "node_no").agg(F.avg("value").alias("x"), F.stddev_pop("value").alias("y")) \
        .withColumn("cluster", F.col("node_no") % 4)
    c = p.groupBy("cluster").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_samp("x").alias("vx"),
                                 F.var_samp("y").alias("vy"), F.covar_samp("x", "y").alias("cxy"))
    det = F.col("vx") * F.col("vy") - F.col("cxy") * F.col("cxy")
    inverse = [[F.col("vy") / det, -F.col("cxy") / det], [-F.col("cxy") / det, F.col("vx") / det]]
    d = fx.mahalanobis([F.col("x") - F.col("mx"), F.col("y") - F.col("my")], inverse)
    return round_doubles(p.join(c, "cluster").select("node", "cluster", d.alias("distance")))


register("f10_mahalanobis", with_views("readings", extra=[
    ("p", "  SELECT node, node_no % 4 AS cluster, avg(value) AS x, stddev_pop(value) AS y FROM readings GROUP BY node, node_no"),
    ("c", "  SELECT cluster, avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, var_samp(y) AS d, covar_samp(x, y) AS b FROM p GROUP BY cluster")]) +
    f"""SELECT node, cluster, {qz('sqrt((d * (x - mx) ** 2 - 2 * b * (x - mx) * (y - my) + a * (y - my) ** 2) / (a * d - b * b))')} AS distance
FROM p JOIN c USING (cluster)""")(f10_mahalanobis)
