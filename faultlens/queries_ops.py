"""Registered queries for profiling, sampling, metrics and comparison operators.

Imported by ``faultlens.queries`` (same registry).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from faultlens.constants import FAULT_NAMES
from faultlens.functions import scalar as fx
from faultlens.oracles import with_views
from faultlens.operators import compare, metrics, profile, sampling
from faultlens.operators.positions import add_positions, ranked
from faultlens.queries import ORACLES, qz, register, round_doubles
from faultlens.session import shared_path
from faultlens.sources import sinks
from faultlens.sources import telemetry as tv

# ---------------------------------------------------------------------------
# shared SQL snippets
# ---------------------------------------------------------------------------
_NAMES_SQL = "(VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(FAULT_NAMES)) + ") AS nm(fault, class_name)"


def conf_ctes(src: str, g: str) -> list[tuple[str, str]]:
    return [
        ("pc", f"  SELECT {g}, y, pred, count(*) AS n FROM {src} GROUP BY {g}, y, pred"),
        ("contrib", f"  SELECT {g}, y AS cls, CASE WHEN y = pred THEN n ELSE 0 END AS tp, 0 AS fp, "
                    f"CASE WHEN y <> pred THEN n ELSE 0 END AS fn FROM pc\n  UNION ALL "
                    f"SELECT {g}, pred AS cls, 0 AS tp, n AS fp, 0 AS fn FROM pc WHERE y <> pred"),
        ("per", f"  SELECT {g}, cls, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, "
                f"CAST(sum(fn) AS BIGINT) AS fn FROM contrib GROUP BY {g}, cls"),
        ("tot", f"  SELECT {g}, CAST(sum(n) AS BIGINT) AS total FROM pc GROUP BY {g}"),
        ("conf", f"  SELECT per.*, total - tp - fp - fn AS tn FROM per JOIN tot USING ({g})"),
    ]


def _div(a: str, b: str) -> str:
    return f"CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0)"


METRIC_SQL = {
    "f1": _div("2 * tp", "2 * tp + fp + fn"),
    "sensitivity": _div("tp", "tp + fn"),
    "specificity": _div("tn", "tn + fp"),
    "fp_rate": _div("fp", "fp + tn"),
    "fn_rate": _div("fn", "fn + tp"),
}


def scores_ctes(g: str, metric_names, zero_division: float = 0.0, conf: str = "conf") -> list[tuple[str, str]]:
    parts = []
    for m in metric_names:
        e = METRIC_SQL[m]
        if m == "f1":
            e = f"coalesce({e}, {float(zero_division)!r})"
        parts.append(f"  SELECT {g}, cls, tp + fn AS support, '{m}' AS metric, {e} AS score FROM {conf}")
    return [("per_m", "\n  UNION ALL\n".join(parts)),
            ("overall", f"  SELECT {g}, metric, sum(score * support) / sum(support) AS score FROM per_m "
                        f"WHERE support > 0 GROUP BY {g}, metric"),
            ("scores", f"  SELECT {g}, metric, CAST(cls AS VARCHAR) AS cls, score FROM per_m\n  UNION ALL\n"
                       f"  SELECT {g}, metric, 'overall' AS cls, score FROM overall")]


def _scores_spark(spark, sf_dir, names, group=("node",), **kw):
    p = tv.predictions(spark, sf_dir)
    return metrics.scores(p, list(group), metrics=names, **kw)


def _scores_query(name, mnames, **kw):
    def q(spark, sf_dir):
        return round_doubles(_scores_spark(spark, sf_dir, mnames, **kw))
    sql = with_views("predictions", extra=conf_ctes("predictions", "node") + scores_ctes("node", mnames)) + \
        f"SELECT node, metric, cls, {qz('score')} AS score FROM scores"
    register(name, sql)(q)


# A12-A19 ---------------------------------------------------------------------
def a12_confusion_counts(spark, sf_dir):
    return metrics.confusion(tv.predictions(spark, sf_dir), ["node"])


register("a12_confusion_counts", with_views("predictions", extra=conf_ctes("predictions", "node")) +
         "SELECT node, cls, tp, fp, fn, tn FROM conf")(a12_confusion_counts)

_scores_query("a13_f1_scores", ["f1"])
_scores_query("a16_sensitivity", ["sensitivity"])
_scores_query("a17_specificity", ["specificity"])
_scores_query("a18_fp_rate", ["fp_rate"])
_scores_query("a19_fn_rate", ["fn_rate"])


def a14_f1_zero_division(spark, sf_dir):
    return round_doubles(_scores_spark(spark, sf_dir, ["f1"], zero_division=1.0, labels=list(range(8))))


register("a14_f1_zero_division", with_views("predictions", extra=conf_ctes("predictions", "node") + [
    ("fullc", "  SELECT k.node, l.cls FROM (SELECT DISTINCT node FROM conf) k, "
             "(SELECT unnest(range(8)) AS cls) l"),
    ("conf8", "  SELECT fullc.node, fullc.cls, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, "
              "coalesce(tn, total) AS tn FROM fullc LEFT JOIN conf USING (node, cls) JOIN tot USING (node)"),
] + scores_ctes("node", ["f1"], 1.0, conf="conf8")) + f"SELECT node, metric, cls, {qz('score')} AS score FROM scores")(
    a14_f1_zero_division)


def a17_rates_with_absent_classes(spark, sf_dir):
    return round_doubles(_scores_spark(spark, sf_dir, ["specificity", "fp_rate"], labels=list(range(8))))


register("a17_rates_with_absent_classes", with_views("predictions", extra=conf_ctes("predictions", "node") + [
    ("fullc", "  SELECT k.node, l.cls FROM (SELECT DISTINCT node FROM conf) k, "
             "(SELECT unnest(range(8)) AS cls) l"),
    ("negatives", "  SELECT f.node, f.cls, count(*) AS rest, count(*) FILTER (WHERE p.pred <> f.cls) AS right "
                  "FROM fullc f JOIN predictions p ON p.node = f.node AND p.y <> f.cls GROUP BY f.node, f.cls"),
] + scores_ctes("node", ["specificity", "fp_rate"])) + f"""
SELECT node, 'specificity' AS metric, CAST(cls AS VARCHAR) AS cls, {qz('"right" / rest')} AS score
FROM fullc LEFT JOIN negatives USING (node, cls)
UNION ALL SELECT node, 'fp_rate' AS metric, CAST(cls AS VARCHAR) AS cls, {qz('(rest - "right") / rest')} AS score
FROM fullc LEFT JOIN negatives USING (node, cls)
UNION ALL SELECT node, metric, cls, {qz('score')} AS score FROM scores WHERE cls = 'overall'""")(
    a17_rates_with_absent_classes)


def a15_class_accuracy(spark, sf_dir):
    return round_doubles(metrics.class_accuracy(tv.predictions(spark, sf_dir), ["node"]))


register("a15_class_accuracy", with_views("predictions") +
         f"SELECT node, y, {qz('avg(CASE WHEN y = pred THEN 1.0 ELSE 0.0 END)')} AS class_accuracy "
         "FROM predictions GROUP BY node, y")(a15_class_accuracy)


def _pred_pos(spark, sf_dir):
    return add_positions(tv.predictions(spark, sf_dir), "node", "event_id")


def a20_fold_means(spark, sf_dir):
    p = sampling.kfold(_pred_pos(spark, sf_dir), 5, node="node", pos="pos")
    fs = metrics.scores(p, ["node", "fold"], metrics=["f1"])
    return round_doubles(metrics.fold_means(fs, ["node"]))


register("a20_fold_means", with_views("predictions", extra=[
    ("pp", "  SELECT *, ntile(5) OVER (PARTITION BY node ORDER BY event_id) - 1 AS fold FROM predictions"),
] + conf_ctes("pp", "node, fold") + scores_ctes("node, fold", ["f1"])) + f"""
SELECT node, metric, cls, {qz('avg(score)')} AS score, count(fold) AS n_folds FROM scores GROUP BY node, metric, cls""")(
    a20_fold_means)


def a20_fold_table(spark, sf_dir):
    p = sampling.kfold(_pred_pos(spark, sf_dir), 5, node="node", pos="pos")
    return round_doubles(metrics.fold_table(metrics.scores(p, ["node", "fold"], metrics=["f1"]), ["node"]))


register("a20_fold_table", with_views("predictions", extra=[
    ("pp", "  SELECT *, ntile(5) OVER (PARTITION BY node ORDER BY event_id) - 1 AS fold FROM predictions"),
] + conf_ctes("pp", "node, fold") + scores_ctes("node, fold", ["f1"])) + f"""
SELECT node, metric, cls, CAST(fold AS VARCHAR) AS fold, {qz('score')} AS score FROM scores
UNION ALL SELECT node, metric, cls, 'all' AS fold, {qz('avg(score)')} AS score FROM scores GROUP BY node, metric, cls""")(
    a20_fold_table)


# A2-A11, P11, A21-A22 -------------------------------------------------------
def a02_value_counts(spark, sf_dir):
    return profile.value_counts(tv.readings(spark, sf_dir), "fault", names=True)


register("a02_value_counts", with_views("readings") +
         f"SELECT r.fault, count(*) AS n, nm.class_name FROM readings r LEFT JOIN {_NAMES_SQL} "
         "ON r.fault = nm.fault GROUP BY r.fault, nm.class_name")(a02_value_counts)


def a03_distinct_values(spark, sf_dir):
    return profile.distinct_values(tv.readings(spark, sf_dir), "app")


register("a03_distinct_values", with_views("readings") + "SELECT DISTINCT app FROM readings")(a03_distinct_values)

_A4_FAULTS, _A4_APPS = [0, 1], [20, 21]


def _a4_sql(agg: str) -> str:
    cond = "fault IN (0, 1) AND app IN (20, 21)"
    f = (lambda m: f"avg(CASE WHEN {cond} THEN {m} END)") if agg == "mean" else \
        (lambda m: f"coalesce(sum(CASE WHEN {cond} THEN {m} END), 0.0)")
    return ", ".join(f"{qz(f(m))} AS {m}" for m in ["click", "error", "view"])


def a04_filtered_node_means(spark, sf_dir):
    t = tv.node_table(spark, sf_dir)
    return round_doubles(profile.filtered_node_means(t, ["click", "error", "view"], faults=_A4_FAULTS,
                                                     apps=_A4_APPS))


register("a04_filtered_node_means", with_views("node_table") +
         f"SELECT node, {_a4_sql('mean')} FROM node_table GROUP BY node")(a04_filtered_node_means)


def a06_filtered_node_sums(spark, sf_dir):
    t = tv.node_table(spark, sf_dir)
    return round_doubles(profile.filtered_node_means(t, ["click", "error", "view"], faults=_A4_FAULTS,
                                                     apps=_A4_APPS, agg="sum"))


register("a06_filtered_node_sums", with_views("node_table") +
         f"SELECT node, {_a4_sql('sum')} FROM node_table GROUP BY node")(a06_filtered_node_sums)


def a05_half_means(spark, sf_dir):
    t = tv.node_table(spark, sf_dir)
    return round_doubles(profile.filtered_half_means(t, ["click", "error", "view"], faults=_A4_FAULTS,
                                                     apps=_A4_APPS))


register("a05_half_means", with_views("node_table", extra=[
    ("h", "  SELECT *, CASE WHEN pos <= floor(count(*) OVER (PARTITION BY node) / 2) THEN 1 ELSE 2 END AS half "
          "FROM node_table")]) +
    f"SELECT node, half, {_a4_sql('mean')}, node || '_' || CAST(half AS VARCHAR) AS nodename "
    "FROM h GROUP BY node, half")(a05_half_means)


def a07_mean_std(spark, sf_dir):
    r = compare.select_runs(tv.readings(spark, sf_dir), faults=[0], apps=[21])
    return round_doubles(profile.mean_std(r, ["node"], "value"))


register("a07_mean_std", with_views("readings") +
         f"SELECT node, {qz('avg(value)')} AS mean, {qz('stddev_samp(value)')} AS std FROM readings "
         "WHERE fault = 0 AND app = 21 GROUP BY node")(a07_mean_std)


def a08_box_stats(spark, sf_dir):
    return round_doubles(profile.box_stats(tv.readings(spark, sf_dir), ["metric"], "value"))


_BOX_SQL = """q AS (SELECT {g}, quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.5) AS median,
  quantile_cont({v}, 0.75) AS q3, avg({v}) AS mean, count({v}) AS n FROM {src} GROUP BY {g}),
j AS (SELECT s.{v}, q.* FROM {src} s JOIN q USING ({g}))
SELECT {g}, {q1} AS q1, {med} AS median, {q3} AS q3, {mean} AS mean, n,
  {wl} AS whisker_low, {wh} AS whisker_high,
  count(CASE WHEN {v} < q1 - 1.5 * (q3 - q1) OR {v} > q3 + 1.5 * (q3 - q1) THEN {v} END) AS n_outliers
FROM j GROUP BY {g}, q1, median, q3, mean, n"""


def box_sql(src: str, g: str, v: str) -> str:
    return _BOX_SQL.format(g=g, v=v, src=src, q1=qz("q1"), med=qz("median"), q3=qz("q3"), mean=qz("mean"),
                           wl=qz(f"min(CASE WHEN {v} >= q1 - 1.5 * (q3 - q1) THEN {v} END)"),
                           wh=qz(f"max(CASE WHEN {v} <= q3 + 1.5 * (q3 - q1) THEN {v} END)"))


register("a08_box_stats", with_views("readings") + ",\n" + box_sql("readings", "metric", "value"))(a08_box_stats)


def a09_horizontal_cpu_stats(spark, sf_dir):
    w = tv.cpu_wide(spark, sf_dir)
    from faultlens.operators.features import cpu_groups, horizontal_stats
    out = horizontal_stats(w, cpu_groups(w.columns))
    return round_doubles(out.select("node", "l_orderkey", "l_partkey", "l_linenumber",
                                    *[f"`m.{s}`" for s in ["min", "max", "perc25", "perc75", "mean"]]))


_CPU = ['"cpu0/m"', '"cpu1/m"', '"cpu2/m"', '"cpu3/m"']
register("a09_horizontal_cpu_stats", with_views("cpu_wide", extra=[
    ("l", f"  SELECT node, l_orderkey, l_partkey, l_linenumber, list_filter([{', '.join(_CPU)}], lambda x: x IS NOT NULL) AS a "
          "FROM cpu_wide")]) + f"""
SELECT node, l_orderkey, l_partkey, l_linenumber, {qz('list_min(a)')} AS "m.min", {qz('list_max(a)')} AS "m.max",
  {qz('list_extract(list_sort(a), CAST(floor((len(a) - 1) * 0.25) AS INTEGER) + 1) + (list_extract(list_sort(a), least(CAST(floor((len(a) - 1) * 0.25) AS INTEGER) + 2, len(a))) - list_extract(list_sort(a), CAST(floor((len(a) - 1) * 0.25) AS INTEGER) + 1)) * ((len(a) - 1) * 0.25 - floor((len(a) - 1) * 0.25))')} AS "m.perc25",
  {qz('list_extract(list_sort(a), CAST(floor((len(a) - 1) * 0.75) AS INTEGER) + 1) + (list_extract(list_sort(a), least(CAST(floor((len(a) - 1) * 0.75) AS INTEGER) + 2, len(a))) - list_extract(list_sort(a), CAST(floor((len(a) - 1) * 0.75) AS INTEGER) + 1)) * ((len(a) - 1) * 0.75 - floor((len(a) - 1) * 0.75))')} AS "m.perc75",
  {qz('list_sum(a) / len(a)')} AS "m.mean"
FROM l""")(a09_horizontal_cpu_stats)


def a10_correlation_matrix(spark, sf_dir):
    return round_doubles(profile.correlation_matrix(tv.windows_big(spark, sf_dir), tv.LINEITEM_METRICS))


def _pearson_sql(a, b):
    keep = f"FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
    return f"covar_pop({a}, {b}) {keep} / NULLIF(stddev_pop({a}) {keep} * stddev_pop({b}) {keep}, 0)"


_pairs = [(a, b) for i, a in enumerate(tv.LINEITEM_METRICS) for b in tv.LINEITEM_METRICS[i + 1:]]
register("a10_correlation_matrix", with_views("windows_big") + "\n UNION ALL ".join(
    [f"SELECT '{a}' AS a, '{b}' AS b, {qz(_pearson_sql(a, b))} AS corr FROM windows_big" for a, b in _pairs]
    + [f"SELECT '{b}' AS a, '{a}' AS b, {qz(_pearson_sql(a, b))} AS corr FROM windows_big" for a, b in _pairs]
    + [f"SELECT '{c}' AS a, '{c}' AS b, 1.0 AS corr" for c in tv.LINEITEM_METRICS]))(a10_correlation_matrix)


def a11_target_correlation(spark, sf_dir):
    return round_doubles(profile.target_correlation(tv.windows_big(spark, sf_dir), tv.LINEITEM_METRICS, "label"))


register("a11_target_correlation", with_views("windows_big") + "\n UNION ALL ".join(
    f"SELECT '{c}' AS feature, {qz('abs(' + _pearson_sql(c, 'label') + ')')} AS abs_corr FROM windows_big"
    for c in tv.LINEITEM_METRICS))(a11_target_correlation)


def a21_class_count_targets(spark, sf_dir):
    c = sampling.class_counts(tv.windows_big(spark, sf_dir), "label", ["node"])
    t1 = sampling.targets(c, "label", ["node"], "majority").withColumnRenamed("target", "t_majority")
    t2 = sampling.targets(c, "label", ["node"], "majority_mean").select("node", "label",
                                                                       F.col("target").alias("t_majority_mean"))
    t3 = sampling.targets(c, "label", ["node"], "minority_mean").select("node", "label",
                                                                       F.col("target").alias("t_minority_mean"))
    return t1.join(t2, ["node", "label"]).join(t3, ["node", "label"])


_TARGET_CTES = [
    ("cnt", "  SELECT node, label, count(*) AS n FROM windows_big GROUP BY node, label"),
    ("r", "  SELECT *, row_number() OVER (PARTITION BY node ORDER BY n DESC, label) AS big, "
          "row_number() OVER (PARTITION BY node ORDER BY n, label) AS small, min(n) OVER (PARTITION BY node) AS mn, "
          "CAST(floor((sum(n) OVER (PARTITION BY node) - max(n) OVER (PARTITION BY node)) / "
          "(count(*) OVER (PARTITION BY node) - 1)) AS BIGINT) AS omb, "
          "CAST(floor((sum(n) OVER (PARTITION BY node) - min(n) OVER (PARTITION BY node)) / "
          "(count(*) OVER (PARTITION BY node) - 1)) AS BIGINT) AS oms FROM cnt"),
]
register("a21_class_count_targets", with_views("windows_big", extra=_TARGET_CTES) + """
SELECT node, label, n, CASE WHEN big = 1 THEN mn ELSE n END AS t_majority,
  CASE WHEN big = 1 THEN least(n, omb) ELSE n END AS t_majority_mean,
  CASE WHEN small = 1 THEN least(n, oms) ELSE n END AS t_minority_mean FROM r""")(a21_class_count_targets)


def a22_node_row_ranges(spark, sf_dir):
    return profile.node_row_ranges(tv.readings(spark, sf_dir), "node", "node_no")


register("a22_node_row_ranges", with_views("readings") + """
SELECT node, node_no, n, coalesce(sum(n) OVER (ORDER BY node_no, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  AS start, coalesce(sum(n) OVER (ORDER BY node_no, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n - 1 AS "end"
FROM (SELECT node, node_no, count(*) AS n FROM readings GROUP BY node, node_no)""")(a22_node_row_ranges)


def a22_fold_ranges(spark, sf_dir):
    p = sampling.kfold(_pred_pos(spark, sf_dir), 5)
    return profile.fold_ranges(p, ["node"], "fold", "pos")


register("a22_fold_ranges", with_views("predictions") + """
SELECT node, fold, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n FROM (
  SELECT node, row_number() OVER (PARTITION BY node ORDER BY event_id) AS pos,
         ntile(5) OVER (PARTITION BY node ORDER BY event_id) - 1 AS fold FROM predictions)
GROUP BY node, fold""")(a22_fold_ranges)


def p11_null_profile(spark, sf_dir):
    return profile.null_profile(tv.cpu_wide(spark, sf_dir))


_CPU_COLS = [("node", "bigint"), ("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_linenumber", "int"),
             ("cpu0/m", "double"), ("cpu1/m", "double"), ("cpu2/m", "double"), ("cpu3/m", "double"),
             ("power", "double"), ("faultLabel", "int")]
register("p11_null_profile", with_views("cpu_wide") + "\n UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count(\"{c}\") AS non_null, count(*) - count(\"{c}\") AS nulls "
    f"FROM cpu_wide" for c, t in _CPU_COLS))(p11_null_profile)


# P2-P10, F1-F9, F11 -----------------------------------------------------------
def p02_drop_cpu_columns(spark, sf_dir):
    return compare.drop_columns_matching(tv.cpu_wide(spark, sf_dir), r"cpu[0-9]")


register("p02_drop_cpu_columns", with_views("cpu_wide") +
         'SELECT node, l_orderkey, l_partkey, l_linenumber, power, "faultLabel" FROM cpu_wide')(p02_drop_cpu_columns)


def p03_drop_columns_alternation(spark, sf_dir):
    return compare.drop_columns_matching(tv.cpu_wide(spark, sf_dir), r"cpu[0-9]+/m|power|l_partkey")


register("p03_drop_columns_alternation", with_views("cpu_wide") +
         'SELECT node, l_orderkey, l_linenumber, "faultLabel" FROM cpu_wide')(p03_drop_columns_alternation)


def p04_find_columns(spark, sf_dir):
    w = tv.cpu_wide(spark, sf_dir)
    cols = compare.columns_containing(w, "cpu")
    return w.select("node", "l_orderkey", "l_partkey", "l_linenumber", *[F.col(f"`{c}`") for c in cols])


register("p04_find_columns", with_views("cpu_wide") +
         'SELECT node, l_orderkey, l_partkey, l_linenumber, "cpu0/m", "cpu1/m", "cpu2/m", "cpu3/m" FROM cpu_wide')(
    p04_find_columns)


def p05_metric_from_path(spark, sf_dir):
    s = tv.sensor_paths(spark, sf_dir)
    return s.select("path", fx.metric_from_path("path").alias("metric"))


register("p05_metric_from_path", "SELECT path, regexp_replace(path, '(/[^/]+/)([^/]+/){3}', '') AS metric FROM ("
         "SELECT DISTINCT printf('/site/rack/chassis/n%05d/%s', user_id, event_type) "
         "AS path FROM events)")(p05_metric_from_path)


def p06_label_last(spark, sf_dir):
    return compare.label_last(tv.cpu_wide(spark, sf_dir), "faultLabel", "label", drop=["power", "busyLabel"])


register("p06_label_last", with_views("cpu_wide") + 'SELECT node, l_orderkey, l_partkey, l_linenumber, "cpu0/m", '
         '"cpu1/m", "cpu2/m", "cpu3/m", "faultLabel" AS label FROM cpu_wide')(p06_label_last)


def p07_fault_app_filter(spark, sf_dir):
    t = compare.select_runs(tv.node_table(spark, sf_dir), faults=[0, 1], apps=[20, 21])
    return round_doubles(t.select("node", "pos", "fault", "app", "click"))


register("p07_fault_app_filter", with_views("node_table") + f"SELECT node, pos, fault, app, {qz('click')} AS click "
         "FROM node_table WHERE fault IN (0, 1) AND app IN (20, 21)")(p07_fault_app_filter)


def p08_healthy_app_runs(spark, sf_dir):
    r = compare.select_runs(tv.readings(spark, sf_dir), faults=[0], apps=[23])
    return round_doubles(r.select("node", "event_id", "metric", "value"))


register("p08_healthy_app_runs", with_views("readings") + f"SELECT node, event_id, metric, {qz('value')} AS value "
         "FROM readings WHERE fault = 0 AND app = 23")(p08_healthy_app_runs)


def p09_node_range(spark, sf_dir):
    r = compare.select_runs(tv.readings(spark, sf_dir), node_range=(10, 40))
    return r.groupBy("node").agg(F.count(F.lit(1)).alias("n"))


register("p09_node_range", with_views("readings") + "SELECT node, count(*) AS n FROM readings "
         "WHERE CAST(substring(node, 2) AS INTEGER) BETWEEN 10 AND 40 GROUP BY node")(p09_node_range)


def p10_truncate_scores(spark, sf_dir):
    s = _scores_spark(spark, sf_dir, ["f1"])
    return compare.truncate_scores(s, ["score"], 2)


register("p10_truncate_scores", with_views("predictions", extra=conf_ctes("predictions", "node") +
                                           scores_ctes("node", ["f1"])) +
         "SELECT node, metric, cls, CAST(regexp_extract(CAST(score AS VARCHAR), '^[0-9]+([.][0-9]{1,2})?') AS DOUBLE) "
         "AS score FROM scores")(p10_truncate_scores)


def f01_ns_to_timestamp(spark, sf_dir):
    r = tv.readings(spark, sf_dir).select("event_id", (fx.epoch_micros("ts") * 1000 + 999).alias("ns"))
    return r.select("event_id", "ns", fx.epoch_micros(fx.ns_to_timestamp("ns")).alias("micros"))


register("f01_ns_to_timestamp", "SELECT event_id, epoch_us(ts) * 1000 + 999 AS ns, epoch_us(ts) AS micros "
         "FROM events")(f01_ns_to_timestamp)


def f02_floor_second(spark, sf_dir):
    r = tv.readings(spark, sf_dir)
    return r.select("event_id", fx.epoch_seconds(fx.floor_second("ts")).alias("sec"))


register("f02_floor_second", "SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS sec FROM events")(
    f02_floor_second)


def f03_regex_functions(spark, sf_dir):
    s = tv.sensor_paths(spark, sf_dir)
    return s.select("path", F.col("path").rlike("/n0000[0-9]/").alias("low_node"),
                    F.col("path").contains("click").alias("is_click"),
                    F.trim(F.regexp_replace("path", "/", " ")).alias("spaced"),
                    F.get(F.split("path", "/"), 4).alias("node_part"))


register("f03_regex_functions", """SELECT path, regexp_matches(path, '/n0000[0-9]/') AS low_node,
  contains(path, 'click') AS is_click, trim(replace(path, '/', ' ')) AS spaced, string_split(path, '/')[5] AS node_part
FROM (SELECT DISTINCT printf('/site/rack/chassis/n%05d/%s', user_id, event_type) AS path
      FROM events)""")(f03_regex_functions)


def f04_node_number(spark, sf_dir):
    return tv.readings(spark, sf_dir).select("node").distinct().select("node", fx.node_number("node").alias("k"))


register("f04_node_number", with_views("readings") +
         "SELECT DISTINCT node, TRY_CAST(substring(node, 2) AS INTEGER) AS k FROM readings")(f04_node_number)


def f05_abs_int_isin(spark, sf_dir):
    b = tv.windows_big(spark, sf_dir)
    return b.select("node", "pos", F.abs(F.col("l_discount") - F.col("l_tax")).alias("abs_gap"),
                    (F.col("l_extendedprice") / 1000).cast("int").alias("k_price"),
                    F.col("label").isin(0, 1, 2).alias("early_line"))


register("f05_abs_int_isin", with_views("windows_big") + """SELECT node, pos, abs(l_discount - l_tax) AS abs_gap,
  CAST(trunc(l_extendedprice / 1000) AS INTEGER) AS k_price, label IN (0, 1, 2) AS early_line FROM windows_big""")(
    f05_abs_int_isin)


def f06_nan_inf_replace(spark, sf_dir):
    b = tv.windows_big(spark, sf_dir)
    r = fx.safe_ratio(F.col("l_tax") - F.col("l_discount"), F.col("l_tax"), default=None)
    return round_doubles(b.select("node", "pos", fx.clean_correlation(r).alias("ratio")))


register("f06_nan_inf_replace", with_views("windows_big") +
         f"SELECT node, pos, {qz('coalesce((l_tax - l_discount) / NULLIF(l_tax, 0), 0)')} AS ratio FROM windows_big")(
    f06_nan_inf_replace)


def f07_minmax_scaling(spark, sf_dir):
    from faultlens.operators.features import minmax_scale
    ns = tv.positioned_seconds(spark, sf_dir)  # with its holes
    t = minmax_scale(ns, tv.EVENT_METRICS, part=("node",))
    return round_doubles(t.select("node", "pos", *tv.EVENT_METRICS, "fault"))


register("f07_minmax_scaling", with_views("ns_pos") + "SELECT node, pos, " + ", ".join(
    f"{qz(f'CASE WHEN {m} IS NOT NULL THEN coalesce(({m} - min({m}) OVER (PARTITION BY node)) / NULLIF(max({m}) OVER (PARTITION BY node) - min({m}) OVER (PARTITION BY node), 0), 0) END')} AS {m}"
    for m in tv.EVENT_METRICS) + ", fault FROM ns_pos")(f07_minmax_scaling)


def f08_zscore_per_node(spark, sf_dir):
    from faultlens.operators.features import zscore_scale
    v = tv.ml_vectors(spark, sf_dir)
    cols = [f"f{i}" for i in range(tv.VECTOR_DIMS)]
    return round_doubles(zscore_scale(v, cols, part=("node",)).select("vec_id", "node", *cols))


register("f08_zscore_per_node", with_views("ml_vectors") + "SELECT vec_id, node, " + ", ".join(
    f"{qz(f'CASE WHEN f{i} IS NOT NULL THEN coalesce((f{i} - avg(f{i}) OVER (PARTITION BY node)) / NULLIF(stddev_pop(f{i}) OVER (PARTITION BY node), 0), 0) END')} AS f{i}"
    for i in range(tv.VECTOR_DIMS)) + " FROM ml_vectors")(f08_zscore_per_node)


def f09_zscore_per_series(spark, sf_dir):
    from faultlens.operators.features import zscore_scale
    r = tv.readings(spark, sf_dir)
    return round_doubles(zscore_scale(r, ["value"], part=("node", "metric")).select("event_id", "value"))


register("f09_zscore_per_series", with_views("readings") + "SELECT event_id, " + qz(
    "CASE WHEN value IS NOT NULL THEN coalesce((value - avg(value) OVER (PARTITION BY node, metric)) / NULLIF(stddev_pop(value) OVER "
    "(PARTITION BY node, metric), 0), 0) END") + " AS value FROM readings")(f09_zscore_per_series)


# node-level clusters for W18/W21/K4/F11: per-node mean of all readings, cluster by node number
def _node_clusters(spark, sf_dir):
    r = tv.readings(spark, sf_dir)
    m = r.groupBy("node", "node_no").agg(F.avg("value").alias("c1"))
    m = m.withColumn("cluster", (F.col("node_no") % 4).cast("string"))
    avg = m.groupBy("cluster").agg(F.avg("c1").alias("_ca"), F.stddev_pop("c1").alias("_cs"))
    return m.join(avg, "cluster").withColumn(
        "distance", F.abs(F.col("c1") - F.col("_ca")) / F.col("_cs")).drop("_ca", "_cs")


_NODE_CLUSTERS_SQL = with_views("readings", extra=[
    ("m", "  SELECT node, node_no, avg(value) AS c1, CAST(node_no % 4 AS VARCHAR) AS cluster FROM readings "
          "GROUP BY node, node_no"),
    ("nc", "  SELECT m.*, abs(c1 - avg(c1) OVER (PARTITION BY cluster)) / stddev_pop(c1) OVER (PARTITION BY cluster) "
           "AS distance FROM m"),
])


def f11_outlier_marking(spark, sf_dir):
    c = _node_clusters(spark, sf_dir)
    return round_doubles(c.select("node", fx.outlier_label("cluster", "distance", 1.5).alias("cluster"), "distance"))


register("f11_outlier_marking", _NODE_CLUSTERS_SQL + f"SELECT node, CASE WHEN distance > 1.5 THEN 'outlier' "
         f"ELSE cluster END AS cluster, {qz('distance')} AS distance FROM nc")(f11_outlier_marking)


def w18_prototypes(spark, sf_dir):
    c = _node_clusters(spark, sf_dir).withColumn("cluster", fx.outlier_label("cluster", "distance", 1.5))
    return round_doubles(compare.prototypes(c).select("node", "cluster", "distance"))


register("w18_prototypes", _NODE_CLUSTERS_SQL + f""", o AS (SELECT node, CASE WHEN distance > 1.5 THEN 'outlier'
  ELSE cluster END AS cluster, distance FROM nc)
SELECT node, cluster, {qz('distance')} AS distance FROM (
  SELECT *, rank() OVER (PARTITION BY cluster ORDER BY distance) AS r FROM o WHERE cluster <> 'outlier') WHERE r = 1""")(
    w18_prototypes)


def w21_renumber_clusters(spark, sf_dir):
    c = _node_clusters(spark, sf_dir).withColumn(
        "cluster", fx.outlier_label(F.concat(F.lit("c"), F.col("cluster")), "distance", 1.5))
    return compare.renumber_clusters(c.select("node", "cluster"))


register("w21_renumber_clusters", _NODE_CLUSTERS_SQL + """, o AS (SELECT node, CASE WHEN distance > 1.5 THEN 'outlier'
  ELSE 'c' || cluster END AS cluster FROM nc)
SELECT node, CASE WHEN cluster = 'outlier' THEN 'outlier' ELSE CAST(dense_rank() OVER (PARTITION BY cluster = 'outlier'
  ORDER BY cluster) AS VARCHAR) END AS cluster FROM o""")(w21_renumber_clusters)


def k04_cluster_order(spark, sf_dir):
    c = _node_clusters(spark, sf_dir).withColumn("cluster", fx.outlier_label("cluster", "distance", 1.5))
    return c.select("node", "cluster", compare.cluster_order_key("cluster").alias("order_key"))


register("k04_cluster_order", _NODE_CLUSTERS_SQL + """SELECT node, cluster, CASE WHEN cluster = 'outlier' THEN 0
  ELSE TRY_CAST(cluster AS INTEGER) END AS order_key FROM (SELECT node, CASE WHEN distance > 1.5 THEN 'outlier'
  ELSE cluster END AS cluster FROM nc)""")(k04_cluster_order)


# Sampling (M1-M12, J4, J5) -----------------------------------------------------
def _big_keyed(spark, sf_dir):
    return tv.windows_big(spark, sf_dir).select("node", "pos", "label")


def _sampler_sql(target_expr: str, group: str = "node") -> str:
    part = f"PARTITION BY {group}, label" if group else "PARTITION BY label"
    return with_views("windows_big", extra=[
        ("cnt", f"  SELECT {group + ', ' if group else ''}label, count(*) AS n FROM windows_big "
                f"GROUP BY {group + ', ' if group else ''}label"),
        ("r", f"  SELECT *, row_number() OVER ({('PARTITION BY ' + group) if group else ''} ORDER BY n DESC, label) AS big, "
              f"row_number() OVER ({('PARTITION BY ' + group) if group else ''} ORDER BY n, label) AS small, "
              f"min(n) OVER ({('PARTITION BY ' + group) if group else ''}) AS mn, "
              f"CAST(floor((sum(n) OVER ({('PARTITION BY ' + group) if group else ''}) - max(n) OVER "
              f"({('PARTITION BY ' + group) if group else ''})) / (count(*) OVER "
              f"({('PARTITION BY ' + group) if group else ''}) - 1)) AS BIGINT) AS omb, "
              f"CAST(floor((sum(n) OVER ({('PARTITION BY ' + group) if group else ''}) - min(n) OVER "
              f"({('PARTITION BY ' + group) if group else ''})) / (count(*) OVER "
              f"({('PARTITION BY ' + group) if group else ''}) - 1)) AS BIGINT) AS oms FROM cnt"),
        ("t", f"  SELECT {group + ', ' if group else ''}label, {target_expr} AS target FROM r"),
        ("h", f"  SELECT b.node, b.pos, b.label, row_number() OVER ({part} ORDER BY "
              f"md5('42:' || CAST(b.node AS VARCHAR) || ':' || CAST(b.pos AS VARCHAR)), b.node, b.pos) AS rn "
              f"FROM windows_big b"),
    ]) + f"SELECT h.node, h.pos, h.label FROM h JOIN t USING ({group + ', ' if group else ''}label) WHERE rn <= target"


def _sampler_query(name, strategy, target_expr, group=("node",)):
    def q(spark, sf_dir):
        return sampling.undersample(_big_keyed(spark, sf_dir), "label", strategy=strategy, group=list(group),
                                    key=("node", "pos"), seed=42)
    register(name, _sampler_sql(target_expr, ", ".join(group)))(q)


_sampler_query("m01_undersample_majority", "majority", "CASE WHEN big = 1 THEN mn ELSE n END")
_sampler_query("m02_undersample_majority_mean", "majority_mean", "CASE WHEN big = 1 THEN least(n, omb) ELSE n END")
_sampler_query("m03_undersample_minority_mean", "minority_mean",
               "CASE WHEN small = 1 THEN least(n, oms) ELSE n END")
_sampler_query("m04_undersample_not_minority", "not minority", "CASE WHEN small = 1 THEN n ELSE least(n, mn) END")
_sampler_query("m06_balance_after_concat", "majority", "CASE WHEN big = 1 THEN mn ELSE n END", group=())


def m01_undersample_buckets(spark, sf_dir):
    """Small ``max_class_rows``, so that the classes take the bucketed plan."""
    return sampling.undersample(_big_keyed(spark, sf_dir), "label", strategy="majority", group=["node"],
                                max_class_rows=20)


register("m01_undersample_buckets", ORACLES["m01_undersample_majority"])(m01_undersample_buckets)


def m05_subsample_class(spark, sf_dir):
    return sampling.subsample_class(_big_keyed(spark, sf_dir), 3, "label", group=["node"])


register("m05_subsample_class", with_views("windows_big", extra=[
    ("cnt", "  SELECT node, label, count(*) AS n FROM windows_big GROUP BY node, label"),
    ("c2", "  SELECT *, max(CASE WHEN label = 3 THEN n END) OVER (PARTITION BY node) AS own FROM cnt"),
    ("t", "  SELECT node, label, CASE WHEN label = 3 THEN least(n, CAST(floor(avg(CASE WHEN n <> own THEN n END) "
          "OVER (PARTITION BY node)) AS BIGINT)) ELSE n END AS target FROM c2"),
    ("h", "  SELECT b.node, b.pos, b.label, row_number() OVER (PARTITION BY node, label ORDER BY "
          "md5('42:' || CAST(b.node AS VARCHAR) || ':' || CAST(b.pos AS VARCHAR)), b.node, b.pos) AS rn FROM windows_big b"),
]) + "SELECT h.node, h.pos, h.label, CASE WHEN h.label = 3 THEN 0 ELSE 1 END AS sampled_first "
     "FROM h JOIN t USING (node, label) WHERE rn <= target")(m05_subsample_class)


def m07_positional_split(spark, sf_dir):
    return sampling.positional_split(_big_keyed(spark, sf_dir))


register("m07_positional_split", with_views("windows_big") + """SELECT node, pos, label,
  CASE WHEN pos <= floor(count(*) OVER (PARTITION BY node) * 6 / 10) THEN 'train' ELSE 'test' END AS split
FROM windows_big""")(m07_positional_split)


def m08_kfold_contiguous(spark, sf_dir):
    return sampling.kfold(_big_keyed(spark, sf_dir), 5)


register("m08_kfold_contiguous", with_views("windows_big") + """SELECT node, pos, label,
  CAST(ntile(5) OVER (PARTITION BY node ORDER BY pos) - 1 AS INTEGER) AS fold FROM windows_big""")(m08_kfold_contiguous)


def m09_kfold_shuffled(spark, sf_dir):
    return sampling.kfold(_big_keyed(spark, sf_dir), 5, shuffle=True, seed=7)


register("m09_kfold_shuffled", with_views("windows_big") + """SELECT node, pos, label,
  CAST(ntile(5) OVER (PARTITION BY node ORDER BY md5('7:' || CAST(node AS VARCHAR) || ':' || CAST(pos AS VARCHAR)), pos)
    - 1 AS INTEGER) AS fold FROM windows_big""")(m09_kfold_shuffled)


def m10_stratified_kfold(spark, sf_dir):
    return sampling.stratified_kfold(_big_keyed(spark, sf_dir), 5)


# independent formulation: sorted labels dealt round robin, then per class in position order
register("m10_stratified_kfold", with_views("windows_big", extra=[
    ("srt", "  SELECT node, label, (row_number() OVER (PARTITION BY node ORDER BY label) - 1) % 5 AS f "
            "FROM windows_big"),
    ("alloc", "  SELECT node, label, f, count(*) AS a FROM srt GROUP BY node, label, f"),
    ("bounds", "  SELECT node, label, f, sum(a) OVER (PARTITION BY node, label ORDER BY f) - a AS lo, "
               "sum(a) OVER (PARTITION BY node, label ORDER BY f) AS hi FROM alloc"),
    ("j", "  SELECT node, pos, label, row_number() OVER (PARTITION BY node, label ORDER BY pos) - 1 AS jj "
          "FROM windows_big"),
]) + "SELECT j.node, j.pos, j.label, CAST(b.f AS INTEGER) AS fold FROM j JOIN bounds b "
     "ON j.node = b.node AND j.label = b.label AND j.jj >= b.lo AND j.jj < b.hi")(m10_stratified_kfold)


def m11_shuffle_rows(spark, sf_dir):
    return sampling.shuffled(_big_keyed(spark, sf_dir), seed=42)


register("m11_shuffle_rows", with_views("windows_big") + "SELECT node, pos, label, md5('42:' || CAST(node AS VARCHAR) "
         "|| ':' || CAST(pos AS VARCHAR)) AS shuffle_key FROM windows_big")(m11_shuffle_rows)


def _nodes(spark, sf_dir):
    return tv.readings(spark, sf_dir).select("node", "node_no").distinct()


def m12_random_designs(spark, sf_dir):
    return sampling.random_designs(_nodes(spark, sf_dir), seed=42, iterations=3)


_DESIGN_SQL = with_views("readings", extra=[
    ("pool", "  SELECT DISTINCT node, node_no FROM readings"),
    ("grid", "  SELECT i AS iter, k FROM range(1, 4) t(i), range(1, 17) s(k)"),
    ("d", "  SELECT node, node_no, CAST(iter AS INTEGER) AS iter, CAST(k AS INTEGER) AS k, row_number() OVER "
          "(PARTITION BY iter, k ORDER BY md5('42:' || CAST(iter AS VARCHAR) || ':' || CAST(k AS VARCHAR) || ':' || node), "
          "node) AS rn FROM pool, grid"),
])
register("m12_random_designs", _DESIGN_SQL + "SELECT node, node_no, iter, k, CASE WHEN rn <= k THEN 'train' "
         "ELSE 'test' END AS role FROM d")(m12_random_designs)


def j04_test_nodes(spark, sf_dir):
    d = sampling.random_designs(_nodes(spark, sf_dir), seed=42, iterations=1, sizes=[4])
    train = d.where(F.col("role") == "train")
    return sampling.test_nodes(_nodes(spark, sf_dir), train)


register("j04_test_nodes", _DESIGN_SQL.replace("range(1, 4) t(i), range(1, 17) s(k)", "range(1, 2) t(i), range(4, 5) s(k)")
         + "SELECT DISTINCT node, node_no FROM readings WHERE node NOT IN (SELECT node FROM d WHERE rn <= k)")(
    j04_test_nodes)


def j05_complementary_halves(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    train = n.where(F.col("node_no") % 3 == 0).select("node", F.lit(1).alias("half")).unionByName(
        n.where(F.col("node_no") % 5 == 0).select("node", F.lit(2).alias("half")))
    return sampling.test_halves(n.select("node"), train)


register("j05_complementary_halves", with_views("readings", extra=[
    ("n", "  SELECT DISTINCT node, node_no FROM readings"),
    ("tr", "  SELECT node, 1 AS half FROM n WHERE node_no % 3 = 0 UNION ALL SELECT node, 2 FROM n WHERE node_no % 5 = 0"),
]) + """SELECT node, 3 - max(half) AS half FROM tr GROUP BY node HAVING count(*) = 1
UNION ALL SELECT node, 0 AS half FROM n WHERE node NOT IN (SELECT node FROM tr)""")(j05_complementary_halves)


def j06_scores_vs_baseline(spark, sf_dir):
    s = _scores_spark(spark, sf_dir, ["f1"]).drop("metric")
    b = _scores_spark(spark, sf_dir, ["sensitivity"]).drop("metric")
    return round_doubles(compare.versus_baseline(s, b))


register("j06_scores_vs_baseline", with_views("predictions", extra=conf_ctes("predictions", "node") +
                                              scores_ctes("node", ["f1", "sensitivity"])) + f"""
SELECT coalesce(a.node, b.node) AS node, coalesce(a.cls, b.cls) AS cls, {qz('a.score')} AS score,
  {qz('b.score')} AS baseline, {qz('a.score - b.score')} AS delta
FROM (SELECT * FROM scores WHERE metric = 'f1') a FULL OUTER JOIN (SELECT * FROM scores WHERE metric = 'sensitivity') b
  ON a.node = b.node AND a.cls = b.cls""")(j06_scores_vs_baseline)


# Comparison tables (U1-U5, W19, W20, K1-K3, K5, L19) ---------------------------
_METHODS = ["clustering", "random", "singlenode"]


def scores_long(spark, sf_dir):
    """F1 by node (overall + classes) with a method tag by node number (FIXTURES view)."""
    s = _scores_spark(spark, sf_dir, ["f1"], group=("node", "node_no"))
    return s.withColumn("method", F.element_at(F.array(*[F.lit(m) for m in _METHODS]),
                                               (F.col("node_no") % 3 + 1).cast("int")))


_SCORES_LONG_SQL = with_views("predictions", extra=conf_ctes("predictions", "node, node_no") +
                              scores_ctes("node, node_no", ["f1"]) + [
    ("sl", "  SELECT *, ['clustering', 'random', 'singlenode'][node_no % 3 + 1] AS method FROM scores")])


def u01_union_node_tables(spark, sf_dir):
    r = tv.readings(spark, sf_dir)
    u = r.where(F.col("node_no") % 2 == 0).unionByName(r.where(F.col("node_no") % 2 == 1))
    return u.groupBy("node").agg(F.count(F.lit(1)).alias("n"))


register("u01_union_node_tables", "SELECT 'N' || CAST(user_id AS VARCHAR) AS node, count(*) AS n FROM events "
         "GROUP BY user_id")(u01_union_node_tables)


def u02_melt_tag_union(spark, sf_dir):
    """Two score sources, melted, tagged by method and concatenated."""
    classes = [str(i) for i in range(5)]
    sources = {}
    for method, metric in (("clustering", "f1"), ("random", "sensitivity")):
        wide = metrics.wide_scores(_scores_spark(spark, sf_dir, [metric]), ["node"], classes)
        sources[method] = compare.melt(wide.drop("metric"), ["node"], ["overall", *classes], "fault", "value")
    return round_doubles(compare.tag_and_union(sources))


register("u02_melt_tag_union", with_views("predictions", extra=conf_ctes("predictions", "node") +
                                          scores_ctes("node", ["f1", "sensitivity"])) + f"""
SELECT n.node, c.cls AS fault, {qz('score')} AS value, CASE m.metric WHEN 'f1' THEN 'clustering' ELSE 'random' END AS method
FROM (SELECT DISTINCT node FROM predictions) n
CROSS JOIN (VALUES ('overall'), ('0'), ('1'), ('2'), ('3'), ('4')) c(cls) CROSS JOIN (VALUES ('f1'), ('sensitivity')) m(metric)
LEFT JOIN scores s ON s.node = n.node AND s.cls = c.cls AND s.metric = m.metric""")(u02_melt_tag_union)


def u03_training_from_blocks(spark, sf_dir):
    d = sampling.random_designs(_nodes(spark, sf_dir), seed=42, iterations=3, sizes=[8])
    testing = d.where(F.col("role") == "test").select(F.col("iter").alias("block"), "node")
    return compare.training_from_blocks(_nodes(spark, sf_dir), testing)


register("u03_training_from_blocks", _DESIGN_SQL.replace("range(1, 17) s(k)", "range(8, 9) s(k)") + """
, t AS (SELECT iter AS block, node FROM d WHERE rn > k)
SELECT DISTINCT p.node FROM pool p, (SELECT DISTINCT block FROM t) b
WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.block = b.block AND t.node = p.node)""")(u03_training_from_blocks)


def u04_sampled_first(spark, sf_dir):
    return sampling.subsample_class(_big_keyed(spark, sf_dir), 3, "label", group=["node"]) \
        .orderBy("node", "sampled_first", "pos")


register("u04_sampled_first", ORACLES["m05_subsample_class"])(u04_sampled_first)


def u05_node_mean_rows(spark, sf_dir):
    b = tv.windows_big(spark, sf_dir)
    return round_doubles(profile.filtered_node_means(b, tv.LINEITEM_METRICS, node="node"), 4)


register("u05_node_mean_rows", with_views("windows_big") + "SELECT node, " + ", ".join(
    f"{qz(f'avg({m})', 4)} AS {m}" for m in tv.LINEITEM_METRICS) + " FROM windows_big GROUP BY node")(u05_node_mean_rows)


def w19_run_blocks(spark, sf_dir):
    s = scores_long(spark, sf_dir).where(F.col("cls") == "overall")
    return round_doubles(compare.run_blocks(s.select("node", "node_no", "score"), ["node_no"], 15, 10))


register("w19_run_blocks", _SCORES_LONG_SQL + f"""SELECT node, node_no, {qz('score')} AS score,
  CASE WHEN floor((row_number() OVER (ORDER BY node_no) - 1) / 15) + 1 <= 10
       THEN 'r' || CAST(CAST(floor((row_number() OVER (ORDER BY node_no) - 1) / 15) + 1 AS BIGINT) AS VARCHAR)
       ELSE 'placeholder' END AS method
FROM sl WHERE cls = 'overall'""")(w19_run_blocks)


def w20_flag_repeats(spark, sf_dir):
    d = sampling.random_designs(_nodes(spark, sf_dir), seed=42, iterations=1, sizes=[10, 20])
    t = d.where(F.col("role") == "train").select("node", F.when(F.col("k") == 10, "clustering")
                                                  .otherwise("random").alias("method"), "k")
    return compare.flag_repeats(t, "node", ["k"]).drop("k")


register("w20_flag_repeats", _DESIGN_SQL.replace("range(1, 17) s(k)", "(VALUES (10), (20)) s(k)")
         .replace("range(1, 4) t(i)", "range(1, 2) t(i)") + """SELECT node, CASE WHEN row_number() OVER
  (PARTITION BY node ORDER BY k) > 1 THEN 'both' WHEN k = 10 THEN 'clustering' ELSE 'random' END AS method
FROM d WHERE rn <= k""")(w20_flag_repeats)


def k01_natural_order(spark, sf_dir):
    n = compare.natural_node_order(_nodes(spark, sf_dir))
    return ranked(n, [fx.node_number("node"), "node"], "order_rank")


register("k01_natural_order", with_views("readings") + """SELECT node, node_no, row_number() OVER
  (ORDER BY CAST(substring(node, 2) AS INTEGER), node) AS order_rank FROM (SELECT DISTINCT node, node_no FROM readings)""")(
    k01_natural_order)


def k02_nodes_by_score(spark, sf_dir):
    s = scores_long(spark, sf_dir).where(F.col("cls") == "overall").select("node", "score")
    return round_doubles(ranked(s, [F.desc("score"), "node"], "rank"))


register("k02_nodes_by_score", _SCORES_LONG_SQL + f"""SELECT node, {qz('score')} AS score,
  row_number() OVER (ORDER BY score DESC, node) AS rank FROM sl WHERE cls = 'overall'""")(k02_nodes_by_score)


def k03_top_features(spark, sf_dir):
    t = profile.target_correlation(tv.windows_big(spark, sf_dir), tv.LINEITEM_METRICS, "label")
    return round_doubles(compare.top_n(t, "abs_corr", 3, tie="feature"))


register("k03_top_features", ORACLES["a11_target_correlation"].replace(
    "SELECT 'l_quantity'", "SELECT * FROM (SELECT 'l_quantity'", 1) + ") ORDER BY abs_corr DESC, feature LIMIT 3")(
    k03_top_features)


def k05_nonzero_coefficients(spark, sf_dir):
    c = profile.correlation_matrix(tv.windows_big(spark, sf_dir), tv.LINEITEM_METRICS) \
        .where(F.col("a") != F.col("b")).withColumnRenamed("corr", "coef")
    return round_doubles(compare.nonzero_sorted(c, "coef", 0.0))


register("k05_nonzero_coefficients", "SELECT a, b, corr AS coef FROM (" + ORACLES["a10_correlation_matrix"]
         .replace("WITH windows_big", "WITH windows_big", 1) + ") WHERE a <> b AND abs(corr) > 0.0")(
    k05_nonzero_coefficients)


def l19_method_comparison(spark, sf_dir):
    s = scores_long(spark, sf_dir)
    return round_doubles(profile.box_stats(s, ["method", "cls"], "score"))


register("l19_method_comparison", _SCORES_LONG_SQL + ",\n" + box_sql("sl", "method, cls", "score"))(
    l19_method_comparison)


# Statistics computed by separate operators, bound by position -------------
def j02_positional_column_bind(spark, sf_dir):
    from faultlens.operators import features as ft
    t = tv.node_table(spark, sf_dir)
    a = ft.window_features(t, ["click"], w=10, stats=["mean"])
    b = ft.window_features(t, ["click"], w=10, stats=["std"], label="fault")
    return round_doubles(a.join(b, on=["node", "pos", "window_id"], how="inner"))


register("j02_positional_column_bind", with_views("node_table") + f"""SELECT * FROM (
  SELECT node, pos, (pos - 10) // 1 AS window_id,
    {qz('avg(click) OVER (PARTITION BY node ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)')} AS mean_click,
    {qz('stddev_samp(click) OVER (PARTITION BY node ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)')} AS std_click
  FROM node_table) f JOIN (
  SELECT node, pos, lab AS label FROM (
    SELECT a.node, a.pos, b.fault AS lab, count(*) AS c,
      row_number() OVER (PARTITION BY a.node, a.pos ORDER BY count(*) DESC, b.fault) AS rk
    FROM node_table a JOIN node_table b ON a.node = b.node AND b.pos BETWEEN a.pos - 9 AND a.pos
    WHERE a.pos >= 10 GROUP BY a.node, a.pos, b.fault) WHERE rk = 1) l USING (node, pos)
WHERE f.pos >= 10""")(j02_positional_column_bind)


# Column pruning at the scan ------------------------------------------------
def s04_pruned_scan(spark, sf_dir):
    from faultlens.sources.tables import table
    return table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_shipdate"]) \
        .select("l_orderkey", "l_linenumber", fx.epoch_seconds("l_shipdate").alias("ship_sec"))


register("s04_pruned_scan", "SELECT l_orderkey, l_linenumber, epoch(l_shipdate)::BIGINT AS ship_sec FROM lineitem")(
    s04_pruned_scan)


# W13 + W14 + W17: counters turned into deltas, first delta filled backward -----
def w14_delta_encode_counters(spark, sf_dir):
    from faultlens.operators import align
    r = tv.readings(spark, sf_dir).select("node", "metric", "ts", "event_id", "value")
    out = align.delta_encode_counters(r, "value", part=("node", "metric"), order=("ts", "event_id"),
                                      labels=["applicationLabel", "faultLabel"])
    return round_doubles(out.select("node", "metric", "event_id", "value"))


register("w14_delta_encode_counters", with_views("readings", extra=[
    ("d", "  SELECT node, metric, event_id, ts, value, value - lag(value) OVER (PARTITION BY node, metric "
          "ORDER BY ts, event_id) AS dl FROM readings"),
    ("m", "  SELECT node, metric, coalesce(min(dl) >= 0, true) OR coalesce(max(dl) <= 0, true) AS mono FROM d "
          "GROUP BY node, metric"),
    ("f", "  SELECT d.*, coalesce(dl, first_value(dl IGNORE NULLS) OVER (PARTITION BY node, metric ORDER BY ts, "
          "event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS dd FROM d"),
]) + f"SELECT node, metric, event_id, {qz('CASE WHEN mono THEN dd ELSE value END')} AS value "
     "FROM f JOIN m USING (node, metric)")(w14_delta_encode_counters)


# NULL nodes are a node of their own -------------------------------------------------
def _unnamed(spark, sf_dir):
    """``windows_big`` with the rows of every fourth supplier under no name, written to
    the shared folder: statistics and joins read it several times, and rows are dealt
    and sorted for their positions once."""
    li = tv.table(spark, sf_dir, "lineitem", ["l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", "l_shipdate", *tv.LINEITEM_METRICS])
    li = li.select(F.when(F.col("l_suppkey") % 4 != 0, F.col("l_suppkey")).alias("node"), *tv.LINEITEM_ORDER, (F.col("l_linenumber") - 1).alias("label"))
    path = shared_path(spark, f"faultlens/unnamed-{uuid.uuid4().hex[:12]}")
    sinks.write_table(add_positions(li, "node", tv.LINEITEM_ORDER).select("node", "pos", *tv.LINEITEM_METRICS, "label"), path)
    return spark.read.parquet(path)


_UNNAMED = [("sizes", "  SELECT node, count(*) AS n FROM u GROUP BY node")]
_UNNAMED.insert(0, ("u", f"  SELECT CASE WHEN l_suppkey % 4 <> 0 THEN l_suppkey END AS node, row_number() OVER (PARTITION BY CASE WHEN l_suppkey % 4 <> 0 THEN l_suppkey END "
                         f"ORDER BY {', '.join(tv.LINEITEM_ORDER)}) AS pos, {', '.join(tv.LINEITEM_METRICS)}, l_linenumber - 1 AS label FROM lineitem"))


def m07_unnamed_node(spark, sf_dir):
    """Split (M7), folds (M8) and halves (A5) keep the rows of a NULL node."""
    u = profile.with_halves(sampling.kfold(sampling.positional_split(_unnamed(spark, sf_dir))))
    return u.select(F.col("node").cast("string").alias("node"), "pos", "split", "fold", "half")


register("m07_unnamed_node", with_views("windows_big", extra=_UNNAMED) + """SELECT u.node::VARCHAR AS node, pos, CASE WHEN pos <= floor(n * 6 / 10) THEN 'train' ELSE 'test' END AS split,
  ntile(5) OVER (PARTITION BY u.node ORDER BY pos)::INT - 1 AS fold, CASE WHEN pos <= n // 2 THEN 1 ELSE 2 END AS half
FROM u JOIN sizes ON u.node IS NOT DISTINCT FROM sizes.node""")(m07_unnamed_node)


def f08_unnamed_node(spark, sf_dir):
    """Scaled values (F7, F8) of a NULL node come from its own statistics."""
    from faultlens.operators import features

    u = features.minmax_scale(_unnamed(spark, sf_dir), ["l_tax"])
    return round_doubles(features.zscore_scale(u, ["l_quantity", "l_discount"]).select(
        F.col("node").cast("string").alias("node"), "pos", "l_quantity", "l_discount", "l_tax"))


def _z(c):
    return qz(f"coalesce(({c} - avg({c}) OVER w) / nullif(stddev_pop({c}) OVER w, 0), 0)") + f" AS {c}"


register("f08_unnamed_node", with_views("windows_big", extra=_UNNAMED) + f"""SELECT node::VARCHAR AS node, pos, {_z('l_quantity')}, {_z('l_discount')},
  {qz('coalesce((l_tax - min(l_tax) OVER w) / nullif(max(l_tax) OVER w - min(l_tax) OVER w, 0), 0)')} AS l_tax
FROM u WINDOW w AS (PARTITION BY node)""")(f08_unnamed_node)


# W16 with other methods --------------------------------------------------------------
def w16_fill_cubic(spark, sf_dir):
    from faultlens.operators import align

    ns = tv.positioned_seconds(spark, sf_dir).select("node", "pos", "click", "view")
    return round_doubles(align.interpolate(ns, ["click", "view"], "spline", order=3))


def _spline_ctes(m):
    """The tridiagonal system of a column's known points by elimination and back substitution."""
    at = "(PARTITION BY node ORDER BY x)"
    return [
        (f"{m}_points", f"  SELECT *, row_number() OVER {at} AS k, count(*) OVER (PARTITION BY node) AS n, x - lag(x) OVER {at} AS h0, lead(x) OVER {at} - x AS h1,\n"
                        f"    6 * ((lead(y) OVER {at} - y) / (lead(x) OVER {at} - x) - (y - lag(y) OVER {at}) / (x - lag(x) OVER {at})) AS r\n"
                        f"  FROM (SELECT node, pos::DOUBLE AS x, {m} AS y FROM ns_pos WHERE {m} IS NOT NULL)"),
        (f"{m}_down", f"  SELECT node, k, n, 0.0::DOUBLE AS c, 0.0::DOUBLE AS d FROM {m}_points WHERE k = 1\n  UNION ALL\n"
                      f"  SELECT p.node, p.k, p.n, p.h1 / (2 * (p.h0 + p.h1) - p.h0 * f.c), (p.r - p.h0 * f.d) / (2 * (p.h0 + p.h1) - p.h0 * f.c)\n"
                      f"  FROM {m}_down f JOIN {m}_points p ON p.node = f.node AND p.k = f.k + 1 WHERE p.k < p.n"),
        (f"{m}_up", f"  SELECT node, n AS k, 0.0::DOUBLE AS m FROM {m}_points WHERE k = n\n  UNION ALL\n"
                    f"  SELECT u.node, u.k - 1, f.d - f.c * u.m FROM {m}_up u JOIN {m}_down f ON f.node = u.node AND f.k = u.k - 1 WHERE u.k > 1"),
        (f"{m}_rows", f"  SELECT s.node, s.pos, p.x, p.y, u.m FROM ns_pos s LEFT JOIN {m}_points p ON p.node = s.node AND p.x = s.pos LEFT JOIN {m}_up u ON u.node = p.node AND u.k = p.k"),
        (f"{m}_near", "  SELECT node, pos, " + ", ".join(
            f"{f}_value({c} IGNORE NULLS) OVER (PARTITION BY node ORDER BY pos ROWS BETWEEN {frame}) AS {c}{i}" for c in ("x", "y", "m")
            for i, f, frame in ((0, "last", "UNBOUNDED PRECEDING AND CURRENT ROW"), (1, "first", "CURRENT ROW AND UNBOUNDED FOLLOWING"))) + f" FROM {m}_rows"),
        (f"{m}_filled", "  SELECT node, pos, CASE WHEN x1 > x0 THEN s * y0 + t * y1 + ((s * s * s - s) * m0 + (t * t * t - t) * m1) * h * h / 6 ELSE coalesce(y0, y1) END AS v\n"
                        f"  FROM (SELECT *, (x1 - pos) / nullif(h, 0) AS s, (pos - x0) / nullif(h, 0) AS t FROM (SELECT *, x1 - x0 AS h FROM {m}_near))"),
    ]


register("w16_fill_cubic", with_views("ns_pos", extra=_spline_ctes("click") + _spline_ctes("view")).replace("WITH ", "WITH RECURSIVE ", 1) +
         f"SELECT node, pos, {qz('c.v')} AS click, {qz('w.v')} AS view FROM click_filled c JOIN view_filled w USING (node, pos)")(w16_fill_cubic)


def w16_fill_nearest(spark, sf_dir):
    from faultlens.operators import align

    ns = tv.positioned_seconds(spark, sf_dir).select("node", "pos", "click", "view")
    return round_doubles(align.interpolate(ns, ["click", "view"], "nearest"))


def _nearest_sql(m):
    known = f"CASE WHEN {m} IS NOT NULL THEN {{'p': pos, 'v': {m}}} END"
    a = f"last_value({known} IGNORE NULLS) OVER (PARTITION BY node ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    b = f"first_value({known} IGNORE NULLS) OVER (PARTITION BY node ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    return f"{a} AS a_{m}, {b} AS b_{m}", qz(f"CASE WHEN a_{m} IS NULL OR b_{m}.p - pos < pos - a_{m}.p THEN b_{m}.v ELSE a_{m}.v END") + f" AS {m}"


register("w16_fill_nearest", with_views("ns_pos") + "SELECT node, pos, {1}, {3} FROM (SELECT node, pos, {0}, {2} FROM ns_pos)".format(
    *_nearest_sql("click"), *_nearest_sql("view")))(w16_fill_nearest)


# J1 for two tables, J7 -----------------------------------------------------------------
def j01_outer_align(spark, sf_dir):
    """Two sensors' seconds of every node side by side, holes on either side."""
    from faultlens.operators import align

    r = tv.readings(spark, sf_dir).withColumn("ts", F.date_trunc("second", "ts"))
    one = lambda m: r.where(F.col("metric") == m).groupBy("node", "ts").agg(F.avg("value").alias(m))
    both = align.outer_align(one("click"), one("view"))
    return round_doubles(both.select("node", fx.epoch_micros("ts").alias("micros"), "click", "view"))


register("j01_outer_align", with_views("readings", extra=[
    (m, f"  SELECT node, date_trunc('second', ts) AS ts, avg(value) AS {m} FROM readings WHERE metric = '{m}' GROUP BY 1, 2") for m in ("click", "view")]) +
    f"""SELECT coalesce(c.node, v.node) AS node, epoch_us(coalesce(c.ts, v.ts)) AS micros, {qz('click')} AS click, {qz('view')} AS view
FROM click c FULL OUTER JOIN view v ON c.node = v.node AND c.ts = v.ts""")(j01_outer_align)


def j07_labels_after_scaling(spark, sf_dir):
    """Labels stay beside the rows that a transform changes: the mean scaled value per label."""
    from faultlens.operators import features

    z = features.zscore_scale(tv.windows_big(spark, sf_dir), ["l_quantity", "l_discount"])
    return round_doubles(z.groupBy("node", "label").agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount")))


register("j07_labels_after_scaling", with_views("windows_big", extra=[
    ("z", "  SELECT node, label, " + ", ".join(f"coalesce(({c} - avg({c}) OVER w) / nullif(stddev_pop({c}) OVER w, 0), 0) AS {c}" for c in ("l_quantity", "l_discount")) +
     " FROM windows_big WINDOW w AS (PARTITION BY node)")]) +
    f"SELECT node, label, count(*) AS n, {qz('avg(l_quantity)')} AS quantity, {qz('avg(l_discount)')} AS discount FROM z GROUP BY node, label")(j07_labels_after_scaling)


# X3, X5 ------------------------------------------------------------------------------
def x03_label_scorers(spark, sf_dir):
    """F1 of two labels and of all, each by its own scorer."""
    p = tv.predictions(spark, sf_dir)
    tables = [score(p).withColumn("scorer", F.lit(name)) for name, score in metrics.label_scorers([1, 4]).items()]
    return round_doubles(tables[0].unionByName(tables[1]).unionByName(tables[2]).select("node", "scorer", "score"))


register("x03_label_scorers", with_views("predictions", extra=conf_ctes("predictions", "node") + scores_ctes("node", ["f1"])) + f"""
SELECT n.node, k.scorer, {qz('coalesce(s.score, 0)')} AS score FROM (SELECT DISTINCT node FROM predictions) n, (VALUES ('1', '1'), ('4', '4'), ('weighted', 'overall')) k(scorer, cls)
LEFT JOIN scores s ON s.node = n.node AND s.cls::VARCHAR = k.cls AND s.metric = 'f1'""")(x03_label_scorers)

_COLLECTIONS = {"healthy": {"faults": [0]}, "late": {"faults": [2, 3], "apps": [21, 23]}, "all": {}}


def x05_run_collections(spark, sf_dir):
    """Three collections of readings, mean and spread per collection and node."""
    from faultlens.operators import runs_of

    return round_doubles(runs_of.gather(tv.readings(spark, sf_dir), _COLLECTIONS).mean_std("value"))


def x05_collection_boxes(spark, sf_dir):
    from faultlens.operators import runs_of

    return round_doubles(runs_of.gather(tv.readings(spark, sf_dir), _COLLECTIONS).box("value"))


_GATHERED = [("gathered", "  SELECT r.*, c AS collection FROM readings r, (VALUES ('healthy'), ('late'), ('all')) v(c) "
              "WHERE c = 'all' OR c = 'healthy' AND fault = 0 OR c = 'late' AND fault IN (2, 3) AND app IN (21, 23)")]
register("x05_run_collections", with_views("readings", extra=_GATHERED) +
         f"SELECT collection, node, {qz('avg(value)')} AS mean, {qz('stddev_samp(value)')} AS std FROM gathered GROUP BY collection, node")(x05_run_collections)
register("x05_collection_boxes", with_views("readings", extra=_GATHERED + [("keyed", "  SELECT collection || '/' || node AS g, value FROM gathered")]) + ",\n" +
         box_sql("keyed", "g", "value").replace("SELECT g, ", "SELECT split_part(g, '/', 1) AS collection, split_part(g, '/', 2) AS node, ", 2).replace(
             "SELECT split_part(g, '/', 1) AS collection, split_part(g, '/', 2) AS node, quantile_cont", "SELECT g, quantile_cont"))(x05_collection_boxes)
