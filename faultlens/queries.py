"""Registry binding the operators to the driver's tables.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLES[name] -> DuckDB SQL``.
Names are the SURVEY operator id plus a word, so the inventory can be checked
line by line. Every query reads whole tables (no id subsets, no row caps);
a ``limit`` appears only where top-k is the feature.

Float columns are rounded to a fixed number of decimals on both sides so the
order-insensitive value hash is stable against summation-order noise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.constants import PERCENTILES
from faultlens.functions.scalar import quantize
from faultlens.oracles import with_views
from faultlens.operators import align, features
from faultlens.sources import telemetry as tv
from faultlens.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[quantize(F.col(f"`{f.name}`"), digits).alias(f.name)
                       if f.dataType.typeName() in ("double", "float") else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


def qz(expr: str, digits: int = 6) -> str:
    """SQL twin of ``quantize``."""
    return f"(floor(CAST({expr} AS DOUBLE) * {float(10 ** digits)!r} + CAST(0.5001 AS DOUBLE)) / {float(10 ** digits)!r})"


def _r(expr: str, alias: str, digits: int = 6) -> str:
    return f"{qz(expr, digits)} AS \"{alias}\""


# ---------------------------------------------------------------------------
# Windowed features: one generator for the Spark side, one for the SQL side.
# ---------------------------------------------------------------------------
SMALL_W = 10
BIG_W = 60


def _spark_windows(df: DataFrame, metrics, w, step, stats, label, label_mode="mode",
                   corr=False, digits=6) -> DataFrame:
    return features.window_features(df, metrics, node="node", pos="pos", w=w, step=step, stats=stats,
                                    label=label, label_mode=label_mode, corr=corr, digits=digits)


def _sql_windows(view: str, metrics, w, step, stats, label=None, label_mode="mode",
                 corr_pairs=(), digits=6) -> str:
    win = f"(PARTITION BY node ORDER BY pos ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    cols = []
    pct_stats = [s for s in stats if s in PERCENTILES]
    for m in metrics:
        q = f"quantile_cont({m}, [{', '.join(str(PERCENTILES[s]) for s in pct_stats)}]) OVER {win}"
        for s in stats:
            e = {"mean": f"avg({m}) OVER {win}", "std": f"stddev_samp({m}) OVER {win}",
                 "sumdiff": f"{m} - first_value({m}) OVER {win}", "last": f"{m}",
                 "min": f"min({m}) OVER {win}", "max": f"max({m}) OVER {win}"}.get(s)
            if e is None:
                e = f"({q})[{pct_stats.index(s) + 1}]"
            cols.append(_r(e, f"{s}_{m}", digits))
    for a, b in corr_pairs:
        x, y = f"CASE WHEN {b} IS NOT NULL THEN {a} END", f"CASE WHEN {a} IS NOT NULL THEN {b} END"
        e = (f"CASE WHEN count({x}) OVER {win} < {w} THEN 0 ELSE coalesce(covar_pop({x}, {y}) OVER {win} / "
             f"nullif(stddev_pop({x}) OVER {win} * stddev_pop({y}) OVER {win}, 0), 0) END")
        cols.append(_r(e, f"corr_{a}_{b}", digits))
    extra = []
    join = ""
    if label and label_mode == "last":
        cols.append(f"CAST(coalesce(last_value(CASE WHEN {label} <> 0 THEN {label} END IGNORE NULLS) "
                    f"OVER {win}, 0) AS INTEGER) AS label")
    elif label:
        extra = [
            ("lab_counts", f"  SELECT a.node, a.pos, b.{label} AS lab, count(*) AS c FROM {view} a "
                           f"JOIN {view} b ON a.node = b.node AND b.pos BETWEEN a.pos - {w - 1} AND a.pos "
                           f"WHERE a.pos >= {w} GROUP BY a.node, a.pos, b.{label}"),
            ("lab_mode", "  SELECT node, pos, lab FROM (SELECT *, row_number() OVER "
                         "(PARTITION BY node, pos ORDER BY c DESC, lab ASC) AS rk FROM lab_counts) WHERE rk = 1"),
        ]
        join = "JOIN lab_mode ON lab_mode.node = f.node AND lab_mode.pos = f.pos"
        cols.append("CAST(lab_mode.lab AS INTEGER) AS label")
    lab_col = ""
    if label and label_mode != "last":
        cols.pop()
        lab_col = ", CAST(lab_mode.lab AS INTEGER) AS label"
    inner = f"SELECT node, pos, (pos - {w}) // {step} AS window_id, {', '.join(cols) or 'NULL AS _none'}\nFROM {view}"
    body = (f"SELECT f.* EXCLUDE (_none){lab_col} FROM ({inner}) f {join}\n"
            f"WHERE f.pos >= {w} AND (f.pos - {w}) % {step} = 0")
    if cols:
        body = body.replace(" EXCLUDE (_none)", "")
    return extra, body


def _windows_sql(view_names, view, metrics, w, step, stats, **kw) -> str:
    extra, body = _sql_windows(view, metrics, w, step, stats, **kw)
    return with_views(*view_names, extra=extra) + body


STATS11 = features.stat_names(11)


def _small(spark, sf_dir):
    return tv.node_table(spark, sf_dir)


def _big(spark, sf_dir):
    return tv.windows_big(spark, sf_dir)


# ---------------------------------------------------------------------------
# Flagship: 11 windowed statistics + mode label per node, then their means per label.
# ---------------------------------------------------------------------------
_FLAG_STATS = [f"{s}_{m}" for m in tv.EVENT_METRICS for s in STATS11]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = features.window_features(_small(spark, sf_dir), tv.EVENT_METRICS, w=SMALL_W, step=1,
                                     numfeatures=11, label="fault", label_mode="mode", engine="moving")
    means = feats.groupBy("label").agg(F.count(F.lit(1)).alias("n_windows"),
                                       *[F.avg(c).alias(c) for c in _FLAG_STATS])
    return round_doubles(means, 4)


_flag_extra, _flag_body = _sql_windows("node_table", tv.EVENT_METRICS, SMALL_W, 1, STATS11, label="fault", digits=9)
register("flagship_window_label_means", with_views("node_table", extra=[*_flag_extra, ("feats", _flag_body)]) +
         "SELECT label, count(*) AS n_windows, " + ", ".join(_r(f'avg("{c}")', c, 4) for c in _FLAG_STATS) +
         " FROM feats GROUP BY label")(flagship)


# Each statistic family on its own (small view, w=10, step 1) ---------
def _stat_query(name: str, stats: list[str], view: str = "small", step: int = 1):
    metrics = tv.EVENT_METRICS if view == "small" else tv.LINEITEM_METRICS
    w = SMALL_W if view == "small" else BIG_W
    digits = 6 if view == "small" else 4
    src = _small if view == "small" else _big
    vname = "node_table" if view == "small" else "windows_big"

    def q(spark, sf_dir):
        return _spark_windows(src(spark, sf_dir), metrics, w, step, stats, None, digits=digits)

    register(name, _windows_sql([vname], vname, metrics, w, step, stats, digits=digits))(q)


_stat_query("w01_rolling_mean", ["mean"])
_stat_query("w02_rolling_std", ["std"])
_stat_query("w03_rolling_percentiles", ["perc5", "perc25", "perc75", "perc95"])
_stat_query("w04_rolling_median", ["median"])
_stat_query("w05_rolling_sumdiff", ["sumdiff"])
_stat_query("w06_rolling_last", ["last"])
_stat_query("w07_rolling_min_max", ["min", "max"])
_stat_query("w01_rolling_mean_big", ["mean"], view="big")
_stat_query("w03_rolling_percentiles_big", ["perc5", "perc25", "perc75", "perc95"], view="big")


def w08_rolling_corr(spark, sf_dir):
    pairs = features.correlation_pairs(tv.LINEITEM_METRICS)
    return _spark_windows(_big(spark, sf_dir), tv.LINEITEM_METRICS, BIG_W, 1, [], None, corr=pairs)


register("w08_rolling_corr", _windows_sql(["windows_big"], "windows_big", tv.LINEITEM_METRICS, BIG_W, 1, [],
                                          corr_pairs=features.correlation_pairs(tv.LINEITEM_METRICS)))(
    w08_rolling_corr)


def w09_window_label_last(spark, sf_dir):
    return _spark_windows(_small(spark, sf_dir), tv.EVENT_METRICS, SMALL_W, 1, [], "fault", "last")


register("w09_window_label_last", _windows_sql(["node_table"], "node_table", tv.EVENT_METRICS, SMALL_W, 1, [],
                                               label="fault", label_mode="last"))(w09_window_label_last)


def w10_window_label_mode(spark, sf_dir):
    return _spark_windows(_big(spark, sf_dir), tv.LINEITEM_METRICS, BIG_W, 1, [], "label", "mode")


register("w10_window_label_mode", _windows_sql(["windows_big"], "windows_big", tv.LINEITEM_METRICS, BIG_W, 1, [],
                                               label="label", label_mode="mode"))(w10_window_label_mode)


def w11_step_windows(spark, sf_dir):
    return _spark_windows(_small(spark, sf_dir), tv.EVENT_METRICS, SMALL_W, 3, STATS11, "fault", "mode")


register("w11_step_windows", _windows_sql(["node_table"], "node_table", tv.EVENT_METRICS, SMALL_W, 3, STATS11,
                                          label="fault", label_mode="mode"))(w11_step_windows)


def w11_feature_vectors_big(spark, sf_dir):
    """The full R1 configuration: 11 statistics, w=60, step 1, mode label, correlations."""
    pairs = features.correlation_pairs(tv.LINEITEM_METRICS)
    return _spark_windows(_big(spark, sf_dir), tv.LINEITEM_METRICS, BIG_W, 1, STATS11, "label", "mode",
                          corr=pairs, digits=4)


register("w11_feature_vectors_big", _windows_sql(
    ["windows_big"], "windows_big", tv.LINEITEM_METRICS, BIG_W, 1, STATS11, label="label", label_mode="mode",
    corr_pairs=features.correlation_pairs(tv.LINEITEM_METRICS), digits=4))(w11_feature_vectors_big)


def w11_feature_vectors_big_pandas(spark, sf_dir):
    """Same R1 configuration through the Arrow/numpy window kernel."""
    return features.window_features(_big(spark, sf_dir), tv.LINEITEM_METRICS, w=BIG_W, step=1, numfeatures=11,
                                    label="label", label_mode="mode", corr=True, engine="moving", digits=4)


register("w11_feature_vectors_big_pandas", ORACLES["w11_feature_vectors_big"])(w11_feature_vectors_big_pandas)


def w09_window_label_last_pandas(spark, sf_dir):
    return features.window_features(_small(spark, sf_dir), tv.EVENT_METRICS, w=SMALL_W, step=3, numfeatures=11,
                                    label="fault", label_mode="last", engine="moving", digits=6)


register("w09_window_label_last_pandas", _windows_sql(["node_table"], "node_table", tv.EVENT_METRICS, SMALL_W, 3,
                                                      STATS11, label="fault", label_mode="last"))(
    w09_window_label_last_pandas)


def w11_large_step_exploded(spark, sf_dir):
    """Large-step plan (step = w): rows copied into their windows, then groupBy."""
    out = features.window_features_exploded(_big(spark, sf_dir), tv.LINEITEM_METRICS, w=BIG_W, step=BIG_W,
                                            stats=["mean", "min", "max", "std"], label="label")
    return round_doubles(out.select("node", "pos", "window_id", *[c for c in out.columns
                                                                  if c not in ("node", "pos", "window_id")]), 4)


register("w11_large_step_exploded", _windows_sql(
    ["windows_big"], "windows_big", tv.LINEITEM_METRICS, BIG_W, BIG_W, ["mean", "min", "max", "std"],
    label="label", label_mode="mode", digits=4))(w11_large_step_exploded)


# The align stage ------------------------------------------
def w12_row_position(spark, sf_dir):
    """Small ``max_group_rows``, so that the nodes take the split plan."""
    return tv.windows_big(spark, sf_dir, max_group_rows=100).select("node", "pos", *tv.LINEITEM_METRICS)


register("w12_row_position", with_views("windows_big") +
         "SELECT node, pos, l_quantity, l_extendedprice, l_discount, l_tax FROM windows_big")(w12_row_position)


def a01_second_means(spark, sf_dir):
    r = tv.readings(spark, sf_dir)
    out = align.second_means(r, keys=("node", "metric"))
    return round_doubles(out.select("node", "metric", F.unix_seconds(F.col("ts").cast("timestamp")).alias("sec"),
                                    "value"))


register("a01_second_means", with_views("readings") +
         "SELECT node, metric, epoch(date_trunc('second', ts))::BIGINT AS sec, (floor(CAST(avg(value) AS DOUBLE) * 1000000.0 + CAST(0.5001 AS DOUBLE)) / 1000000.0) AS value "
         "FROM readings GROUP BY 1, 2, 3")(a01_second_means)


def j01_pivot_align(spark, sf_dir):
    ns = tv.node_seconds(spark, sf_dir)
    return round_doubles(ns.withColumn("ts", F.unix_seconds(F.col("ts").cast("timestamp"))))


register("j01_pivot_align", with_views("node_seconds") +
         "SELECT node, epoch(ts)::BIGINT AS ts, " + ", ".join(f"(floor(CAST({m} AS DOUBLE) * 1000000.0 + CAST(0.5001 AS DOUBLE)) / 1000000.0) AS {m}" for m in tv.EVENT_METRICS) +
         ", fault, app FROM node_seconds")(j01_pivot_align)


def _node_table_out(df):
    return round_doubles(df.select("node", "pos", *tv.EVENT_METRICS, "fault", "app"))


def w16_fill_linear(spark, sf_dir):
    return _node_table_out(tv.node_table(spark, sf_dir))


register("w16_fill_linear", with_views("node_table") +
         "SELECT node, pos, " + ", ".join(f"(floor(CAST({m} AS DOUBLE) * 1000000.0 + CAST(0.5001 AS DOUBLE)) / 1000000.0) AS {m}" for m in tv.EVENT_METRICS) +
         ", fault, app FROM node_table")(w16_fill_linear)


def w15_fill_labels(spark, sf_dir):
    ns = tv.node_seconds(spark, sf_dir).withColumn(
        "fault", F.when(F.col("click").isNull(), F.col("fault")))  # labels only on click seconds
    from faultlens.operators.positions import add_positions
    ns = add_positions(ns, "node", "ts")
    out = align.fill_forward_backward(ns, ["fault"], chunk_rows=7)
    return out.select("node", "pos", "fault")


register("w15_fill_labels", with_views("ns_pos") + """
SELECT node, pos, coalesce(
  last_value(f IGNORE NULLS) OVER (PARTITION BY node ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(f IGNORE NULLS) OVER (PARTITION BY node ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
  AS fault
FROM (SELECT *, CASE WHEN click IS NULL THEN fault END AS f FROM ns_pos)""")(w15_fill_labels)


def w17_fill_backward(spark, sf_dir):
    ns = tv.positioned_seconds(spark, sf_dir)
    out = align.fill_backward(ns, tv.EVENT_METRICS, chunk_rows=7)
    return round_doubles(out.select("node", "pos", *tv.EVENT_METRICS))


register("w17_fill_backward", with_views("ns_pos") + "SELECT node, pos, " + ", ".join(
    f"(floor(CAST(first_value({m} IGNORE NULLS) OVER (PARTITION BY node ORDER BY pos ROWS BETWEEN CURRENT ROW "
    f"AND UNBOUNDED FOLLOWING) AS DOUBLE) * 1000000.0 + CAST(0.5001 AS DOUBLE)) / 1000000.0) AS {m}" for m in tv.EVENT_METRICS) + " FROM ns_pos")(w17_fill_backward)


def w13_first_difference(spark, sf_dir):
    r = tv.readings(spark, sf_dir)
    out = align.first_difference(r, "value", part=("node", "metric"), order=("ts", "event_id"), out="delta")
    return round_doubles(out.select("node", "metric", "event_id", "delta"))


register("w13_first_difference", with_views("readings") +
         "SELECT node, metric, event_id, (floor(CAST(value - lag(value) OVER (PARTITION BY node, metric "
         "ORDER BY ts, event_id) AS DOUBLE) * 1000000.0 + CAST(0.5001 AS DOUBLE)) / 1000000.0) AS delta FROM readings")(w13_first_difference)


def w14_monotonic_check(spark, sf_dir):
    r = tv.readings(spark, sf_dir)
    return align.monotonic_series(r, "value", part=("node", "metric"), order=("ts", "event_id"))


register("w14_monotonic_check", with_views("readings") + """
SELECT node, metric, coalesce(min(d) >= 0, true) OR coalesce(max(d) <= 0, true) AS monotonic
FROM (SELECT node, metric, value - lag(value) OVER (PARTITION BY node, metric ORDER BY ts, event_id) AS d
      FROM readings) GROUP BY node, metric""")(w14_monotonic_check)


def w22_regular_grid(spark, sf_dir):
    ns = tv.node_seconds(spark, sf_dir)
    g = align.regular_grid(ns.select("node", "ts", "click"), 3600, part=("node",), ts="ts")
    return round_doubles(g.select("node", F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), "click"))


register("w22_regular_grid", with_views("node_seconds") + """
SELECT g.node, epoch(g.ts)::BIGINT AS ts, (floor(CAST(n.click AS DOUBLE) * 1000000.0 + CAST(0.5001 AS DOUBLE)) / 1000000.0) AS click
FROM (SELECT node, unnest(generate_series(min(ts), max(ts), INTERVAL 3600 SECOND)) AS ts
      FROM node_seconds GROUP BY node) g
LEFT JOIN node_seconds n ON n.node = g.node AND n.ts = g.ts""")(w22_regular_grid)


def j03_substring_semi_join(spark, sf_dir):
    return align.sensors_of_nodes(tv.sensor_paths(spark, sf_dir), tv.node_list(spark, sf_dir)).select("path")


_PATHS_SQL = """paths AS (SELECT DISTINCT printf('/site/rack/chassis/n%05d/%s', user_id, event_type) AS path FROM events),
nodes AS (SELECT DISTINCT printf('n%05d', user_id) AS node FROM events WHERE user_id % 2 = 0)
"""
register("j03_substring_semi_join", "WITH " + _PATHS_SQL + """SELECT path FROM paths p
WHERE EXISTS (SELECT 1 FROM nodes n WHERE contains(replace(p.path, '/', ''), n.node))""")(j03_substring_semi_join)


def p01_sensors_in_node_list(spark, sf_dir):
    return align.sensors_of_nodes(tv.sensor_paths(spark, sf_dir), tv.node_list(spark, sf_dir)) \
        .select("path")


register("p01_sensors_in_node_list", ORACLES["j03_substring_semi_join"])(p01_sensors_in_node_list)


# second batch (profiling, sampling, metrics, comparison) registers into the same dicts
from faultlens import queries_ops  # noqa: E402,F401
from faultlens import queries_ml  # noqa: E402,F401
