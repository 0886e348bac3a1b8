"""Sliding-window features per node, horizontal per-CPU
statistics (A9) and per-node scaling (F7-F9).

A window is ``w`` consecutive rows of one node (positions ``pos - w + 1 .. pos``),
only full windows are kept, one output row every ``step`` rows:
``pos >= w and (pos - w) % step == 0``; ``window_id = (pos - w) / step``.

All statistics of all metrics share ONE ``WindowSpec`` so Spark plans a single
``Window`` operator; the five percentiles are one ``percentile(v, array)``.
Windows are partitioned by ``(node, chunk)`` with a ``w - 1`` row halo
(``positions.chunked``): a node that holds a third of the data is spread over
many tasks instead of one.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens.constants import PERCENTILES, STATS_6, STATS_11
from faultlens.functions.scalar import quantize
from faultlens.operators.keys import join_same
from faultlens.operators.positions import CHUNK_COL, HALO_COL, chunked

DEFAULT_CHUNK_ROWS = 1_000_000
#: Rows of a chunk of the numpy engine: its windows are copied, w values to a row.
KERNEL_CHUNK_ROWS = 16_384


def stat_names(numfeatures: int) -> list[str]:
    if numfeatures == 6:
        return list(STATS_6)
    if numfeatures == 11:
        return list(STATS_11)
    raise ValueError("numfeatures must be 6 or 11")


def correlation_pairs(metrics: Sequence[str]) -> list[tuple[str, str]]:
    """Unordered pairs a != b, first-listed name first (W8 naming)."""
    return list(itertools.combinations(list(metrics), 2))


def _frame(part: Sequence[str], pos: str, w: int):
    return Window.partitionBy(*part).orderBy(pos).rowsBetween(-(w - 1), 0)


def window_stat_columns(metric: str, W, stats: Sequence[str]) -> list[Column]:
    """Column expressions of the chosen statistics of one metric over frame W."""
    v = F.col(metric)
    cols: list[Column] = []
    pct_names = [s for s in stats if s in PERCENTILES]
    pct = None
    if pct_names:
        pct = F.percentile(v, [PERCENTILES[s] for s in pct_names]).over(W)
    for s in stats:
        name = f"{s}_{metric}"
        if s == "mean":
            e = F.avg(v).over(W)
        elif s == "std":
            e = F.stddev_samp(v).over(W)
        elif s in PERCENTILES:
            e = F.get(pct, pct_names.index(s))
        elif s == "sumdiff":
            e = v - F.first(v).over(W)
        elif s == "last":
            e = v
        elif s == "min":
            e = F.min(v).over(W)
        elif s == "max":
            e = F.max(v).over(W)
        else:
            raise ValueError(f"unknown statistic {s}")
        cols.append(e.cast("double").alias(name))
    return cols


def window_corr(a: str, b: str, W, w: int) -> Column:
    """Rolling Pearson correlation over full windows; a window with a hole in
    either column, or with a constant column, gives 0 (undefined -> 0).

    All three aggregates see the same rows: those with both values.
    ``try_divide`` stands in for ``corr``, which fails on a constant window
    under ANSI mode.
    """
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    r = F.try_divide(F.covar_pop(x, y).over(W), F.stddev_pop(x).over(W) * F.stddev_pop(y).over(W))
    full = F.count(x).over(W) == w
    return F.coalesce(F.when(full, r), F.lit(0.0)).alias(f"corr_{a}_{b}")


def window_label(label: str, W, mode: str = "mode") -> Column:
    """W10 ``mode``: most frequent label, smallest on ties; W9 ``last``: latest
    non-zero label, else 0."""
    if mode == "mode":
        e = F.mode(F.col(label), True).over(W)
    elif mode == "last":
        e = F.coalesce(F.last(F.when(F.col(label) != 0, F.col(label)), ignorenulls=True).over(W),
                       F.lit(0))
    else:
        raise ValueError("label mode must be 'mode' or 'last'")
    return e.cast("int").alias("label")


def window_features(df: DataFrame, metrics: Sequence[str], *, node: Sequence[str] | str = "node",
                    pos: str = "pos", w: int = 60, step: int = 1, numfeatures: int = 11,
                    stats: Sequence[str] | None = None, label: str | None = None,
                    label_mode: str = "mode", corr: bool | Sequence[tuple[str, str]] = False,
                    extra: Sequence[Column] = (), chunk_rows: int | None = DEFAULT_CHUNK_ROWS,
                    keep: Sequence[str] = (), engine: str | None = None, digits: int | None = None) -> DataFrame:
    """Feature vectors of full windows of ``w`` rows, every ``step`` rows.

    Output: node keys, ``pos`` (end row), ``window_id``, ``<stat>_<metric>`` in
    metric-then-statistic order, ``corr_<a>_<b>``, ``label``.
    ``extra`` accepts user window expressions (``F.something(...)`` without
    ``.over``, e.g. a grouped-agg ``pandas_udf``); they are applied over the same frame.
    Engines give the same output: ``moving`` (numpy over many nodes at once, cost per
    row independent of ``w``) and ``native`` (window expressions; the default with
    ``extra`` or ``keep``). ``digits`` rounds statistics and correlations as
    ``quantize`` does; the numpy engine does so in its own arrays, where it costs
    next to nothing (as Spark expressions, fifty columns of it are one method that
    the JVM doesn't compile).
    """
    part = [node] if isinstance(node, str) else list(node)
    stats = list(stats) if stats is not None else stat_names(numfeatures)
    if engine is None:
        engine = "native" if extra or keep else "moving"
    if engine == "moving":
        if extra or keep:
            raise ValueError("extra/keep columns need engine='native'")
        if label and label_mode not in ("mode", "last"):
            raise ValueError("label mode must be 'mode' or 'last'")
        return _moving_features(df, metrics, part, pos, w, step, stats, label, label_mode, corr,
                                min(chunk_rows or KERNEL_CHUNK_ROWS, max(KERNEL_CHUNK_ROWS, 4 * w)), digits)
    if engine != "native":
        raise ValueError("engine must be 'native' or 'moving'")
    src = df
    wpart = list(part)
    if chunk_rows:
        src = chunked(df, pos, w, chunk_rows)
        wpart = part + [CHUNK_COL]
    W = _frame(wpart, pos, w)
    cols: list[Column] = []
    for m in metrics:
        cols.extend(window_stat_columns(m, W, stats))
    pairs = correlation_pairs(metrics) if corr is True else list(corr or [])
    for a, b in pairs:
        cols.append(window_corr(a, b, W, w))
    names = [f"{s}_{m}" for m in metrics for s in stats] + [f"corr_{a}_{b}" for a, b in pairs]
    for e in extra:
        cols.append(e.over(W))
    if label:
        cols.append(window_label(label, W, label_mode))
    keep_cols = [F.col(k) for k in keep]
    out = src.select(*part, F.col(pos), *keep_cols, *cols,
                     *([F.col(HALO_COL)] if chunk_rows else []))
    cond = (F.col(pos) >= w) & (F.pmod(F.col(pos) - w, F.lit(step)) == 0)
    if chunk_rows:
        cond = cond & ~F.col(HALO_COL)
    out = out.where(cond)
    if chunk_rows:
        out = out.drop(HALO_COL)
    if digits is not None:
        out = out.withColumns({c: quantize(F.col(f"`{c}`"), digits) for c in names})
    wid = F.floor((F.col(pos) - w) / F.lit(step)).cast("long").alias("window_id")
    return out.select(*part, pos, wid, *[c for c in out.columns if c not in set(part) | {pos}])


def _moving_features(df, metrics, part, pos, w, step, stats, label, label_mode, corr, chunk_rows, digits) -> DataFrame:
    """Same output as the native plan, many (node, chunk) groups to a numpy call:
    rows meet in their group's partition, sorted, and are read as Arrow batches.
    The number of partitions is given, so that it holds: rows are small and their
    statistics are not, and partitions put together by size leave cores idle."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    from faultlens.operators.moving import window_batches

    pairs = correlation_pairs(metrics) if corr is True else list(corr or [])
    need = list(dict.fromkeys([*metrics, *[x for pr in pairs for x in pr]]))
    src = chunked(df.select(*part, F.col(pos).cast("long").alias(pos), *need, *([label] if label else [])), pos, w, chunk_rows)
    keys = [*part, CHUNK_COL]
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    src = src.repartition(tasks, *keys).sortWithinPartitions(*keys, pos)
    fields = [df.schema[k] for k in part] + [T.StructField(pos, T.LongType()), T.StructField("window_id", T.LongType())]
    for m in metrics:
        fields += [T.StructField(f"{s}_{m}", T.DoubleType()) for s in stats]
    fields += [T.StructField(f"corr_{a}_{b}", T.DoubleType()) for a, b in pairs]
    if label:
        fields.append(T.StructField("label", T.IntegerType()))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    arrow = to_arrow_schema(schema)
    return src.mapInArrow(lambda it: window_batches(
        it, keys=part, chunk=CHUNK_COL, halo=HALO_COL, pos=pos, metrics=list(metrics), stats=list(stats), pairs=pairs, label=label,
        label_mode=label_mode, w=w, step=step, schema=arrow, digits=digits), schema)


def window_features_exploded(df: DataFrame, metrics: Sequence[str], *, node="node", pos: str = "pos",
                             w: int = 60, step: int = 60, stats: Sequence[str] = ("mean", "min", "max"),
                             label: str | None = None) -> DataFrame:
    """Large-step plan (W11, step near w): copy each row into the <= ceil(w/step)
    windows that contain it and aggregate with ``groupBy(node, window_id)``.
    Supports order-free statistics (mean, std, min, max, percentiles) and the
    mode label."""
    part = [node] if isinstance(node, str) else list(node)
    p = F.col(pos)
    lo = F.greatest(F.ceil((p - w) / F.lit(step)), F.lit(0)).cast("long")
    hi = F.floor((p - 1) / F.lit(step)).cast("long")
    n_rows = df.groupBy(*part).agg(F.max(pos).alias("_n"))
    x = join_same(df, n_rows, part).withColumn("_wid", F.explode(F.sequence(lo, F.greatest(lo, hi))))
    x = x.where((F.col("_wid") * step + w <= F.col("_n")) & (F.col("_wid") * step < p)
                & (p <= F.col("_wid") * step + w))
    aggs = []
    for m in metrics:
        for s in stats:
            name = f"{s}_{m}"
            if s == "mean":
                aggs.append(F.avg(m).alias(name))
            elif s == "std":
                aggs.append(F.stddev_samp(m).alias(name))
            elif s == "min":
                aggs.append(F.min(m).alias(name))
            elif s == "max":
                aggs.append(F.max(m).alias(name))
            elif s in PERCENTILES:
                aggs.append(F.percentile(m, PERCENTILES[s]).alias(name))
            elif s == "last":
                aggs.append(F.max_by(m, pos).alias(name))
            elif s == "sumdiff":
                aggs.append((F.max_by(m, pos) - F.min_by(m, pos)).alias(name))
            else:
                raise ValueError(s)
    if label:
        aggs.append(F.mode(F.col(label), True).cast("int").alias("label"))
    out = x.groupBy(*part, F.col("_wid").alias("window_id")).agg(*aggs)
    return out.withColumn(pos, (F.col("window_id") * step + w).cast("long"))


# A9 -------------------------------------------------------------------------
def horizontal_stats(df: DataFrame, members: dict[str, Sequence[str]],
                     stats: Sequence[str] = ("min", "max", "perc25", "perc75", "mean")) -> DataFrame:
    """Per row, statistics across a group of columns (``cpuN/<m>`` -> ``<m>``),
    NULL skipped. ``members`` maps output base name -> member columns.
    Output names follow ``<m>.<stat>`` (e.g. ``instructions.max``)."""
    out = df
    for base, cols in members.items():
        arr = F.array_compact(F.array(*[F.col(f"`{c}`").cast("double") for c in cols]))
        srt = F.array_sort(arr)
        n = F.size(arr)

        def q(p: float) -> Column:
            h = (n - 1) * F.lit(p)
            lo = F.floor(h).cast("int")
            frac = h - lo
            a = F.get(srt, lo)
            b = F.get(srt, F.least(lo + 1, n - 1))
            return F.when(n > 0, a + (b - a) * frac)

        exprs = {
            "min": F.array_min(arr),
            "max": F.array_max(arr),
            "mean": F.when(n > 0, F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x) / n),
            "perc25": q(0.25), "perc75": q(0.75), "median": q(0.5),
        }
        for s in stats:
            out = out.withColumn(f"{base}.{s}", exprs[s])
    return out


def cpu_groups(columns: Sequence[str], pattern: str = r"^cpu[0-9]+/(.+)$") -> dict[str, list[str]]:
    """Group ``cpuN/<m>`` columns by ``<m>`` (schema-level work on the driver)."""
    import re
    groups: dict[str, list[str]] = {}
    rx = re.compile(pattern)
    for c in columns:
        m = rx.match(c)
        if m:
            groups.setdefault(m.group(1), []).append(c)
    return groups


# F7 / F8 / F9 ---------------------------------------------------------------
# Scalers take per-node statistics with a groupBy (partial aggregation, so a
# hot node is pre-aggregated on every map task) and join them back on the node
# key; the statistics table has one row per node, so AQE broadcasts it when small.

def scale_stats(df: DataFrame, cols: Sequence[str], part=("node",)) -> DataFrame:
    """Per-partition min/max/mean/population std as a small table."""
    aggs = []
    for c in cols:
        aggs += [F.min(c).alias(f"{c}__min"), F.max(c).alias(f"{c}__max"),
                 F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std")]
    return df.groupBy(*part).agg(*aggs)


def _scaled(df: DataFrame, cols: Sequence[str], part, fn) -> DataFrame:
    st = scale_stats(df, cols, part)
    j = join_same(df, st, list(part), "left")
    return j.select(*[fn(c).alias(c) if c in set(cols) else F.col(f"`{c}`") for c in df.columns])


def minmax_scale(df: DataFrame, cols: Sequence[str], part=("node",)) -> DataFrame:
    """Per-node min-max scaling; a constant column gives 0, a missing value stays
    missing. Labels untouched (F7)."""
    return _scaled(df, cols, part, lambda c: F.when(F.col(c).isNotNull(), F.coalesce(
        F.try_divide(F.col(c) - F.col(f"{c}__min"), F.col(f"{c}__max") - F.col(f"{c}__min")),
        F.lit(0.0))))


def zscore_scale(df: DataFrame, cols: Sequence[str], part=("node",)) -> DataFrame:
    """Standardisation with the population std per partition; a constant column
    gives 0, a missing value stays missing (F8, F9)."""
    return _scaled(df, cols, part, lambda c: F.when(F.col(c).isNotNull(), F.coalesce(
        F.try_divide(F.col(c) - F.col(f"{c}__mean"), F.col(f"{c}__std")), F.lit(0.0))))
