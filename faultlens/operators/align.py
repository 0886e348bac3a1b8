"""Ingest alignment: per-second means, counter deltas, pivot to one time axis,
gap fills and regular grids (SURVEY 2.3 J1-J3, 2.4 A1, 2.5 W13-W17, W22).

Canonical form is long ``(node, metric, ts, value)``; the wide node table is a
grouped aggregation at the edge. Windows run over chunks of a node or a series,
with what lies beyond a chunk carried over; none runs over a whole node.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens.constants import LABEL_COLUMNS
from faultlens.functions.scalar import floor_second, strip_slashes
from faultlens.operators.keys import join_same
from faultlens.operators.positions import CHUNK_COL, HALO_COL, add_positions, chunked
from faultlens.operators.spline import with_curvature

#: Positions of a node, or of a series, that one task sorts.
CHUNK_ROWS = 1_000_000


# A1 -------------------------------------------------------------------------
def second_means(readings: DataFrame, keys: Sequence[str] = ("node", "metric"),
                 ts: str = "ts", value: str = "value") -> DataFrame:
    """Duplicate readings inside one second -> their mean (partial agg map-side)."""
    return (readings.withColumn(ts, floor_second(ts))
            .groupBy(*keys, ts).agg(F.avg(value).alias(value)))


# J1 -------------------------------------------------------------------------
def pivot_metrics(long_df: DataFrame, metrics: Sequence[str], keys=("node", "ts"),
                  metric: str = "metric", value: str = "value",
                  extra_aggs: Sequence[Column] = ()) -> DataFrame:
    """Full-outer alignment of many series on ``keys``: ONE groupBy + pivot.

    The metric list is passed explicitly, so there is no distinct-values job;
    the means and ``extra_aggs`` (e.g. label columns) come from the same scan
    and the same aggregation. NULL keys form one row like any other key.
    """
    means = [F.avg(F.when(F.col(metric) == m, F.col(value))).alias(m) for m in metrics]
    return long_df.groupBy(*keys).agg(*means, *extra_aggs)


def outer_align(left: DataFrame, right: DataFrame, keys=("node", "ts")) -> DataFrame:
    """Two-table full outer join on the time key (J1, public two-input variant).
    Keys without a value on the other side, NULL keys among them, keep their rows."""
    return left.join(right, on=list(keys), how="full_outer")


# J3 / P1 --------------------------------------------------------------------
def sensors_of_nodes(sensors: DataFrame, nodes: DataFrame, path: str = "path",
                     node: str = "node") -> DataFrame:
    """Sensors whose path, with '/' removed, contains a node id (substring semi join).

    Exact substring semantics as an *equi* join: for each distinct node-id
    length L, every length-L substring of the stripped path is a candidate key,
    joined to the node list on equality. Cost grows with path length, not
    with sensors x nodes; no nested-loop join.
    """
    lengths = [r[0] for r in nodes.select(F.length(node).alias("L")).distinct().collect()]
    s = sensors.withColumn("_stripped", strip_slashes(path))
    parts = []
    for L in sorted(x for x in lengths if x and x > 0):
        starts = F.sequence(F.lit(1), F.greatest(F.length("_stripped") - F.lit(L) + 1, F.lit(0)))
        cand = (s.select(F.col(path).alias("_p"),
                         F.explode_outer(starts).alias("_i"), "_stripped")
                .where(F.col("_i") >= 1)
                .select("_p", F.substring("_stripped", F.col("_i"), F.lit(L)).alias("_sub")))
        parts.append(cand)
    if not parts:
        return sensors.limit(0)
    cand = parts[0]
    for p in parts[1:]:
        cand = cand.unionByName(p)
    hits = cand.join(nodes.select(F.col(node).alias("_sub")).distinct(), on="_sub",
                     how="left_semi").select(F.col("_p").alias(path)).distinct()
    return sensors.join(hits, on=path, how="left_semi")


# W13 ------------------------------------------------------------------------
def first_difference(df: DataFrame, value: str, part=("node", "metric"), order=("ts",),
                     out: str | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """value - previous value per series (NULL on the first row).

    Series are cut into chunks of ``chunk_rows`` positions that carry the row
    before them, so a long series is many tasks.
    """
    x = chunked(add_positions(df, list(part), list(order), "_pos"), "_pos", 2, chunk_rows)
    w = Window.partitionBy(*part, CHUNK_COL).orderBy("_pos")
    x = x.withColumn("_difference", F.col(value) - F.lag(value).over(w)).where(~F.col(HALO_COL))
    name = out or value
    kept = [c for c in df.columns if c != name]
    return x.select(*kept, F.col("_difference").alias(name)).select(*(df.columns if name in df.columns else [*df.columns, name]))


# W14 ------------------------------------------------------------------------
def monotonic_series(df: DataFrame, value: str = "value", part=("node", "metric"),
                     order=("ts",)) -> DataFrame:
    """Per series: is it non-strictly monotonic (either direction; constants count)?"""
    d = first_difference(df.select(*part, *order, value), value, part, order, out="_d")
    return (d.groupBy(*part)
            .agg(F.min("_d").alias("_mn"), F.max("_d").alias("_mx"))
            .select(*part, (F.coalesce(F.col("_mn") >= 0, F.lit(True))
                            | F.coalesce(F.col("_mx") <= 0, F.lit(True))).alias("monotonic")))


def delta_encode_counters(df: DataFrame, value: str = "value", part=("node", "metric"),
                          order=("ts",), labels: Sequence[str] = tuple(LABEL_COLUMNS)) -> DataFrame:
    """Counters (monotonic series, label metrics excluded) -> first differences,
    every hole filled backward with the next difference (W13 + W14 + W17)."""
    mono = monotonic_series(df, value, part, order)
    if labels:
        mono = mono.withColumn("monotonic", F.col("monotonic") & ~F.coalesce(F.col(part[-1]).isin(list(labels)), F.lit(False)))
    d = add_positions(first_difference(df, value, part, order, out="_delta"), list(part), list(order), "_pos")
    d = join_same(fill_backward(d, ["_delta"], part, "_pos"), mono, list(part), "left")
    return d.withColumn(value, F.when(F.col("monotonic"), F.col("_delta")).otherwise(F.col(value))) \
            .drop("_delta", "_pos", "monotonic")


# W15-W17 --------------------------------------------------------------------
def _neighbours(df: DataFrame, cols: Sequence[str], part, pos: str, chunk_rows: int) -> tuple[DataFrame, dict, dict]:
    """Per column the nearest known value at or before a row, and at or after it,
    as ``(pos, value)`` structs: two windows for all columns together.

    The windows run inside chunks of ``chunk_rows`` positions; what lies beyond
    a chunk's ends comes from a table of one row per chunk (its first and last
    known value of every column), so a long node is many tasks.
    """
    part = list(part)
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(pos).alias("p"), F.col(c).alias("v"))) for c in cols}
    x = df.withColumn("_chunk_no", F.floor((F.col(pos) - 1) / F.lit(chunk_rows)).cast("long"))
    ends = x.groupBy(*part, "_chunk_no").agg(*[F.max(known[c]).alias(f"_l_{i}") for i, c in enumerate(cols)],
                                             *[F.min(known[c]).alias(f"_f_{i}") for i, c in enumerate(cols)])
    fwd = Window.partitionBy(*part).orderBy("_chunk_no").rowsBetween(Window.unboundedPreceding, -1)
    bwd = Window.partitionBy(*part).orderBy(F.col("_chunk_no").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*[F.col(c).alias(f"_of_{c}") for c in part], F.col("_chunk_no").alias("_of_chunk"),
                       *[F.max(f"_l_{i}").over(fwd).alias(f"_cl_{i}") for i in range(len(cols))],
                       *[F.min(f"_f_{i}").over(bwd).alias(f"_cf_{i}") for i in range(len(cols))])
    up = Window.partitionBy(*part, "_chunk_no").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*part, "_chunk_no").orderBy(F.col(pos).desc()).rowsBetween(Window.unboundedPreceding, 0)
    x = x.select("*", *[F.last(known[c], ignorenulls=True).over(up).alias(f"_u_{i}") for i, c in enumerate(cols)])
    x = x.select("*", *[F.last(known[c], ignorenulls=True).over(down).alias(f"_d_{i}") for i, c in enumerate(cols)])
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in part] + [F.col("_chunk_no") == F.col("_of_chunk")]
    x = x.join(ends, same)
    # columns of their own: formulas that name them many times stay small enough to be compiled
    x = x.select(*[F.col(f"`{c}`") for c in df.columns], *[F.coalesce(F.col(f"_u_{i}"), F.col(f"_cl_{i}")).alias(f"_before_{i}") for i in range(len(cols))],
                 *[F.coalesce(F.col(f"_d_{i}"), F.col(f"_cf_{i}")).alias(f"_after_{i}") for i in range(len(cols))])
    before = {c: F.col(f"_before_{i}") for i, c in enumerate(cols)}
    after = {c: F.col(f"_after_{i}") for i, c in enumerate(cols)}
    return x, before, after


def fill_table(df: DataFrame, steps: Sequence[str] = (), lines: Sequence[str] = (), holds: Sequence[str] = (),
               part=("node",), pos: str = "pos", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """All fills of a table in one plan of two windows.

    ``steps``: forward, then backward fill (W15). ``lines``: linear
    interpolation by position, trailing holes repeat the last value, leading
    holes take the first (W16 + W17). ``holds``: backward fill alone (W17).
    A column without any value stays NULL.
    """
    x, before, after = _neighbours(df, [*steps, *lines, *holds], part, pos, chunk_rows)
    p, filled = F.col(pos), {}
    for c in steps:
        filled[c] = F.coalesce(before[c]["v"], after[c]["v"])
    for c in holds:
        filled[c] = after[c]["v"]
    for c in lines:
        a, b = before[c], after[c]
        line = a["v"] + (b["v"] - a["v"]) * (p - a["p"]) / (b["p"] - a["p"])
        filled[c] = F.when(F.col(c).isNotNull(), F.col(c)).when(a.isNotNull() & b.isNotNull(), line).otherwise(
            F.coalesce(a["v"], b["v"]))
    return x.select(*[filled[c].alias(c) if c in filled else F.col(f"`{c}`") for c in df.columns])


def fill_forward_backward(df: DataFrame, cols: Sequence[str], part=("node",), pos: str = "pos", **options) -> DataFrame:
    """Forward fill, then backward fill of the leading hole."""
    return fill_table(df, steps=cols, part=part, pos=pos, **options)


def fill_linear(df: DataFrame, cols: Sequence[str], part=("node",), pos: str = "pos", **options) -> DataFrame:
    """Linear interpolation by row position, then the ends (W16 + W17)."""
    return fill_table(df, lines=cols, part=part, pos=pos, **options)


def fill_cubic(df: DataFrame, cols: Sequence[str], part=("node",), pos: str = "pos", chunk_rows: int = CHUNK_ROWS,
               chunk_points: int | None = None) -> DataFrame:
    """Natural cubic spline by row position through the known values; holes before
    the first and after the last known value repeat it, as with ``fill_linear``. One
    known value fills all holes, two give a line. Filled columns are doubles."""
    x, before, after = _neighbours(with_curvature(df, cols, list(part), pos, chunk_points), cols, part, pos, chunk_rows)
    filled = {}
    for c in cols:
        a, b = before[c], after[c]
        h = (b["p"] - a["p"]).cast("double")
        s, t = (b["p"] - F.col(pos)) / h, (F.col(pos) - a["p"]) / h
        bend = ((s * s * s - s) * a["v"]["m"] + (t * t * t - t) * b["v"]["m"]) * h * h / 6
        inside = a.isNotNull() & b.isNotNull() & (b["p"] > a["p"])
        filled[c] = F.when(inside, s * a["v"]["v"] + t * b["v"]["v"] + bend).otherwise(F.coalesce(a["v"]["v"], b["v"]["v"]))
    return x.select(*[filled[c].alias(c) if c in filled else F.col(f"`{c}`") for c in df.columns])


def fill_nearest(df: DataFrame, cols: Sequence[str], part=("node",), pos: str = "pos", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The known value nearest by row position, the earlier one halfway."""
    x, before, after = _neighbours(df, cols, part, pos, chunk_rows)
    filled = {}
    for c in cols:
        a, b = before[c], after[c]
        late = b["p"] - F.col(pos) < F.col(pos) - a["p"]
        filled[c] = F.when(a.isNull() | F.coalesce(late, F.lit(False)), b["v"]).otherwise(a["v"])
    return x.select(*[filled[c].alias(c) if c in filled else F.col(f"`{c}`") for c in df.columns])


def interpolate(df: DataFrame, cols: Sequence[str], method: str = "linear", order: int = 3, **options) -> DataFrame:
    """W16 by method name: ``linear``, ``nearest``, ``cubic`` (natural spline), or
    ``spline`` with ``order`` 1 or 3."""
    if method == "spline" and order in (1, 3):
        method = "linear" if order == 1 else "cubic"
    if method not in ("linear", "nearest", "cubic"):
        raise ValueError(f"unknown interpolation {method!r} of order {order}")
    return {"linear": fill_linear, "nearest": fill_nearest, "cubic": fill_cubic}[method](df, cols, **options)


def fill_backward(df: DataFrame, cols: Sequence[str], part=("node",), pos: str = "pos", **options) -> DataFrame:
    """Backward fill only."""
    return fill_table(df, holds=cols, part=part, pos=pos, **options)


# W22 ------------------------------------------------------------------------
def regular_grid(df: DataFrame, freq_seconds: int, part=("node",), ts: str = "ts", block: int = 4096) -> DataFrame:
    """Rows at exact multiples of ``freq`` from each node's first timestamp
    (``asfreq``): rows off the grid are dropped, missing grid points get NULL
    metrics. The grid is generated in blocks of ``block`` points, each a row of
    its own, so no node's whole grid is ever one array."""
    step = int(freq_seconds) * 1_000_000
    t0 = F.unix_micros(F.min(ts).cast("timestamp"))
    points = F.floor((F.unix_micros(F.max(ts).cast("timestamp")) - t0) / F.lit(step)).cast("long")
    bounds = df.groupBy(*part).agg(F.min(ts).alias("_t0"), points.alias("_last"))
    blocks = bounds.select(*part, "_t0", "_last", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_last") / block))).alias("_b"))
    grid = blocks.select(*part, "_t0", F.explode(F.sequence(
        F.col("_b") * block, F.least(F.col("_b") * block + (block - 1), F.col("_last")))).alias("_i"))
    at = F.timestamp_micros(F.unix_micros(F.col("_t0").cast("timestamp")) + F.col("_i") * step)
    grid = grid.select(*part, at.cast(df.schema[ts].dataType).alias(ts))
    return join_same(grid, df, [*part, ts], "left")
