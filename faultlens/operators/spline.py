"""Natural cubic splines through the known values of a column (W16 with order 3).

The second derivatives at the known points solve one tridiagonal system per node.
It is cut into chunks of known points, each with ``HALO`` points of its neighbours
on both sides, and a chunk solves its own part. What a chunk assumes beyond its halo
loses at least half of its influence per point (the system's off-diagonal entries
are at most half of its diagonal together), so after 64 points it is below the last
bit of a double: chunk borders don't show, and a node of any size is many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.functions.shipping import ship_by_value
from faultlens.operators.keys import join_same
from faultlens.operators.positions import add_positions

ship_by_value("faultlens.operators.spline")

CHUNK_POINTS, HALO = 16_384, 64


def second_derivatives(x: Sequence[float], y: Sequence[float]) -> list[float]:
    """Of the natural spline through the points, at the points."""
    n = len(x)
    m, upper, right = [0.0] * n, [0.0] * n, [0.0] * n
    for i in range(1, n - 1):
        a, b = x[i] - x[i - 1], x[i + 1] - x[i]
        pivot = 2 * (a + b) - a * upper[i - 1]
        upper[i] = b / pivot
        right[i] = (6 * ((y[i + 1] - y[i]) / b - (y[i] - y[i - 1]) / a) - a * right[i - 1]) / pivot
    for i in range(n - 2, 0, -1):
        m[i] = right[i] - upper[i] * m[i + 1]
    return m


def _solved(points: pa.Table) -> pa.Table:
    points = points.sort_by("_k")
    m = second_derivatives(points.column("_x").to_pylist(), points.column("_y").to_pylist())
    own = points.column("_own")
    return points.append_column("_m", pa.array(m, pa.float64())).filter(own).drop_columns(["_own", "_chunk", "_k", "_y"])


def with_curvature(df: DataFrame, cols: Sequence[str], part: Sequence[str], pos: str, chunk_points: int | None = None) -> DataFrame:
    """``df`` with every column of ``cols`` as a struct ``(v, m)``: its value and the
    spline's second derivative there; NULL where the value is."""
    size = chunk_points or CHUNK_POINTS
    cells = F.posexplode(F.array(*(F.col(f"`{c}`").cast("double") for c in cols))).alias("_c", "_y")
    points = df.select(*part, F.col(pos).cast("double").alias("_x"), cells).where(F.col("_y").isNotNull() & ~F.isnan("_y"))
    points = add_positions(points, [*part, "_c"], ["_x"], "_k")
    home = F.floor((F.col("_k") - 1) / size).cast("long")
    at = (F.col("_k") - 1) % size
    near = F.array_compact(F.array(home, F.when(at < HALO, home - 1), F.when(at >= size - HALO, home + 1)))
    points = points.select("*", home.alias("_home"), F.explode(near).alias("_chunk")).where("_chunk >= 0")
    points = points.withColumn("_own", F.col("_home") == F.col("_chunk")).drop("_home")
    schema = points.drop("_own", "_chunk", "_k", "_y").schema.add("_m", "double")
    solved = points.groupBy(*part, "_c", "_chunk").applyInArrow(_solved, schema)
    wide = solved.groupBy(*part, "_x").agg(*(F.max(F.when(F.col("_c") == i, F.col("_m"))).alias(f"_m_{i}") for i in range(len(cols))))
    x = join_same(df.withColumn("_x", F.col(pos).cast("double")), wide, [*part, "_x"], "left")
    pairs = {c: F.when(F.col(f"`{c}`").isNotNull(), F.struct(F.col(f"`{c}`").cast("double").alias("v"), F.coalesce(f"_m_{i}", F.lit(0.0)).alias("m")))
             for i, c in enumerate(cols)}
    return x.select(*(pairs[c].alias(c) if c in pairs else F.col(f"`{c}`") for c in df.columns))
