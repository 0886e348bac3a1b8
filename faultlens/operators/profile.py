"""Profiling tables: counts, distinct values, filtered per-node means, box
statistics, correlation matrices, schema/NULL profile (SURVEY 2.4 A2-A11,
A21-A22, 2.2 P11).

All of them are aggregations: Spark runs a partial aggregate on every map task
before the shuffle, so a key holding a third of the rows costs one partial row
per task, not a third of the data in one task.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens.constants import FAULT_NAMES
from faultlens.operators.keys import join_same
from faultlens.operators.positions import running_totals
from faultlens.session import ensure_checkpoint_dir


def _in(col: str, values) -> Column:
    return F.lit(True) if values is None else F.col(col).isin(list(values))


# A2 -------------------------------------------------------------------------
def value_counts(df: DataFrame, col: str, names: bool = False) -> DataFrame:
    """Count per value, sorted by value; optional class names (fixed 8-row table, broadcast)."""
    out = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    if names:
        dim = df.sparkSession.createDataFrame(list(enumerate(FAULT_NAMES)), [col, "class_name"])
        out = out.join(F.broadcast(dim), on=col, how="left")
    return out.orderBy(col)


# A3 -------------------------------------------------------------------------
def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct().orderBy(col)


# A4 / A6 --------------------------------------------------------------------
def filtered_node_means(df: DataFrame, cols: Sequence[str], *, node: str = "node",
                        faults=None, apps=None, fault_col: str = "fault", app_col: str = "app",
                        agg: str = "mean", group: Sequence[str] = ()) -> DataFrame:
    """Per node (and ``group``), mean (or sum) of ``cols`` over rows of the chosen
    fault and application classes. The filter is *conditional* inside the
    aggregate, so a node without matching rows still yields a row (NULL mean,
    0 sum)."""
    cond = _in(fault_col, faults) & _in(app_col, apps)
    aggs = []
    for c in cols:
        v = F.when(cond, F.col(c))
        aggs.append((F.avg(v) if agg == "mean" else F.coalesce(F.sum(v), F.lit(0.0))).alias(c))
    return df.groupBy(node, *group).agg(*aggs)


# A5 -------------------------------------------------------------------------
def with_halves(df: DataFrame, node: str = "node", pos: str = "pos") -> DataFrame:
    """``half`` = 1 for the first ``floor(n/2)`` rows of a node, else 2 (split before filters).
    ``n`` per node comes from a grouped count joined back (no per-node window)."""
    n = df.groupBy(node).agg(F.count(F.lit(1)).alias("_n"))
    return (join_same(df, n, [node]).withColumn("half", F.when(F.col(pos) <= F.floor(F.col("_n") / 2), 1)
                                           .otherwise(2)).drop("_n"))


def filtered_half_means(df: DataFrame, cols: Sequence[str], *, node="node", pos="pos", faults=None,
                        apps=None, fault_col="fault", app_col="app", agg="mean") -> DataFrame:
    h = with_halves(df, node, pos)
    out = filtered_node_means(h, cols, node=node, faults=faults, apps=apps, fault_col=fault_col,
                              app_col=app_col, agg=agg, group=["half"])
    return out.withColumn("nodename", F.concat(F.col(node).cast("string"), F.lit("_"),
                                               F.col("half").cast("string")))


# A7 -------------------------------------------------------------------------
def mean_std(df: DataFrame, group: Sequence[str], col: str) -> DataFrame:
    return df.groupBy(*group).agg(F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"))


# A8 -------------------------------------------------------------------------
def box_stats(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Box-plot numbers per group: quartiles (linear), whiskers = most extreme
    values within 1.5 IQR of the box, count of points beyond, mean.

    One scan counts each (group, value); everything else comes from these
    counts. They are range-sorted over all tasks and written once with their
    partition, ranks are running sums inside a partition plus the sums of the
    group's earlier partitions, so no task holds a group's values.
    """
    group = list(group)
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    ensure_checkpoint_dir(df.sparkSession)
    counts = counts.repartitionByRange(*group, "_v").select("*", F.spark_partition_id().alias("_p")).checkpoint()

    def joined(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:  # NULL keys meet each other
        named = right.select(*[F.col(k).alias(f"_of_{k}") for k in keys], *[c for c in right.columns if c not in keys])
        return left.join(named, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]).drop(*[f"_of_{k}" for k in keys])

    before = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.groupBy(*group, "_p").agg(F.sum("_c").alias("_pc")).select(
        *group, "_p", F.coalesce(F.sum("_pc").over(before), F.lit(0)).alias("_off"))
    totals = counts.groupBy(*group).agg(F.sum("_c").alias("n"), F.sum(F.col("_v") * F.col("_c")).alias("_sum"))
    inside = Window.partitionBy(*group, "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = joined(counts.withColumn("_upto", F.sum("_c").over(inside)), parts, *group, "_p").withColumn(
        "_upto", F.col("_upto") + F.col("_off"))
    ranked = joined(ranked, totals, *group)

    def at(p: float, up: int) -> Column:  # value of the row at floor((n - 1) p) + up, 0-based
        i = F.least(F.floor((F.col("n") - 1) * p) + up, F.col("n") - 1)
        return F.max(F.when((F.col("_upto") - F.col("_c") <= i) & (i < F.col("_upto")), F.col("_v")))

    ps = (0.25, 0.5, 0.75)
    q = ranked.groupBy(*group).agg(*[at(p, up).alias(f"_{k}{up}") for k, p in enumerate(ps) for up in (0, 1)],
                                   F.max("n").alias("n"), (F.max("_sum") / F.max("n")).alias("mean"))

    def line(k: int) -> Column:
        h = (F.col("n") - 1) * ps[k]
        return F.col(f"_{k}0") + (F.col(f"_{k}1") - F.col(f"_{k}0")) * (h - F.floor(h))

    q = q.select(*group, line(0).alias("q1"), line(1).alias("median"), line(2).alias("q3"), "mean", "n")
    spread = 1.5 * (F.col("q3") - F.col("q1"))
    box = joined(counts, q.select(*group, (F.col("q1") - spread).alias("_lo"), (F.col("q3") + spread).alias("_hi")), *group)
    v = F.col("_v")
    w = box.groupBy(*group).agg(
        F.min(F.when(v >= F.col("_lo"), v)).alias("whisker_low"), F.max(F.when(v <= F.col("_hi"), v)).alias("whisker_high"),
        F.sum(F.when((v < F.col("_lo")) | (v > F.col("_hi")), F.col("_c")).otherwise(0)).alias("n_outliers"))
    return joined(q, w, *group)


# A10 ------------------------------------------------------------------------
def pearson(a: str, b: str) -> Column:
    """Pearson correlation as an aggregate over the rows that have both values;
    NULL when a column is constant there (ANSI safe)."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Long ``(a, b, corr)`` for every ordered pair (diagonal = 1) in one pass."""
    pairs = list(itertools.combinations(cols, 2))
    row = df.agg(*[pearson(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    stack = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{i}").alias("corr"))
             for i, (a, b) in enumerate(pairs)]
    stack += [F.struct(F.lit(b).alias("a"), F.lit(a).alias("b"), F.col(f"{i}").alias("corr"))
              for i, (a, b) in enumerate(pairs)]
    stack += [F.struct(F.lit(c).alias("a"), F.lit(c).alias("b"), F.lit(1.0).alias("corr")) for c in cols]
    return row.select(F.explode(F.array(*stack)).alias("s")).select("s.*")


# A11 ------------------------------------------------------------------------
def target_correlation(df: DataFrame, cols: Sequence[str], target: str = "label") -> DataFrame:
    """``|corr(c, target)|`` per column, sorted descending."""
    row = df.agg(*[F.abs(pearson(c, target)).alias(f"{i}") for i, c in enumerate(cols)])
    st = [F.struct(F.lit(c).alias("feature"), F.col(f"{i}").alias("abs_corr")) for i, c in enumerate(cols)]
    return row.select(F.explode(F.array(*st)).alias("s")).select("s.*") \
        .orderBy(F.desc_nulls_last("abs_corr"), "feature")


# P11 ------------------------------------------------------------------------
def null_profile(df: DataFrame) -> DataFrame:
    """``(column, dtype, non_null, nulls)`` for every column, one scan."""
    fields = df.schema.fields
    row = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count(F.col(f"`{f.name}`")).alias(f"c{i}") for i, f in enumerate(fields)])
    st = [F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"),
                   F.col(f"c{i}").alias("non_null"), (F.col("_rows") - F.col(f"c{i}")).alias("nulls"))
          for i, f in enumerate(fields)]
    return row.select(F.explode(F.array(*st)).alias("s")).select("s.*")


# A22 ------------------------------------------------------------------------
def node_row_ranges(df: DataFrame, node: str = "node", order: str = "node_no") -> DataFrame:
    """Row-index range of each node inside the concatenation of all nodes in
    ``order``: ``start = sum of earlier node sizes``, ``end = start + n - 1``.
    The per-node counts are range-sorted and summed up over all tasks."""
    n = df.groupBy(node, order).agg(F.count(F.lit(1)).alias("n"))
    return running_totals(n, [order, node], "n", "start").withColumn("end", F.col("start") + F.col("n") - 1)


def fold_ranges(df: DataFrame, group: Sequence[str], fold: str = "fold", pos: str = "pos") -> DataFrame:
    return df.groupBy(*group, fold).agg(F.min(pos).alias("first_pos"), F.max(pos).alias("last_pos"),
                                        F.count(F.lit(1)).alias("n"))
