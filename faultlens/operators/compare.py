"""Method-comparison tables: melt/union of score tables, run blocks, flags,
cluster renumbering, prototypes and orderings (SURVEY 2.6 K1-K5, U1-U5,
2.5 W18-W21, 2.2 P2-P10, 2.9 L19, 2.3 J6).

Inputs here are score- or node-sized (one row per node, class, method, run),
so single-partition windows (global ``row_number``/``dense_rank``) are only
used on such tables.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultlens.functions.scalar import node_number, truncate_decimals
from faultlens.operators.positions import ranked


# P2 / P3 / P4 / P6 -----------------------------------------------------------
def drop_columns_matching(df: DataFrame, pattern: str = r"cpu[0-9]") -> DataFrame:
    """Drop every column whose name matches ``pattern`` (schema-level, no data pass)."""
    rx = re.compile(pattern)
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not rx.search(c)])


def columns_containing(df: DataFrame, text: str) -> list[str]:
    return [c for c in df.columns if text in c]


def drop_metrics_matching(long_df: DataFrame, pattern: str, metric: str = "metric") -> DataFrame:
    """Long-form twin of ``drop_columns_matching``: a row filter on the metric name."""
    return long_df.where(~F.col(metric).rlike(pattern))


def label_last(df: DataFrame, label_from: str = "faultLabel", label: str = "label",
               drop: Sequence[str] = ()) -> DataFrame:
    """Rename the fault label, drop columns if present, move the label last."""
    out = df.withColumnRenamed(label_from, label) if label_from in df.columns else df
    out = out.drop(*[d for d in drop if d in out.columns])
    return out.select(*[F.col(f"`{c}`") for c in out.columns if c != label], label)


# P7 / P8 / P9 -----------------------------------------------------------------
def run_condition(df: DataFrame, *, faults=None, apps=None, fault_col: str = "fault", app_col: str = "app",
                  node_range: tuple[int, int] | None = None, node: str = "node", node_no: str | None = "node_no") -> Column:
    """What ``select_runs`` asks of a row, for aggregations over all rows."""
    asked = F.lit(True)
    if faults is not None:
        asked = asked & F.col(fault_col).isin(list(faults))
    if apps is not None:
        asked = asked & F.col(app_col).isin(list(apps))
    if node_range is not None:
        key = F.col(node_no) if node_no and node_no in df.columns else node_number(node)
        asked = asked & key.between(*node_range)
    return asked


def select_runs(df: DataFrame, *, faults=None, apps=None, fault_col: str = "fault", app_col: str = "app",
                node_range: tuple[int, int] | None = None, node: str = "node",
                node_no: str | None = "node_no") -> DataFrame:
    """Rows of the chosen fault/app classes and node-number range. With a numeric
    ``node_no`` column the range reaches the parquet scan as a pushed filter."""
    return df.where(run_condition(df, faults=faults, apps=apps, fault_col=fault_col, app_col=app_col,
                                  node_range=node_range, node=node, node_no=node_no))


# P10 -------------------------------------------------------------------------
def truncate_scores(df: DataFrame, cols: Sequence[str], d: int = 2) -> DataFrame:
    out = df
    for c in cols:
        out = out.withColumn(c, truncate_decimals(c, d))
    return out


# U2 / J6 ---------------------------------------------------------------------
def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], var: str = "fault",
         value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), var, value)


def tag_and_union(tables: dict[str, DataFrame], tag: str = "method") -> DataFrame:
    out = None
    for name, t in tables.items():
        t = t.withColumn(tag, F.lit(name))
        out = t if out is None else out.unionByName(t)
    return out


def versus_baseline(scores: DataFrame, baseline: DataFrame, keys: Sequence[str] = ("node", "cls"),
                    value: str = "score") -> DataFrame:
    """Scores and baseline side by side with the difference."""
    b = baseline.select(*keys, F.col(value).alias("baseline"))
    return scores.join(b, on=list(keys), how="full_outer") \
        .withColumn("delta", F.col(value) - F.col("baseline"))


# W19 -------------------------------------------------------------------------
def run_blocks(df: DataFrame, order: Sequence[str], block_rows: int, n_blocks: int = 10,
               col: str = "method") -> DataFrame:
    """Rows in ``order`` cut in blocks of ``block_rows``: r1..r{n_blocks}, rest ``placeholder``."""
    blk = F.floor((F.col("_rn") - 1) / block_rows) + 1
    return ranked(df, order, "_rn").withColumn(col, F.when(blk <= n_blocks, F.concat(F.lit("r"), blk.cast("string")))
                         .otherwise(F.lit("placeholder"))).drop("_rn")


# W20 -------------------------------------------------------------------------
def flag_repeats(df: DataFrame, key: str, order: Sequence[str], col: str = "method",
                 flag: str = "both") -> DataFrame:
    """Second and later occurrences of ``key`` get ``col = flag``."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn(col, F.when(rn > 1, F.lit(flag)).otherwise(F.col(col)))


# W21 -------------------------------------------------------------------------
def renumber_clusters(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Dense renumbering from 1 in string order; ``outlier`` kept."""
    keys = df.select(cluster).where(F.col(cluster) != "outlier").distinct()
    keys = keys.withColumn("_new", F.dense_rank().over(Window.orderBy(F.col(cluster).cast("string"))))
    j = df.join(F.broadcast(keys), on=cluster, how="left")  # one row per cluster
    return j.withColumn(cluster, F.coalesce(F.col("_new").cast("string"), F.col(cluster))).drop("_new")


# W18 -------------------------------------------------------------------------
def prototypes(df: DataFrame, cluster: str = "cluster", distance: str = "distance") -> DataFrame:
    """Rows closest to their cluster centre (ties kept); outliers excluded first."""
    x = df.where(F.col(cluster) != "outlier")
    r = F.rank().over(Window.partitionBy(cluster).orderBy(distance))
    return x.withColumn("_r", r).where(F.col("_r") == 1).drop("_r")


# K1-K5 -----------------------------------------------------------------------
def natural_node_order(df: DataFrame, node: str = "node") -> DataFrame:
    return df.orderBy(node_number(node), node)


def cluster_order_key(cluster: str = "cluster"):
    return F.when(F.col(cluster) == "outlier", F.lit(0)).otherwise(F.col(cluster).try_cast("int"))


def top_n(df: DataFrame, by: str, n: int, tie: str | None = None) -> DataFrame:
    """First n rows by ``by`` descending (top-k is the feature here)."""
    order = [F.desc(by)] + ([F.asc(tie)] if tie else [])
    return df.orderBy(*order).limit(n)


def nonzero_sorted(df: DataFrame, coef: str = "coef", eps: float = 0.0) -> DataFrame:
    return df.where(F.abs(F.col(coef)) > eps).orderBy(F.desc(F.abs(F.col(coef))))


# U3 --------------------------------------------------------------------------
def training_from_blocks(nodes: DataFrame, testing: DataFrame, block: str = "block",
                         node: str = "node") -> DataFrame:
    """Distinct union over blocks of (all nodes minus that block's testing nodes).

    A node is in that union unless every block tests it, so this is a grouped
    count compared with the number of blocks; no blocks x nodes product.
    """
    n_blocks = testing.select(block).distinct().count()  # scalar
    tested = testing.groupBy(node).agg(F.countDistinct(block).alias("_t"))
    j = nodes.select(node).distinct().join(tested, on=node, how="left")
    return j.where(F.coalesce(F.col("_t"), F.lit(0)) < n_blocks).select(node)
