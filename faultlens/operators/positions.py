"""Row positions per node (W12) and split-safe sliding-frame partitions.

Row order is meaningful everywhere in the studied pipeline: windows, splits,
steps and halves all count rows. ``add_positions`` gives ``pos`` = 1..n per
node, ordered by a unique key.

Two plans with the same numbers:

* ``method="window"``: ``row_number()`` over ``partitionBy(node)``. One shuffle,
  but a node is one task.
* ``method="range"`` (default): nodes up to ``max_group_rows`` rows are numbered
  that way; the rows of larger nodes are range-sorted together by node and full
  order key, written once to the checkpoint folder with their place in the sort
  partition, and shifted by a prefix sum over the (node, partition) counts. No
  task holds more of a node than its share of the sort, ties on the first order
  column included.

``chunked`` then cuts every node into chunks of ``chunk_rows`` positions and
copies the last ``w - 1`` rows of each chunk into the next one (a halo), so a
``rowsBetween(-(w-1), 0)`` frame never crosses a chunk and windows can be
partitioned by ``(node, chunk)`` instead of ``node``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_COL = "_chunk"
HALO_COL = "_halo"


def _cols(xs) -> list:
    return [xs] if isinstance(xs, (str, Column)) else list(xs)


def add_positions(df: DataFrame, part_cols, order_cols, pos_col: str = "pos",
                  method: str = "range", max_group_rows: int = 1_000_000) -> DataFrame:
    """Add ``pos`` (long, 1-based) per ``part_cols`` ordered by ``order_cols``.

    ``order_cols`` must make rows unique inside a partition key; with ties the
    numbering is arbitrary among tied rows. A NULL key is a group of its own.
    """
    part, order = _cols(part_cols), _cols(order_cols)
    w = Window.partitionBy(*part).orderBy(*order)
    numbered = F.row_number().over(w).cast("long")
    if method == "window":
        return df.withColumn(pos_col, numbered)
    if method != "range":
        raise ValueError(f"unknown method {method!r}")
    if not all(isinstance(c, str) for c in part + order):
        raise ValueError("range positions need named columns")
    sizes = df.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    hot = sizes.where(F.col("_n") > max_group_rows).select(*[F.col(c).alias(f"_hot_{c}") for c in part])
    if hot.isEmpty():
        return df.withColumn(pos_col, numbered)
    same = [F.col(c).eqNullSafe(F.col(f"_hot_{c}")) for c in part]
    small = df.join(hot, same, "left_anti").withColumn(pos_col, numbered)
    return small.unionByName(_sorted_positions(df.join(hot, same, "left_semi"), part, order, pos_col))


def _sorted_positions(df: DataFrame, part: list[str], order: list[str], pos_col: str) -> DataFrame:
    """Positions of large groups: place in a range-sorted partition plus the
    group's rows in earlier partitions. The sorted rows are checkpointed, so
    both uses and every retried task see the same partitions."""
    in_partition = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = df.repartitionByRange(*part, *order).sortWithinPartitions(*part, *order).select(
        "*", F.spark_partition_id().alias("_p"), in_partition.alias("_i")).checkpoint()
    before = Window.partitionBy(*part).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*part, "_p").agg(F.min("_i").alias("_lo"), F.count(F.lit(1)).alias("_c")).withColumn(
        "_off", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    parts = parts.select(*[F.col(c).alias(f"_of_{c}") for c in part], F.col("_p").alias("_of_p"), "_lo", "_off")
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in part] + [F.col("_p") == F.col("_of_p")]
    return rows.join(parts, same).select(*df.columns, (F.col("_off") + F.col("_i") - F.col("_lo") + 1).alias(pos_col))


def running_totals(df: DataFrame, order_cols, value: str, out: str) -> DataFrame:
    """``out``: the sum of ``value`` over all rows before a row in ``order_cols``,
    which make rows unique. The rows are range-sorted over all tasks and written
    once; the totals of earlier tasks are a table of one row per task."""
    order = _cols(order_cols)
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_i")).checkpoint()
    earlier = Window.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(value).over(earlier.partitionBy("_p").orderBy("_i")), F.lit(0))
    tasks = rows.groupBy(F.col("_p").alias("_of_p")).agg(F.sum(value).alias("_t"))
    tasks = tasks.select("_of_p", F.coalesce(F.sum("_t").over(earlier.orderBy("_of_p")), F.lit(0)).alias("_off"))
    done = rows.withColumn("_in", inside).join(F.broadcast(tasks), F.col("_p") == F.col("_of_p"))  # one row per task
    return done.select(*df.columns, (F.col("_off") + F.col("_in")).alias(out))


def ranked(df: DataFrame, order_cols, pos_col: str = "pos") -> DataFrame:
    """Positions 1, 2, ... of all rows in ``order_cols`` without one task for all."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    return running_totals(one, order_cols, "_one", pos_col).withColumn(pos_col, F.col(pos_col) + 1).drop("_one")


def chunked(df: DataFrame, pos_col: str, w: int, chunk_rows: int) -> DataFrame:
    """Assign ``_chunk`` and copy each chunk's last ``w-1`` rows into the next as halo rows."""
    if chunk_rows < max(w - 1, 1):
        raise ValueError("chunk_rows must be at least w - 1")
    p = F.col(pos_col) - 1
    c = F.floor(p / F.lit(chunk_rows)).cast("long")
    r = F.pmod(p, F.lit(chunk_rows))
    halo_from = chunk_rows - (w - 1)
    chunks = F.when(F.lit(w > 1) & (r >= F.lit(halo_from)), F.array(c, c + 1)).otherwise(F.array(c))
    out = df.withColumn("_own", c).withColumn(CHUNK_COL, F.explode(chunks))
    return out.withColumn(HALO_COL, F.col(CHUNK_COL) != F.col("_own")).drop("_own")
