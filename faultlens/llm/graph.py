"""Lineage cuts and connected components as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlens.functions.shipping import ship_by_value
from faultlens.session import ensure_checkpoint_dir

# Executors get the worker code of this package with the task.
ship_by_value("faultlens.llm")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder now and read it from there:
    later steps don't repeat the work, and a lost executor loses no part."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Edges to a partition: small graphs are walked by few tasks.
EDGES = 1_000_000


def components(links: DataFrame) -> DataFrame:
    """Connected components of the undirected links ``(a, b)``: ``(node, root)``.

    ``root`` is the smallest node that ``node`` reaches; nodes without links
    are not returned; NULL ends and self links are ignored; no links give no
    rows. Alternating large-star and small-star steps: each keeps at most as
    many edges as there were, halves long paths, and aggregates a hub's
    neighbours to one minimum before any of its rows are joined.
    """
    e = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
            .where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("u") > F.col("v"))).distinct())
    seen = None
    while True:
        state = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1000003)).first()
        if state == seen or not state[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = state
        k = state[0] // EDGES + 1
        e = e.coalesce(k)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.coalesce(2 * k).distinct().coalesce(k))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.coalesce(k).unionByName(low.select("u", F.col("m").alias("v")).coalesce(k)).distinct().coalesce(k))
