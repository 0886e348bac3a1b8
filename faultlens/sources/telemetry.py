"""Telemetry views derived from the driver's tables (FIXTURES section B).

The studied pipeline reads private HPC telemetry; these views give the same
shapes from the given tables so every operator runs on data that grows with
the scale factor:

* ``readings``      long sensor readings from ``events``
* ``sensor_paths``  slash paths per (node, metric) and a node list
* ``node_seconds``  per-second means pivoted to one column per metric
* ``node_table``    ``node_seconds`` with labels and metrics filled, plus ``pos``
* ``windows_big``   ``lineitem`` as 4-metric series per supplier
* ``cpu_wide``      ``lineitem`` with ``cpuN/m`` columns for horizontal stats
* ``predictions``   (node, y, pred) pairs for the scoring operators
* ``ml_vectors``    labelled vectors of all 64 dimensions from ``embeddings``
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.operators import align
from faultlens.operators.positions import add_positions
from faultlens.session import ensure_checkpoint_dir
from faultlens.sources.tables import table

# The five event types act as metrics, in this order (their codes 0..4).
EVENT_METRICS = ["click", "error", "purchase", "signup", "view"]
# Application codes indexed by k % 6.
APP_CODES = [0, 20, 21, 22, 23, 24]
# Lineitem series used as node metrics.
LINEITEM_METRICS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINEITEM_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey",
                  "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
# Fixed value: components of an embedding.
VECTOR_DIMS = 64
CPU_COLUMNS = {"cpu0/m": "l_quantity", "cpu1/m": "l_extendedprice",
               "cpu2/m": "l_discount", "cpu3/m": "l_tax"}


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``node, node_no, metric, ts, value, event_id, k, fault, app`` from ``events``."""
    e = table(spark, sf_dir, "events",
              ["event_id", "ts", "user_id", "event_type", "value", "props"])
    k = F.get_json_object("props", "$.k").try_cast("int")
    return e.select(
        F.concat(F.lit("N"), F.col("user_id").cast("string")).alias("node"),
        F.col("user_id").alias("node_no"),
        F.col("event_type").alias("metric"),
        "ts", "value", "event_id",
        k.alias("k"),
        (k % 8).alias("fault"),
        F.element_at(F.array(*[F.lit(a) for a in APP_CODES]), (k % 6) + 1).alias("app"),
    )


def sensor_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One slash path per distinct (node, metric): ``/site/rack/chassis/nXXXXX/<metric>``."""
    e = table(spark, sf_dir, "events", ["user_id", "event_type"]).distinct()
    return e.select(
        F.format_string("/site/rack/chassis/n%05d/%s", "user_id", "event_type").alias("path"),
        F.col("user_id"), F.col("event_type"))


def node_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node ids ``nXXXXX`` of the even users."""
    u = table(spark, sf_dir, "events", ["user_id"]).distinct().where(F.col("user_id") % 2 == 0)
    return u.select(F.format_string("n%05d", "user_id").alias("node"))


def node_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-second means (A1) pivoted over the event types (J1); labels per second
    are the largest code seen in that second."""
    r = readings(spark, sf_dir)
    sec = r.withColumn("ts", F.date_trunc("second", "ts"))
    return align.pivot_metrics(sec, EVENT_METRICS, keys=("node", "ts"),
                               extra_aggs=[F.max("fault").alias("fault"),
                                           F.max("app").alias("app")])


def positioned_seconds(spark: SparkSession, sf_dir: str, pos_method: str = "range") -> DataFrame:
    """``node_seconds`` with ``pos``, holes and all, written to the shared folder: sizes,
    positions and the fills that follow read it several times, and the aggregation
    that makes it runs once."""
    ensure_checkpoint_dir(spark)
    ns = node_seconds(spark, sf_dir).checkpoint()
    return add_positions(ns, "node", "ts", method=pos_method).checkpoint()


def node_table(spark: SparkSession, sf_dir: str, pos_method: str = "range") -> DataFrame:
    """``node_seconds`` with ``pos``, labels forward/backward filled (W15) and
    metrics interpolated by position then backward filled (W16, W17)."""
    ns = positioned_seconds(spark, sf_dir, pos_method)
    return align.fill_table(ns, steps=["fault", "app"], lines=EVENT_METRICS)


def windows_big(spark: SparkSession, sf_dir: str, pos_method: str = "range",
                max_group_rows: int = 1_000_000) -> DataFrame:
    """``lineitem`` as series per supplier: ``node, pos, 4 metrics, label``."""
    li = table(spark, sf_dir, "lineitem",
               ["l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", "l_shipdate", *LINEITEM_METRICS])
    li = li.select(F.col("l_suppkey").alias("node"), *LINEITEM_ORDER,
                   (F.col("l_linenumber") - 1).alias("label"))
    li = add_positions(li, "node", LINEITEM_ORDER, method=pos_method, max_group_rows=max_group_rows)
    return li.select("node", "pos", *LINEITEM_METRICS, "label")


def cpu_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` with per-CPU style columns; ``cpu1/m`` is NULL on every 7th order."""
    li = table(spark, sf_dir, "lineitem",
               ["l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", *CPU_COLUMNS.values()])
    cols = []
    for name, src in CPU_COLUMNS.items():
        c = F.col(src).cast("double")
        if name == "cpu1/m":
            c = F.when(F.col("l_orderkey") % 7 != 0, c)
        cols.append(c.alias(name))
    return li.select(F.col("l_suppkey").alias("node"), "l_orderkey", "l_partkey", "l_linenumber",
                     *cols, (F.col("l_quantity") * F.col("l_tax")).alias("power"),
                     (F.col("l_linenumber") - 1).alias("faultLabel"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``node, node_no, event_id, y, pred``: y = event type code, pred wrong on every 7th event."""
    e = table(spark, sf_dir, "events", ["event_id", "user_id", "event_type"])
    y = F.array_position(F.array(*[F.lit(m) for m in EVENT_METRICS]), F.col("event_type")).cast("int") - 1
    return e.select(
        F.concat(F.lit("N"), F.col("user_id").cast("string")).alias("node"),
        F.col("user_id").alias("node_no"), "event_id", y.alias("y"),
        F.when(F.col("event_id") % 7 == 0, (y + 1) % 5).otherwise(y).alias("pred"))


def ml_vectors(spark: SparkSession, sf_dir: str, dims: int = VECTOR_DIMS) -> DataFrame:
    """``vec_id, node, f0..f{dims-1}, label`` from ``embeddings``."""
    e = table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
    return e.select("vec_id", F.concat(F.lit("N"), (F.col("vec_id") % 8).cast("string")).alias("node"),
                    *[F.get("embedding", i).cast("double").alias(f"f{i}") for i in range(dims)],
                    "label")
