"""Readers for exported telemetry and node tables.

All reads declare their schema (no inference pass) and leave filters to
Catalyst, so time ranges and sensor lists are pushed into the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.functions.scalar import metric_from_path, ns_to_timestamp

# The exported reading layout (one sensor per file).
SENSOR_SCHEMA = "Sensor string, Time long, Value double"


def read_sensor_exports(spark: SparkSession, path: str | Sequence[str], *, t0_ns: int | None = None,
                        t1_ns: int | None = None, sensors: DataFrame | None = None) -> DataFrame:
    """S1 + S2: exported readings ``Sensor, Time (epoch ns), Value`` -> long
    readings ``sensor, metric, ts, value`` restricted to ``[t0, t1]`` and to the
    sensors of ``sensors`` (semi join). Parallelism = file splits."""
    df = spark.read.schema(SENSOR_SCHEMA).option("header", True).csv(path)
    if t0_ns is not None:
        df = df.where(F.col("Time") >= t0_ns)
    if t1_ns is not None:
        df = df.where(F.col("Time") <= t1_ns)
    if sensors is not None:
        df = df.join(sensors.select(F.col(sensors.columns[0]).alias("Sensor")).distinct(), "Sensor", "left_semi")
    return df.select(F.col("Sensor").alias("sensor"), metric_from_path("Sensor").alias("metric"),
                     ns_to_timestamp("Time").alias("ts"), F.col("Value").alias("value"))


def read_node_tables(spark: SparkSession, path: str | Sequence[str], schema: str | None = None,
                     fmt: str = "csv", columns: Sequence[str] | None = None, node_pattern: str = r"([^/]+)\.\w+$",
                     ts_col: str = "Time") -> DataFrame:
    """S3 + S4 + S7 + S8: all node files of a folder in one read; the node name is
    the file stem (``_metadata.file_name``); optional column pruning."""
    r = spark.read.format(fmt).option("recursiveFileLookup", True)
    if fmt == "csv":
        r = r.option("header", True)
        r = r.schema(schema) if schema else r.option("inferSchema", True)
    df = r.load(path)
    node = F.regexp_extract(F.col("_metadata.file_path"), node_pattern, 1)
    cols = [F.col(f"`{c}`") for c in (columns or df.columns)]
    out = df.select(node.alias("node"), *cols)
    if ts_col in out.columns:
        out = out.withColumn(ts_col, F.col(ts_col).cast("timestamp"))
    return out


def positional_range(df: DataFrame, start: int, n: int, pos: str = "pos") -> DataFrame:
    """Rows ``start .. start+n-1`` (1-based) of every node. With ``pos`` stored
    in Parquet, min/max statistics prune row groups."""
    return df.where(F.col(pos).between(start, start + n - 1))


def systematic_sample(df: DataFrame, step: int, pos: str = "pos") -> DataFrame:
    """Rows 1, 1+step, 1+2*step, ... of every node."""
    return df.where(F.pmod(F.col(pos) - 1, F.lit(step)) == 0)


def read_training_nodes(spark: SparkSession, path: str, column: str = "nodename") -> DataFrame:
    """Chosen training nodes (CSV with a header); a small table, broadcast by joins."""
    df = spark.read.option("header", True).csv(path)
    return df.select(F.col(column).alias("node")).distinct()
