"""Sinks for node tables, feature tables and score tables.

Writes go through the DataFrame writer (task-parallel, atomic commit per job).
Score tables are long ``(run, num_train, method, node, metric, cls, score)``;
append mode adds one run at a time, partitioned by metric.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Node / feature / score table with header (CSV) or Parquet. With very many
    folders, ``df`` should be ``dealt`` by ``partition_by``, so that a folder has one file;
    tasks move their own files there (version 2 of the committer), not the driver all."""
    w = df.write.mode(mode).format(fmt)
    if partition_by and mode == "overwrite":
        w = w.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def dealt(df: DataFrame, by: list[str]) -> DataFrame:
    """``df`` with the rows of a folder in one task, over several tasks to a core: opening
    files takes the time, however few bytes there are, so partitions are not merged."""
    spark = df.sparkSession
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks, *by)


def append_scores(scores: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append a run's long score table, partitioned by metric."""
    write_table(scores, path, fmt=fmt, mode="append", partition_by=["metric"])


def with_run_tags(scores: DataFrame, num_train: int, num_iter: int | None = None) -> DataFrame:
    """Tag one class's scores with ``num_train`` (and ``num_iter``)."""
    out = scores.withColumn("num_train", F.lit(int(num_train)))
    if num_iter is not None:
        out = out.withColumn("num_iter", F.lit(int(num_iter)))
    return out


def write_run_config(spark: SparkSession, path: str, **params) -> None:
    """The parameters of a run as one JSON row next to its results."""
    row = spark.createDataFrame([(json.dumps(params, sort_keys=True, default=str),)], "config string")
    row.coalesce(1).write.mode("overwrite").text(path)


def read_run_config(spark: SparkSession, path: str) -> dict:
    """The parameters that ``write_run_config`` left; one row."""
    return json.loads(spark.read.text(path).first()["value"])
