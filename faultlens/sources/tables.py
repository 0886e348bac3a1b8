"""Scans of the driver's parquet tables (S3, S4, S8): one lazy read per table.

Column pruning and predicate pushdown are left to Catalyst: callers select the
columns they need and the parquet scan reads only those (``ReadSchema``).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]

DEFAULT_SF_DIR = "/root/testdata/sf0.01"


def table(spark: SparkSession, sf_dir: str, name: str, columns=None) -> DataFrame:
    """Read one driver table; ``columns`` prunes at the scan."""
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    if columns:
        df = df.select(*columns)
    return df
