"""Ordered feature lists.

File format: one header line, then ``---- name`` (plain) or
``---- name: importance`` (ranked); the dashes may be missing. A list has a handful to a few hundred
names, so reading it returns Python names; the writer takes a rank table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultlens.constants import MSG_EMPTY, MSG_MISSING, MSG_N_TOO_LOW

FORMATS = ("plain", "ranked")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def feature_table(spark: SparkSession, path: str, fmt: str = "plain") -> DataFrame:
    """``(rank, feature, importance)``; the header line is dropped by position."""
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    if not _exists(spark, path):
        raise OSError(MSG_MISSING.format(path=path))
    lines = spark.read.text(path).withColumn("_i", F.monotonically_increasing_id())
    # a feature list is a few hundred lines: one ordered window over it is fine
    lines = lines.withColumn("_line", F.row_number().over(Window.orderBy("_i")))
    body = lines.where(F.col("_line") > 1)
    name = F.trim(F.regexp_replace("value", "---- ", ""))
    imp = F.lit(None).cast("double")
    if fmt == "ranked":
        imp = F.trim(F.regexp_extract(name, ":(.*)$", 1)).try_cast("double")
        name = F.trim(F.regexp_replace(name, ":.*$", ""))
    return body.select((F.col("_line") - 1).alias("rank"), name.alias("feature"), imp.alias("importance"))


class FeatureReader:
    """File facade with the studied error texts; ``fmt`` is the strategy."""

    def __init__(self, spark: SparkSession, path: str, fmt: str = "plain"):
        self.spark, self.path, self.fmt = spark, path, fmt

    def _names(self) -> list[str]:
        if not _exists(self.spark, self.path):
            raise OSError(MSG_MISSING.format(path=self.path))
        t = feature_table(self.spark, self.path, self.fmt)
        names = [r["feature"] for r in t.orderBy("rank").collect()]  # the list itself is the result
        if not names and self.spark.read.text(self.path).count() == 0:
            raise ValueError(MSG_EMPTY.format(path=self.path))
        return names

    def get_features(self) -> list[str]:
        return self._names()

    def get_n_features(self, n: int) -> list[str]:
        if n < 1:
            raise ValueError(MSG_N_TOO_LOW.format(n=n))
        return self._names()[:n]


def write_feature_list(ranks: DataFrame, path: str, header: str, fmt: str = "plain") -> None:
    """S9/S10 writer: ``ranks(feature, importance, rank)`` -> one text file."""
    line = F.concat(F.lit("---- "), F.col("feature"))
    if fmt == "ranked":
        line = F.concat(line, F.lit(": "), F.col("importance").cast("string"))
    body = ranks.select(F.lit(1).alias("_o"), F.col("rank").cast("int").alias("_r"), line.alias("value"))
    hdr = ranks.sparkSession.createDataFrame([(0, 0, header)], "_o int, _r int, value string")
    out = hdr.unionByName(body)
    out.coalesce(1).sortWithinPartitions("_o", "_r").select("value").write.mode("overwrite").text(path)

