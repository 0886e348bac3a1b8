"""Structured Streaming form of the ingest stage (A1 over arriving exports).

The studied pipeline has no stream processor; its ingest is a batch over
exported sensor files. When exports arrive continuously, the same per-second
means are an event-time aggregation: ``window(ts, '1 second')`` grouped by
sensor, with a watermark bounding state. Output rows equal the batch
``align.second_means`` for every second older than the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultlens.functions.scalar import metric_from_path, ns_to_timestamp
from faultlens.sources.readers import SENSOR_SCHEMA


def sensor_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 1000) -> DataFrame:
    """Readings from CSV exports landing in ``path`` (``Sensor, Time ns, Value``)."""
    raw = (spark.readStream.schema(SENSOR_SCHEMA).option("header", True)
           .option("maxFilesPerTrigger", max_files_per_trigger).csv(path))
    return raw.select(F.col("Sensor").alias("sensor"), metric_from_path("Sensor").alias("metric"),
                      ns_to_timestamp("Time").alias("ts"), F.col("Value").alias("value"))


def streaming_second_means(readings: DataFrame, lateness: str = "10 seconds") -> DataFrame:
    """Per (sensor, second) mean with a watermark; append mode emits closed seconds."""
    return (readings.withWatermark("ts", lateness)
            .groupBy("sensor", "metric", F.window("ts", "1 second").alias("w"))
            .agg(F.avg("value").alias("value"))
            .select("sensor", "metric", F.col("w.start").alias("ts"), "value"))


def start_ingest(spark: SparkSession, source: str, sink: str, checkpoint: str, lateness: str = "10 seconds"):
    """Run the streaming ingest into a Parquet table; the checkpoint lives in a
    shared folder so a restarted driver resumes exactly once."""
    q = (streaming_second_means(sensor_stream(spark, source), lateness)
         .writeStream.outputMode("append").format("parquet")
         .option("path", sink).option("checkpointLocation", checkpoint).start())
    return q
