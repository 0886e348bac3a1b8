import os
import tempfile

from pyspark.sql import functions as F

from faultlens.operators import align
from faultlens.streaming.ingest import sensor_stream, streaming_second_means


def test_streaming_second_means_match_batch(spark):
    d = tempfile.mkdtemp(prefix="fl-stream-")
    src = os.path.join(d, "in")
    rows = []
    for s in range(20):
        for k in range(3):
            rows.append(("/a/b/c/n00001/cpu0/instructions", (1_700_000_000 + s) * 10**9 + k * 10**8, float(s * 3 + k)))
    spark.createDataFrame(rows, "Sensor string, Time long, Value double").coalesce(1) \
        .write.option("header", True).csv(src)
    q = (streaming_second_means(sensor_stream(spark, src), "0 seconds").writeStream
         .format("memory").queryName("fl_sec").outputMode("append")
         .option("checkpointLocation", os.path.join(d, "ck")).start())
    q.processAllAvailable()
    q.stop()
    got = spark.table("fl_sec")
    assert got.select("metric").distinct().first()[0] == "cpu0/instructions"
    batch = align.second_means(spark.createDataFrame(rows, "sensor string, t long, value double")
                               .withColumn("ts", F.timestamp_seconds(F.col("t") / 10**9)).drop("t"),
                               keys=("sensor",))
    # every emitted second equals the batch mean of that second
    j = got.join(batch.withColumnRenamed("value", "b"), ["sensor", "ts"])
    assert j.count() == got.count() > 0
    assert j.where(F.abs(F.col("value") - F.col("b")) > 1e-9).count() == 0
