"""faultlens — telemetry fault analytics as Spark DataFrame operators.

Layers:
  sources/    readers and sinks, telemetry views over the driver tables
  functions/  scalar Column expressions (time, names, scaling, distances)
  operators/  DataFrame -> DataFrame operators (align, features, sampling,
              metrics, profiling, comparison tables)
  plans/      multi-stage jobs on pyspark.ml (forests, selection,
              clustering, DTW node choice)
  streaming/  Structured Streaming form of the ingest stage
"""

__version__ = "0.1.0"
